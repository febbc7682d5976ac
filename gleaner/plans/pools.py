"""Queries over pools, selections and document aggregation."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import hashing, text, urls
from gleaner.operators import aggregate, fuse, pool, retrieve, select
from gleaner.plans.registry import CHUNKS, HITS, query
from gleaner.plans.retrieval import _DOCS, chunks, hits
from gleaner.session import table

DEPTHS = {"R": 50, "A": 50, "N": 100}
POOL = f"""{HITS}, p AS (SELECT query_id, chunk_id, min(doc_id) AS doc_id, count(DISTINCT doc_id) > 1 AS conflict, min(rank) FILTER (arm = 'R') AS rank_r, min(rank) FILTER (arm = 'A') AS rank_a,
  min(rank) FILTER (arm = 'N') AS rank_n, array_to_string(list_sort(list(DISTINCT arm)), '+') AS membership FROM ranked WHERE (arm = 'R' AND rank <= 50) OR (arm = 'A' AND rank <= 50) OR (arm = 'N' AND rank <= 100) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_r IS NULL, coalesce(rank_r, 1000000000), least(coalesce(rank_a, 1000000000), coalesce(rank_n, 1000000000)),
  coalesce(rank_a, 1000000000), coalesce(rank_n, 1000000000), chunk_id)::BIGINT AS pool_rank FROM p),
best AS (SELECT query_id, chunk_id, max(score) AS score FROM hits GROUP BY ALL), pool AS (SELECT o.*, best.score FROM o JOIN best USING (query_id, chunk_id) WHERE pool_rank <= 100)"""


def best_scores(spark, sf):
    return hits(spark, sf).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def scored_pool(spark, sf):
    return pool.unified_pool(hits(spark, sf), DEPTHS, "R", 100).join(best_scores(spark, sf), ["query_id", "chunk_id"])


@query("p1_unified_pool", f"WITH {POOL} SELECT query_id, chunk_id, doc_id, conflict, rank_r, rank_a, rank_n, membership, pool_rank FROM pool")
def _(spark, sf):
    return pool.unified_pool(hits(spark, sf), DEPTHS, "R", 100)


@query("p2_pool_alignment", f"WITH {POOL} SELECT query_id, count(*)::BIGINT AS n, max(pool_rank) AS last, count(*) = max(pool_rank) AS gapless FROM pool GROUP BY 1")
def _(spark, sf):
    p = pool.unified_pool(hits(spark, sf), DEPTHS, "R", 100)
    return p.groupBy("query_id").agg(F.count("*").alias("n"), F.max("pool_rank").alias("last")).withColumn("gapless", F.col("n") == F.col("last"))


def _overlap(query_text: pd.Series, chunk_text: pd.Series) -> pd.Series:
    """Stand-in scorer: shared words over the chunk's words."""
    return pd.Series([round(len(set(q.split()) & set(c.split())) / max(1, len(set(c.split()))), 9) for q, c in zip(query_text, chunk_text, strict=True)], dtype="float64")


@query("p3_score_missing_pairs", f"""WITH {HITS}, {CHUNKS}, need AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE arm = 'A' AND rank <= 20 AND (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM ranked WHERE arm = 'R' AND rank <= 50)),
t AS (SELECT query_id, chunk_id, ['red', 'small', 'lot', (query_id % 2)::VARCHAR] AS q, list_distinct(string_split(chunk_text, ' ')) AS c FROM need JOIN chunks USING (chunk_id))
SELECT query_id, chunk_id, round(len(list_intersect(q, c)) / greatest(1, len(c))::DOUBLE, 6) AS score FROM t""")
def _(spark, sf):
    found = hits(spark, sf)
    need = pool.missing_scores(found.where("arm = 'A' and rank <= 20"), found.where("arm = 'R' and rank <= 50").select("query_id", "chunk_id").distinct())
    asked = need.join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id").withColumn("query_text", F.concat(F.lit("red small lot "), (F.col("query_id") % 2).cast("string")))
    return pool.score_pairs(asked, _overlap, ["query_text", "chunk_text"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("p4_seed_scores", f"""WITH {HITS}, a AS (SELECT query_id, chunk_id, score FROM ranked WHERE arm = 'A'), n AS (SELECT query_id, chunk_id, score FROM ranked WHERE arm = 'N'), r AS (SELECT query_id, chunk_id FROM ranked WHERE arm = 'R')
SELECT query_id, chunk_id, coalesce(a.score, n.score) AS score, CASE WHEN a.score IS NOT NULL THEN 0 WHEN n.score IS NOT NULL THEN 1 END::BIGINT AS store FROM r LEFT JOIN a USING (query_id, chunk_id) LEFT JOIN n USING (query_id, chunk_id)""")
def _(spark, sf):
    found = hits(spark, sf)
    arm = lambda a: found.where(F.col("arm") == a)
    return pool.seed_scores(arm("R").select("query_id", "chunk_id"), [arm("A"), arm("N")])


@query("p5_novel_pairs_fan_out", f"""WITH {HITS}, d AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE rank <= 30), s AS (SELECT query_id, chunk_id, (query_id * 31 + chunk_id) % 97 AS value FROM d)
SELECT arm, count(*)::BIGINT AS members, sum(value)::BIGINT AS total FROM ranked JOIN s USING (query_id, chunk_id) WHERE rank <= 30 GROUP BY 1""")
def _(spark, sf):
    member = hits(spark, sf).where("rank <= 30")
    once = member.select("query_id", "chunk_id").distinct().withColumn("value", (F.col("query_id") * 31 + F.col("chunk_id")) % 97)
    return member.join(once, ["query_id", "chunk_id"]).groupBy("arm").agg(F.count("*").alias("members"), F.sum("value").alias("total"))


@query("p6_rerank_depth", f"WITH {POOL} SELECT query_id, chunk_id, score, row_number() OVER w::BIGINT AS rank FROM pool WHERE pool_rank <= 60 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 20")
def _(spark, sf):
    return pool.rerank(scored_pool(spark, sf), 60, 20).select("query_id", "chunk_id", "score", "rank")


@query("p7_controlled_selection")
def _(spark, sf):
    df = scored_pool(spark, sf).join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id").withColumn("minus", -F.col("score"))
    rule = functools.partial(select.controlled, most_per_doc=2, unique_text=True, k=20)
    return select.fold_groups(df, ["query_id"], ["minus", "chunk_id"], rule, "query_id long, chunk_id long, doc_id long, score double, position long")


@query("p8_capped_per_document", f"""WITH {POOL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS own FROM pool)
SELECT query_id, chunk_id, doc_id, score, row_number() OVER w::BIGINT AS rank FROM c WHERE own <= 1 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 20""")
def _(spark, sf):
    return pool.cap_per_document(scored_pool(spark, sf), 1, 20).select("query_id", "chunk_id", "doc_id", "score", "rank")


@query("p8_text_suppression", f"""WITH {POOL}, {CHUNKS}, t AS (SELECT pool.*, chunk_text FROM pool JOIN chunks USING (chunk_id)), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_text ORDER BY score DESC, chunk_id) AS own FROM t)
SELECT query_id, chunk_id, score, row_number() OVER w::BIGINT AS rank FROM c WHERE own = 1 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 20""")
def _(spark, sf):
    df = scored_pool(spark, sf).join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id")
    one = retrieve.first_per(df, ["query_id", "chunk_text"], F.desc("score"), F.col("chunk_id"))
    return retrieve.top_k(one, 20, ["query_id"], F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score", "rank")


@query("p9_merged_documents", f"""WITH {HITS}, m AS (SELECT query_id, doc_id, chunk_id, max(score) AS score FROM ranked WHERE arm IN ('A', 'R') AND rank <= 40 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m),
d AS (SELECT query_id, doc_id, min(rank) AS first FROM r GROUP BY ALL) SELECT query_id, doc_id, first::BIGINT AS first, row_number() OVER (PARTITION BY query_id ORDER BY first)::BIGINT AS position FROM d""")
def _(spark, sf):
    m = hits(spark, sf).where("arm in ('A', 'R') and rank <= 40").groupBy("query_id", "doc_id", "chunk_id").agg(F.max("score").alias("score"))
    r = m.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))
    d = r.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return d.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long"))


def _by_domain(spark, sf):
    docs = fuse.documents_of(hits(spark, sf)).where("arm = 'A' and rank <= 60")
    domain = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.lower("p_brand").alias("domain"))
    return docs.join(domain, "doc_id").select("query_id", "doc_id", "domain", "score", "rank")


BY_DOMAIN = f"{HITS}, {_DOCS}, dom AS (SELECT query_id, doc_id, lower(p_brand) AS domain, score, rank FROM docs JOIN part ON p_partkey = doc_id WHERE arm = 'A' AND rank <= 60)"


@query("p10_round_robin", f"""WITH {BY_DOMAIN}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, doc_id) - 1 AS place, count(*) OVER (PARTITION BY query_id, domain) AS size,
  dense_rank() OVER (PARTITION BY query_id ORDER BY domain) - 1 AS pos FROM dom), b AS (SELECT *, max(pos) OVER (PARTITION BY query_id) + 1 AS n FROM a),
c AS (SELECT *, (((place - query_id) % size) + size) % size AS turn, (((pos - query_id) % n) + n) % n AS seat FROM b)
SELECT query_id, doc_id, domain, row_number() OVER w::BIGINT AS rank FROM c WINDOW w AS (PARTITION BY query_id ORDER BY turn, seat) QUALIFY row_number() OVER w <= 20""")
def _(spark, sf):
    return pool.round_robin(_by_domain(spark, sf).drop("rank"), 20).select("query_id", "doc_id", "domain", "rank")


@query("p11_domain_shares")
def _(spark, sf):
    main = _by_domain(spark, sf).withColumn("fallback", F.lit(False))
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.lower("p_brand").alias("domain"))
    spare = retrieve.top_k(part, 4, ["domain"], hashing.hash_rank("spare", F.col("doc_id"))).select("doc_id", "domain")
    # the reservoir is 4 rows per domain; each query gets its own copy of it
    spare = main.select("query_id").distinct().join(spare, F.lit(True)).select("query_id", "doc_id", "domain", F.lit(0.0).alias("score"), F.lit(1000).cast("long").alias("rank"), F.lit(True).alias("fallback"))
    rows = main.unionByName(spare).withColumn("weak", pool.weak(F.max("score").over(Window.partitionBy("query_id")), F.count_if(~F.col("fallback")).over(Window.partitionBy("query_id")), 50_000.0, 40))

    def rule(found):
        return select.domain_shares(found, depth=30, share=0.1, least_domains=5, weak=bool(found[0]["weak"]), reserve=10)

    return select.fold_groups(rows, ["query_id"], ["rank", "doc_id"], rule, "query_id long, doc_id long, domain string, fallback boolean, position long")


@query("p12_weak_queries", f"WITH {HITS} SELECT query_id, max(score) AS best, count(*)::BIGINT AS n, count(*) < 190 OR max(score) < 95000 AS weak FROM ranked WHERE arm = 'A' GROUP BY 1")
def _(spark, sf):
    q = hits(spark, sf).where("arm = 'A'").groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return q.withColumn("weak", pool.weak(F.col("best"), F.col("n"), 95_000.0, 190))


@query("p13_domain_reservoir", r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, sha256('keep:' || page_id::VARCHAR)[1:16] AS h FROM pages)
SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY h, page_id)::BIGINT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY h, page_id) <= 32""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), hashing.hash_rank("keep", F.col("page_id")).alias("h"))
    return retrieve.top_k(p, 32, ["host"], F.col("h"), F.col("page_id")).select("host", "page_id", "rank")


@query("p14_depth_table", f"WITH {HITS} SELECT arm, depth::BIGINT AS depth, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM ranked, (SELECT unnest([10, 50, 100]) AS depth) WHERE rank <= depth GROUP BY ALL")
def _(spark, sf):
    d = pool.at_depths(hits(spark, sf), [10, 50, 100])
    return d.groupBy("arm", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("p15_owner_diversity", f"""WITH {HITS}, a AS (SELECT query_id, doc_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS own FROM ranked WHERE arm = 'N' AND rank <= 100),
b AS (SELECT *, sum((own <= 1)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT query_id, doc_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY NOT (own <= 1 AND run <= 20), rank)::BIGINT AS position FROM b""")
def _(spark, sf):
    df = hits(spark, sf).where("arm = 'N' and rank <= 100").select("query_id", "doc_id", "chunk_id", "rank")
    return pool.owner_diversity(df, 1, 20)


@query("p16_near_duplicate_pairs", f"""WITH {POOL}, {CHUNKS}, t AS (SELECT query_id, chunk_id, chunk_text, list_distinct(string_split(chunk_text, ' ')) AS w FROM pool JOIN chunks USING (chunk_id) WHERE pool_rank <= 40)
SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id
WHERE a.chunk_text = b.chunk_text OR len(list_intersect(a.w, b.w)) >= 0.85 * len(list_distinct(list_concat(a.w, b.w)))""")
def _(spark, sf):
    t = scored_pool(spark, sf).where("pool_rank <= 40").join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id").select("query_id", "chunk_id", "chunk_text", F.array_distinct(F.split("chunk_text", " ")).alias("w"))
    a, b = t.alias("a"), t.alias("b")  # at most 40 chunks a query
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.chunk_id") < F.col("b.chunk_id")))
    j = text.jaccard(F.col("a.w"), F.col("b.w"))
    return pairs.where((F.col("a.chunk_text") == F.col("b.chunk_text")) | (j >= 0.85)).select("a.query_id", F.col("a.chunk_id").alias("a"), F.col("b.chunk_id").alias("b"), F.round(j, 6).alias("jaccard"))


_TEXTED = "query_id long, chunk_id long, doc_id long, score double, position long"


def _texted(spark, sf):
    return scored_pool(spark, sf).join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id").withColumn("minus", -F.col("score"))


_REPRESENTATIVES = functools.partial(select.per_owner, rule=functools.partial(select.representatives, k=3))


@query("p17_representative_chunks")
def _(spark, sf):
    return select.fold_groups(_texted(spark, sf), ["query_id"], ["minus", "chunk_id"], _REPRESENTATIVES, _TEXTED)


@query("p18_chunk_selection")
def _(spark, sf):
    return select.fold_groups(_texted(spark, sf), ["query_id"], ["minus", "chunk_id"], functools.partial(select.without_near_copies, k=40), _TEXTED)


_OVER = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS gram FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS w FROM benchmark), h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS gram FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n FROM h GROUP BY 1) SELECT item_id, doc_id, count(*)::BIGINT AS shared, round(count(*) / any_value(n)::DOUBLE, 6) AS contained FROM h JOIN g USING (gram) JOIN n USING (item_id) GROUP BY item_id, doc_id HAVING count(*) >= 0.8 * any_value(n)"""


@query("p19_containment_overlap", _OVER)
def _(spark, sf):
    grams = lambda df, key: df.select(key, F.explode(text.word_ngrams(text.words(F.col("text")))).alias("gram"))
    h = grams(table(spark, sf, "benchmark"), "item_id")
    n = h.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = h.join(grams(table(spark, sf, "documents"), "doc_id"), "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.join(n, "item_id").where(F.col("shared") >= 0.8 * F.col("n")).select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("contained"))


@query("p20_refinement")
def _(spark, sf):
    return select.fold_groups(_texted(spark, sf), ["query_id"], ["minus", "chunk_id"], functools.partial(select.refined, k=40), _TEXTED)


@query("p22_consensus_swap", rf"""WITH {HITS}, {_DOCS}, inside AS (SELECT query_id, doc_id, rank FROM docs WHERE arm = 'A' AND rank <= 20),
win AS (SELECT query_id, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chunk_id) AS place FROM ranked WHERE arm IN ('N', 'R') AND rank <= 100 GROUP BY query_id, doc_id, chunk_id),
txt AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')[1:60] AS w FROM documents), nd AS (SELECT count(*) AS total FROM documents),
g AS (SELECT query_id, doc_id, place, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM win CROSS JOIN nd JOIN txt ON id = chunk_id % total WHERE len(w) >= 24),
ind AS (SELECT DISTINCT a.query_id, a.doc_id FROM g a JOIN g b USING (query_id, doc_id) WHERE a.place < b.place AND len(list_intersect(a.g, b.g)) <= 0.5 * least(len(a.g), len(b.g))),
cnt AS (SELECT query_id, doc_id, count(*) AS windows, min(place) AS first FROM win GROUP BY ALL),
gain AS (SELECT query_id, doc_id AS new, row_number() OVER (PARTITION BY query_id ORDER BY windows DESC, first, doc_id) AS n FROM cnt SEMI JOIN ind USING (query_id, doc_id) ANTI JOIN inside USING (query_id, doc_id)),
lose AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS n FROM inside LEFT JOIN cnt USING (query_id, doc_id) WHERE rank > 15 AND coalesce(windows, 0) <= 1)
SELECT query_id, coalesce(new, i.doc_id) AS doc_id, rank, new IS NOT NULL AS swapped FROM inside i LEFT JOIN (SELECT lose.query_id, lose.doc_id, new FROM lose JOIN gain USING (query_id, n) WHERE n <= 2) s USING (query_id, doc_id)""")
def _(spark, sf):
    """A chunk's window has the first words of a document of the corpus, as the chunks' own texts are short."""
    found = hits(spark, sf)
    docs = fuse.documents_of(found).where("arm = 'A'").select("query_id", "doc_id", "rank")
    best = found.where("arm in ('N', 'R') and rank <= 100").groupBy("query_id", "doc_id", "chunk_id").agg(F.min("rank").alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "chunk_id"))
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.slice(text.words(F.col("text")), 1, 60).alias("words"))
    windows = best.withColumn("place", place).join(corpus, F.col("id") == F.col("chunk_id") % corpus.count(), "left")
    return pool.swap_by_consensus(docs, windows.select("query_id", "doc_id", "place", "words"), 15, 20, 2)


@query("p23_best_window", f"WITH {HITS} SELECT query_id, doc_id, arg_min(chunk_id, struct_pack(a := -score, b := chunk_id)) AS chunk_id, max(score) AS score FROM ranked GROUP BY ALL")
def _(spark, sf):
    return pool.best_window(hits(spark, sf), "doc_id")


@query("p25_document_dedupe", f"WITH {HITS} SELECT query_id, doc_id, min(rank) AS rank FROM ranked WHERE arm = 'A' GROUP BY ALL")
def _(spark, sf):
    return retrieve.first_per(hits(spark, sf).where("arm = 'A'").withColumnRenamed("rank", "r"), ["query_id", "doc_id"], F.col("r")).select("query_id", "doc_id", F.col("r").alias("rank"))


@query("p26_candidate_dedupe", "SELECT host, path, min(page_id) AS page_id FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) GROUP BY ALL")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.lower(urls.part(F.col("url"), 2)).alias("host"), urls.part(F.col("url"), 4).alias("path"))
    return p.groupBy("host", "path").agg(F.min("page_id").alias("page_id"))


@query("p27_cap_calibration", f"""WITH {HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS own FROM ranked WHERE arm = 'A'), w AS (SELECT query_id, chunk_id FROM ranked WHERE arm = 'A' AND rank <= 50),
k AS (SELECT cap, count(*) / (SELECT count(*) FROM w)::DOUBLE AS retention FROM a SEMI JOIN w USING (query_id, chunk_id), (SELECT unnest([1, 2, 3]) AS cap) WHERE own <= cap GROUP BY 1)
SELECT cap::BIGINT AS cap, round(retention, 6) AS retention, cap = coalesce((SELECT min(cap) FROM k WHERE retention >= 0.99), -1) AS chosen FROM k""")
def _(spark, sf):
    a = hits(spark, sf).where("arm = 'A'")
    out = pool.calibrate_cap(a, a.where("rank <= 50").select("query_id", "chunk_id"), [1, 2, 3], 0.99)
    return out.withColumn("cap", F.col("cap").cast("long"))


_AGG = """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS p FROM pool), g AS (SELECT query_id, doc_id, round(avg(score), 9) AS doc_score, arg_min(chunk_id, p) AS best_chunk, count(*)::BIGINT AS n_chunks FROM a WHERE p <= {n} GROUP BY ALL)
SELECT query_id, doc_id, round(doc_score, 6) AS doc_score, best_chunk, n_chunks, row_number() OVER w::BIGINT AS rank FROM g WINDOW w AS (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) QUALIFY row_number() OVER w <= 20"""

for _name, _n in (("a1_best_chunk", 1), ("a1_top3_mean", 3), ("a4_top2_mean", 2)):

    @query(_name, f"WITH {POOL}" + _AGG.format(n=_n))
    def _(spark, sf, n=_n):
        return aggregate.aggregate_documents(scored_pool(spark, sf), n, 20).withColumn("doc_score", F.round("doc_score", 6))


@query("a3_robust_top3")
def _(spark, sf):
    best = select.fold_groups(_texted(spark, sf), ["query_id"], ["minus", "chunk_id"], _REPRESENTATIVES, _TEXTED)
    return aggregate.aggregate_documents(best, 3, 20)


@query("a5_ledger", f"""WITH {HITS}, h AS (SELECT * FROM ranked WHERE rank <= 100), own AS (SELECT query_id, doc_id, arm, min(rank) AS rank FROM h GROUP BY ALL),
r AS (SELECT query_id, doc_id, array_to_string(list(arm ORDER BY arm), ',') AS arms, '{{' || string_agg('"' || arm || '":' || rank::VARCHAR, ',' ORDER BY arm) || '}}' AS ranks_by_arm, min(rank) AS best_rank FROM own GROUP BY ALL),
s AS (SELECT query_id, chunk_id, score FROM ranked WHERE arm = 'A'), c AS (SELECT query_id, doc_id, count(DISTINCT chunk_id)::BIGINT AS n_chunks, (count(*) - count(DISTINCT chunk_id))::BIGINT AS duplicate_rows FROM h GROUP BY ALL),
m AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC NULLS LAST, chunk_id) AS p FROM (SELECT DISTINCT query_id, doc_id, chunk_id FROM h) LEFT JOIN s USING (query_id, chunk_id)),
a AS (SELECT query_id, doc_id, max(score) AS best, round(avg(score) FILTER (p <= 2), 6) AS mean2, round(avg(score) FILTER (p <= 3), 6) AS mean3 FROM m GROUP BY ALL)
SELECT query_id, doc_id, arms, ranks_by_arm, best_rank, n_chunks, duplicate_rows, best, mean2, mean3, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM ranked WHERE arm = 'N' AND rank <= 10) AS in_final FROM r JOIN c USING (query_id, doc_id) JOIN a USING (query_id, doc_id)""")
def _(spark, sf):
    found = hits(spark, sf)
    scores = found.where("arm = 'A'").select("query_id", "chunk_id", "score")
    out = aggregate.ledger(found.where("rank <= 100").drop("score"), scores, ["A", "N", "R"], found.where("arm = 'N' and rank <= 10"))
    return out.withColumn("arms", F.array_join("arms", ","))


@query("a6_evidence_quality", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) < 200 THEN 'short' END, CASE WHEN len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')) < 20 THEN 'few_words' END,
  CASE WHEN len(regexp_extract_all(text, '\p{L}')) < 0.5 * length(text) THEN 'few_letters' END, CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) > 0.02 * length(text) THEN 'symbols' END,
  CASE WHEN len(regexp_extract_all(text, '\|')) >= 5 THEN 'menu' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def _(spark, sf):
    return aggregate.quality_reasons(table(spark, sf, "documents"), "text").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("n8_close_pairs")
def _(spark, sf):
    df = scored_pool(spark, sf).withColumn("minus", -F.col("score"))
    return select.fold_groups(df, ["query_id"], ["minus", "chunk_id"], functools.partial(select.close_pairs, k=2), "query_id long, chunk_id long, other long, gap double, position long")
