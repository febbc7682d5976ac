"""Queries over indexes, retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import hashing, text, urls
from gleaner.operators import fuse, index, retrieve
from gleaner.plans.registry import CHUNKS, HITS, TOKENS, bm25_sql, query
from gleaner.session import table

ARMS = ["A", "N", "R"]
W = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def hits(spark, sf) -> DataFrame:
    """The three scored arms: (query_id, arm, doc_id, chunk_id, score, rank)."""
    line = table(spark, sf, "lineitem")
    chunk = (F.col("l_partkey") * 4 + F.col("l_linenumber") % 4).cast("long")
    found = line.groupBy(
        F.col("l_suppkey").cast("long").alias("query_id"), F.col("l_returnflag").alias("arm"), F.col("l_partkey").cast("long").alias("doc_id"),
        chunk.alias("chunk_id")).agg(F.max("l_extendedprice").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "chunk_id")).cast("long")
    return found.withColumn("rank", rank)


def chunks(spark, sf) -> DataFrame:
    """Four rows with text for each part: far more than the file's size tells the planner, so joins merge and never broadcast them."""
    part = table(spark, sf, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))
    brand = F.lower("p_brand")
    return part.select(
        (F.col("p_partkey") * 4 + F.col("k")).cast("long").alias("chunk_id"), F.col("p_partkey").cast("long").alias("doc_id"), F.col("k").alias("chunk_index"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), brand, F.lit(" lot "), F.floor(F.col("k") / 2).cast("string")).alias("chunk_text"),
        brand.alias("domain"), F.concat(F.lit("https://"), F.replace(brand, F.lit("#"), F.lit("")), F.lit(".example.org/"), F.col("p_partkey").cast("string")).alias("source_url")).hint("merge")


def corpus_index(spark, sf, key=None, vocabulary=None) -> index.Index:
    return index.build(table(spark, sf, "documents"), "doc_id", text.words(F.col("text")), key, vocabulary)


def passages(spark, sf, distinct=False) -> DataFrame:
    return index.query_terms(table(spark, sf, "benchmark"), "item_id", text.words(F.col("text")), distinct)


def bm25(spark, sf, k=10, distinct=False) -> DataFrame:
    """The index holds only postings of the queries' vocabulary; lengths stay whole."""
    terms = passages(spark, sf, distinct)
    return retrieve.bm25_top_k(corpus_index(spark, sf, vocabulary=terms), terms, k).withColumnRenamed("doc", "doc_id")


_TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM {src}) WHERE rank <= {k}"


@query("i1_index_statistics", f"WITH {TOKENS} SELECT count(*)::BIGINT AS postings, count(DISTINCT term)::BIGINT AS terms, sum(tf)::BIGINT AS tokens, round(max(avgdl), 6) AS avgdl, max(n)::BIGINT AS n FROM tf, stats")
def _(spark, sf):
    ix = corpus_index(spark, sf)
    p = ix.postings.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens"))
    return p.crossJoin(ix.stats.select(F.round("avgdl", 6).alias("avgdl"), F.col("n").cast("long").alias("n")))


@query("i1_document_frequencies", f"WITH {TOKENS} SELECT term, df::BIGINT AS df FROM df")
def _(spark, sf):
    return corpus_index(spark, sf).frequencies


@query("i2_index_mapping", f"WITH {TOKENS} SELECT doc_id, 'right' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tf)")
def _(spark, sf):
    p = corpus_index(spark, sf).postings.withColumnRenamed("doc", "doc_id")
    return index.unmatched(p, table(spark, sf, "documents"), "doc_id")


@query("i3_query_conditioned_index", f"WITH {TOKENS} SELECT term, count(*)::BIGINT AS postings, sum(tf)::BIGINT AS tokens, sum(dl)::BIGINT AS length FROM tf JOIN dl USING (doc_id) WHERE term IN (SELECT term FROM qf) GROUP BY 1")
def _(spark, sf):
    ix = corpus_index(spark, sf, vocabulary=passages(spark, sf))
    return ix.postings.join(ix.lengths, "doc").groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.sum("dl").alias("length"))


@query("i4_append_new_only", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("i5_filtered_index", f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents WHERE lang = 'en' AND n_chars >= 200)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM d GROUP BY 1""")
def _(spark, sf):
    good = table(spark, sf, "documents").where("lang = 'en' and n_chars >= 200")
    return index.build(good, "doc_id", text.words(F.col("text"))).frequencies


@query("i6_per_source_index", f"""WITH t AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents)
SELECT source, term, count(DISTINCT doc_id)::BIGINT AS df FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return corpus_index(spark, sf, ["source"]).frequencies


@query("i7_token_state", f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '{W}')) AS term FROM pages)
SELECT term, count(*)::BIGINT AS tf, count(DISTINCT page_id)::BIGINT AS df, regexp_matches(term, '^\\d+$') AS numeric FROM t GROUP BY 1""")
def _(spark, sf):
    ix = index.build(table(spark, sf, "pages"), "page_id", text.words(F.col("url")))
    return ix.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).withColumn("numeric", F.col("term").rlike(r"^\d+$"))


@query("i11_text_hash_duplicates", """SELECT count(*)::BIGINT AS groups, sum(n - 1)::BIGINT AS beyond_first, max(n)::BIGINT AS largest FROM (
  SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("beyond_first"), F.max("n").alias("largest"))


@query("bm25_topk", f"WITH {bm25_sql('qf')} " + _TOP.format(src="bm25", k=10))
def _(spark, sf):
    return bm25(spark, sf)


@query("r2_bm25_set_terms", f"WITH {bm25_sql('1')} " + _TOP.format(src="bm25 WHERE score > 0", k=10))
def _(spark, sf):
    return bm25(spark, sf, distinct=True)


@query("r3_term_scores", f"WITH {TOKENS} SELECT term, doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), stats WHERE term IN (SELECT term FROM qf)")
def _(spark, sf):
    ix = corpus_index(spark, sf, vocabulary=passages(spark, sf))
    p = ix.postings.join(ix.frequencies, "term").join(ix.lengths, "doc").crossJoin(ix.stats)
    return p.select("term", F.col("doc").alias("doc_id"), F.round(index.term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")), 6).alias("score"))


_RARE = ", rare AS (SELECT * FROM (SELECT qf.*, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r FROM qf JOIN df USING (term)) WHERE r <= 12)"


@query("r4_rarest_terms", f"WITH {bm25_sql('1').replace(', bm25 AS', _RARE + ', bm25 AS').replace('FROM qf JOIN tf USING', 'FROM rare JOIN tf USING')} " + _TOP.format(src="bm25", k=10))
def _(spark, sf):
    terms = passages(spark, sf, distinct=True)
    ix = corpus_index(spark, sf, vocabulary=terms)
    return retrieve.bm25_top_k(ix, retrieve.rarest_terms(terms, ix.frequencies, 12), 10).withColumnRenamed("doc", "doc_id")


_FIELDS = rf"""h AS (SELECT doc_id, regexp_extract_all(lower(regexp_extract(text, '^[^\n]*')), '{W}') AS title, regexp_extract_all(lower(text), '{W}') AS body FROM documents),
ft AS (SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, unnest(title) AS term, 4.0 AS w FROM h UNION ALL SELECT doc_id, unnest(body), 1.0 FROM h) GROUP BY ALL),
len AS (SELECT doc_id, (len(title) + len(body))::DOUBLE AS dl FROM h), st AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM len), fdf AS (SELECT term, count(*) AS df FROM ft GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark),
f AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN ft USING (term) JOIN fdf USING (term) JOIN len USING (doc_id), st GROUP BY ALL)"""


@query("r5_weighted_fields", f"WITH {_FIELDS} " + _TOP.format(src="f", k=10))
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("title", F.regexp_extract("text", r"^[^\n]*", 0))
    terms = passages(spark, sf, distinct=True)
    title = index.build(docs, "doc_id", text.words(F.col("title")), vocabulary=terms)
    body = index.build(docs, "doc_id", text.words(F.col("text")), vocabulary=terms)
    postings = retrieve.weighted_postings([(title.postings, 4.0), (body.postings, 1.0)])
    lengths = docs.select(F.col("doc_id").alias("doc"), (F.size(text.words(F.col("title"))) + F.size(text.words(F.col("text")))).cast("double").alias("dl"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    ix = index.Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), stats, [])
    return retrieve.bm25_top_k(ix, terms, 10).withColumnRenamed("doc", "doc_id")


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def dense(spark, sf, k=10):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieve.dense_top_k(q, v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), k)


_DENSE = f"dense AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, round({_DOT}, 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@query("r6_dense_topk", f"WITH {_DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::BIGINT AS rank FROM dense) WHERE rank <= 10")
def _(spark, sf):
    return dense(spark, sf).withColumn("score", F.round("score", 6))


@query("r9_dense_by_owner", f"WITH {_DENSE}, o AS (SELECT query_id, label AS owner, max(score) AS score FROM dense JOIN embeddings ON doc = vec_id GROUP BY ALL) SELECT query_id, owner::BIGINT AS owner, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner)::BIGINT AS rank FROM o) WHERE rank <= 5")
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    every = v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("owner"))
    from gleaner.functions.vectors import dot

    pairs = retrieve.against_all(q, every).groupBy("query_id", "owner").agg(F.max(F.round(dot(F.col("q"), F.col("v")), 12)).alias("score"))
    return retrieve.top_k(pairs, 5, ["query_id"], F.desc("score"), F.col("owner")).withColumn("score", F.round("score", 6))


@query("r10_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id")
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    a = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"))
    # a stated query set against all rows: every pair is a row of the result
    return retrieve.cosine_pairs(a, v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), 6)


@query("r8_stable_top_k", "SELECT l_suppkey::BIGINT AS query_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice)::BIGINT AS rank FROM lineitem) WHERE rank <= 20")
def _(spark, sf):
    # quantities tie all the time: the order must end in something unique
    top = retrieve.top_k(table(spark, sf, "lineitem"), 20, ["l_suppkey"], F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"))
    return top.select(F.col("l_suppkey").cast("long").alias("query_id"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", "rank")


_SRC = f"""t AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY ALL),
l AS (SELECT source, doc_id, len(regexp_extract_all(lower(text), '{W}')) AS dl FROM documents), s AS (SELECT source, count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM l GROUP BY 1),
d AS (SELECT source, term, count(*) AS df FROM t GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark),
f AS (SELECT source, query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN t USING (term) JOIN d USING (source, term) JOIN l USING (source, doc_id) JOIN s USING (source) GROUP BY ALL)"""


@query("r11_per_source_candidates", f"WITH {_SRC} SELECT source, query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM f) WHERE rank <= 5")
def _(spark, sf):
    terms = passages(spark, sf, distinct=True)
    return retrieve.bm25_top_k(corpus_index(spark, sf, ["source"], terms), terms, 5).withColumnRenamed("doc", "doc_id")


@query("r16_expansion_terms", f"""WITH {bm25_sql('qf')}, seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm25) WHERE r <= 3),
t AS (SELECT query_id, doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term, regexp_extract_all(lower(regexp_extract(text, '^[^\\n]*')), '{W}') AS title FROM seeds JOIN documents USING (doc_id)),
c AS (SELECT query_id, term, count(*) AS tf, max(list_contains(title, term)) AS in_title FROM t GROUP BY ALL),
w AS (SELECT query_id, term, round((1 + ln(tf)) * ln((n + 1) / (df + 1)) * CASE WHEN in_title THEN 1.25 ELSE 1.0 END, 9) AS weight FROM c JOIN df USING (term), stats WHERE df / n <= 0.05)
SELECT query_id, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term)::BIGINT AS rank FROM w) WHERE rank <= 12""")
def _(spark, sf):
    seeds = bm25(spark, sf, 3).drop("rank", "score").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    seeds = seeds.withColumn("head", F.regexp_extract("text", r"^[^\n]*", 0))
    n = F.lit(float(table(spark, sf, "documents").count()))
    out = retrieve.expansion_terms(seeds, text.words(F.col("text")), text.words(F.col("head")), corpus_index(spark, sf).frequencies, n, 12, 0.05)
    return out.select("query_id", "term", F.round("weight", 6).alias("weight"), "rank")


@query("r19_corpus_ranking", f"""WITH {bm25_sql('1')}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25),
s AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r WHERE rank <= 100 GROUP BY 1), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT doc_id, row_number() OVER (ORDER BY rank IS NULL, rank, CASE WHEN rank IS NULL THEN sha256('order:' || doc_id::VARCHAR)[1:16] END, doc_id)::BIGINT AS position FROM documents LEFT JOIN k USING (doc_id)""")
def _(spark, sf):
    per_query = bm25(spark, sf, 100, distinct=True)
    score = per_query.groupBy("doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"))
    ranked = fuse.ranked_by_score(score, "score", "doc_id")
    return fuse.complete(ranked, table(spark, sf, "documents").select("doc_id"), "doc_id", hashing.hash_rank("order", F.col("doc_id")))


@query("r20_seed_expansion", f"""WITH {TOKENS}, f AS (SELECT doc_id, ((('0x' || sha256('fold:' || doc_id::VARCHAR)[1:16])::UBIGINT % 5))::BIGINT AS fold, quality FROM documents LEFT JOIN labels USING (doc_id)),
seed AS (SELECT g.fold, term, count(*) AS n_seeds FROM tf JOIN f USING (doc_id), (SELECT unnest(range(5)) AS fold) g WHERE quality = 0 AND f.fold <> g.fold GROUP BY ALL)
SELECT doc_id, round(sum(ln((n + 1) / (df + 1)) * (1 + ln(n_seeds))), 4) AS score FROM tf JOIN f USING (doc_id) JOIN seed USING (fold, term) JOIN df USING (term), stats WHERE df <= 0.05 * n GROUP BY 1""")
def _(spark, sf):
    ix = corpus_index(spark, sf)
    label = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id").join(label, "doc_id", "left").select(F.col("doc_id").alias("doc"), hashing.hash_fold("fold", F.col("doc_id"), 5).alias("fold"), "quality")
    folded = ix.postings.join(docs, "doc")
    # a seed counts for every fold but its own: five copies of a few labelled documents' terms
    seeds = folded.where("quality = 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>"))).where("other <> fold")
    seeds = seeds.groupBy(F.col("other").alias("fold"), "term").agg(F.count("*").alias("n_seeds"))
    scored = folded.join(seeds, ["fold", "term"]).join(ix.frequencies, "term").crossJoin(ix.stats).where("df <= 0.05 * n")
    one = F.ln((F.col("n") + 1) / (F.col("df") + 1)) * (1 + F.ln("n_seeds"))
    return scored.groupBy(F.col("doc").alias("doc_id")).agg(F.round(F.sum(one), 4).alias("score"))


@query("r21_attach_evidence", f"""WITH {HITS}, {CHUNKS}, docs AS (SELECT DISTINCT query_id, doc_id FROM ranked WHERE arm = 'A' AND rank <= 20),
e AS (SELECT query_id, d.doc_id, c.chunk_id, h.score, row_number() OVER (PARTITION BY query_id, d.doc_id ORDER BY chunk_index) AS slot FROM docs d JOIN chunks c USING (doc_id)
  LEFT JOIN (SELECT query_id, chunk_id, max(score) AS score FROM hits GROUP BY ALL) h USING (query_id, chunk_id))
SELECT query_id, doc_id, chunk_id, score, slot::BIGINT AS slot FROM e WHERE slot <= 2""")
def _(spark, sf):
    found = hits(spark, sf)
    docs = found.where("arm = 'A' and rank <= 20").select("query_id", "doc_id").distinct()
    first = docs.join(chunks(spark, sf), "doc_id")
    first = retrieve.top_k(first, 2, ["query_id", "doc_id"], F.col("chunk_index")).withColumnRenamed("rank", "slot")
    scores = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return first.join(scores, ["query_id", "chunk_id"], "left").select("query_id", "doc_id", "chunk_id", "score", "slot")


@query("r22_documents_to_chunks", f"WITH {HITS}, {CHUNKS} SELECT query_id, doc_id, c.chunk_id, chunk_index FROM (SELECT DISTINCT query_id, doc_id FROM ranked WHERE rank <= 10) JOIN chunks c USING (doc_id)")
def _(spark, sf):
    docs = hits(spark, sf).where("rank <= 10").select("query_id", "doc_id").distinct()
    return docs.join(chunks(spark, sf), "doc_id").select("query_id", "doc_id", "chunk_id", "chunk_index")


def _norm(url: str) -> str:
    """DuckDB SQL of a normalized URL, for URLs without escapes and ports."""
    path, q = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)", rf"regexp_extract({url}, '\?([^#]*)', 1)"
    kept = f"array_to_string(list_filter(string_split({q}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({', '.join(repr(t) for t in urls.TRACKING)})), '&')"
    return (f"(regexp_extract({url}, '^([a-z]+)://', 1) || '://' || lower(regexp_extract({url}, '^[a-z]+://([^/?#:]*)', 1)) || CASE WHEN regexp_matches({path}, '^/*$') THEN '/' "
            f"ELSE regexp_replace({path}, '/+$', '') END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)")


_MAP = rf"""u AS (SELECT page_id, url, {_norm('url')} AS plain FROM pages),
r AS (SELECT page_id AS result_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN split_part(url, '#', 1) || '#x'
  WHEN url LIKE 'https:%' THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END AS url FROM u),
k AS (SELECT result_id, url, {_norm('url')} AS plain FROM r),
m AS (SELECT result_id, 0 AS level, 'exact' AS how, u.page_id AS id FROM k JOIN u USING (url) UNION SELECT result_id, 1, 'normalized', u.page_id FROM k JOIN u USING (plain)
  UNION SELECT result_id, 2, 'canonical', u.page_id FROM k JOIN u ON regexp_replace(k.plain, '^[a-z]+:', '') = regexp_replace(u.plain, '^[a-z]+:', '')),
g AS (SELECT result_id, level, how, min(id) AS id, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY level) = 1)"""


@query("r23_map_urls", f"WITH {_MAP} SELECT result_id, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n > 1 THEN 'ambiguous' ELSE coalesce(how, 'none') END AS how FROM r LEFT JOIN b USING (result_id)")
def _(spark, sf):
    pages, u = table(spark, sf, "pages"), F.col("url")
    moved = F.when(F.startswith(u, F.lit("https:")), F.concat(F.lit("http"), F.expr("substr(url, 6)"))).otherwise(F.concat(F.lit("https"), F.expr("substr(url, 5)")))
    third = F.col("page_id") % 3
    found = pages.select(F.col("page_id").alias("result_id"), F.when(third == 0, u).when(third == 1, F.concat(F.split_part(u, F.lit("#"), F.lit(1)), F.lit("#x"))).otherwise(moved).alias("url"))
    return retrieve.map_by_precedence(
        found, pages.select(F.col("page_id").alias("id"), "url"), [("exact", u), ("normalized", urls.normalized(u)), ("canonical", urls.canonical_key(u))])


@query("u1_best_per_chunk", "SELECT query_id, chunk_id, score FROM (SELECT l_suppkey::BIGINT AS query_id, (l_partkey * 4 + l_linenumber % 4)::BIGINT AS chunk_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)")
def _(spark, sf):
    return fuse.best_per_item(hits(spark, sf), ["query_id"], "chunk_id").select("query_id", "chunk_id", "score")


_FUSE = """f AS (SELECT query_id, {item}, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best_rank, max(rank) FILTER (arm = 'A') AS rank_a, max(rank) FILTER (arm = 'N') AS rank_n,
  max(rank) FILTER (arm = 'R') AS rank_r, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms FROM {src} WHERE rank <= 100 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, {item})::BIGINT AS rank FROM f)"""
_DOCS = """bydoc AS (SELECT query_id, arm, doc_id, min(rank) AS r, max(score) AS score FROM ranked GROUP BY ALL),
docs AS (SELECT query_id, arm, doc_id, score, row_number() OVER (PARTITION BY query_id, arm ORDER BY r, doc_id)::BIGINT AS rank FROM bydoc)"""


@query("u2_rrf_chunks", f"WITH {HITS}, {_FUSE.format(item='chunk_id', src='ranked')} SELECT query_id, chunk_id, score, best_rank, rank_a, rank_n, rank_r, arms, rank FROM o WHERE rank <= 50")
def _(spark, sf):
    return fuse.rrf(hits(spark, sf).where("rank <= 100"), "chunk_id", ARMS, 50)


@query("u3_rrf_documents", f"WITH {HITS}, {_DOCS}, {_FUSE.format(item='doc_id', src='docs')} SELECT query_id, doc_id, score, best_rank, rank_a, rank_n, rank_r, arms, rank FROM o WHERE rank <= 20")
def _(spark, sf):
    return fuse.rrf(fuse.documents_of(hits(spark, sf)).where("rank <= 100"), "doc_id", ARMS, 20)


@query("u4_arm_union", f"WITH {HITS}, {_DOCS} SELECT query_id, doc_id, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms, max(score) FILTER (arm = 'A') AS score_a, max(score) FILTER (arm = 'N') AS score_n FROM docs WHERE rank <= 20 AND arm IN ('A', 'N') GROUP BY ALL")
def _(spark, sf):
    docs = fuse.documents_of(hits(spark, sf)).where("rank <= 20 and arm in ('A', 'N')")
    score = lambda a: F.max(F.when(F.col("arm") == a, F.col("score"))).alias(f"score_{a.lower()}")
    return docs.groupBy("query_id", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"), score("A"), score("N"))


@query("u5_best_arm_rrf", f"WITH {HITS}, {_DOCS}, {_FUSE.format(item='doc_id', src='docs').replace('sum(1.0', 'max(1.0')} SELECT query_id, doc_id, score, rank FROM o WHERE rank <= 20")
def _(spark, sf):
    return fuse.rrf(fuse.documents_of(hits(spark, sf)).where("rank <= 100"), "doc_id", ARMS, 20, how="max").select("query_id", "doc_id", "score", "rank")


@query("u6_balanced_pre_merge", f"WITH {HITS}, {_DOCS} SELECT query_id, doc_id, max(score) AS score FROM docs WHERE rank <= 40 GROUP BY ALL")
def _(spark, sf):
    return fuse.pre_merge(fuse.documents_of(hits(spark, sf)), "doc_id", 40)


@query("u7_capped_domain", f"""WITH {HITS}, {_DOCS}, m AS (SELECT query_id, doc_id, max(docs.score) AS score, any_value(lower(p_brand)) AS domain FROM docs JOIN part ON doc_id = p_partkey WHERE rank <= 40 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain = 'brand#1' ORDER BY score DESC, doc_id) AS place FROM m) SELECT query_id, doc_id, domain, score FROM c WHERE domain <> 'brand#1' OR place <= 2""")
def _(spark, sf):
    merged = fuse.pre_merge(fuse.documents_of(hits(spark, sf)), "doc_id", 40)
    domains = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.lower("p_brand").alias("domain"))
    return fuse.cap_group(merged.join(domains, "doc_id"), "domain", "brand#1", 2, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "domain", "score")


@query("u8_global_order", f"WITH {HITS}, b AS (SELECT query_id, doc_id, max(score) AS score, arg_min(chunk_id, struct_pack(a := -score, b := chunk_id)) AS chunk_id FROM ranked GROUP BY ALL) SELECT query_id, doc_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, doc_id)::BIGINT AS rank FROM b")
def _(spark, sf):
    b = hits(spark, sf).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "doc_id")).cast("long"))


@query("u9_representative_arm", f"WITH {HITS} SELECT query_id, doc_id, arg_min(chunk_id, struct_pack(a := list_position(['R', 'A', 'N'], arm), b := rank)) AS chunk_id FROM ranked WHERE rank <= 50 GROUP BY ALL")
def _(spark, sf):
    return fuse.representative(hits(spark, sf).where("rank <= 50"), "doc_id", "chunk_id", ["R", "A", "N"])


@query("u10_completed_ranking", f"""WITH {HITS}, r AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM ranked WHERE rank <= 10 GROUP BY 1), k AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM r)
SELECT p_partkey::BIGINT AS doc_id, row_number() OVER (ORDER BY rank IS NULL, rank, CASE WHEN rank IS NULL THEN sha256('rest:' || p_partkey::VARCHAR)[1:16] END, p_partkey)::BIGINT AS position FROM part LEFT JOIN k ON doc_id = p_partkey""")
def _(spark, sf):
    s = hits(spark, sf).where("rank <= 10").groupBy("doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("s"))
    k = fuse.ranked_by_score(s, "s", "doc_id")
    every = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("doc_id"))
    return fuse.complete(k, every, "doc_id", hashing.hash_rank("rest", F.col("doc_id")))


@query("u11_protected_arm", f"""WITH {HITS}, {_DOCS}, c AS (SELECT * FROM docs WHERE arm = 'A'), head AS (SELECT query_id, doc_id, rank, 0 AS cls FROM c WHERE rank <= 10),
new AS (SELECT query_id, doc_id, rank, 1 AS cls FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS n FROM docs b WHERE arm = 'N' AND rank <= 20 AND NOT EXISTS (SELECT 1 FROM head h WHERE h.query_id = b.query_id AND h.doc_id = b.doc_id)) WHERE n <= 5),
tail AS (SELECT query_id, doc_id, rank, 2 AS cls FROM c WHERE rank > 10 AND NOT EXISTS (SELECT 1 FROM new WHERE new.query_id = c.query_id AND new.doc_id = c.doc_id)), e AS (SELECT * FROM head UNION ALL SELECT * FROM new UNION ALL SELECT * FROM tail)
SELECT query_id, doc_id, row_number() OVER w::BIGINT AS rank, ['control', 'added', 'tail'][cls + 1] AS part FROM e WINDOW w AS (PARTITION BY query_id ORDER BY cls, rank, doc_id) QUALIFY row_number() OVER w <= 20""")
def _(spark, sf):
    docs = fuse.documents_of(hits(spark, sf))
    return fuse.protected(docs.where("arm = 'A'"), docs.where("arm = 'N' and rank <= 20"), 10, 5, 20)


@query("hybrid_bm25_dense", f"""WITH {bm25_sql('qf')}, s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25),
v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_DOT}, 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
d AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v), u AS (SELECT * FROM s WHERE rank <= 100 UNION ALL SELECT * FROM d WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(rank) AS best FROM u GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER w::BIGINT AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, best, doc_id) QUALIFY row_number() OVER w <= 50""")
def _(spark, sf):
    # text and vectors are paired by equal numbers, which the synthetic tables do not mean
    sparse = bm25(spark, sf, 100).select("query_id", F.lit("sparse").alias("arm"), "doc_id", "rank")
    v = table(spark, sf, "embeddings")
    q = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieve.dense_top_k(q, v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), 50)
    both = sparse.unionByName(near.select("query_id", F.lit("dense").alias("arm"), F.col("doc").alias("doc_id"), "rank"))
    return fuse.rrf(both, "doc_id", ["dense", "sparse"], 50).select("query_id", "doc_id", "score", "rank")


