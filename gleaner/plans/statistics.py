"""Queries over statistics, comparisons, samples, audits and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.operators import audit, evaluate, fuse, pool, sample, stats
from gleaner.plans.pools import POOL, best_scores, scored_pool
from gleaner.plans.registry import CHUNKS, HITS, bm25_sql, query
from gleaner.plans.retrieval import _DOCS, bm25, chunks, hits
from gleaner.session import table

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '')"


def q(c, p):
    return f"round(quantile_cont({c}, {p}), 6)"


def arm(spark, sf, a):
    return hits(spark, sf).where(F.col("arm") == a)


@query("g1_linear_percentiles", f"SELECT l_returnflag AS arm, {q('l_extendedprice', 0.25)} AS p25, {q('l_extendedprice', 0.5)} AS p50, {q('l_extendedprice', 0.95)} AS p95 FROM lineitem GROUP BY 1")
def _(spark, sf):
    c = "l_extendedprice"
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(stats.linear(c, 0.25).alias("p25"), stats.linear(c, 0.5).alias("p50"), stats.linear(c, 0.95).alias("p95"))


@query("g2_nearest_rank_p95", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = greatest(1, ceil(n * 0.95))")
def _(spark, sf):
    return stats.nearest(table(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("g3_distribution", f"SELECT event_type, count(value)::BIGINT AS n, min(value) AS low, {q('value', 0.05)} AS p5, {q('value', 0.5)} AS median, {q('value', 0.95)} AS p95, max(value) AS high FROM events GROUP BY 1")
def _(spark, sf):
    return stats.distribution(table(spark, sf, "events"), ["event_type"], "value")


@query("g4_count_summary", f"SELECT sum(n)::BIGINT AS total, min(n)::BIGINT AS low, {q('n', 0.5)} AS median, {q('n', 0.9)} AS p90, max(n)::BIGINT AS high, round(avg(n), 6) AS mean, count(*) FILTER (n < 60)::BIGINT AS below FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def _(spark, sf):
    return stats.count_summary(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n", 60)


@query("g5_telemetry", "SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value >= 20)::BIGINT AS high_values, count(DISTINCT user_id)::BIGINT AS users, CASE WHEN avg(value) < 20 THEN 'low' ELSE 'high' END AS level FROM events GROUP BY ROLLUP (event_type)")
def _(spark, sf):
    return table(spark, sf, "events").rollup("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("high_values"), F.count_distinct("user_id").alias("users"),
        F.when(F.avg("value") < 20, "low").otherwise("high").alias("level"))


@query("g6_domain_shares", f"""WITH d AS (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS r, sum(n) OVER () AS total FROM d)
SELECT count(*)::BIGINT AS hosts, round(sum(n) FILTER (r <= 1) / any_value(total), 6) AS top1_share, round(sum(n) FILTER (r <= 5) / any_value(total), 6) AS top5_share FROM r""")
def _(spark, sf):
    d = table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    r = d.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "host")))
    share = lambda k: F.round(F.sum(F.when(F.col("r") <= k, F.col("n"))) / F.sum("n"), 6)
    return r.agg(F.count("*").alias("hosts"), share(1).alias("top1_share"), share(5).alias("top5_share"))


@query("g7_candidate_diagnostics", f"""WITH {HITS}, d AS (SELECT arm, depth, query_id, doc_id, chunk_id FROM ranked, (SELECT unnest([10, 50]) AS depth) WHERE rank <= depth), g AS (SELECT arm, depth, doc_id, count(*) AS n FROM d GROUP BY ALL)
SELECT arm, depth::BIGINT AS depth, sum(n)::BIGINT AS candidates, count(*)::BIGINT AS docs, count(*) FILTER (n > 1)::BIGINT AS repeated_docs, max(n)::BIGINT AS most FROM g GROUP BY ALL""")
def _(spark, sf):
    g = pool.at_depths(hits(spark, sf), [10, 50]).groupBy("arm", F.col("depth").cast("long").alias("depth"), "doc_id").agg(F.count("*").alias("n"))
    return g.groupBy("arm", "depth").agg(F.sum("n").alias("candidates"), F.count("*").alias("docs"), F.count_if(F.col("n") > 1).alias("repeated_docs"), F.max("n").alias("most"))


@query("g8_method_diagnostics", f"""WITH {HITS}, p AS (SELECT arm, query_id, doc_id, count(*) AS n FROM ranked WHERE rank <= 50 GROUP BY ALL), s AS (SELECT arm, query_id, sum(n) AS rows, count(*) AS docs, max(n) AS most FROM p GROUP BY ALL)
SELECT arm, round(avg(docs / rows), 6) AS unique_share, max(most)::BIGINT AS most_per_doc, (SELECT round(avg(score), 4) FROM ranked r WHERE rank = 1 AND r.arm = s.arm) AS top1_score FROM s GROUP BY 1""")
def _(spark, sf):
    top = hits(spark, sf).where("rank <= 50")
    p = top.groupBy("arm", "query_id", "doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"))
    s = p.groupBy("arm", "query_id").agg(F.sum("n").alias("rows"), F.count("*").alias("docs"), F.max("n").alias("most"), F.max("first").alias("first"))
    return s.groupBy("arm").agg(F.round(F.avg(F.col("docs") / F.col("rows")), 6).alias("unique_share"), F.max("most").alias("most_per_doc"), F.round(F.avg("first"), 4).alias("top1_score"))


@query("g9_signal_summary", """WITH s AS (SELECT l_suppkey AS query_id, l_returnflag AS arm, l_linestatus AS signal FROM lineitem WHERE l_quantity >= 45)
SELECT arm, signal, count(*)::BIGINT AS n, count(DISTINCT query_id)::BIGINT AS queries FROM s GROUP BY ALL""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").where("l_quantity >= 45")
    return s.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("signal")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("queries"))


@query("g10_duplicate_texts", """WITH g AS (SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*)::BIGINT AS groups, coalesce(sum(n - 1), 0)::BIGINT AS beyond_first, count(*) FILTER (owners = 1)::BIGINT AS within_owner, count(*) FILTER (owners > 1)::BIGINT AS across_owners FROM g""")
def _(spark, sf):
    return stats.duplicate_text_stats(table(spark, sf, "documents"), "text", "source")


_MOVES = f"""WITH {POOL}, m AS (SELECT query_id, chunk_id, pool_rank AS before, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS after FROM pool), s AS (SELECT *, abs(before - after) AS step FROM m)
SELECT count(*) FILTER (after = 1 AND before <> 1)::BIGINT AS top1_changes, round(avg(step), 6) AS mean_step, {q('step', 0.5)} AS median_step, {q('step', 0.95)} AS p95_step, count(*) FILTER (after <= 10 AND before > 10)::BIGINT AS promoted FROM s"""


@query("g11_rerank_movement", _MOVES)
def _(spark, sf):
    after = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return stats.movement(scored_pool(spark, sf).select("query_id", F.col("pool_rank").alias("before"), after.alias("after")))


@query("g12_selection_summary", f"""WITH {POOL}, d AS (SELECT query_id, doc_id, count(*) AS n FROM pool GROUP BY ALL), s AS (SELECT query_id, count(*) AS docs, max(n) / sum(n)::DOUBLE AS share FROM d GROUP BY 1)
SELECT round(avg(docs), 6) AS mean_docs, min(docs)::BIGINT AS fewest, round(max(share), 6) AS concentration FROM s""")
def _(spark, sf):
    d = scored_pool(spark, sf).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    s = d.groupBy("query_id").agg(F.count("*").alias("docs"), (F.max("n") / F.sum("n")).alias("share"))
    return s.agg(F.round(F.avg("docs"), 6).alias("mean_docs"), F.min("docs").alias("fewest"), F.round(F.max("share"), 6).alias("concentration"))


@query("g13_score_margins", f"""WITH {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS p FROM pool)
SELECT query_id, max(score) FILTER (p = 1) AS best, round(max(score) FILTER (p = 1) - max(score) FILTER (p = 2), 6) AS margin FROM r WHERE p <= 2 GROUP BY 1""")
def _(spark, sf):
    return stats.margins(scored_pool(spark, sf))


@query("g14_source_metrics", """WITH d AS (SELECT source, d.doc_id, n_chars, coalesce(quality, 0) AS usable, ceil(n_chars / 1200.0) AS chunks FROM documents d LEFT JOIN labels USING (doc_id))
SELECT source, count(*)::BIGINT AS docs, round(avg(usable), 6) AS usable_rate, round(avg(chunks), 6) AS chunks_per_doc, round(avg(usable) * 10000, 2) AS usable_at_10k, round(avg(chunks) * 50000, 2) AS chunks_at_50k FROM d GROUP BY 1""")
def _(spark, sf):
    label = table(spark, sf, "labels").select("doc_id", "quality")
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars").join(label, "doc_id", "left").select("source", F.coalesce("quality", F.lit(0)).alias("usable"), F.ceil(F.col("n_chars") / 1200).alias("chunks"))
    return d.groupBy("source").agg(
        F.count("*").alias("docs"), F.round(F.avg("usable"), 6).alias("usable_rate"), F.round(F.avg("chunks"), 6).alias("chunks_per_doc"),
        F.round(F.avg("usable") * 10000, 2).alias("usable_at_10k"), F.round(F.avg("chunks") * 50000, 2).alias("chunks_at_50k"))


@query("g15_probe_summary", """SELECT source, string_agg(lang || '=' || n::VARCHAR, ',' ORDER BY lang) AS languages FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entry = F.sort_array(F.collect_list(F.struct("lang", F.concat("lang", F.lit("="), F.col("n").cast("string")).alias("e"))))
    return n.groupBy("source").agg(F.array_join(F.transform(entry, lambda x: x["e"]), ",").alias("languages"))


@query("g16_domain_inventory", f"""WITH h AS (SELECT {_HOST} AS host, page_id, html FROM pages), g AS (SELECT host, count(*) AS n, count(*) FILTER (contains(html, '<article>')) AS articles FROM h GROUP BY 1),
e AS (SELECT {_HOST} AS host, count(*) AS labelled FROM pages JOIN labels ON page_id = doc_id GROUP BY 1)
SELECT host, n::BIGINT AS n, articles::BIGINT AS articles, coalesce(labelled, 0)::BIGINT AS labelled, round(n / (SELECT sum(n) FROM g), 6) AS share FROM g LEFT JOIN e USING (host)""")
def _(spark, sf):
    p = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), F.col("page_id").alias("doc_id"), F.contains("html", F.lit("<article>")).alias("article"))
    known = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("known"))
    g = p.join(known, "doc_id", "left").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("article")).alias("articles"), F.count("known").alias("labelled"))
    return g.crossJoin(g.agg(F.sum("n").alias("total"))).select("host", "n", "articles", "labelled", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("g17_corpus_profile", f"""SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (text IS NULL)::BIGINT AS nulls, (count(*) - count(DISTINCT text))::BIGINT AS repeated, {q('length(text)', 0.5)} AS median,
  count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))::BIGINT AS control, count(*) FILTER (contains(text, chr(65533)))::BIGINT AS replaced FROM documents GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("len", F.length("text"))
    return d.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), (F.count("*") - F.count_distinct("text")).alias("repeated"), stats.linear("len", 0.5).alias("median"),
        F.count_if(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).alias("control"), F.count_if(F.col("text").contains("�")).alias("replaced"))


@query("g17_id_gaps", "SELECT count(*)::BIGINT AS gaps, coalesce(max(doc_id - before - 1), 0)::BIGINT AS widest FROM (SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS before FROM labels) WHERE doc_id - before > 1")
def _(spark, sf):
    return stats.id_gaps(table(spark, sf, "labels"), "doc_id", 1000)


@query("g18_mean_latency", f"SELECT event_type, round(avg(value), 4) AS mean, {q('value', 0.5)} AS median FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), stats.linear("value", 0.5).alias("median"))


@query("g19_ledger_summary", f"WITH {HITS}, l AS (SELECT query_id, doc_id, count(DISTINCT arm) AS arms FROM ranked WHERE rank <= 100 GROUP BY ALL) SELECT arms::BIGINT AS arms, count(*)::BIGINT AS pairs, count(DISTINCT query_id)::BIGINT AS queries FROM l GROUP BY 1")
def _(spark, sf):
    pair = hits(spark, sf).where("rank <= 100").groupBy("query_id", "doc_id").agg(F.count_distinct("arm").alias("arms"))
    return pair.groupBy("arms").agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))


@query("g21_output_duplicates", f"""WITH {POOL}, {CHUNKS}, t AS (SELECT query_id, chunk_id, chunk_text FROM pool JOIN chunks USING (chunk_id) WHERE pool_rank <= 40), g AS (SELECT query_id, chunk_text, count(*) AS n FROM t GROUP BY ALL)
SELECT query_id, sum(n * (n - 1) // 2)::BIGINT AS exact_pairs, count(*)::BIGINT AS texts FROM g GROUP BY 1""")
def _(spark, sf):
    t = scored_pool(spark, sf).where("pool_rank <= 40").join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id")
    g = t.groupBy("query_id", "chunk_text").agg(F.count("*").alias("n"))
    return g.groupBy("query_id").agg(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("exact_pairs"), F.count("*").alias("texts"))


@query("g22_source_composition", f"WITH {POOL} SELECT membership, count(*)::BIGINT AS n, count(*) FILTER (pool_rank <= 10)::BIGINT AS top10 FROM pool GROUP BY 1")
def _(spark, sf):
    return scored_pool(spark, sf).groupBy("membership").agg(F.count("*").alias("n"), F.count_if(F.col("pool_rank") <= 10).alias("top10"))


@query("e1_language_jaccard", r"""WITH t AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')) AS w FROM documents), n AS (SELECT lang, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.lang AS a, b.lang AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.lang < b.lang GROUP BY ALL) SELECT c.a, c.b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS jaccard FROM c JOIN n x ON x.lang = a JOIN n y ON y.lang = b""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.explode(text.words(F.col("text"))).alias("w")).distinct()
    n = t.groupBy("lang").agg(F.count("*").alias("n"))
    # one list of languages per word instead of a self-join on words
    held = t.groupBy("w").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    pairs = held.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    side = lambda k: n.select(F.col("lang").alias(k), F.col("n").alias(f"n{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("e2_ranking_comparison", f"""WITH {HITS}, {_DOCS}, s AS (SELECT query_id, arm, list(doc_id) FILTER (rank <= 10) AS top, list(doc_id) AS every, max(doc_id) FILTER (rank = 1) AS first FROM docs WHERE rank <= 50 GROUP BY ALL)
SELECT a.query_id, a.first = n.first AS same_first, round(len(list_intersect(a.top, n.top)) / len(list_distinct(list_concat(a.top, n.top)))::DOUBLE, 6) AS top_jaccard,
  round(len(list_intersect(a.every, n.every)) / len(list_distinct(list_concat(a.every, n.every)))::DOUBLE, 6) AS all_jaccard FROM s a JOIN s n USING (query_id) WHERE a.arm = 'A' AND n.arm = 'N'""")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf)).where("rank <= 50")
    return evaluate.compare_rankings(d.where("arm = 'A'"), d.where("arm = 'N'"), "doc_id", 10)


@query("e3_overlap_summary", f"""WITH {HITS}, {_DOCS}, j AS (SELECT a.query_id, a.rank AS ra, n.rank AS rn FROM docs a JOIN docs n USING (query_id, doc_id) WHERE a.arm = 'A' AND n.arm = 'N')
SELECT depth::BIGINT AS depth, count(DISTINCT query_id)::BIGINT AS queries, count(*)::BIGINT AS pairs FROM j, (SELECT unnest([10, 50, 1000]) AS depth) WHERE ra <= depth AND rn <= depth GROUP BY 1""")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    return evaluate.overlap_at(d.where("arm = 'A'"), d.where("arm = 'N'"), "doc_id", [10, 50, 1000])


@query("e4_retention", f"""WITH {HITS}, {_DOCS}, p AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'A' AND rank <= 10), c AS (SELECT query_id, doc_id, min(rank) AS rank FROM docs WHERE arm IN ('N', 'R') GROUP BY ALL)
SELECT depth::BIGINT AS depth, count(*)::BIGINT AS pairs, count(*) FILTER (rank <= depth)::BIGINT AS held, round(avg(coalesce(rank <= depth, false)::INT), 6) AS rate FROM p LEFT JOIN c USING (query_id, doc_id), (SELECT unnest([10, 50, 200]) AS depth) GROUP BY 1""")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    return evaluate.retention(d.where("arm = 'A' and rank <= 10"), d.where("arm in ('N', 'R')"), ["query_id", "doc_id"], [10, 50, 200])


@query("e5_budget_retention", f"""WITH {bm25_sql('1')}, r AS (SELECT doc_id, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 100 GROUP BY 1)
SELECT quality::BIGINT AS quality, count(*)::BIGINT AS docs, count(*) FILTER (coalesce(rank, 101) <= 20)::BIGINT AS held FROM labels LEFT JOIN r USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    r = bm25(spark, sf, 100, distinct=True).groupBy("doc_id").agg(F.min("rank").alias("rank"))
    j = table(spark, sf, "labels").join(r, "doc_id", "left")
    return j.groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("docs"), F.count_if(F.coalesce("rank", F.lit(101)) <= 20).alias("held"))


def _positives(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    return d.where("arm = 'R' and rank = 1").select("query_id", "doc_id"), d.where("arm = 'A'")


@query("e7_known_positive", f"""WITH {HITS}, {_DOCS}, p AS (SELECT query_id, doc_id FROM docs WHERE arm = 'R' AND rank = 1), b AS (SELECT query_id, doc_id, min(r.rank) AS rank FROM p LEFT JOIN (SELECT * FROM docs WHERE arm = 'A') r USING (query_id, doc_id) GROUP BY ALL)
SELECT count(*)::BIGINT AS queries, round(avg(coalesce(rank <= 20, false)::INT), 6) AS recall_20, round(avg(coalesce(rank <= 100, false)::INT), 6) AS recall_100, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(rank)::BIGINT AS covered FROM b""")
def _(spark, sf):
    positives, ranking = _positives(spark, sf)
    return evaluate.known_positive(ranking.select("query_id", "doc_id", "rank"), positives)


@query("e6_partial_pairs", f"""WITH {HITS}, {_DOCS}, p AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'R' AND rank <= 5), r AS (SELECT query_id, doc_id, rank FROM docs WHERE arm = 'A')
SELECT count(*) FILTER (rank <= 20)::BIGINT AS at_20, count(*) FILTER (rank <= 100)::BIGINT AS at_100, count(*)::BIGINT AS pairs FROM p LEFT JOIN r USING (query_id, doc_id)""")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    p = d.where("arm = 'R' and rank <= 5").select("query_id", "doc_id").distinct().join(d.where("arm = 'A'").select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return p.agg(F.count_if(F.col("rank") <= 20).alias("at_20"), F.count_if(F.col("rank") <= 100).alias("at_100"), F.count("*").alias("pairs"))


@query("e8_judged_units", """WITH u AS (SELECT lang, d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT lang, count(quality)::BIGINT AS judged, CASE WHEN count(*) FILTER (quality = 1) > 0 THEN round(avg(CASE WHEN quality = 1 THEN (toxic = 0)::INT END), 6) END AS clean_rate, bool_and(quality IS NOT NULL) AS fully_judged FROM u GROUP BY 1""")
def _(spark, sf):
    u = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return u.groupBy("lang").agg(
        F.count("quality").alias("judged"), F.round(F.avg(F.when(F.col("quality") == 1, (F.col("toxic") == 0).cast("int"))), 6).alias("clean_rate"), F.every(F.col("quality").isNotNull()).alias("fully_judged"))


@query("e9_inversions", f"""WITH {HITS}, {_DOCS}, b AS (SELECT query_id, doc_id, a.rank AS ra, n.rank AS rb FROM docs a JOIN docs n USING (query_id, doc_id) WHERE a.arm = 'A' AND n.arm = 'N' AND a.rank <= 100 AND n.rank <= 100)
SELECT x.query_id, count(*)::BIGINT AS pairs, count(*) FILTER (x.rb > y.rb)::BIGINT AS inverted FROM b x JOIN b y ON x.query_id = y.query_id AND x.ra < y.ra GROUP BY 1""")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf)).where("rank <= 100")
    return evaluate.inversions(d.where("arm = 'A'"), d.where("arm = 'N'"), "doc_id")


_OLDNEW = f"WITH {HITS}, {_DOCS}, old AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'A' AND rank <= 20), new AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm IN ('A', 'N') AND rank <= 15)"


@query("e10_output_difference", f"{_OLDNEW} SELECT query_id, doc_id, 'retained' AS change FROM old SEMI JOIN new USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, 'displaced' FROM old ANTI JOIN new USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, 'inserted' FROM new ANTI JOIN old USING (query_id, doc_id)")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    pair = lambda x: x.select("query_id", "doc_id").distinct()
    return evaluate.difference(pair(d.where("arm = 'A' and rank <= 20")), pair(d.where("arm in ('A', 'N') and rank <= 15")), ["query_id", "doc_id"])


@query("e11_corpus_difference", """WITH o AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0), c AS (SELECT doc_id, 'retained' AS change FROM (SELECT * FROM o INTERSECT SELECT * FROM n)
  UNION ALL SELECT doc_id, 'displaced' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT doc_id, 'inserted' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) SELECT lang, change, count(*)::BIGINT AS n FROM c JOIN documents USING (doc_id) GROUP BY ALL""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    # the two corpora of the test are whole rules over ids, not samples of one
    change = evaluate.difference(d.where("doc_id % 3 <> 0").select("doc_id"), d.where("doc_id % 4 <> 0").select("doc_id"), ["doc_id"])
    return change.join(d, "doc_id").groupBy("lang", "change").agg(F.count("*").alias("n"))


@query("e12_slot_attribution", f"WITH {POOL} SELECT pool_rank AS slot, membership, count(*)::BIGINT AS n FROM pool WHERE pool_rank <= 20 GROUP BY ALL")
def _(spark, sf):
    return scored_pool(spark, sf).where("pool_rank <= 20").groupBy(F.col("pool_rank").alias("slot"), "membership").agg(F.count("*").alias("n"))


@query("e13_paired_transitions", "SELECT quality::BIGINT AS quality, count(*) FILTER (toxic = 0)::BIGINT AS toxic_0, count(*) FILTER (toxic = 1)::BIGINT AS toxic_1 FROM labels GROUP BY 1")
def _(spark, sf):
    t = table(spark, sf, "labels").groupBy(F.col("quality").cast("long").alias("quality")).pivot("toxic", [0, 1]).count()
    return t.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("e14_failure_funnel", """SELECT stage, count(*)::BIGINT AS n FROM (SELECT CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN quality IS NULL THEN 'unjudged' WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' ELSE 'usable' END AS stage
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    stage = (F.when(F.length(F.trim("text")) == 0, "empty").when(F.col("n_chars") < 200, "short").when(F.col("quality").isNull(), "unjudged").when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("usable"))
    return d.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("e15_group_coverage", """SELECT doc_id, contains(lower(text), 'licens') AS has_legal, contains(lower(text), 'tion') OR contains(lower(text), 'ing') AS has_suffix, contains(lower(text), 'licens') AND (contains(lower(text), 'tion') OR contains(lower(text), 'ing')) AS has_all FROM documents""")
def _(spark, sf):
    return evaluate.coverage_groups(table(spark, sf, "documents").select("doc_id", "text"), "text", {"legal": ["licens"], "suffix": ["tion", "ing"]}).drop("text")


@query("e17_score_equivalence", f"""WITH {HITS}, a AS (SELECT query_id, chunk_id, score FROM ranked WHERE arm = 'A'), b AS (SELECT query_id, chunk_id, round(score, 0) AS score FROM ranked WHERE arm = 'A' AND rank <= 150),
j AS (SELECT query_id, chunk_id, a.score AS sa, b.score AS sb FROM a FULL JOIN b USING (query_id, chunk_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC NULLS LAST, chunk_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY sb DESC NULLS LAST, chunk_id) AS rb FROM j)
SELECT count(*)::BIGINT AS rows, count(*) FILTER (sa IS NULL OR sb IS NULL)::BIGINT AS missing, round(max(abs(sa - sb)), 6) AS largest, count(*) FILTER (ra <> rb)::BIGINT AS moved, max(abs(sa - sb)) <= 0.5 AS within FROM r""")
def _(spark, sf):
    a = arm(spark, sf, "A")
    return evaluate.score_equivalence(a, a.where("rank <= 150").withColumn("score", F.round("score", 0)), 0.5)


@query("e18_query_outcomes", f"""WITH {HITS}, {_DOCS}, p AS (SELECT query_id, doc_id FROM docs WHERE arm = 'R' AND rank = 1), r AS (SELECT query_id, doc_id, rank FROM docs WHERE arm = 'A'), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1)
SELECT query_id, rank, CASE WHEN n IS NULL THEN 'no_results' WHEN rank IS NULL THEN 'not_found' WHEN rank <= 20 THEN 'found' ELSE 'deep' END AS outcome FROM p LEFT JOIN r USING (query_id, doc_id) LEFT JOIN n USING (query_id)""")
def _(spark, sf):
    positives, r = _positives(spark, sf)
    r = r.select("query_id", "doc_id", "rank")
    j = positives.join(r, ["query_id", "doc_id"], "left").join(r.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    return j.select("query_id", "rank", F.when(F.col("n").isNull(), "no_results").when(F.col("rank").isNull(), "not_found").when(F.col("rank") <= 20, "found").otherwise("deep").alias("outcome"))


@query("e20_proxy_sets", f"WITH {HITS}, {_DOCS} SELECT doc_id, count(DISTINCT query_id)::BIGINT AS queries, bool_or(rank <= 3) AS in_top3, bool_or(rank <= 5) AS in_top5 FROM docs WHERE rank <= 10 GROUP BY 1 HAVING count(DISTINCT query_id) >= 2")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf)).where("rank <= 10")
    return d.groupBy("doc_id").agg(F.count_distinct("query_id").alias("queries"), F.bool_or(F.col("rank") <= 3).alias("in_top3"), F.bool_or(F.col("rank") <= 5).alias("in_top5")).where("queries >= 2")


def _h(seed, key):
    return f"sha256('{seed}:' || {key}::VARCHAR)[1:16]"


@query("m1_sample_per_source", f"SELECT source, doc_id, rank, population FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('m1', 'doc_id')}, doc_id)::BIGINT AS rank, count(*) OVER (PARTITION BY source)::BIGINT AS population FROM documents) WHERE rank <= 5")
def _(spark, sf):
    return sample.per_group(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", "m1", 5)


@query("m2_sample_overall", f"SELECT doc_id FROM documents ORDER BY {_h('m2', 'doc_id')}, doc_id LIMIT 100")
def _(spark, sf):
    return sample.overall(table(spark, sf, "documents").select("doc_id"), "doc_id", "m2", 100)


_RULES = "WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN lang = 'fr' THEN 'french' END, CASE WHEN n_chars > 3000 THEN 'long' END], lambda x: x IS NOT NULL)) AS rule FROM documents)"


@query("m3_rule_quotas", f"{_RULES}, p AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY {_h('m3', 'doc_id')}, doc_id) AS p FROM r) SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM p WHERE p <= CASE rule WHEN 'french' THEN 20 ELSE 30 END GROUP BY 1")
def _(spark, sf):
    return sample.by_rules(table(spark, sf, "documents"), "doc_id", {"french": (F.col("lang") == "fr", 20), "long": (F.col("n_chars") > 3000, 30)}, "m3")


@query("m4_sample_excluding_known", f"SELECT source, doc_id, rank, population FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('m4', 'doc_id')}, doc_id)::BIGINT AS rank, count(*) OVER (PARTITION BY source)::BIGINT AS population FROM documents ANTI JOIN labels USING (doc_id)) WHERE rank <= 3")
def _(spark, sf):
    return sample.excluding(table(spark, sf, "documents").select("source", "doc_id"), table(spark, sf, "labels"), "doc_id", "source", "m4", 3)


@query("m5_stratified_round_robin", f"""WITH s AS (SELECT doc_id, lang, source, lang || '|' || source AS s FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_h('m5', 'doc_id')}, doc_id) AS t FROM s)
SELECT doc_id, lang, source FROM t ORDER BY t, {_h('m5', 's')}, doc_id LIMIT 100""")
def _(spark, sf):
    return sample.round_robin_strata(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "m5", 100)


@query("m6_largest_remainder", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, n * 97 / (SELECT sum(n) FROM n)::DOUBLE AS x FROM n), b AS (SELECT *, floor(x) AS base, round(x - floor(x), 9) AS rest FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS p FROM b) SELECT lang, n::BIGINT AS n, (base + CASE WHEN p <= 97 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END)::BIGINT AS quota FROM p""")
def _(spark, sf):
    return sample.largest_remainder(table(spark, sf, "documents"), "lang", 97)


@query("m7_topic_round_robin", f"""WITH t AS (SELECT item_id, CASE WHEN contains(lower(text), 'tion') THEN 'a' WHEN contains(lower(text), 'eau') THEN 'b' ELSE 'c' END AS topic FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_h('m7', 'item_id')}, item_id) AS t FROM t)
SELECT item_id, topic FROM r ORDER BY t, {_h('m7', 'topic')}, item_id LIMIT 12""")
def _(spark, sf):
    topic = text.first_category(F.col("text"), {"a": ["tion"], "b": ["eau"]}, "c")
    return sample.round_robin_strata(table(spark, sf, "benchmark").select("item_id", topic.alias("topic")), ["topic"], "item_id", "m7", 12)


@query("m8_evenly_spaced", """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY length(text), item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), k AS (SELECT DISTINCT round_even(j * (n - 1) / 10.0, 0)::INT AS i FROM r, range(11) t(j)) SELECT item_id FROM r WHERE i IN (SELECT i FROM k)""")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.length("text").alias("len"))
    return sample.evenly_spaced(b, ["len", "item_id"], 11).select("item_id")


@query("m9_balanced_groups", """SELECT part, source, count(*)::BIGINT AS n FROM (SELECT source, ((row_number() OVER (ORDER BY source, doc_id) - 1) % 3)::BIGINT AS part FROM documents) GROUP BY ALL""")
def _(spark, sf):
    return sample.balanced_groups(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3).groupBy("part", "source").agg(F.count("*").alias("n"))


@query("m11_one_per_stratum", f"SELECT lang, source, arg_min(doc_id, {_h('m11', 'doc_id')}) AS doc_id FROM documents GROUP BY ALL")
def _(spark, sf):
    return sample.one_per_stratum(table(spark, sf, "documents"), ["lang", "source"], "doc_id", "m11")


@query("n1_nested_prefix_sample", f"""WITH c AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('n1', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 3),
k AS (SELECT source, doc_id, doc_id IN (SELECT doc_id FROM c) AS kept FROM documents) SELECT source, doc_id, kept, row_number() OVER w::BIGINT AS rank FROM k WINDOW w AS (PARTITION BY source ORDER BY NOT kept, {_h('n1', 'doc_id')}, doc_id) QUALIFY row_number() OVER w <= 8""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return sample.nested(d, sample.per_group(d, "source", "doc_id", "n1", 3), "doc_id", "source", "n1", 8)


@query("q1_document_audit", """WITH f AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT count(*) FILTER (f.doc_id IS NULL)::BIGINT AS missing, count(*) FILTER (d.doc_id IS NULL)::BIGINT AS unexpected, count(*) FILTER (n > 1)::BIGINT AS repeated FROM f FULL JOIN documents d USING (doc_id)""")
def _(spark, sf):
    return audit.id_audit(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query("q3_provenance_closure", f"""WITH {HITS}, {CHUNKS} SELECT count(*)::BIGINT AS rows, count(*) FILTER (c.chunk_id IS NULL)::BIGINT AS no_chunk, count(*) FILTER (c.doc_id <> r.doc_id)::BIGINT AS wrong_owner,
  count(*) FILTER (p.p_partkey IS NULL)::BIGINT AS no_document, count(*) FILTER (p.p_partkey IS NULL OR p_size < 5)::BIGINT AS not_official FROM ranked r LEFT JOIN chunks c USING (chunk_id) LEFT JOIN part p ON r.doc_id = p_partkey""")
def _(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), "p_size")
    return audit.closure(hits(spark, sf), chunks(spark, sf), docs, docs.where("p_size >= 5"))


@query("q4_score_cache_audit", f"""WITH {HITS}, s AS (SELECT query_id, chunk_id, score FROM ranked WHERE rank <= 50), e AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE arm IN ('A', 'N') AND rank <= 60), o AS (SELECT query_id, chunk_id, count(*) AS n, max(score) AS score FROM s GROUP BY ALL)
SELECT count(*) FILTER (o.n IS NULL)::BIGINT AS missing, count(*) FILTER (e.query_id IS NULL)::BIGINT AS unexpected, count(*) FILTER (n > 1)::BIGINT AS repeated, 0::BIGINT AS not_finite, count(DISTINCT score)::BIGINT AS distinct_scores FROM o FULL JOIN e USING (query_id, chunk_id)""")
def _(spark, sf):
    found = hits(spark, sf)
    return audit.score_audit(found.where("rank <= 50").select("query_id", "chunk_id", "score"), found.where("arm in ('A', 'N') and rank <= 60"))


@query("q5_reuse_audit", f"WITH {HITS}, c AS (SELECT query_id, chunk_id, max(score) AS score FROM hits GROUP BY ALL) SELECT arm, count(*)::BIGINT AS n, count(*) FILTER (ranked.score = c.score)::BIGINT AS reused FROM ranked JOIN c USING (query_id, chunk_id) GROUP BY 1")
def _(spark, sf):
    best = best_scores(spark, sf).withColumnRenamed("score", "best")
    return hits(spark, sf).join(best, ["query_id", "chunk_id"]).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("score") == F.col("best")).alias("reused"))


_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')"


@query("q6_document_flags", rf"""WITH p AS (SELECT doc_id, text, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
w AS (SELECT *, list_transform(ps, lambda x: list_distinct({_W.format('x')})) AS ws FROM p), j AS (SELECT *, list_transform(range(1, len(ws)), lambda i: len(list_intersect(ws[i], ws[i + 1])) / greatest(1, len(list_distinct(list_concat(ws[i], ws[i + 1]))))::DOUBLE) AS js FROM w)
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN regexp_matches(text, '<[a-zA-Z/][^>]*>') THEN 'markup' END, CASE WHEN len(ps) - len(list_distinct(ps)) >= 0.2 * len(ps) THEN 'repeated' END,
  CASE WHEN len(list_filter(js, lambda x: x >= 0.9)) > 0 THEN 'adjacent_copies' END, CASE WHEN length(text) > 20000 THEN 'large' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement' END, CASE WHEN lang IS NULL THEN 'no_language' END], lambda x: x IS NOT NULL), ',') AS flags FROM j""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(audit.document_flags(F.col("text"), F.col("lang")), ",").alias("flags"))


@query("q7_identity_conflicts", "SELECT o_custkey::BIGINT AS o_custkey, count(DISTINCT o_orderpriority)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _(spark, sf):
    return audit.conflicts(table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("long")), "o_custkey", "o_orderpriority")


@query("q8_technical_triage", "SELECT source, round(avg((n_chars >= 500)::INT), 6) AS usable_rate, avg((n_chars >= 500)::INT) >= 0.8 AS healthy FROM documents GROUP BY 1")
def _(spark, sf):
    rate = F.avg((F.col("n_chars") >= 500).cast("int"))
    return table(spark, sf, "documents").groupBy("source").agg(F.round(rate, 6).alias("usable_rate"), (rate >= 0.8).alias("healthy"))


@query("q9_short_qa", "SELECT conv_id, turn, length(text)::BIGINT AS n_chars FROM conversations WHERE role = 'assistant' AND length(text) BETWEEN 80 AND 400")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    return c.where("role = 'assistant' and n_chars between 80 and 400").select("conv_id", "turn", "n_chars")


@query("q10_gate_verdicts", "SELECT source, CASE WHEN r >= 0.55 THEN 'strong' WHEN r >= 0.4 THEN 'promising' WHEN r >= 0.25 THEN 'weak' ELSE 'blocked' END AS verdict FROM (SELECT source, round(avg((quality = 1)::INT), 9) AS r FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    r = d.groupBy("source").agg(F.round(F.avg((F.col("quality") == 1).cast("int")), 9).alias("r"))
    return r.select("source", audit.verdict(F.col("r"), [(0.55, "strong"), (0.4, "promising"), (0.25, "weak")], "blocked").alias("verdict"))


@query("q12_split_leakage", r"""WITH b AS (SELECT array_to_string(list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*'), 1, 2), ' ') AS normal, source AS split FROM documents) SELECT normal, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS n FROM b GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    normal = F.array_join(F.slice(text.words(F.col("text")), 1, 2), " ")
    return audit.split_leakage(table(spark, sf, "documents"), normal, "source")
