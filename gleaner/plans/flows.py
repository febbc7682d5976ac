"""Queries over ingestion, corpus assembly, cached scores and lexicon retrieval."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import hashing, vectors
from gleaner.operators import concepts, fuse, pool, retrieve, sample, select
from gleaner.plans.pools import POOL, scored_pool
from gleaner.plans.registry import CHUNKS, HITS, bm25_sql, query
from gleaner.plans.retrieval import _DENSE, _DOCS, bm25, chunks, dense, hits
from gleaner.session import scratch_dir, table
from gleaner.sources import tables
from gleaner.streaming import ingest

_EV = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) AS p FROM events"


@query("z1_stream_ingest", f"SELECT user_id, event_id, event_type FROM ({_EV}) WHERE p = 1")
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/[e]vents.parquet")  # a pattern reads a file or a folder alike
    path = scratch_dir(spark, "stream")
    merge = functools.partial(ingest.monotone, key="user_id", success=F.col("event_type") == "purchase", order=["event_id"])
    return ingest.run_available(stream, ingest.VersionedTable(spark, f"{path}/table"), merge, f"{path}/checkpoint")


@query("z1_stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    """Hourly windows over the stream; the last state of every window is kept."""
    events = table(spark, sf, "events").select("ts", "event_type", "value")
    path = scratch_dir(spark, "windows")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.tumbling(stream, "1 hour", "1 day")

    target = ingest.VersionedTable(spark, f"{path}/table")

    def each(batch, number):
        target.replace(batch.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total")), number)

    counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return target.read()


@query("z2_spaced_starts", "WITH i AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS i FROM events) SELECT user_id, event_id, arrived, (i * 1000000 + max(arrived - i * 1000000) OVER (PARTITION BY user_id ORDER BY arrived, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS start FROM i")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("arrived"))
    return ingest.spaced_starts(e, "user_id", "arrived", ["event_id"], 1_000_000)


@query("z3_monotone_upsert", f"SELECT user_id, event_id, event_type, value FROM ({_EV}) WHERE p = 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return ingest.monotone(e, "user_id", F.col("event_type") == "purchase", ["event_id"])


@query("z4_pending", "WITH s AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'SUCCESS' WHEN page_id % 4 = 1 THEN 'TIMEOUT' ELSE 'NOT_FOUND' END AS status FROM pages) SELECT doc_id AS id FROM documents LEFT JOIN s ON id = doc_id WHERE status IS NULL OR status = 'TIMEOUT'")
def _(spark, sf):
    q = F.col("page_id") % 4
    done = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(q == 0, "SUCCESS").when(q == 1, "TIMEOUT").otherwise("NOT_FOUND").alias("status"))
    return ingest.pending(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), done, "id")


@query("z5_unfinished_parts", "SELECT (doc_id // 64)::BIGINT AS part, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING part NOT IN (SELECT page_id // 64 FROM pages)")
def _(spark, sf):
    done = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 64).cast("long").alias("part"), F.lit("v1").alias("signature")).distinct()
    return ingest.unfinished_parts(table(spark, sf, "documents"), done, 64, "doc_id", "v1")


@query("z11_response_cache", "SELECT count(*) FILTER (page_id % 3 <> 0)::BIGINT AS answered, count(*) FILTER (page_id % 3 = 0)::BIGINT AS to_ask FROM pages")
def _(spark, sf):
    requests = table(spark, sf, "pages").select("url", "page_id")
    cache = requests.where("page_id % 3 <> 0").select(F.sha2(F.to_json(F.struct("page_id", "url")), 256).alias("fingerprint"))
    found, missing = ingest.cached_or_missing(requests, cache)
    return found.agg(F.count("*").alias("answered")).crossJoin(missing.agg(F.count("*").alias("to_ask")))


@query("z12_aligned_merge", f"WITH {HITS} SELECT query_id, sum((arm = 'A')::INT)::BIGINT AS n_a, sum((arm = 'N')::INT)::BIGINT AS n_n, count(DISTINCT chunk_id)::BIGINT AS chunks FROM ranked WHERE rank <= 50 GROUP BY 1")
def _(spark, sf):
    h = hits(spark, sf).where("rank <= 50")
    return h.groupBy("query_id").agg(F.count_if(F.col("arm") == "A").alias("n_a"), F.count_if(F.col("arm") == "N").alias("n_n"), F.count_distinct("chunk_id").alias("chunks"))


@query("session_windows", "WITH g AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s")
def _(spark, sf):
    w = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("r7_two_phase_dense", f"WITH {_DENSE} SELECT query_id, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::BIGINT AS rank FROM dense) WHERE rank <= 5")
def _(spark, sf):
    """Top-k of each block of vectors, then of the blocks' winners."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = v.join(q, F.lit(True)).select("query_id", F.col("vec_id").alias("doc"), F.round(vectors.dot(F.col("q"), F.col("embedding")), 12).alias("score"))
    local = retrieve.top_k(scored.withColumn("block", F.col("doc") % 8), 5, ["query_id", "block"], F.desc("score"), F.col("doc")).drop("rank")
    return retrieve.top_k(local, 5, ["query_id"], F.desc("score"), F.col("doc")).select("query_id", "doc", "rank")


GROUPS = {"topic": ["tion"], "place": ["eau", "ing"], "answer": ["licens", "est "]}
_HIT = "contains(lower(text), 'tion') AS hit_topic, contains(lower(text), 'eau') OR contains(lower(text), 'ing') AS hit_place, contains(lower(text), 'licens') OR contains(lower(text), 'est ') AS hit_answer"


@query("r12_concept_gates", f"""WITH {bm25_sql('1')}, c AS (SELECT doc_id, {_HIT} FROM documents), j AS (SELECT *, (hit_topic::INT + hit_place::INT + hit_answer::INT)::BIGINT AS n_hits FROM bm25 JOIN c USING (doc_id))
SELECT query_id, doc_id, n_hits, n_hits = 3 AS direct, row_number() OVER w::BIGINT AS rank FROM j WHERE n_hits > 0 WINDOW w AS (PARTITION BY query_id ORDER BY (n_hits = 3 AND hit_answer) DESC, (hit_topic AND hit_answer) DESC, n_hits DESC, score DESC, doc_id) QUALIFY row_number() OVER w <= 20""")
def _(spark, sf):
    marked = concepts.concept_hits(table(spark, sf, "documents").select("doc_id", "text"), "text", GROUPS).drop("text")
    terms = bm25_all(spark, sf)
    out = concepts.gated(terms.join(marked, "doc_id").withColumn("chunk_id", F.col("doc_id")), list(GROUPS), "topic", "answer", 20)
    return out.select("query_id", "doc_id", "n_hits", "direct", "rank")


def bm25_all(spark, sf):
    from gleaner.plans.retrieval import corpus_index, passages

    terms = passages(spark, sf, distinct=True)
    return retrieve.bm25_scores(corpus_index(spark, sf, vocabulary=terms), terms).withColumnRenamed("doc", "doc_id")


@query("r13_admission_reasons", f"""WITH {bm25_sql('1')}, b AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20), q AS (SELECT item_id AS query_id FROM benchmark),
c AS (SELECT query_id, doc_id, contains(lower(text), 'licens') AS entity, contains(lower(text), 'version') AS relation FROM documents, q WHERE contains(lower(text), 'licens')), j AS (SELECT query_id, doc_id, entity, relation, score FROM c FULL JOIN b USING (query_id, doc_id))
SELECT query_id, doc_id, array_to_string(list_filter([CASE WHEN entity THEN 'entity' END, CASE WHEN relation THEN 'relation' END, CASE WHEN score IS NOT NULL THEN 'lexical' END], lambda x: x IS NOT NULL), '+') AS reasons, row_number() OVER w::BIGINT AS rank
FROM j WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(entity, false) DESC, coalesce(score, 0) DESC, doc_id) QUALIFY row_number() OVER w <= 30""")
def _(spark, sf):
    low = F.lower("text")
    marked = table(spark, sf, "documents").select("doc_id", low.contains("licens").alias("entity"), low.contains("version").alias("relation")).where("entity")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    out = concepts.admitted(marked.join(q, F.lit(True)), bm25(spark, sf, 20, distinct=True).drop("rank"), 30)
    return out.select("query_id", "doc_id", F.array_join("reasons", "+").alias("reasons"), "rank")


@query("r14_first_per_owner", f"WITH {bm25_sql('1')}, o AS (SELECT query_id, source, max(score) AS score FROM bm25 JOIN documents USING (doc_id) GROUP BY ALL) SELECT query_id, source, score, row_number() OVER w::BIGINT AS rank FROM o WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source) QUALIFY row_number() OVER w <= 10")
def _(spark, sf):
    owned = bm25_all(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    best = owned.groupBy("query_id", "source").agg(F.max("score").alias("score"))
    return retrieve.top_k(best, 10, ["query_id"], F.desc("score"), F.col("source"))


@query("r15_concept_retrieval", f"SELECT doc_id, (hit_topic::INT + hit_place::INT + hit_answer::INT)::BIGINT AS n_hits FROM (SELECT doc_id, {_HIT} FROM documents) WHERE hit_topic OR hit_place OR hit_answer")
def _(spark, sf):
    marked = concepts.concept_hits(table(spark, sf, "documents").select("doc_id", "text"), "text", GROUPS)
    n = sum((F.col(f"hit_{g}").cast("int") for g in GROUPS), F.lit(0)).cast("long")
    return marked.select("doc_id", n.alias("n_hits")).where("n_hits > 0")


ALIASES = {"of the": "genitive", "the": "article", "and the": "conjunction", "in": "locative", "that": "relative"}


@query("r17_grounded_anchors")
def _(spark, sf):
    return concepts.anchors(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), ALIASES)


@query("r18_query_understanding")
def _(spark, sf):
    def run(frames):
        for pdf in frames:
            rows = [{"item_id": int(i), **concepts.understand(t, ALIASES, ("not", "no"))} for i, t in zip(pdf.item_id, pdf.text, strict=True)]
            yield pd.DataFrame([{**r, "concepts": ",".join(r["concepts"]), "n_residual": len(r["residual"])} for r in rows], columns=["item_id", "concepts", "polar", "n_residual"])

    return table(spark, sf, "benchmark").mapInPandas(run, "item_id long, concepts string, polar boolean, n_residual int")


@query("e16_record_equality", f"WITH {HITS}, {_DOCS}, a AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM docs WHERE arm = 'A' AND rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM docs WHERE arm = 'A' AND rank <= 5 + query_id % 2 GROUP BY 1) SELECT query_id, a.l = b.l AS equal FROM a JOIN b USING (query_id)")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf)).where("arm = 'A'")
    listed = lambda x, n: x.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias(n))
    return listed(d.where("rank <= 5"), "a").join(listed(d.where("rank <= 5 + query_id % 2"), "b"), "query_id").select("query_id", (F.col("a") == F.col("b")).alias("equal"))


@query("e19_overlap_with_exact")
def _(spark, sf):
    """How much of the exact top 10 a coarse search (signs of 16 of the dimensions) finds."""
    exact = dense(spark, sf, 10)
    v = table(spark, sf, "embeddings")
    coarse = F.transform(F.slice("embedding", 1, 16), lambda x: F.signum(x).cast("float"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), coarse.alias("q"))
    near = retrieve.dense_top_k(q, v.select(F.col("vec_id").alias("doc"), coarse.alias("v")), 10)
    both = exact.select("query_id", "doc").join(near.select("query_id", "doc", F.lit(1).alias("hit")), ["query_id", "doc"], "left")
    return both.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("overlap"))


@query("n2_priority_assembly", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'first' WHEN n_chars > 1000 THEN 'second' ELSE 'third' END AS origin FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    parts = {"first": d.where("lang = 'en'"), "second": d.where("n_chars > 1000"), "third": d}
    return tables.priority_assembly(parts, "doc_id", F.col("doc_id")).select("doc_id", "origin")


@query("n3_union_proof", "SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS old, count(*) FILTER (n_chars > 1000)::BIGINT AS new, count(*) FILTER (lang = 'en' AND n_chars > 1000)::BIGINT AS both, count(*) FILTER (lang = 'en' OR n_chars > 1000)::BIGINT AS union_size, true AS proved FROM documents GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    a = d.where("lang = 'en'").select("source", "doc_id", F.lit(1).alias("a"))
    b = d.where("n_chars > 1000").select("source", "doc_id", F.lit(1).alias("b"))
    every = a.join(b, ["source", "doc_id"], "full").groupBy("source").agg(F.count("a").alias("old"), F.count("b").alias("new"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("union_size"))
    return every.withColumn("proved", F.col("old") + F.col("new") - F.col("both") == F.col("union_size"))


@query("n4_score_store_union", f"WITH {HITS} SELECT query_id, chunk_id, max(score) AS score, min(score) <> max(score) AS conflict FROM ranked WHERE arm IN ('A', 'N') GROUP BY ALL")
def _(spark, sf):
    return hits(spark, sf).where("arm in ('A', 'N')").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), (F.min("score") != F.max("score")).alias("conflict"))


@query("n5_source_accounting", "WITH g AS (SELECT sha256(text) AS h, count(DISTINCT source) AS sources FROM documents GROUP BY 1) SELECT source, count(*)::BIGINT AS docs, count(*) FILTER (sources > 1)::BIGINT AS shared FROM documents JOIN g ON h = sha256(text) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    g = d.groupBy("h").agg(F.count_distinct("source").alias("sources"))
    return d.join(g, "h").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("sources") > 1).alias("shared"))


@query("n6_registry", """SELECT d.doc_id, array_to_string(list_filter([CASE WHEN p.page_id IS NOT NULL THEN 'page' END, CASE WHEN l.doc_id IS NOT NULL THEN 'label' END], lambda x: x IS NOT NULL), '+') AS arms,
  coalesce(p.url NOT LIKE '%/' || d.lang || '/%', false) AS url_mismatch, sha256(d.source || chr(0) || d.text) AS content_hash FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    lab = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("labelled"))
    j = d.join(p, "doc_id", "left").join(lab, "doc_id", "left")
    arms = F.array_compact(F.array(F.when(F.col("url").isNotNull(), F.lit("page")), F.when(F.col("labelled").isNotNull(), F.lit("label"))))
    mismatch = F.coalesce(~F.contains("url", F.concat(F.lit("/"), "lang", F.lit("/"))), F.lit(False))
    return j.select("doc_id", F.array_join(arms, "+").alias("arms"), mismatch.alias("url_mismatch"), hashing.joined_digest(F.col("source"), F.col("text")).alias("content_hash"))


@query("n7_question_answers", """WITH i AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations),
g AS (SELECT conv_id, island, max(text) FILTER (role = 'user') AS question, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user') AS answer FROM i WHERE island > 0 GROUP BY ALL) SELECT conv_id, island::BIGINT AS pair, length(question)::BIGINT AS question_chars, length(answer)::BIGINT AS answer_chars FROM g WHERE length(answer) >= 80""")
def _(spark, sf):
    island = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    i = table(spark, sf, "conversations").withColumn("pair", island).where("pair > 0")
    said = F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text"))))
    g = i.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("answer"))
    return g.select("conv_id", "pair", F.length("question").cast("long").alias("question_chars"), F.length("answer").cast("long").alias("answer_chars")).where("answer_chars >= 80")


@query("n9_stratified_reservoir", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('n9:' || doc_id::VARCHAR)[1:16], doc_id)::BIGINT AS rank, count(*) OVER (PARTITION BY lang)::BIGINT AS population FROM documents ANTI JOIN pages ON page_id = doc_id) SELECT lang, doc_id, rank, population FROM r WHERE rank <= 10")
def _(spark, sf):
    used = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return sample.excluding(table(spark, sf, "documents").select("lang", "doc_id"), used, "doc_id", "lang", "n9", 10)


@query("n10_length_sorted_batches", "WITH w AS (SELECT doc_id, n_chars, doc_id // 128 AS win FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n_chars DESC, doc_id) - 1 AS p FROM w) SELECT win::BIGINT AS win, (p // 16)::BIGINT AS batch, max(n_chars)::BIGINT AS longest, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def _(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 128).alias("win"))
    p = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("n_chars"), "doc_id")) - 1
    return w.withColumn("p", p).groupBy("win", F.floor(F.col("p") / 16).alias("batch")).agg(F.max("n_chars").alias("longest"), F.count("*").alias("n"))


@query("n11_candidate_audit", f"WITH {POOL}, c AS (SELECT query_id, count(*) AS n, count(DISTINCT chunk_id) AS d FROM pool GROUP BY 1) SELECT count(*)::BIGINT AS queries, count(*) FILTER (n = 100)::BIGINT AS full_pools, sum(n - d)::BIGINT AS repeated FROM c")
def _(spark, sf):
    c = scored_pool(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("d"))
    return c.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 100).alias("full_pools"), F.sum(F.col("n") - F.col("d")).alias("repeated"))


@query("n12_cache_probe", f"WITH {HITS} SELECT arm, count(*)::BIGINT AS n, bool_and(score IS NOT NULL) AS all_scored, bool_and(isfinite(score)) AS all_finite FROM ranked GROUP BY 1")
def _(spark, sf):
    c = F.col("score")
    return hits(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), F.every(c.isNotNull()).alias("all_scored"), F.every(~F.isnan(c) & (F.abs(c) < float("inf"))).alias("all_finite"))


@query("n13_absent_from_both", f"WITH {HITS} SELECT query_id, chunk_id FROM ranked a WHERE arm = 'A' AND NOT EXISTS (SELECT 1 FROM ranked b WHERE b.arm = 'N' AND b.query_id = a.query_id AND b.chunk_id = a.chunk_id) AND NOT EXISTS (SELECT 1 FROM ranked c WHERE c.arm = 'R' AND c.query_id = a.query_id AND c.chunk_id = a.chunk_id)")
def _(spark, sf):
    h = hits(spark, sf)
    a = h.where("arm = 'A'").select("query_id", "chunk_id")
    return pool.missing_scores(pool.missing_scores(a, h.where("arm = 'N'")), h.where("arm = 'R'"))


@query("n14_missing_diagnosis", "SELECT d.doc_id, d.lang, p.url, l.quality::BIGINT AS quality FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    gone = d.join(lab.where("quality = 1"), "doc_id", "left_anti").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return gone.join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").join(lab, "doc_id", "left")


@query("n15_best_competitor", f"WITH {HITS}, {_DOCS}, t AS (SELECT query_id, doc_id FROM docs WHERE arm = 'A' AND rank = 1), o AS (SELECT h.query_id, h.doc_id, h.chunk_id, max(score) AS score FROM hits h JOIN t ON h.query_id = t.query_id AND h.doc_id <> t.doc_id GROUP BY ALL) SELECT query_id, arg_min(chunk_id, struct_pack(a := -score, b := chunk_id)) AS chunk_id, max(score) AS score FROM o GROUP BY 1")
def _(spark, sf):
    top = fuse.documents_of(hits(spark, sf)).where("arm = 'A' and rank = 1").select("query_id", F.col("doc_id").alias("top"))
    rest = hits(spark, sf).join(top, "query_id").where("doc_id <> top")
    return rest.groupBy("query_id").agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("score"))


@query("n17_positive_retention", f"WITH {HITS}, {_DOCS}, p AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'R' AND rank <= 10), a AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'A' AND rank <= 20), n AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE arm = 'N' AND rank <= 20) SELECT (SELECT count(*) FROM p SEMI JOIN a USING (query_id, doc_id))::BIGINT AS before, (SELECT count(*) FROM p SEMI JOIN n USING (query_id, doc_id))::BIGINT AS after")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    p = d.where("arm = 'R' and rank <= 10").select("query_id", "doc_id").distinct()
    kept = lambda a, n: p.join(d.where(F.col("arm") == a).where("rank <= 20"), ["query_id", "doc_id"], "left_semi").agg(F.count("*").alias(n))
    return kept("A", "before").crossJoin(kept("N", "after"))


@query("n18_three_key_match", f"WITH {HITS}, {CHUNKS}, t AS (SELECT r.*, chunk_text FROM ranked r JOIN chunks USING (chunk_id)), x AS (SELECT query_id, t.doc_id, chunk_text, max(score) AS score FROM t WHERE arm = 'A' GROUP BY ALL), y AS (SELECT query_id, t.doc_id, chunk_text, max(score) AS score FROM t WHERE arm = 'N' GROUP BY ALL) SELECT query_id, doc_id, chunk_text, x.score = y.score AS agree FROM x JOIN y USING (query_id, doc_id, chunk_text)")
def _(spark, sf):
    t = hits(spark, sf).join(chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id")
    best = lambda a, n: t.where(F.col("arm") == a).groupBy("query_id", "doc_id", "chunk_text").agg(F.max("score").alias(n))
    return best("A", "x").join(best("N", "y"), ["query_id", "doc_id", "chunk_text"]).select("query_id", "doc_id", "chunk_text", (F.col("x") == F.col("y")).alias("agree"))


@query("n19_reused_or_default_scores", f"WITH {HITS}, s AS (SELECT query_id, chunk_id, score FROM ranked WHERE arm = 'N'), j AS (SELECT query_id, chunk_id, coalesce(s.score, -1000) AS score FROM (SELECT query_id, chunk_id FROM ranked WHERE arm = 'A') LEFT JOIN s USING (query_id, chunk_id)) SELECT query_id, chunk_id, score, row_number() OVER w::BIGINT AS rank FROM j WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= 10")
def _(spark, sf):
    h = hits(spark, sf)
    seeded = pool.seed_scores(h.where("arm = 'A'").select("query_id", "chunk_id"), [h.where("arm = 'N'")]).withColumn("score", F.coalesce("score", F.lit(-1000.0)))
    return retrieve.top_k(seeded, 10, ["query_id"], F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score", "rank")


@query("n21_url_targets", "SELECT page_id, CASE WHEN contains(lower(url), 'blog') OR contains(lower(url), 'news') THEN 1 WHEN contains(lower(url), 'casino') THEN 2 WHEN contains(lower(url), 'th') THEN 3 END::BIGINT AS query_id FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(url), 'news') OR contains(lower(url), 'casino') OR contains(lower(url), 'th')")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return concepts.url_targets(p, {1: ["blog", "news"], 2: ["casino"], 3: ["th"]}, "url").select("page_id", "query_id")


@query("n22_pooled_units", f"WITH {HITS}, {_DOCS}, u AS (SELECT DISTINCT query_id, doc_id FROM docs WHERE rank <= 10) SELECT query_id, doc_id, coalesce(min(rank) FILTER (arm = 'A'), 999)::BIGINT AS rank_a, coalesce(min(rank) FILTER (arm = 'N'), 999)::BIGINT AS rank_n, coalesce(min(rank) FILTER (arm = 'R'), 999)::BIGINT AS rank_r FROM u JOIN docs USING (query_id, doc_id) GROUP BY ALL")
def _(spark, sf):
    d = fuse.documents_of(hits(spark, sf))
    unit = d.where("rank <= 10").select("query_id", "doc_id").distinct()
    at = lambda a: F.coalesce(F.min(F.when(F.col("arm") == a, F.col("rank"))), F.lit(999)).cast("long").alias(f"rank_{a.lower()}")
    return unit.join(d, ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(at("A"), at("N"), at("R"))


@query("i9_flat_index", f"WITH {_DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM dense) SELECT query_id, doc FROM n WHERE r = 1")
def _(spark, sf):
    return dense(spark, sf, 1).select("query_id", "doc")


@query("m12_length_bucket_sample", "WITH b AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'a' WHEN n_chars < 2000 THEN 'b' ELSE 'c' END AS bucket FROM documents) SELECT bucket, doc_id, row_number() OVER w::BIGINT AS rank, count(*) OVER (PARTITION BY bucket)::BIGINT AS population FROM b WINDOW w AS (PARTITION BY bucket ORDER BY sha256('m12:' || doc_id::VARCHAR)[1:16], doc_id) QUALIFY row_number() OVER w <= 10")
def _(spark, sf):
    b = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "a").when(F.col("n_chars") < 2000, "b").otherwise("c").alias("bucket"))
    return sample.per_group(b, "bucket", "doc_id", "m12", 10)


@query("p24_coverage_review")
def _(spark, sf):
    """Review rows: one of each membership first, then strata in turn."""
    df = scored_pool(spark, sf).withColumn("minus", -F.col("score"))

    def rule(rows, k=8):
        seen, first = set(), []
        for r in rows:
            if r["membership"] not in seen:
                seen.add(r["membership"])
                first.append(r)
        rest = [r for r in rows if r not in first]
        return (first + rest)[:k]

    return select.fold_groups(df, ["query_id"], ["minus", "chunk_id"], rule, "query_id long, chunk_id long, membership string, position long")


@query("n16_review_queue")
def _(spark, sf):
    """Documents to review by source and quality, the id modulo 40 as their query, those without label preferred."""
    label = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").join(label, "doc_id", "left").select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("quality", F.lit(-1)).alias("quality"), (F.col("doc_id") % 40).alias("query_id"),
        F.concat_ws(":", hashing.hash_rank("n16", F.col("doc_id")), F.col("doc_id").cast("string")).alias("key"), F.col("quality").isNull().alias("development"))
    return sample.review_queue(docs, ["source", "quality"], "query_id", "key", "development", 16)


@query("g20_chunk_statistics", "SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (n_chars < 500)::BIGINT AS short, round(quantile_cont(n_chars, 0.5), 6) AS median, max(n_chars)::BIGINT AS longest FROM documents GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"), F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.max("n_chars").alias("longest"))


