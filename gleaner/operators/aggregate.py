"""From chunks to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.retrieve import top_k


def aggregate_documents(df: DataFrame, n: int, k: int, digits: int = 9) -> DataFrame:
    """Documents by the mean of their best ``n`` chunks (of those they have); ``n`` of 1 is the best chunk."""
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    best = df.withColumn("_p", place).where(F.col("_p") <= n)
    docs = best.groupBy("query_id", "doc_id").agg(
        F.round(F.avg("score"), digits).alias("doc_score"), F.min_by("chunk_id", "_p").alias("best_chunk"), F.count("*").alias("n_chunks"))
    return top_k(docs, k, ["query_id"], F.desc("doc_score"), F.col("doc_id"))


def ledger(hits: DataFrame, scores: DataFrame, arms: list[str], final: DataFrame) -> DataFrame:
    """One row per (query, document): ranks by arm, chunks, score means and whether the final list has it."""
    own = hits.groupBy("query_id", "doc_id", "arm").agg(F.min("rank").alias("rank"))
    ranks = own.groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_list("arm")).alias("arms"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", "rank"))))).alias("ranks_by_arm"), F.min("rank").alias("best_rank"))
    chunks = hits.groupBy("query_id", "doc_id").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_rows"))
    scored = hits.select("query_id", "doc_id", "chunk_id").distinct().join(scores, ["query_id", "chunk_id"], "left")
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc_nulls_last("score"), "chunk_id"))
    means = scored.withColumn("_p", place).groupBy("query_id", "doc_id").agg(
        F.max("score").alias("best"), F.round(F.avg(F.when(F.col("_p") <= 2, F.col("score"))), 6).alias("mean2"),
        F.round(F.avg(F.when(F.col("_p") <= 3, F.col("score"))), 6).alias("mean3"))
    flags = final.select("query_id", "doc_id", F.lit(True).alias("_in")).distinct()
    out = ranks.join(chunks, ["query_id", "doc_id"]).join(means, ["query_id", "doc_id"], "left").join(flags, ["query_id", "doc_id"], "left")
    return out.withColumn("in_final", F.coalesce("_in", F.lit(False))).withColumn("duplicate_rows", F.col("n_rows") - F.col("n_chunks")).drop("_in", "n_rows")


def quality_reasons(df: DataFrame, text: str) -> DataFrame:
    """Why a fragment is weak evidence: an array of reasons, empty for a good one."""
    c = F.col(text)
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    reasons = F.array(
        F.when(F.length(F.trim(c)) < 200, F.lit("short")), F.when(words < 20, F.lit("few_words")),
        F.when(letters < 0.5 * F.length(c), F.lit("few_letters")), F.when(F.regexp_count(c, F.lit(r"[#*$%&|<>]")) > 0.02 * F.length(c), F.lit("symbols")),
        F.when(F.regexp_count(c, F.lit(r"\|")) >= 5, F.lit("menu")))
    return df.withColumn("reasons", F.array_compact(reasons))
