"""Packaging: one record per query, and its strict validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.retrieve import first_per


def ordered_documents(docs: DataFrame, depth: int) -> DataFrame:
    """(query_id, relevant_docs): document ids by (rank, id), up to ``depth``."""
    top = docs.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("_p") <= depth)
    listed = F.sort_array(F.collect_list(F.struct("_p", "doc_id")))
    return top.groupBy("query_id").agg(F.transform(listed, lambda x: x["doc_id"]).alias("relevant_docs"))


def ordered_chunks(chunks: DataFrame, depth: int) -> DataFrame:
    """(query_id, relevant_chunks): without repeated chunks or repeated (document, text), by rank."""
    once = first_per(chunks.withColumnRenamed("rank", "_r"), ["query_id", "chunk_id"], F.col("_r"))
    once = first_per(once, ["query_id", "doc_id", "chunk_text"], F.col("_r"), F.col("chunk_id"))
    top = once.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "chunk_id"))).where(F.col("_p") <= depth)
    listed = F.sort_array(F.collect_list(F.struct("_p", "doc_id", "chunk_text")))
    return top.groupBy("query_id").agg(F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["chunk_text"].alias("chunk_text"))).alias("relevant_chunks"))


def records(queries: DataFrame, docs: DataFrame, chunks: DataFrame, n_docs: int, n_chunks: int) -> DataFrame:
    """One record per query, lists empty where there is nothing."""
    d, c = ordered_documents(docs, n_docs), ordered_chunks(chunks, n_chunks)
    out = queries.select("query_id").join(d, "query_id", "left").join(c, "query_id", "left")
    empty = F.array().cast("array<struct<doc_id:bigint,chunk_text:string>>")
    return out.select(F.col("query_id").alias("id"), F.coalesce("relevant_docs", F.array().cast("array<bigint>")).alias("relevant_docs"), F.coalesce("relevant_chunks", empty).alias("relevant_chunks"))


def violations(packed: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, problem): everything a strict validator would refuse; no rows means valid."""
    rep = packed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    gone = queries.select(F.col("query_id").alias("id")).join(packed, "id", "left_anti").select("id", F.lit("missing id").alias("problem"))
    more = packed.join(queries.select(F.col("query_id").alias("id")), "id", "left_anti").select("id", F.lit("unknown id").alias("problem"))
    twice = packed.where(F.size("relevant_docs") != F.size(F.array_distinct("relevant_docs"))).select("id", F.lit("repeated document").alias("problem"))
    listed = packed.select("id", F.explode("relevant_chunks").alias("c")).select("id", "c.doc_id", "c.chunk_text")
    repeated = listed.groupBy("id", "doc_id", "chunk_text").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated chunk").alias("problem"))
    checked = listed.join(texts.select("doc_id", "text"), "doc_id", "left")
    strange = checked.where(F.col("text").isNull()).select("id", F.lit("unknown owner").alias("problem"))
    changed = checked.where(F.col("text").isNotNull() & ~F.contains("text", "chunk_text")).select("id", F.lit("not verbatim").alias("problem"))
    out = rep
    for part in (gone, more, twice, repeated, strange, changed):
        out = out.unionByName(part)
    return out
