"""Quality audits, closure checks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import jaccard, words


def id_audit(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Missing, unexpected and repeated keys, in one row."""
    counts = found.groupBy(key).agg(F.count("*").alias("n"))
    side = counts.withColumn("_f", F.lit(1)).join(expected.select(key).distinct().withColumn("_e", F.lit(1)), key, "full")
    return side.agg(
        F.count_if(F.col("_f").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))


def chunk_audit(chunks: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """Owners exist, ``text[start:end]`` is the chunk, budgets hold, no chunk is empty; in one row."""
    joined = chunks.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id", "left")
    same = F.substring("_doc", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("chunk_text")
    return joined.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("_doc").isNull()).alias("ownerless"), F.count_if(~F.coalesce(same, F.lit(False))).alias("not_verbatim"),
        F.count_if(F.col("n_tokens") > budget).alias("over_budget"), F.count_if(F.trim("chunk_text") == "").alias("empty"))


def closure(ranked: DataFrame, chunks: DataFrame, docs: DataFrame, official: DataFrame) -> DataFrame:
    """How many ranked rows fail each link of the chain: chunk, owner, document, official id."""
    known = chunks.select("chunk_id", F.col("doc_id").alias("_owner"))
    j = ranked.join(known, "chunk_id", "left")
    j = j.join(docs.select("doc_id", F.lit(True).alias("_doc")), "doc_id", "left").join(official.select("doc_id", F.lit(True).alias("_official")), "doc_id", "left")
    return j.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_owner").isNull()).alias("no_chunk"), F.count_if(F.col("_owner") != F.col("doc_id")).alias("wrong_owner"),
        F.count_if(F.col("_doc").isNull()).alias("no_document"), F.count_if(F.col("_official").isNull()).alias("not_official"))


def score_audit(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing, unexpected, repeated and unusable scores, in one row."""
    keys = ["query_id", "chunk_id"]
    one = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.max("score").alias("score"))
    j = one.withColumn("_s", F.lit(1)).join(expected.select(*keys).distinct().withColumn("_e", F.lit(1)), keys, "full")
    bad = F.col("_s").isNotNull() & (F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    return j.agg(
        F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(bad).alias("not_finite"), F.count_distinct("score").alias("distinct_scores"))


def document_flags(text: Column, lang: Column) -> Column:
    """An array of flags of a document."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    repeated = F.size(paragraphs) - F.size(F.array_distinct(paragraphs))
    # one pass over the paragraphs' words: each is cut once and met by the next
    start = F.struct(F.lit(None).cast("array<string>").alias("last"), F.lit(False).alias("hit"))
    near = lambda a, w: F.coalesce(jaccard(a["last"], w) >= 0.9, F.lit(False))
    walked = F.aggregate(
        F.transform(paragraphs, words), start, lambda a, w: F.struct(w.alias("last"), (a["hit"] | near(a, w)).alias("hit")), lambda a: a["hit"])
    return F.array_compact(F.array(
        F.when(F.trim(text) == "", F.lit("empty")), F.when(F.length(text) < 200, F.lit("short")), F.when(text.rlike("<[a-zA-Z/][^>]*>"), F.lit("markup")),
        F.when(repeated >= 0.2 * F.size(paragraphs), F.lit("repeated")), F.when(walked, F.lit("adjacent_copies")),
        F.when(F.length(text) > 20000, F.lit("large")), F.when(text.contains("�"), F.lit("replacement")), F.when(lang.isNull(), F.lit("no_language"))))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that come with several values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def split_leakage(df: DataFrame, normal: Column, split: str) -> DataFrame:
    """Normalised queries that occur in several splits."""
    return df.groupBy(normal.alias("normal")).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def verdict(value: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first bound that the value reaches."""
    out = None
    for least, name in bounds:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(otherwise)
