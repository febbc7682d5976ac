"""Statistics over rankings, corpora and telemetry.

Two percentile rules exist and are never mixed: ``linear`` interpolates,
``nearest`` takes an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(c: str, p: float) -> Column:
    return F.round(F.percentile(c, p), 6)


def nearest(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """Nearest-rank percentile: the element at ceil(n * p), found by rank, not by collecting the group."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p)))).select(*group, F.col(value).alias("value"))


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), linear(value, 0.05).alias("p5"), linear(value, 0.5).alias("median"),
        linear(value, 0.95).alias("p95"), F.max(value).alias("high"))


def count_summary(df: DataFrame, value: str, below: int) -> DataFrame:
    return df.agg(
        F.sum(value).alias("total"), F.min(value).alias("low"), linear(value, 0.5).alias("median"), linear(value, 0.9).alias("p90"),
        F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), F.count_if(F.col(value) < below).alias("below"))


def duplicate_text_stats(df: DataFrame, text: str, owner: str) -> DataFrame:
    """Groups of equal texts: how many, rows beyond the first, within and across owners."""
    g = df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners")).where("n > 1")
    return g.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"),
        F.count_if(F.col("owners") == 1).alias("within_owner"), F.count_if(F.col("owners") > 1).alias("across_owners"))


def movement(pairs: DataFrame) -> DataFrame:
    """(before, after) ranks per query: changes of the first place, and how far rows move."""
    step = pairs.withColumn("step", F.abs(F.col("before") - F.col("after")))
    return step.agg(
        F.count_if((F.col("after") == 1) & (F.col("before") != 1)).alias("top1_changes"), F.round(F.avg("step"), 6).alias("mean_step"),
        linear("step", 0.5).alias("median_step"), linear("step", 0.95).alias("p95_step"), F.count_if((F.col("after") <= 10) & (F.col("before") > 10)).alias("promoted"))


def margins(df: DataFrame) -> DataFrame:
    """Per query: the best score and its lead over the second."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    two = df.withColumn("_p", place).where(F.col("_p") <= 2)
    first, second = F.max(F.when(F.col("_p") == 1, F.col("score"))), F.max(F.when(F.col("_p") == 2, F.col("score")))
    return two.groupBy("query_id").agg(first.alias("best"), F.round(first - second, 6).alias("margin"))


def id_gaps(df: DataFrame, column: str, width: int) -> DataFrame:
    """Gaps between consecutive ids: inside blocks of ids by a window, between blocks from their ends only."""
    block = F.floor(F.col(column) / width).alias("_b")
    own = df.select(F.col(column).alias("id"), block).distinct()
    inside = own.withColumn("before", F.lag("id").over(Window.partitionBy("_b").orderBy("id"))).where("before is not null")
    ends = own.groupBy("_b").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    across = ends.select(F.col("first").alias("id"), F.lag("last").over(Window.orderBy("_b")).alias("before")).where("before is not null")
    both = inside.select("id", "before").unionByName(across)
    return both.where(F.col("id") - F.col("before") > 1).agg(
        F.count("*").alias("gaps"), F.coalesce(F.max(F.col("id") - F.col("before") - 1), F.lit(0)).alias("widest"))
