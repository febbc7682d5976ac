"""Fusion of rankings by reciprocal rank.

Rankings are long: (query_id, arm, item, rank, ...).  Sums are rounded to twelve
digits before they order rows, as a sum over three arms depends on its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.retrieve import first_per, top_k

CONSTANT = 60


def best_per_item(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """The best row of each item: highest score, then lowest rank."""
    return first_per(df, [*group, item], F.desc("score"), F.col("rank"))


def first_per_arm(df: DataFrame, item: str) -> DataFrame:
    """(query_id, arm, item, rank): an item's first place in each arm."""
    return df.groupBy("query_id", "arm", item).agg(F.min("rank").alias("rank"))


def arm_ranks(df: DataFrame, item: str, arms: list[str]) -> list[Column]:
    return [F.max(F.when(F.col("arm") == a, F.col("rank"))).alias(f"rank_{a.lower()}") for a in arms]


def rrf(df: DataFrame, item: str, arms: list[str], k: int, constant: int = CONSTANT, how: str = "sum") -> DataFrame:
    """Fused ranking; ``how`` is ``sum`` or ``max`` (best arm only).  Ties: least rank anywhere, then the item."""
    own = first_per_arm(df, item)
    part = 1 / (F.lit(constant) + F.col("rank"))
    score = F.sum(part) if how == "sum" else F.max(part)
    fused = own.groupBy("query_id", item).agg(
        F.round(score, 12).alias("score"), F.min("rank").alias("best_rank"), *arm_ranks(own, item, arms),
        F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"))
    return top_k(fused, k, ["query_id"], F.desc("score"), F.col("best_rank"), F.col(item))


def documents_of(df: DataFrame) -> DataFrame:
    """Each arm's document ranking: a document stands where its best chunk does."""
    best = df.groupBy("query_id", "arm", "doc_id").agg(F.min("rank").alias("chunk_rank"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy("chunk_rank", "doc_id")).cast("long")
    return best.withColumn("rank", rank).drop("chunk_rank")


def representative(df: DataFrame, item: str, value: str, arms: list[str]) -> DataFrame:
    """The value that the first arm (in the given order) has for each item."""
    order = F.array_position(F.array(*map(F.lit, arms)), F.col("arm"))
    return df.groupBy("query_id", item).agg(F.min_by(value, F.struct(order, F.col("rank"))).alias(value))


def pre_merge(df: DataFrame, item: str, depth: int) -> DataFrame:
    """Items that any arm ranks within ``depth``, with their best score."""
    return df.where(F.col("rank") <= depth).groupBy("query_id", item).agg(F.max("score").alias("score"))


def cap_group(df: DataFrame, group: str, name: str, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows of one group value in a query; all others are left alone."""
    capped = F.col(group) == name
    place = F.row_number().over(Window.partitionBy("query_id", capped).orderBy(*order))
    return df.withColumn("_place", place).where(~capped | (F.col("_place") <= most)).drop("_place")


def complete(ranking: DataFrame, universe: DataFrame, item: str, order: Column, digits: int = 3) -> DataFrame:
    """A ranking (item, rank) followed by all unranked items by ``order``, a text: every item gets a position.

    Unranked items are numbered inside buckets of their order's first characters, from
    each bucket's offset, so that the universe is never sorted in one task.
    """
    rest = universe.join(ranking, item, "left_anti").select(item, F.lit(0).cast("long").alias("_rank"), order.alias("_order"))
    rest = rest.withColumn("_bucket", F.concat(F.lit("1"), F.substring("_order", 1, digits)))
    own = ranking.select(item, F.col("rank").cast("long").alias("_rank"), F.lit("").alias("_order"), F.lit("0").alias("_bucket"))
    every = own.unionByName(rest)
    sizes = every.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # buckets only
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_rank", "_order", item))
    return every.join(offsets, "_bucket").select(item, (F.col("_offset") + place).cast("long").alias("position"))


def ranked_by_score(scored: DataFrame, score: str, item: str) -> DataFrame:
    """(item, rank) by falling ``score``, then ``item``, counted in buckets of the score's logarithm instead of one task.

    Scores that are not positive come last, in one bucket.
    """
    bucket = F.when(F.col(score) > 0, -F.floor(F.ln(score) * 256)).otherwise(F.lit(1 << 40))
    rows = scored.select(item, score, bucket.cast("long").alias("_bucket"))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # buckets only
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc(score), item))
    return rows.join(offsets, "_bucket").select(item, (F.col("_offset") + place).alias("rank"))


def protected(control: DataFrame, extra: DataFrame, prefix: int, most: int, size: int) -> DataFrame:
    """The control's first ``prefix`` items, then ``most`` new items of ``extra``, then the control's tail, up to ``size``."""
    head = control.where(F.col("rank") <= prefix).withColumn("_class", F.lit(0))
    new = extra.join(head, ["query_id", "doc_id"], "left_anti")
    new = top_k(new.withColumnRenamed("rank", "_r"), most, ["query_id"], F.col("_r"), F.col("doc_id")).withColumn("_class", F.lit(1))
    tail = control.where(F.col("rank") > prefix).join(new, ["query_id", "doc_id"], "left_anti").withColumn("_class", F.lit(2))
    names = ["query_id", "doc_id", "rank", "_class"]
    every = head.select(names).unionByName(new.select(names)).unionByName(tail.select(names)).withColumnRenamed("rank", "_r")
    out = top_k(every, size, ["query_id"], F.col("_class"), F.col("_r"), F.col("doc_id"))
    return out.select("query_id", "doc_id", "rank", F.element_at(F.array(F.lit("control"), F.lit("added"), F.lit("tail")), F.col("_class") + 1).alias("part"))
