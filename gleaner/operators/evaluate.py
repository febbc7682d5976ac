"""Set comparison, retention and quality of rankings.

Unjudged is not negative: where a unit has no judged positive, its rate is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import jaccard


def compare_rankings(a: DataFrame, b: DataFrame, item: str, depth: int) -> DataFrame:
    """Per query: same first item, and the Jaccard similarity of the first ``depth`` and of all items."""
    def sets(df, name):
        return df.groupBy("query_id").agg(
            F.collect_set(F.when(F.col("rank") <= depth, F.col(item))).alias(f"{name}_top"), F.collect_set(item).alias(f"{name}_all"),
            F.max(F.when(F.col("rank") == 1, F.col(item))).alias(f"{name}_first"))

    both = sets(a, "a").join(sets(b, "b"), "query_id")
    return both.select(
        "query_id", (F.col("a_first") == F.col("b_first")).alias("same_first"),
        F.round(jaccard(F.col("a_top"), F.col("b_top")), 6).alias("top_jaccard"), F.round(jaccard(F.col("a_all"), F.col("b_all")), 6).alias("all_jaccard"))


def retention(pairs: DataFrame, candidates: DataFrame, on: list[str], depths: list[int]) -> DataFrame:
    """The share of (query, item) pairs that candidates hold within each depth."""
    best = candidates.groupBy(*on).agg(F.min("rank").alias("rank"))
    joined = pairs.select(*on).distinct().join(best, on, "left")
    at = joined.withColumn("depth", F.explode(F.array(*[F.lit(d).cast("long") for d in depths])))
    held = F.coalesce(F.col("rank") <= F.col("depth"), F.lit(False))
    return at.groupBy("depth").agg(F.count("*").alias("pairs"), F.count_if(held).alias("held"), F.round(F.avg(held.cast("double")), 6).alias("rate"))


def known_positive(rankings: DataFrame, positives: DataFrame) -> DataFrame:
    """Recall at 20 and 100, mean reciprocal rank and coverage of one known document per query."""
    best = positives.join(rankings, ["query_id", "doc_id"], "left").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    at = lambda d: F.round(F.avg(F.coalesce((F.col("rank") <= d).cast("double"), F.lit(0.0))), 6)
    return best.agg(
        F.count("*").alias("queries"), at(20).alias("recall_20"), at(100).alias("recall_100"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count("rank").alias("covered"))


def inversions(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Pairs of common items of a query whose order differs; lists are bounded by their depth."""
    both = a.select("query_id", item, F.col("rank").alias("ra")).join(b.select("query_id", item, F.col("rank").alias("rb")), ["query_id", item])
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.ra") < F.col("y.ra")))
    return pairs.groupBy(F.col("x.query_id").alias("query_id")).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("x.rb") > F.col("y.rb")).alias("inverted"))


def difference(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """retained, displaced and inserted rows, by key."""
    keep = old.join(new, on, "left_semi").select(*on, F.lit("retained").alias("change"))
    gone = old.join(new, on, "left_anti").select(*on, F.lit("displaced").alias("change"))
    more = new.join(old, on, "left_anti").select(*on, F.lit("inserted").alias("change"))
    return keep.unionByName(gone).unionByName(more)


def overlap_at(a: DataFrame, b: DataFrame, item: str, depths: list[int]) -> DataFrame:
    """Queries with any common item, and common pairs, at each depth."""
    both = a.select("query_id", item, F.col("rank").alias("ra")).join(b.select("query_id", item, F.col("rank").alias("rb")), ["query_id", item])
    at = both.withColumn("depth", F.explode(F.array(*[F.lit(d).cast("long") for d in depths]))).where((F.col("ra") <= F.col("depth")) & (F.col("rb") <= F.col("depth")))
    return at.groupBy("depth").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("pairs"))


def score_equivalence(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Whether two scorings agree: missing rows, the largest difference, equal orders."""
    both = a.select("query_id", "chunk_id", F.col("score").alias("sa")).join(
        b.select("query_id", "chunk_id", F.col("score").alias("sb")), ["query_id", "chunk_id"], "full")
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "chunk_id"))
    ranked = both.withColumn("ra", order("sa")).withColumn("rb", order("sb"))
    gap = F.abs(F.col("sa") - F.col("sb"))
    return ranked.agg(
        F.count("*").alias("rows"), F.count_if(F.col("sa").isNull() | F.col("sb").isNull()).alias("missing"), F.round(F.max(gap), 6).alias("largest"),
        F.count_if(F.col("ra") != F.col("rb")).alias("moved"), F.coalesce(F.max(gap) <= tolerance, F.lit(True)).alias("within"))


def coverage_groups(df: DataFrame, text: str, groups: dict[str, list[str]]) -> DataFrame:
    """Which groups of terms a text hits, and whether it hits them all."""
    lower = F.lower(F.col(text))
    for name, terms in groups.items():
        df = df.withColumn(f"has_{name}", F.exists(F.array(*map(F.lit, terms)), lambda t: lower.contains(t)))
    every = F.lit(True)
    for name in groups:
        every = every & F.col(f"has_{name}")
    return df.withColumn("has_all", every)
