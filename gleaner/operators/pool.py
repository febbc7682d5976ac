"""Candidate pools, score reuse and ranking, all with total orders.

``WORST`` stands for a missing rank in sort keys, so nulls never decide an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.retrieve import top_k

WORST = 1_000_000_000


class PoolError(ValueError):
    """An invariant of a pool does not hold."""


def unified_pool(hits: DataFrame, depths: dict[str, int], first: str, k: int) -> DataFrame:
    """One row per (query_id, chunk_id) of all arms within their depths, with each arm's best rank and a pool rank.

    Order: found by arm ``first``, its rank, the least rank of the others, each
    other's rank, the chunk.  ``membership`` lists the arms, ``conflict`` says
    whether a chunk came with several owners.
    """
    others = [a for a in depths if a != first]
    within = F.lit(False)
    for arm, depth in depths.items():
        within = within | ((F.col("arm") == arm) & (F.col("rank") <= depth))
    name = lambda a: f"rank_{a.lower()}"
    pool = hits.where(within).groupBy("query_id", "chunk_id").agg(
        F.min("doc_id").alias("doc_id"), (F.count_distinct("doc_id") > 1).alias("conflict"),
        *[F.min(F.when(F.col("arm") == a, F.col("rank"))).alias(name(a)) for a in depths],
        F.array_join(F.sort_array(F.collect_set("arm")), "+").alias("membership"))
    worst = lambda a: F.coalesce(F.col(name(a)), F.lit(WORST))
    order = [F.col(name(first)).isNull(), worst(first), F.least(*map(worst, others)) if len(others) > 1 else worst(others[0]), *map(worst, others), F.col("chunk_id")]
    return top_k(pool, k, ["query_id"], *order).withColumnRenamed("rank", "pool_rank")


def assert_none(df: DataFrame, what: str) -> None:
    """Raise if ``df`` has a row: a check that stops a job rather than a column that nobody reads."""
    found = df.limit(1).collect()
    if found:
        raise PoolError(f"{what}: {found[0].asDict()}")


def missing_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs whose exact key has no score yet."""
    return pairs.select("query_id", "chunk_id").distinct().join(scores, ["query_id", "chunk_id"], "left_anti")


def seed_scores(pairs: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """Each pair with the score of the first store that has its exact key, and which store that was."""
    out, found, which = pairs, None, None
    for i, store in enumerate(stores):
        out = out.join(store.select("query_id", "chunk_id", F.col("score").alias(f"_s{i}")), ["query_id", "chunk_id"], "left")
        found = F.col("_s0") if i == 0 else F.coalesce(found, F.col(f"_s{i}"))
        hit = F.when(F.col(f"_s{i}").isNotNull(), i)
        which = hit if i == 0 else F.coalesce(which, hit)
    return out.withColumn("score", found).withColumn("store", which.cast("long")).drop(*[f"_s{i}" for i in range(len(stores))])


def score_pairs(pairs: DataFrame, scorer: Callable, columns: list[str]) -> DataFrame:
    """Apply a vectorised scorer (pandas Series in, Series out) to the pairs that need one."""
    udf = F.pandas_udf(scorer, "double")
    return pairs.withColumn("score", udf(*columns))


def rerank(pool: DataFrame, depth: int, k: int) -> DataFrame:
    """Order the pool's first ``depth`` rows by score, ties by chunk."""
    return top_k(pool.where(F.col("pool_rank") <= depth), k, ["query_id"], F.desc("score"), F.col("chunk_id"))


def cap_per_document(df: DataFrame, most: int, k: int) -> DataFrame:
    """At most ``most`` chunks of a document, then the best ``k``."""
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    return top_k(df.withColumn("_p", place).where(F.col("_p") <= most).drop("_p"), k, ["query_id"], F.desc("score"), F.col("chunk_id"))


def round_robin(df: DataFrame, k: int) -> DataFrame:
    """Domains take turns, both the domain order and each domain's items rotated by the query's number.

    In closed form: an item's turn is its place in its domain, rotated; its place in
    the turn is the domain's position, rotated.
    """
    own = Window.partitionBy("query_id", "domain")
    place = F.row_number().over(own.orderBy(F.desc("score"), "doc_id")) - 1
    size = F.count("*").over(own)
    df = df.withColumn("_place", place).withColumn("_size", size)
    domains = df.select("query_id", "domain", F.col("_size")).distinct()
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("domain")) - 1
    domains = domains.withColumn("_pos", position).withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).drop("_size")
    turn = F.pmod(F.col("_place") - F.col("query_id"), F.col("_size"))
    seat = F.pmod(F.col("_pos") - F.col("query_id"), F.col("_n"))
    out = df.join(domains, ["query_id", "domain"]).withColumn("_turn", turn).withColumn("_seat", seat)
    return top_k(out, k, ["query_id"], F.col("_turn"), F.col("_seat")).drop("_place", "_size", "_pos", "_n", "_turn", "_seat")


def weak(scores: Column, count: Column, least_score: float, least_count: int) -> Column:
    """A query whose best score or number of hits is too low."""
    return (count < least_count) | (F.coalesce(scores, F.lit(0.0)) < least_score)


def at_depths(df: DataFrame, depths: list[int]) -> DataFrame:
    """Each row once for every depth that reaches its rank."""
    return df.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where(F.col("rank") <= F.col("depth"))


def owner_diversity(df: DataFrame, most: int, depth: int) -> DataFrame:
    """First up to ``most`` rows of each owner within ``depth`` rows, then the others in their old order."""
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    allowed = (F.col("_own") <= most).cast("int")
    running = F.sum(allowed).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_own", own).withColumn("_run", running)
    late = ~((F.col("_own") <= most) & (F.col("_run") <= depth))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(late, "rank")).cast("long")
    return out.withColumn("position", place).drop("_own", "_run")


def independent_owners(windows: DataFrame, least: int = 24, overlap: float = 0.5) -> DataFrame:
    """(query_id, doc_id) with two windows of ``least`` words or more whose 5-grams share at most ``overlap`` of the smaller set.

    ``windows`` are (query_id, doc_id, place, words); a query's are a bounded pool, so an owner's pairs are few.
    """
    five = F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.array_join(F.slice("words", i, 5), " "))
    grams = windows.where(F.size("words") >= least).select("query_id", "doc_id", "place", F.array_distinct(five).alias("grams"))
    a, b = (grams.select("query_id", "doc_id", F.col("place").alias(f"place_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    pairs = a.join(b, ["query_id", "doc_id"]).where("place_a < place_b")
    both, smaller = F.size(F.array_intersect("grams_a", "grams_b")), F.least(F.size("grams_a"), F.size("grams_b"))
    return pairs.where(both <= overlap * smaller).select("query_id", "doc_id").distinct()


def swap_by_consensus(ranking: DataFrame, windows: DataFrame, head: int, last: int, most: int) -> DataFrame:
    """Replace up to ``most`` weak documents after the protected head by outsiders with independent windows.

    Candidates (owners of independent ``windows`` outside the list, most windows first)
    and victims (from the list's end upward, with one window at most) are numbered and
    joined on their number: no loop is needed.
    """
    inside = ranking.where(F.col("rank") <= last)
    counted = windows.groupBy("query_id", "doc_id").agg(F.count("*").alias("windows"), F.min("place").alias("first"))
    keys = ["query_id", "doc_id"]
    outside = windows.join(inside, keys, "left_anti")
    candidates = counted.join(independent_owners(outside), keys, "left_semi")
    gain = top_k(candidates, most, ["query_id"], F.desc("windows"), F.col("first"), F.col("doc_id")).select("query_id", F.col("doc_id").alias("new"), F.col("rank").alias("n"))
    victims = inside.where(F.col("rank") > head).withColumnRenamed("rank", "_r").join(counted, keys, "left").where("coalesce(windows, 0) <= 1")
    lose = top_k(victims, most, ["query_id"], F.desc("_r"), F.col("doc_id")).select("query_id", F.col("doc_id"), F.col("rank").alias("n"))
    swaps = lose.join(gain, ["query_id", "n"]).select("query_id", "doc_id", "new")
    out = inside.join(swaps, keys, "left")
    return out.select("query_id", F.coalesce("new", "doc_id").alias("doc_id"), "rank", F.col("new").isNotNull().alias("swapped"))


def best_window(df: DataFrame, owner: str) -> DataFrame:
    """The best chunk of each owner: highest score, then least chunk."""
    return df.groupBy("query_id", owner).agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("score"))


def calibrate_cap(df: DataFrame, wanted: DataFrame, caps: list[int], retention: float) -> DataFrame:
    """The smallest per-document cap at which enough of the wanted pairs survive, and each cap's retention."""
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    kept = df.withColumn("_p", place).withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).where(F.col("_p") <= F.col("cap"))
    found = kept.join(wanted, ["query_id", "chunk_id"], "left_semi").groupBy("cap").agg(F.count("*").alias("found"))
    total = wanted.agg(F.count("*").alias("total"))  # one row
    rates = found.crossJoin(total).select("cap", (F.col("found") / F.col("total")).alias("retention"))
    least = rates.agg(F.min(F.when(F.col("retention") >= retention, F.col("cap"))).alias("least"))
    return rates.crossJoin(least).select("cap", F.round("retention", 6).alias("retention"), (F.col("cap") == F.coalesce("least", F.lit(-1))).alias("chosen"))
