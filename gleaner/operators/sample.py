"""Deterministic samples by content hash, strata and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import hash_rank
from gleaner.operators.retrieve import top_k


def per_group(df: DataFrame, group: str, key: str, seed: str, k: int) -> DataFrame:
    """The ``k`` lowest-hash rows of each group, with the group's population."""
    df = df.withColumn("_h", hash_rank(seed, F.col(key)))
    size = df.groupBy(group).agg(F.count("*").alias("population"))
    return top_k(df, k, [group], F.col("_h"), F.col(key)).join(size, group).drop("_h")


def overall(df: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    return df.orderBy(hash_rank(seed, F.col(key)), key).limit(k)


def excluding(df: DataFrame, known: DataFrame, key: str, group: str, seed: str, k: int) -> DataFrame:
    return per_group(df.join(known, key, "left_anti"), group, key, seed, k)


def by_rules(df: DataFrame, key: str, rules: dict[str, tuple[Column, int]], seed: str) -> DataFrame:
    """Each rule takes its quota of lowest-hash rows; a row lists the rules that took it."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, (rule, _) in rules.items()]))
    quota = F.create_map(*[x for name, (_, q) in rules.items() for x in (F.lit(name), F.lit(q))])
    rows = df.withColumn("rule", F.explode(names)).withColumn("_h", hash_rank(seed, F.col(key)))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("_h", key))
    taken = rows.withColumn("_p", place).where(F.col("_p") <= F.element_at(quota, F.col("rule")))
    return taken.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


def round_robin_strata(df: DataFrame, strata: list[str], key: str, seed: str, k: int) -> DataFrame:
    """Strata take turns in hashed order; within one, lowest hash first."""
    stratum = F.concat_ws("|", *[F.col(s).cast("string") for s in strata])
    df = df.withColumn("_s", stratum).withColumn("_h", hash_rank(seed, F.col(key)))
    turn = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))
    df = df.withColumn("_t", turn).where(F.col("_t") <= k).withColumn("_sh", hash_rank(seed, F.col("_s")))
    return df.orderBy("_t", "_sh", key).limit(k).drop("_s", "_h", "_t", "_sh")


def largest_remainder(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Quotas of strata in proportion to their sizes that add up to ``total``."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    every = sizes.crossJoin(sizes.agg(F.sum("n").alias("all")))  # one row of the total
    exact = F.col("n") * F.lit(total) / F.col("all")
    every = every.withColumn("_base", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    left = every.agg((F.lit(total) - F.sum("_base")).alias("left"))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))  # strata only
    return every.withColumn("_p", place).crossJoin(left).select(
        stratum, "n", (F.col("_base") + F.when(F.col("_p") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def evenly_spaced(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """``k`` rows at even steps of the order; halves round to even."""
    n = F.count("*").over(Window.partitionBy())
    ranked = df.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", n)
    step = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1), 0).cast("int")))
    return ranked.where(F.array_contains(step, F.col("_i").cast("int"))).drop("_i", "_n")


def balanced_groups(df: DataFrame, stratum: str, key: str, groups: int) -> DataFrame:
    """Deal rows to groups in turn, the turn carrying on from stratum to stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    before = sizes.select(stratum, F.coalesce(F.sum("_n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(key)) - 1
    return df.withColumn("_p", place).join(before, stratum).withColumn("part", ((F.col("_p") + F.col("_o")) % groups).cast("long")).drop("_p", "_o")


def one_per_stratum(df: DataFrame, strata: list[str], key: str, seed: str) -> DataFrame:
    return df.groupBy(*strata).agg(F.min_by(key, F.struct(hash_rank(seed, F.col(key)), F.col(key))).alias(key))


def nested(df: DataFrame, chosen: DataFrame, key: str, group: str, seed: str, target: int) -> DataFrame:
    """Keep earlier choices (in hash order), then add the lowest-hash new rows up to the target."""
    old = chosen.select(key).distinct().withColumn("_old", F.lit(0))
    rows = df.join(old, key, "left").withColumn("_new", F.coalesce("_old", F.lit(1))).withColumn("_h", hash_rank(seed, F.col(key)))
    return top_k(rows, target, [group], F.col("_new"), F.col("_h"), F.col(key)).withColumn("kept", F.col("_new") == 0).drop("_old", "_new", "_h")


def review_queue(df: DataFrame, strata: list[str], query: str, key: str, preferred: str, k: int) -> DataFrame:
    """(position, query, key) of up to ``k`` rows for review: one per stratum in turn, no query twice, then preferred rows first.

    ``key`` orders rows and tells them apart.  As at most ``k`` queries are ever taken, a
    stratum needs its first ``k`` queries only, and they are read in order until the queue
    is full; the fill needs each query's first row and ``2 * k`` of those.
    """
    one = df.groupBy(*strata, query).agg(F.min(key).alias(key))
    near = one.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("_n") <= k)
    chosen: dict = {}
    done = None
    for row in near.orderBy(*strata, key).toLocalIterator():
        stratum = tuple(row[c] for c in strata)
        if len(chosen) == k:
            break
        if stratum != done and row[query] not in chosen:
            chosen[row[query]], done = row[key], stratum
    fill = df.groupBy(query).agg(F.min(F.struct((~F.col(preferred)).alias("late"), F.col(key).alias(key))).alias("_first"))
    for row in fill.orderBy("_first").limit(2 * k).collect():
        if len(chosen) < k and row[query] not in chosen:
            chosen[row[query]] = row["_first"][key]
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame(
        [(i, q, x) for i, (q, x) in enumerate(chosen.items())], f"position long, `{query}` {kinds[query]}, `{key}` {kinds[key]}")
