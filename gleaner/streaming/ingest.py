"""Incremental ingestion: idempotent, monotone and resumable.

A target is a Parquet folder of versions; each micro-batch merges into the newest
version and writes the next, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETRYABLE = ("TIMEOUT", "SERVER_ERROR", "CONNECTION_ERROR")


class StateError(ValueError):
    """A checkpoint does not belong to this run."""


def monotone(df: DataFrame, key: str, success: Column, order: list[str]) -> DataFrame:
    """One row per key: the latest success if there is one, else the latest row.  Needs no earlier state but rows."""
    rows = df.withColumn("_s", success.cast("int"))
    rest = [c for c in df.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_s", *order)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def spaced_starts(df: DataFrame, group: str, at: str, order: list[str], delay: int) -> DataFrame:
    """Earliest starts no closer than ``delay`` within a group: max(arrival, previous start + delay).

    In closed form: with ``i`` the row's number, start = i * delay + running max(arrival - i * delay).
    """
    w = Window.partitionBy(group).orderBy(at, *order)
    i = F.row_number().over(w) - 1
    df = df.withColumn("_i", i)
    running = F.max(F.col(at) - F.col("_i") * F.lit(delay)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", (F.col("_i") * F.lit(delay) + running).cast("long")).drop("_i")


def pending(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without a result, and keys whose last failure may be tried again."""
    state = done.select(key, "status")
    joined = expected.select(key).join(state, key, "left")
    return joined.where(F.col("status").isNull() | F.col("status").isin(*RETRYABLE)).select(key)


def unfinished_parts(items: DataFrame, done: DataFrame, width: int, key: str, signature: str) -> DataFrame:
    """Ranges of keys not yet finished under this signature; another signature raises."""
    other = done.where(F.col("signature") != signature).limit(1).collect()
    if other:
        raise StateError(f"checkpoint has signature {other[0]['signature']}, not {signature}")
    parts = items.select(F.floor(F.col(key) / width).cast("long").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return parts.join(done, "part", "left_anti")


class VersionedTable:
    """A table that micro-batches merge into."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version: int | None = None

    def read(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.path}/v={self.version}")

    def replace(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        self.version = batch


def run_available(stream: DataFrame, target: VersionedTable, merge: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """Process everything that has arrived, then stop: rows held and rows new go through ``merge`` together."""
    def each(batch: DataFrame, number: int) -> None:
        held = target.read()
        target.replace(merge(batch if held is None else held.unionByName(batch)), number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return target.read()


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts per type and window; rows later than ``late`` behind the newest are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def cached_or_missing(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (fields) by fingerprint: those answered, and those to ask."""
    keyed = requests.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(requests.columns))), 256))
    return keyed.join(cache, "fingerprint"), keyed.join(cache, "fingerprint", "left_anti")


def progress(done: int, total: int, seconds: float, ended: bool = False) -> dict:
    """Percent below 100 until the end, and the time left where it can be told."""
    share = 100.0 if ended else min(99.99, 100.0 * done / total) if total else 0.0
    left = 0.0 if ended else seconds * (total - done) / done if done else None
    return {"percent": round(share, 2), "seconds_left": "INDETERMINATE" if left is None else round(left, 1)}
