"""Scans, merges and idempotent appends of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.urls import host
from gleaner.operators.retrieve import first_per


class SourceError(ValueError):
    """A source breaks an invariant."""


def corpus_scan(df: DataFrame, domains: list[str] | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, url) without nulls; of each wanted domain ceil(limit / domains) ids, lowest first."""
    out = df.where("id is not null and url is not null")
    if after is not None:
        out = out.where(F.col("id") > after)
    if domains is None:
        return out.orderBy("id").limit(limit) if limit else out
    out = out.withColumn("domain", host(F.col("url"))).where(F.col("domain").isin(*domains))
    if limit:
        each = -(-limit // len(domains))
        out = out.withColumn("_p", F.row_number().over(Window.partitionBy("domain").orderBy("id"))).where(F.col("_p") <= each).drop("_p")
    return out


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, after an aggregation that raises if a key repeats."""
    found = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if found:
        raise SourceError(f"repeated key: {found[0].asDict()}")
    return df


def in_requested_order(df: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows of ``ids`` with their place in that list."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} long")
    return df.join(wanted, key)


def read_with_schema(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Parts whose all-null lists were inferred as other types read as the given schema."""
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        part = part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = part if out is None else out.unionByName(part)
    return out


def merge_parts(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts with the same columns and no repeated key."""
    names = set(parts[0].columns)
    out = parts[0]
    for p in parts[1:]:
        if set(p.columns) != names:
            raise SourceError(f"columns differ: {sorted(names ^ set(p.columns))}")
        out = out.unionByName(p)
    return require_unique(out, key)


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """One row per key, from the first part that has it; ``source_no`` says which."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return first_per(out, [key], F.col("source_no"))


def filter_by_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows, and the keys that were not found."""
    return df.join(keys, key, "left_semi"), keys.join(df, key, "left_anti")


def append_bodies(held: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (id, body) whose id is not held; a held id with another checksum raises."""
    signed = new.withColumn("sha256", F.sha2("body", 256))
    clash = signed.alias("n").join(held.alias("h"), "id").where(F.col("n.sha256") != F.col("h.sha256")).limit(1).collect()
    if clash:
        raise SourceError(f"body of {clash[0]['id']} changed")
    return first_per(signed.join(held, "id", "left_anti"), ["id"], F.col("sha256"))


def corrupted(bodies: DataFrame) -> DataFrame:
    """Ids whose body no longer has its checksum."""
    return bodies.where(F.sha2("body", 256) != F.col("sha256")).select("id")


def priority_assembly(parts: dict[str, DataFrame], key: str, order: Column) -> DataFrame:
    """Sources by priority, first wins per key, then one canonical order."""
    out = None
    for i, (name, p) in enumerate(parts.items()):
        p = p.withColumn("origin", F.lit(name)).withColumn("_i", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return first_per(out, [key], F.col("_i"), order).drop("_i")
