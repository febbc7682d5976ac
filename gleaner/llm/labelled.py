"""Bounded, reproducible samples of labelled and unlabelled documents for model fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 5; fold 0 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, fold) of the training folds; an id labelled both ways counts as 0, null labels not at all."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")


def lowest(df: DataFrame, n: int, salt: int) -> DataFrame:
    """The ``n`` rows whose hashed id is lowest: a uniform sample that reruns repeat."""
    return df.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)
