"""Distributed positions: running totals in a pseudo-random or key order.

A window over one group would put the whole group in one task.  Here each group
is cut into ordered buckets: bucket totals give each bucket's offset and the
window runs inside a bucket only, so a source or shard with a third of all rows
still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.workspace import spare


def bucket_bits(n_rows: int, rows_per_bucket: int = 2048) -> int:
    """Bits of bucket number so that a bucket holds about ``rows_per_bucket`` rows."""
    return min(40, max(0, (max(n_rows, 1) // rows_per_bucket).bit_length()))


def running_total(
    df: DataFrame, groups: list[str], order: str, ties: list[str], value: Column, bits: int, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in its group.

    ``order`` is a long column spread over all 64 bits (a hash); rows order by
    (``order``, ``ties``).  Buckets are the top ``bits`` bits, which respect that order.
    """
    own, bucket, offset = spare(df, "value", "bucket", "offset")
    df = df.withColumn(own, value.cast("long"))
    df = df.withColumn(bucket, F.shiftright(F.col(order), 64 - bits) if bits else F.lit(0).cast("long"))
    totals = df.groupBy(*groups, bucket).agg(F.sum(own).alias(offset))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, F.coalesce(F.sum(offset).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(*groups, bucket).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*groups, bucket])
        .withColumn(name, (F.col(offset) + F.coalesce(F.sum(own).over(inside), F.lit(0))).cast("long"))
        .drop(own, bucket, offset)
    )


def permuted(x: Column, domain: Column, key: Column, rounds: int = 14) -> Column:
    """Swap-or-not: a keyed bijection of [0, domain) in plain column arithmetic."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(key, r) - at, domain)
        return F.when(F.xxhash64(key, r, F.greatest(at, partner), F.lit("swap")) < 0, partner).otherwise(at)

    # a fold, as nesting the rounds would double the expression with each
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)
