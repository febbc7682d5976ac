"""Content-addressed order: sampling ranks, folds and digests from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_rank(seed: str, key: Column) -> Column:
    """16 hex digits; their text order is the order of the unsigned 64-bit prefix."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def hash_fold(seed: str, key: Column, folds: int) -> Column:
    """The unsigned 64-bit prefix modulo ``folds``."""
    return F.pmod(F.conv(hash_rank(seed, key), 16, 10).cast("decimal(20,0)"), F.lit(folds).cast("decimal(20,0)")).cast("long")


def joined_digest(*fields: Column) -> Column:
    """SHA-256 over fields joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[f.cast("string") for f in fields]), 256)


def chunk_digest(*fields: Column) -> Column:
    return F.substring(joined_digest(*fields), 1, 24)


def order_free_digest(*fields: Column) -> Column:
    """Aggregate: the same for the same multiset of rows in any order, the sum of 60 bits of each row's SHA-256."""
    return F.sum(F.conv(F.substring(joined_digest(*fields), 1, 15), 16, 10).cast("decimal(20,0)"))
