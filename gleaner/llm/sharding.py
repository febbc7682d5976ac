"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many of a partition's rows go to each shard is drawn first, for all
partitions, from the multivariate hypergeometric law that a uniform permutation
of all rows would induce.  Each partition then permutes its own rows in place (a
keyed permutation of their positions) and cuts them by its matrix row; whole rows
are exchanged once, and every shard is permuted again.  The driver holds one row of
counts for each input partition and nothing that grows with rows.

Cases: null text has size 1 and the CRC of an empty text; repeated rows are
separate rows; an empty table gives an empty result; extra columns pass through
unchanged, but for ``shard`` and ``slot``, which the result's replace.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.ranking import bucket_bits, permuted, running_total
from gleaner.llm.workspace import Workspace, spare

SHARDS, SEED, LIMIT, SENT_ROWS = 16, 20261, 10**9, 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good, whatever their number.

    From 10**9 rows on, where numpy stops, the law's ratios of neighbours give its
    values around the mode, twelve deviations to each side: all that a double holds.
    """
    total = good + bad
    if total < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))) + 20
    low, high = max(0, n - bad, mode - wide), min(good, n, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate(([0.0], np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1)))))
    share = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(share, rng.random() * share[-1], side="right"))


def _draw(rng: np.random.Generator, room: list[int], n: int) -> list[int]:
    """How many of ``n`` rows, drawn without replacement, fall on each shard's room; the shards are split in halves."""
    if len(room) == 1 or not n:
        return [n] + [0] * (len(room) - 1)
    half = len(room) // 2
    got = hypergeometric(rng, sum(room[:half]), sum(room[half:]), n)
    return _draw(rng, room[:half], got) + _draw(rng, room[half:], n - got)


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Exact counts: row p sums to ``sizes[p]``, columns differ by one row at most."""
    total, rng = sum(sizes), np.random.default_rng(seed)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = np.zeros((len(sizes), n_shards), np.int64)
    for p, n in enumerate(sizes):
        out[p] = _draw(rng, room, n)
        room = [r - int(x) for r, x in zip(room, out[p], strict=True)]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    The input is written once with its partition number and position, so that
    retried tasks and both passes see the same partitions.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "shards")
    df = df.drop("shard", "slot")
    part, at, cuts, n, order = spare(df, "part", "at", "cuts", "n", "order")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition, from 0
    rows = ws.save(df.withColumn(part, F.spark_partition_id()).withColumn(at, place))
    counts = sorted(map(tuple, rows.groupBy(part).agg(F.count("*")).collect()))
    matrix = communication_matrix([c for _, c in counts], n_shards, seed)
    drawn = spark.createDataFrame(
        [(p, c, np.cumsum(m).tolist()) for (p, c), m in zip(counts, matrix, strict=True)], f"`{part}` int, `{n}` long, `{cuts}` array<long>")
    if len(counts) <= SENT_ROWS:  # a row of counts for each partition: whole rows stay where they are
        drawn = F.broadcast(drawn)
    # first permutation: of the positions within the partition; an array of one, so that each is permuted once
    rank = F.array(permuted(F.col(at), F.col(n), F.xxhash64(F.lit(seed), part)))
    shard = F.aggregate(rank, F.lit(0), lambda _, r: F.size(F.filter(cuts, lambda c: c <= r)))
    dealt = rows.join(drawn, part).withColumn("shard", shard)
    # the exchange and the second permutation, inside the shard
    dealt = dealt.withColumn(order, F.xxhash64(F.lit(seed + 1), part, at)).drop(cuts, n)
    bits = max(0, bucket_bits(sum(c for _, c in counts)) - 2)
    return running_total(dealt, ["shard"], order, [part, at], F.lit(1), bits, "slot").select(*df.columns, "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts and all, in 16 shards under the ``rows`` law; one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
