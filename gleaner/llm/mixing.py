"""Mix sources to target weights, in blocks of a fixed number of words.

Each source's words, its documents in hash order, are packed into blocks of
``BLOCK`` words (the last may be shorter).  For every output shard a multinomial
draw, from what each source still has to give, says how many slots each source
fills; the draws are taken without exceeding a source's total, so every source
ends at its target to within half a block.  Slot ``j`` of a source takes block
``permutation(j mod blocks)``, a swap-or-not permutation keyed by the source, so
no block is used again before all others were.  Slots and blocks meet in a join
on (source, block index); nothing is ever listed on the driver but one row per
source.

Cases: null text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; repeated rows are separate rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.ranking import bucket_bits, permuted, running_total
from gleaner.llm.textkit import lean, small_batches
from gleaner.llm.workspace import Workspace, spare

BLOCK, OUTPUT_SHARDS, SEED, MOST_TIMES, LISTED = 64, 64, 7, 3, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)


def targets(sizes: list[int], weights: list[int], cap: int = MOST_TIMES) -> list[float]:
    """Shares of all words by weight; a share over ``cap`` times its source is cut and reshared."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        left = total - sum(cap * n for n, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [
            float(cap * n) if c else (left * w / weight if weight else 0.0)
            for n, w, c in zip(sizes, weights, capped, strict=True)
        ]
        over = [not c and t > cap * n for t, n, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def slot_draws(slots: list[int], n_shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(source, output shard, first slot, slots): multinomial from what is left, never beyond it."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    used, total, out = np.zeros_like(left), int(left.sum()), []
    for k in range(n_shards):
        room = total * (k + 1) // n_shards - total * k // n_shards
        take = np.zeros_like(left)
        while (short := room - int(take.sum())) > 0:
            open_ = left - take
            take += np.minimum(rng.multinomial(short, open_ / open_.sum()), open_)
        out += [(int(s), k, int(used[s]), int(take[s])) for s in np.flatnonzero(take)]
        used, left = used + take, left - take
    return out


class Mix:
    """The plan of a mix: ``rows`` (with source, word interval), ``slots`` and the ``uses`` of each block.

    ``row`` names a column of ``docs`` that tells its rows apart and is kept as ``_row``.
    """

    def __init__(self, ws: Workspace, docs: DataFrame, block: int, seed: int, n_shards: int = OUTPUT_SHARDS, row: str | None = None):
        spark = docs.sparkSession
        known = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        rows = ws.save(
            docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), known.alias("_source"), size.alias("size"),
                        *([F.col(row).alias("_row")] if row else []))
            .withColumn("_at", F.monotonically_increasing_id())
        )
        # one row per source goes to the driver: the catalogue of sources, not documents
        found = rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: r["_source"].encode("utf-8"))
        sizes = [r["size"] for r in found]
        wanted = targets(sizes, [1 + i % 3 for i in range(len(found))])
        blocks = [-(-n // block) for n in sizes]
        # a whole pass over a source has a short last block, which its slots make up for
        lack = [(t // n) * (b * block - n) if n else 0 for t, n, b in zip(wanted, sizes, blocks, strict=True)]
        slots = [min(round((t + x) / block), MOST_TIMES * b) for t, x, b in zip(wanted, lack, blocks, strict=True)]
        self.sources = spark.createDataFrame(
            [(r["_source"], i, sizes[i], wanted[i], blocks[i]) for i, r in enumerate(found)],
            "_source string, _sid int, source_size long, target double, _blocks long",
        )
        draws = spark.createDataFrame(
            slot_draws(slots, n_shards, seed) if sum(slots) else [], "_sid int, shard int, first long, n long"
        )
        order = F.xxhash64(F.lit(seed), "doc_id", "_text_hash")
        rows = rows.join(self.sources, "_source").withColumn("_order", order)
        bits = bucket_bits(sum(r["n"] for r in found))
        self.rows = running_total(rows, ["_sid"], "_order", ["doc_id", "_text_hash", "_at"], F.col("size"), bits, "_start")
        per_source = self.sources.select("_sid", "_blocks")
        # a draw is cut into pieces of bounded length before it is listed slot by slot
        piece = 4096
        listed = (
            draws.join(per_source, "_sid")
            .withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
            .repartition(max(1, min(10_000, sum(slots) // LISTED)), "_sid", "shard", "p")  # a stated number is not merged
            .withColumn("j", F.explode(F.sequence(
                F.col("first") + F.col("p") * piece,
                F.col("first") + F.least(F.col("n"), (F.col("p") + 1) * piece) - 1)))
        )
        key = F.xxhash64(F.lit(seed), "_sid")
        self.slots = listed.select(
            "_sid", "shard", F.col("j").alias("slot"),
            permuted(F.pmod("j", F.col("_blocks")), F.col("_blocks"), key).alias("block"),
        )
        self.uses = self.slots.groupBy("_sid", "block").agg(
            F.count("*").alias("uses"), F.min("shard").alias("_low"), F.max("shard").alias("_high"))
        self.size = block

    def pieces(self) -> DataFrame:
        """(``_at``, ``_sid``, block, ``_from``, ``_to``): each row's words in each block, counted from its first word."""
        b = self.size
        span = self.rows.where("size > 0").select("_at", "_sid", "_start", "size").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("_start") / b), F.floor((F.col("_start") + F.col("size") - 1) / b)))
        )
        lo = F.greatest(F.col("_start"), F.col("block") * b) - F.col("_start")
        hi = F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * b) - F.col("_start")
        return span.select("_at", "_sid", "block", lo.alias("_from"), hi.alias("_to"))


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted, and the first and last output shard that has some."""
    mix = Mix(Workspace(docs.sparkSession, "mix"), docs, block, seed)
    # runs of block numbers shuffle to almost nothing, so a size check on shuffled bytes would broadcast them
    taken = (
        mix.pieces().join(mix.uses.hint("merge"), ["_sid", "block"])
        .groupBy("_at").agg(
            F.sum((F.col("_to") - F.col("_from")) * F.col("uses")).alias("taken"),
            F.min("_low").alias("first_shard"), F.max("_high").alias("last_shard"))
    )
    return mix.rows.join(taken.hint("merge"), "_at", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard"
    )


def mixed_blocks(docs: DataFrame, block: int = BLOCK, seed: int = SEED, n_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """The mix as packed blocks: (shard, source, slot, block, n_words, text), a source's words in order, joined by blanks."""
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "blocks")
    kept = ws.save(docs.select("doc_id", "source", "text").withColumn("_n", F.monotonically_increasing_id()))
    mix = Mix(ws, kept, block, seed, n_shards, "_n")
    pieces = mix.pieces().join(mix.rows.select("_at", "_row", "_start"), "_at")
    # each piece is cut from its text once, however often its block is used
    spans = pieces.groupBy("_row").agg(F.collect_list(F.struct("_sid", "block", "_start", "_from", "_to")).alias("_cuts"))
    cut = kept.join(spans, kept["_n"] == spans["_row"]).select("text", "_cuts").mapInArrow(
        _cut_pieces, "_sid int, block long, first long, words array<string>")
    packed = cut.groupBy("_sid", "block").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))  # a block's words
    words = F.flatten(F.transform("parts", lambda p: p["words"]))
    names = mix.sources.select("_sid", F.when(F.col("_source") != "1", F.substring("_source", 2, 1 << 30)).alias("source"))
    return mix.slots.join(packed.withColumn("words", words).hint("merge"), ["_sid", "block"]).join(names, "_sid").select(
        "shard", "source", "slot", "block", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"))


def mixed_documents(docs: DataFrame, block: int = 256, seed: int = SEED) -> DataFrame:
    """The mix itself as documents: the taken words of each document, once for each pass over its source.

    A pass that takes a whole document returns its whole text; a pass that takes
    some of its blocks returns those words, runs joined by a newline.  Columns
    are those of ``docs``, with ``n_chars`` recomputed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "mixed")
    row, left, held, several, wanted = spare(docs, "row", "left", "held", "several", "spans")
    kept = ws.save(docs.withColumn(row, F.monotonically_increasing_id()))
    mix = Mix(ws, kept, block, seed, row=row)
    passes = mix.slots.join(mix.sources.select("_sid", "_blocks"), "_sid").select(
        "_sid", "block", F.floor(F.col("slot") / F.col("_blocks")).alias("pass"))
    spans = (
        mix.pieces().join(passes.hint("merge"), ["_sid", "block"])
        .groupBy("_at", "pass").agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("spans"))
    )
    rows = mix.rows.select("_at", F.col("_row").alias(row), F.col("size").alias(held)).join(spans, "_at").groupBy(row, held).agg(
        F.collect_list(F.struct(F.col("pass"), F.col("spans"))).alias(several))
    out = kept.join(rows, row).withColumn(left, F.explode(F.sort_array(several)))
    whole = F.aggregate(F.col(left)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["_to"] - s["_from"]) == F.col(held)
    out = out.select(*docs.columns, F.when(~whole, F.col(left)["spans"]).alias(wanted))
    cut = out.mapInArrow(_cut_batches(wanted), out.drop(wanted).schema)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def _cut_batches(wanted: str):
    """``text`` cut to the word spans of the column ``wanted``; null spans leave it whole."""

    @lean
    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for t, s in zip(batch.column(at), batch.column(batch.schema.get_field_index(wanted)), strict=True):
                t, s = t.as_py(), s.as_py()
                if s is not None and t is not None:
                    edges = [m.span() for m in _WORDS.finditer(t)]
                    joined: list[list[int]] = []
                    for x in s:
                        if joined and joined[-1][1] == x["_from"]:
                            joined[-1][1] = x["_to"]
                        else:
                            joined.append([x["_from"], x["_to"]])
                    t = "\n".join(t[edges[a][0] : edges[b - 1][1]] for a, b in joined)
                texts.append(t)
            keep = [n for n in batch.schema.names if n != wanted]
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays(cols, names=keep)

    return cut


@lean
def _cut_pieces(batches):
    """The words of each block's part of a text."""
    for batch in batches:
        for t, s in zip(batch.column(0), batch.column(1), strict=True):
            words, rows = _WORDS.findall(t.as_py() or ""), s.as_py()
            columns = (
                pa.array([x["_sid"] for x in rows], pa.int32()), pa.array([x["block"] for x in rows], pa.int64()),
                pa.array([x["_start"] + x["_from"] for x in rows], pa.int64()),
                pa.array([words[x["_from"] : x["_to"]] for x in rows], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(list(columns), names=["_sid", "block", "first", "words"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: size, source size, the source's target and the words taken."""
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


