"""Document near-duplicates by ProbMinHash over weighted word shingles.

A document is its shingles of five words (lower case; runs of ASCII letters,
digits and non-ASCII characters), each weighted ``1 + ln(count)``.  Every shingle
is a Poisson process whose rate is its weight: its arrivals fall on one of
``REGISTERS`` registers, a register keeps its earliest shingle, and a shingle stops
when its next arrival is later than the latest register.  Registers of two documents
agree with their probability Jaccard.  ``BANDS`` bands of ``ROWS`` registers make
buckets.  That similarity falls below the Jaccard of the shingle sets where one
side repeats a passage, so a document with repeated shingles is signed a second
time with all weights 1, and such registers agree with the sets' Jaccard; without
repeats both signatures are the same, so all share one space of buckets.  Pairs
are then verified on the whole texts by the Jaccard similarity of their shingle
sets, 0.8 or more, and linked documents are one class.

Cases: equal texts are one class whatever their length, texts without words too,
which link with no other text; texts of one to four words are one shingle; null
text is empty; repeated rows are of one class; texts are told apart by 64-bit
hashes; an empty table gives an empty result; other columns pass through where
rows are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.linking import WORDS, classes, short_shingle
from gleaner.llm.textkit import U64, Chunk, chunks, lean, mix, ngrams, small_batches, string_rows
from gleaner.llm.workspace import Workspace, spare

REGISTERS, BANDS, ROWS, SEEN = 64, 16, 4, 500_000


def weighted_shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document, weight) of a chunk of lower-cased texts."""
    starts, ends, doc = chunk.words()
    h = chunk.span_hash(starts, ends)
    grams, at = ngrams(h, doc, WORDS)
    short, few = short_shingle(h, doc, chunk.n)
    value, owner = np.concatenate([grams, short]), np.concatenate([doc[at], few])
    key = mix(value ^ mix(owner.astype(U64) + U64(1)))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return value[first], owner[first], 1 + np.log(count)


def prob_minhash(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) shingles with the earliest arrival in each register; all documents advance together."""
    time = np.full(n * m, np.inf)
    best = np.zeros(n * m, U64)
    live, state, clock = np.arange(len(value)), value, np.zeros(len(value))
    while len(live):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        uniform = ((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(uniform) / weight[live]
        spot = owner[live] * m + (((mix(state) >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        np.minimum.at(time, spot, clock)
        won = time[spot] == clock
        best[spot[won]] = value[live[won]]
        still = clock < time.reshape(n, m).max(1)[owner[live]]
        live, state, clock = live[still], state[still], clock[still]
    return best.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys of groups of ``rows`` registers."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64)[None, :], parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * U64(0x880355F21E6D1965) + parts[:, :, r])
    return key.view(np.int64)


def signatures(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, registers): each document with shingles once, and again with weights 1 where shingles repeat."""
    some = np.flatnonzero(np.bincount(owner, minlength=n))
    again = np.flatnonzero(np.bincount(owner[weight > 1], minlength=n))
    place = np.full(n, -1)
    place[again] = np.arange(len(again))
    plain = place[owner] >= 0
    sets = prob_minhash(value[plain], place[owner[plain]], np.ones(int(plain.sum())), len(again))
    return np.concatenate([some, again]), np.concatenate([prob_minhash(value, owner, weight, n)[some], sets])


@lean
def _bands(batches):
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        for first, texts in string_rows(batch):
            at = first
            own = [(i, t) for i, t in zip(ids[first : first + len(texts)], texts, strict=True) if not (i in seen or seen.add(i))]
            if len(seen) > SEEN:
                seen.clear()
            at = 0
            for _, held in chunks([(t or "").lower() for _, t in own]):
                chunk = Chunk(held)
                value, owner, weight = weighted_shingles(chunk)
                if len(value):
                    signed, registers = signatures(value, owner, weight, chunk.n)
                    keys = band_keys(registers, BANDS, ROWS)
                    of = np.array([own[at + d][0] for d in signed], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(of, BANDS))], names=["bucket", "id"])
                at += chunk.n


def near_classes(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of texts that link with another text; ids are ``text_id``s."""
    small_batches(docs.sparkSession)
    source = docs.select(text_id().alias("id"), "text")
    bands = source.mapInArrow(_bands, "bucket long, id long")

    def fetch(ids: DataFrame) -> DataFrame:
        return source.join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))

    return classes(bands, fetch, "words", ws)


def text_id():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def label_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (with a long doc_id) with the least doc_id of its class, the class's size and whether it stays.

    Of several rows with that doc_id and the same text all are marked; use
    ``deduplicated`` for one row per class.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    found = near_classes(docs, ws)
    slim = docs.select("doc_id", text_id().alias("id"))
    copies = slim.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    labelled = copies.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = ws.save(labelled)
    group = ws.save(labelled.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")))
    ids = ws.save(labelled.join(group, "component").select("id", "class_id", "class_size"))
    rows = slim.join(ids, "id").select("doc_id", "id", "class_id", "class_size")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, the one of least doc_id (and least text hash)."""
    ws = Workspace(docs.sparkSession, "deduplicated")
    (row,) = spare(docs, "row")
    rows = ws.save(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_classes(rows, ws)
    member = rows.select(F.col(row).alias("row"), "doc_id", text_id().alias("id")).join(found, "id", "left")
    member = ws.save(member.select("row", "doc_id", "id", F.coalesce("component", "id").alias("component")))
    several = ws.save(member.groupBy("component").agg(F.min(F.struct("doc_id", "id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    # those that go are fewer than those that stay
    gone = ws.save(member.join(several, "component").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)))
    return rows.join(gone, row, "left_anti").drop(row)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class (least doc_id), its size, and whether this one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return label_documents(slim).select("doc_id", "class_id", "class_size", "kept")
