"""Fuzzy line dedup by MinHash of character shingles.

Lines are the parts of a text between newlines; a line counts when it is not
blank, and is told by a 64-bit hash of its lower-cased form without the blanks at
its ends.  Each distinct line of ``CHARS`` characters or more is signed over its
shingles of eight characters (one-permutation hashing where it has enough of
them, repeated throws where not; lines near the border are signed both ways),
``BANDS`` bands of ``ROWS`` make buckets, and pairs are verified by the exact
Jaccard similarity of their shingle sets, 0.8 or more.  Of each component of
linked lines the first occurrence by (doc_id, text hash, line number) stays.

Cases: null text is empty; blank lines always stay; a line of fewer than ``CHARS``
characters is one shingle, so it links with equal lines only, which its hash
tells; of rows repeated with the same doc_id and text one is the first, and the
others keep no counting line; an empty table gives an empty result; other columns
pass through where rows are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.linking import CHARS, PACKED, char_grams, classes, pack
from gleaner.llm.near_dedup import band_keys, prob_minhash
from gleaner.llm.textkit import INK_BYTES, U64, Chunk, chunks, id_filter, lean, may_hold, mix, small_batches, string_rows
from gleaner.llm.workspace import Workspace, spare

BANDS, ROWS, BORDER, FEW, SEEN, SENT = 12, 4, 72, 13, 1_000_000, 16 << 20
#: bytes of text at a time: arrays of their shingles stay in a core's cache
LINE_BYTES = 1 << 18
M = BANDS * ROWS


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


class Lines:
    """The counting lines of a chunk of lower-cased texts."""

    def __init__(self, encoded: list[bytes]):
        self.chunk = chunk = Chunk(encoded)
        end = np.flatnonzero(chunk.buf == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        doc = chunk.doc_of(start)
        number = np.arange(len(start)) - np.searchsorted(doc, doc, side="left")
        full = np.arange(len(start))
        for edge in (0, 1):  # cut blanks at the ends, a byte of all lines at a time
            for _ in range(8):
                blank = np.flatnonzero((start < end) & ~INK_BYTES[chunk.buf[end - 1 if edge else start]])
                if edge:
                    end[blank] -= 1
                else:
                    start[blank] += 1
        for i in np.flatnonzero((start < end) & ~(INK_BYTES[chunk.buf[start]] & INK_BYTES[chunk.buf[end - 1]])).tolist():
            raw = chunk.buf[start[i] : end[i]].tobytes()  # the few lines with long blank ends
            start[i] += len(raw) - len(raw.lstrip())
            end[i] -= len(raw) - len(raw.rstrip()) if raw.strip() else 0
        full = full[start < end]
        start, end = start[full], end[full]
        #: characters before each byte
        self.points = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))
        self.start, self.end, self.doc, self.number = start, end, doc[full], number[full]
        self.id = chunk.span_hash(self.start, self.end).view(np.int64)
        self.n_lines = np.bincount(doc, minlength=chunk.n)


def line_chunks(batch):
    """(first row, Lines) over an Arrow batch with a text column."""
    for first, texts in string_rows(batch):
        for at, held in chunks([(t or "").lower() for t in texts], LINE_BYTES):
            yield first + at, Lines(held)


def one_permutation(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, M) minima of one hash over M bins; an empty bin borrows from a bin that its number draws."""
    sig = np.full(n * M, np.iinfo(np.uint64).max, U64)
    spot = ((value >> U64(32)) * U64(M)) >> U64(32)  # the bin, from the upper bits
    np.minimum.at(sig, owner * M + spot.astype(np.int64), value)
    sig = sig.reshape(n, M)
    empty = sig == np.iinfo(np.uint64).max
    out, turn = sig.copy(), 0
    while empty.any() and turn < 4096:
        turn += 1
        r, c = np.nonzero(empty)
        draw = (mix(c.astype(U64) * U64(4099) + U64(turn)) % U64(M)).astype(np.int64)
        out[r, c] = sig[r, draw]
        empty[r, c] = out[r, c] == np.iinfo(np.uint64).max
    return out


def sign(lines: Lines, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the line, band keys); a line near the border comes twice, one without shingles not at all."""
    points = np.frombuffer(lines.chunk.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = char_grams(points)
    first = lines.points[lines.start[pick]]
    n = lines.points[lines.end[pick]] - first - CHARS + 1
    found, keys = [np.empty(0, np.int64)], [np.empty((0, BANDS), np.int64)]
    # lines of few shingles take many turns to fill their registers: on their own they are few and cheap
    for short, own in ((True, (n > 0) & (n < FEW)), (True, (n >= FEW) & (n < BORDER / 0.78)), (False, n >= BORDER * 0.78)):
        own = np.flatnonzero(own)
        if not len(own):
            continue
        owner = np.repeat(np.arange(len(own)), n[own])
        value = grams[np.arange(len(owner)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + first[own][owner]]
        if short:  # a set: repeated shingles count once, as equal ones arrive at the same times
            sig = prob_minhash(value, owner, np.ones(len(value)), len(own), M)
        else:
            sig = one_permutation(value, owner, len(own))
        found.append(own)
        keys.append(band_keys(sig, BANDS, ROWS) ^ np.int64(short))
    at = np.concatenate(found)
    return pick[at], np.concatenate(keys)


READ = "line long, doc_id long, row long, at int, copy long, slice int, packed binary"


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)


@lean
def _read(batches):
    """A row for every document with its number of lines and its ``copy``, one for each counting line, and packed (band key, line) rows.

    A line's band keys come the first time that this task meets it.
    """
    seen: set[int] = set()
    keys, ids, size = [], [], 0
    for batch in batches:
        doc_id, key, copy = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row", "copy"))
        for first, lines in line_chunks(batch):
            new = np.array([x not in seen and not seen.add(x) for x in lines.id.tolist()], bool)
            if len(seen) > SEEN:
                seen.clear()
            of, bands = sign(lines, np.flatnonzero(new))
            keys.append(bands.ravel())
            ids.append(np.repeat(lines.id[of], BANDS))
            size += len(ids[-1])
            doc = pa.array(np.arange(lines.chunk.n) + first)
            yield _rows(doc_id=doc_id.take(doc), row=key.take(doc), at=pa.array(lines.n_lines.astype(np.int32)), copy=copy.take(doc))
            doc = pa.array(lines.doc + first)
            yield _rows(line=pa.array(lines.id), doc_id=doc_id.take(doc), row=key.take(doc), at=pa.array(lines.number.astype(np.int32)))
            if size > PACKED:
                of, packed = pack(np.concatenate(keys), np.concatenate(ids))
                keys, ids, size = [], [], 0
                yield _rows(slice=of, packed=packed)
    if size:
        of, packed = pack(np.concatenate(keys), np.concatenate(ids))
        yield _rows(slice=of, packed=packed)


def _line_texts(wanted):
    """(id, text) of the lines that pass a filter of ids, once in a while for each."""

    @lean
    def texts(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, lines in line_chunks(batch):
                raw = lines.chunk.buf.tobytes()
                ids, out = [], []
                for i in np.flatnonzero(may_hold(wanted.value, lines.id)).tolist():
                    line = int(lines.id[i])
                    if line not in seen:
                        seen.add(line)
                        ids.append(line)
                        out.append(raw[lines.start[i] : lines.end[i]].decode("utf-8", "surrogatepass"))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    return texts


class Repeats:
    """What repeats in ``docs``; ``row`` is ``row_key()``.

    ``counts`` (doc_id, row, n_lines, copy) has a row for each row of ``docs``;
    ``dropped`` (row, dropped, every) the sorted numbers of the lines that go from the
    first of the rows with that key, and, where there are several, from the others;
    ``again`` (row, first) tells the copy that is the first.
    """

    def __init__(self, docs: DataFrame, ws: Workspace):
        small_batches(docs.sparkSession)
        source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", row_key().alias("row"))
        numbered = source.withColumn("copy", F.monotonically_increasing_id())
        read = ws.save(numbered.mapInArrow(_read, READ))
        self.counts = read.where("copy is not null").select("doc_id", "row", F.col("at").cast("long").alias("n_lines"), "copy")
        self.again = ws.save(self.counts.groupBy("row").agg(F.min("copy").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        seen = read.where("line is not null").select("line", "doc_id", "row", "at")
        place = F.struct("doc_id", "row", "at")
        lines = ws.save(seen.groupBy("line").agg(F.count("*").alias("n")))

        def fetch(ids: DataFrame) -> DataFrame:
            # the filter's size is bounded; whole texts are read again, but only lines are shuffled
            wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
            texts = source.select("text").mapInArrow(_line_texts(wanted), "id long, text string")
            return texts.join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))

        linked = classes(read.where("slice is not null").select("slice", "packed"), fetch, "chars", ws)
        # most lines neither recur nor link: only the others' places matter
        of = lines.join(linked.withColumnRenamed("id", "line"), "line", "left").where("n > 1 or component is not null")
        of = of.select("line", F.coalesce("component", "line").alias("component"))
        many = ws.save(seen.join(of, "line").select("component", place.alias("place")))
        stays = ws.save(many.groupBy("component").agg(F.min("place").alias("stays")))
        lost = many.join(stays, "component").where(F.col("place") != F.col("stays"))
        numbers = lambda at: F.sort_array(F.collect_set(at))
        once = lost.groupBy("place.row").agg(numbers("place.at").alias("dropped"))
        self.repeated_rows = bool(self.again.limit(1).count())
        if self.repeated_rows:
            every = seen.join(self.again, "row").groupBy("row").agg(numbers("at").alias("every"))
            self.dropped = ws.save(once.join(every, "row", "full"))
        else:
            self.dropped = ws.save(once.withColumn("every", F.lit(None).cast("array<int>")))
        ws.drop(lines, linked, many, stays)
        self.read = read


def line_counts(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many stay, and the numbers (from 0) of those that go."""
    found = Repeats(docs, Workspace(docs.sparkSession, "lines"))
    rows = found.counts.join(found.again, "row", "left").join(found.dropped, "row", "left")
    gone = F.when(F.col("copy") != F.col("first"), F.col("every")).otherwise(F.col("dropped"))
    gone = F.coalesce(gone, F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size(gone)).cast("long").alias("n_kept"), gone.alias("dropped"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` (and ``n_chars`` recomputed where there is one)."""
    ws = Workspace(docs.sparkSession, "lines")
    found = Repeats(docs, ws)
    ws.drop(found.read)
    names = docs.columns
    row, gone, every, number, parts = spare(docs, "row", "gone", "every", "number", "parts")
    dropped = found.dropped.select(F.col("row").alias(row), F.col("dropped").alias(gone), F.col("every").alias(every))
    size = found.dropped.agg(F.sum(F.lit(32) + 4 * (F.greatest(F.size("dropped"), F.lit(0)) + F.greatest(F.size("every"), F.lit(0))))).first()[0]
    if (size or 0) <= SENT:  # whole texts are shuffled only where the line numbers are too many to send
        dropped = F.broadcast(dropped)
    joined = docs.withColumn(row, row_key()).join(dropped, row, "left")
    if found.repeated_rows:
        # copies are alike but for other columns, so any of them may be the first
        joined = joined.withColumn(number, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1))))
        joined = joined.withColumn(gone, F.when(F.col(number) == 1, F.col(gone)).otherwise(F.col(every)))
    # a column of its own, used twice: inside the lambda the text would be split for every line
    joined = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).select(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_counts(docs.select("doc_id", "text"))
