"""Quality rules: counts of each whole text, and a hashed n-gram logistic regression.

The counts (words, symbols, repeated lines and repeated 8-word windows) fail a
text outright.  The others are kept or not by a logistic regression over hashed
character 2-, 3- and 4-grams and word 1- and 2-grams, each kind's features being
shares of the text's n-grams of that kind.  It is fitted on a bounded sample of
labelled rows (``PER_CLASS`` of each label; folds 2 to 4), calibrated to
probabilities on another (``CALIBRATE`` rows of fold 1), and applied to Arrow
batches against the fixed threshold ``KEEP``.  Fold 0 is never learned from.

Cases: null and empty texts have no words and fail; repeated rows are separate
rows; an empty table gives an empty result; without labels of both kinds only
the counts decide; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.labelled import lowest, quality_labels
from gleaner.llm.textkit import INK_BYTES, U64, Chunk, chunks, lean, mix, ngrams, small_batches, string_rows

BITS, KINDS, SCALE = 16, 5, 40.0
PER_CLASS, CALIBRATE, STEPS, RATE, DECAY = 800, 1000, 120, 0.25, 1e-4
KEEP, MIN_WORDS, REPEATED_PERCENT, WINDOW = 0.3, 20, 30, 8
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])


def _sums(marks: np.ndarray, chunk: Chunk) -> np.ndarray:
    """How many bytes of each document are marked."""
    c = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return c[chunk.stops] - c[chunk.starts]


def counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The rule counts of each document of a chunk."""
    starts, ends, doc = chunk.words(INK_BYTES)
    ink = INK_BYTES[chunk.buf]
    n_words = np.bincount(doc, minlength=chunk.n)
    out = {"n_words": n_words, "word_chars": _sums(ink & ((chunk.buf & 0xC0) != 0x80), chunk), "n_symbols": _sums(SYMBOLS[chunk.buf], chunk)}
    line_end = np.flatnonzero(chunk.buf == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    inked = np.concatenate(([0], np.cumsum(ink)))
    full = inked[line_end] > inked[line_start]
    line_start, line_end = line_start[full], line_end[full]
    owner = chunk.doc_of(line_start)
    key = mix(chunk.span_hash(line_start, line_end) ^ mix(owner.astype(U64)))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=chunk.n) - np.bincount(owner[first], minlength=chunk.n)
    words = chunk.span_hash(starts, ends)
    grams, at = ngrams(words, doc, WINDOW)
    grams = mix(grams ^ mix(doc[at].astype(U64)))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=chunk.n)
    out["_words"] = (words, doc)
    return out


def features(chunk: Chunk, words: np.ndarray, doc: np.ndarray):
    """For each kind of n-gram: its buckets, and each document's first and last one."""
    text = chunk.buf.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    before = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))  # characters before each byte
    first, stop = before[chunk.starts], before[chunk.stops]
    gram = points
    for n in (2, 3, 4):
        gram = gram[:-1] * U64(0x9E3779B97F4A7C15) + points[n - 1 :]
        bucket = ((gram * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)).astype(np.int64)
        last = np.maximum(stop - n, first)  # within the text and its closing newline
        yield bucket, first, np.minimum(last + (stop - first >= n), len(bucket))
    edges = np.searchsorted(doc, np.arange(chunk.n + 1))
    yield (words >> U64(64 - BITS)).astype(np.int64), edges[:-1], edges[1:]
    pairs, at = ngrams(words, doc, 2)
    edges = np.searchsorted(doc[at], np.arange(chunk.n + 1))
    yield (pairs >> U64(64 - BITS)).astype(np.int64), edges[:-1], edges[1:]


def margins(weights: np.ndarray, chunk: Chunk, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The linear score of each document, without the intercept."""
    out = np.zeros(chunk.n)
    for kind, (bucket, a, z) in enumerate(features(chunk, words, doc)):
        c = np.concatenate(([0.0], np.cumsum(weights[kind][bucket], dtype=np.float64)))
        z = np.maximum(a, z)
        out += SCALE * (c[z] - c[a]) / np.maximum(1, z - a)
    return out


def sparse_rows(chunk: Chunk) -> list[tuple[bytes, bytes]]:
    """Each document's features as (int32 indices, float32 values)."""
    starts, ends, doc = chunk.words(INK_BYTES)
    words = chunk.span_hash(starts, ends)
    parts: list[tuple[list, list]] = [([], []) for _ in range(chunk.n)]
    for kind, (bucket, a, z) in enumerate(features(chunk, words, doc)):
        for d in range(chunk.n):
            own = bucket[a[d] : max(a[d], z[d])]
            if len(own):
                at, n = np.unique(own, return_counts=True)
                parts[d][0].append((at + (kind << BITS)).astype(np.int32))
                parts[d][1].append((n * (SCALE / len(own))).astype(np.float32))
    join = lambda x, t: np.concatenate(x).tobytes() if x else np.empty(0, t).tobytes()
    return [(join(i, np.int32), join(v, np.float32)) for i, v in parts]


@lean
def _featurise(batches):
    for batch in batches:
        rows: list[tuple[bytes, bytes]] = []
        for _, texts in string_rows(batch):
            for _, held in chunks(texts):
                rows += sparse_rows(Chunk(held))
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "quality", "fold")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            names=["doc_id", "quality", "fold", "at", "val"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list, dims: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; classes count alike."""
    at = np.concatenate([np.frombuffer(r["at"], np.int32) for r in rows])
    val = np.concatenate([np.frombuffer(r["val"], np.float32) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) // 4 for r in rows])
    y = np.array([r["quality"] for r in rows], float)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, STEPS + 1):
        err = (_sigmoid(np.bincount(row, val * w[at], len(rows)) + b) - y) * share
        g, gb = np.bincount(at, val * err[row], dims) + DECAY * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = RATE * (1 - t / (STEPS + 1)) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w, b


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept by Newton steps, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = np.median(np.abs(x)) or 1.0
    z = np.stack([x / unit, np.ones(len(x))], 1)

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, z @ w) - target * (z @ w)).sum() + 0.5 * w[0] ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(z @ w)
        g = z.T @ (p - target) + [w[0], 0.0]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1e-6]), g)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(w[0] / unit), float(w[1])


def train(docs: DataFrame, labels: DataFrame):
    """(weights by kind, slope, intercept), or None without labels of both kinds."""
    known = quality_labels(labels)
    wanted = (
        lowest(known.where("fold > 1 and quality = 1"), PER_CLASS, 1)
        .unionByName(lowest(known.where("fold > 1 and quality = 0"), PER_CLASS, 1))
        .unionByName(lowest(known.where("fold = 1"), CALIBRATE, 2))
    )  # at most 2 * PER_CLASS + CALIBRATE rows: small enough to broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    made = texts.mapInArrow(_featurise, "doc_id long, quality int, fold int, at binary, val binary")
    # one text for each id, however often it is repeated
    rows = made.groupBy("doc_id", "quality", "fold").agg(F.min(F.struct("at", "val")).alias("x")).select("doc_id", "quality", "fold", "x.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    fitted = [r for r in rows if r["fold"] > 1]
    if len({r["quality"] for r in fitted}) < 2:
        return None
    w, b = fit(fitted, KINDS << BITS)
    held = [r for r in rows if r["fold"] == 1]
    x = np.array([float(np.frombuffer(r["val"], np.float32) @ w[np.frombuffer(r["at"], np.int32)]) + b for r in held])
    slope, shift = calibrate(x, np.array([r["quality"] for r in held], float))
    return w.reshape(KINDS, -1).astype(np.float32), slope, slope * b + shift


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, whether they fail it, the model's probability and the verdict."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def score(batches):
        model = shared.value
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for _, texts in string_rows(batch):
                for _, held in chunks(texts):
                    chunk = Chunk(held)
                    c = counts(chunk)
                    n = c["n_words"]
                    failed = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEATED_PERCENT * n)
                    p = np.ones(chunk.n) if model is None else _sigmoid(model[1] * margins(model[0], chunk, *c["_words"]) + model[2])
                    parts.append([n, c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], failed, ~failed & (p >= KEEP), p])
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            if columns:
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(score, SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
