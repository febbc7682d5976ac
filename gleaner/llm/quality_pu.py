"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are training rows labelled 1; the unlabelled sample is web
text as it comes.  Both are bounded samples (``POSITIVES`` and ``UNLABELLED``
rows of lowest hashed id).  Each whole text becomes shares and ratios of its
words, characters and lines, cut into quantile bins of the unlabelled sample; a
linear model over the bins minimises

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

with logistic loss, stepping against the second part where it is negative.  The
class prior is estimated first, cross-fitted: a positive-against-unlabelled model
of one half ranks the other, and the prior is the ratio of the shares above the
cut where its upper confidence bound is lowest.  The score is the model's posterior,
its log odds moved by one number so that the threshold stands at the margin that all
but ``LOST`` of ``CALIBRATE`` trusted positives of fold 1 reach, rows that the fit
does not use.  No row labelled 0 is used anywhere, and fold 0 is never learned from.

Cases: null and empty texts are scored like any other; repeated rows are
separate rows; an empty table gives an empty result; without positives every
text scores 0.5; other columns are ignored and never inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.labelled import fold, lowest, quality_labels
from gleaner.llm.textkit import INK_BYTES, U64, Chunk, chunks, lean, mix, ngrams, small_batches, string_rows

POSITIVES, UNLABELLED, CALIBRATE, LOST, BINS, STEPS, RATE, DECAY = 6000, 12000, 3000, 0.002, 16, 400, 0.05, 3e-4
THRESHOLD = 0.3
FEATURES = (
    "symbols", "uppercase", "bars", "exclamations", "digits", "punctuation", "newlines", "word_length", "short_words", "distinct_words",
    "repeated_neighbours", "repeated_5grams", "log_words", "words_ending_in_letter", "repeated_lines", "words_starting_upper", "periods", "long_words",
)


def _table(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)])


_SYMBOL, _UPPER, _LOWER = _table(lambda c: c in "#*$%&<>@^~=+_{}[]\\/"), _table(str.isupper), _table(str.islower)
_DIGIT, _PUNCT, _LETTER = _table(str.isdigit), _table(lambda c: c in ",;:'\"()-?"), np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def measure(chunk: Chunk) -> np.ndarray:
    """The features of each document, one row each."""
    n = chunk.n
    length = np.maximum(1, chunk.stops - chunk.starts - 1)
    starts, ends, doc = chunk.words(INK_BYTES)
    n_words = np.bincount(doc, minlength=n)
    words = np.maximum(1, n_words)

    def share(table: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(table[chunk.buf])))
        return (c[chunk.stops] - c[chunk.starts]) / length

    def of_words(mark: np.ndarray) -> np.ndarray:
        return np.bincount(doc, mark, n) / words

    size = ends - starts
    first, last = chunk.buf[starts], chunk.buf[np.maximum(ends - 1, 0)]
    h = chunk.span_hash(starts, ends)
    own = mix(h ^ mix(doc.astype(U64)))
    kept = np.unique(own, return_index=True)[1]
    again = np.concatenate(([False], own[1:] == own[:-1])) if len(own) else np.empty(0, bool)
    grams, at = ngrams(h, doc, 5)
    grams = mix(grams ^ mix(doc[at].astype(U64)))
    distinct = np.unique(grams, return_index=True)[1]
    n_grams = np.bincount(doc[at], minlength=n)
    line_end = np.flatnonzero(chunk.buf == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_doc = chunk.doc_of(line_start)
    line_key = mix(chunk.span_hash(line_start, line_end) ^ mix(line_doc.astype(U64)))
    lines = np.bincount(line_doc, minlength=n)
    line_kept = np.bincount(line_doc[np.unique(line_key, return_index=True)[1]], minlength=n)
    one = lambda c: _table(lambda x: x == c)
    columns = [
        share(_SYMBOL), share(_UPPER), share(one("|")), share(one("!")), share(_DIGIT), share(_PUNCT), share(one("\n")),
        of_words(size), of_words(size <= 3), np.bincount(doc[kept], minlength=n) / words / np.sqrt(200 / np.maximum(200, words)),
        of_words(again), 1 - np.bincount(doc[at][distinct], minlength=n) / np.maximum(1, n_grams), np.log1p(n_words),
        of_words(_LETTER[last]), 1 - line_kept / np.maximum(1, lines), of_words(_UPPER[first]), share(one(".")), of_words(size >= 18),
    ]
    return np.stack(columns, 1).astype(np.float64)


@lean
def _measure_batches(batches):
    for batch in batches:
        rows = [measure(Chunk(held)) for _, texts in string_rows(batch) for _, held in chunks(texts)]
        if rows:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(np.concatenate(rows)), pa.list_(pa.float64()))], names=["doc_id", "x"])


class Model:
    """Quantile bins and one weight for each bin of each feature."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.w, self.shift = cuts, np.zeros(len(cuts) * BINS + 1), 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") + j * BINS for j, c in enumerate(self.cuts)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.w[bins].sum(1) + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(x)) + self.shift)

    def set_threshold(self, pos: np.ndarray) -> None:
        """All but ``LOST`` of these positives score the threshold or more."""
        cut = np.quantile(self.margin(self.bins(pos)), LOST, method="lower")
        self.shift = float(math.log(THRESHOLD / (1 - THRESHOLD)) - cut + 1e-9)

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None) -> Model:
        """With a prior: the non-negative risk.  Without: positives against unlabelled."""
        bp, bu = self.bins(pos), self.bins(unl)
        self.w[:] = 0
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)

        def spread(bins: np.ndarray, d: np.ndarray) -> np.ndarray:
            g = np.bincount(bins.ravel(), np.repeat(d / len(d), bins.shape[1]), len(self.w))
            g[-1] = d.mean()
            return g

        for t in range(1, STEPS + 1):
            fp, fu = self.margin(bp), self.margin(bu)
            if prior is None:
                g = spread(bp, _sigmoid(fp) - 1) + spread(bu, _sigmoid(fu))
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                part = spread(bu, _sigmoid(fu)) - prior * spread(bp, _sigmoid(fp))
                g = -part if negative < 0 else prior * spread(bp, _sigmoid(fp) - 1) + part
            g = g + DECAY * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= RATE * (1 - 0.9 * t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the scores of both samples."""
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.99, 100)))
    p = np.array([(pos >= c).mean() for c in cuts])
    u = np.array([(unl >= c).mean() for c in cuts])
    slack = math.sqrt(math.log(4 / delta) / (2 * len(unl))) + math.sqrt(math.log(4 / delta) / (2 * len(pos)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def estimate_prior(model: Model, pos: np.ndarray, unl: np.ndarray) -> float:
    """Cross-fitted: each half of the samples is ranked by a model of the other half."""
    parts = []
    for k in (0, 1):
        model.fit(pos[k::2], unl[k::2], None)
        if len(pos[1 - k :: 2]) and len(unl[1 - k :: 2]):
            parts.append(class_prior(model.margin(model.bins(pos[1 - k :: 2])), model.margin(model.bins(unl[1 - k :: 2]))))
    return float(np.mean(parts)) if parts else 0.5


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    known = quality_labels(labels)
    trusted = lowest(known.where("fold > 1 and quality = 1").select("doc_id"), POSITIVES, 11).withColumn("role", F.lit("p"))
    web = lowest(docs.where("doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id")), UNLABELLED, 12)
    held = lowest(known.where("fold = 1 and quality = 1").select("doc_id"), CALIBRATE, 13).withColumn("role", F.lit("c"))
    wanted = trusted.unionByName(web.withColumn("role", F.lit("u"))).unionByName(held)
    # at most POSITIVES + UNLABELLED + CALIBRATE ids: small enough to broadcast
    ids = wanted.groupBy("doc_id").agg(F.collect_set("role").alias("roles"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    # one text for each id, however often it is repeated
    once = texts.mapInArrow(_measure_batches, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    found = once.join(F.broadcast(ids), "doc_id").collect()
    found.sort(key=lambda r: r["doc_id"])
    pos = np.array([r["x"] for r in found if "p" in r["roles"]])
    unl = np.array([r["x"] for r in found if "u" in r["roles"]])
    if not len(pos) or not len(unl):
        return None
    cuts = [np.unique(np.quantile(unl[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(len(FEATURES))]
    model = Model(cuts)
    prior = estimate_prior(model, pos, unl)
    model.fit(pos, unl, prior)
    calm = np.array([r["x"] for r in found if "c" in r["roles"]])
    if len(calm):
        model.set_threshold(calm)
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, labels: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Score every document; with ``keep_rows`` the documents' own columns of those predicted 1 instead."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scores(batch) -> np.ndarray:
        rows = []
        for _, texts in string_rows(batch):
            for _, held in chunks(texts):
                rows.append(np.full(len(held), 0.5) if model.value is None else model.value.score(measure(Chunk(held))))
        return np.concatenate(rows) if rows else np.empty(0)

    @lean
    def score(batches):
        for batch in batches:
            s = scores(batch)
            columns = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    @lean
    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) >= THRESHOLD, pa.bool_()))

    if keep_rows:
        return docs.mapInArrow(keep, docs.schema)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return slim.mapInArrow(score, SCHEMA)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
