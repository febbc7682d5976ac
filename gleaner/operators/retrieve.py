"""Retrieval: exact BM25 and dense top-k with a total order.

Scores are rounded before they order rows, so that the order in which partial
sums meet cannot change a ranking; ties end in the unique id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleaner.functions import vectors
from gleaner.operators.index import Index, term_score

DIGITS = 9


def top_k(df: DataFrame, k: int, group: list[str], *order: Column) -> DataFrame:
    """Rows ranked 1 to k within their group; Spark cuts each task's rows to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_scores(index: Index, terms: DataFrame) -> DataFrame:
    """(key, query_id, doc, score) of all pairs that share a term.

    The query terms meet the frequencies first: both are small beside the
    postings, and only matching postings reach the aggregation.
    """
    known = terms.join(index.frequencies, "term")
    known = known.join(index.stats, index.key) if index.key else known.crossJoin(index.stats)  # one row of statistics
    hits = index.postings.join(known, [*index.key, "term"]).join(index.lengths, [*index.key, "doc"])
    one = F.col("qf") * term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return hits.groupBy(*index.key, "query_id", "doc").agg(F.round(F.sum(one), DIGITS).alias("score"))


def bm25_top_k(index: Index, terms: DataFrame, k: int) -> DataFrame:
    scores = bm25_scores(index, terms).where("score > 0")
    return top_k(scores, k, [*index.key, "query_id"], F.desc("score"), F.col("doc"))


def rarest_terms(terms: DataFrame, frequencies: DataFrame, most: int) -> DataFrame:
    """Of each query's known terms the ``most`` with the least document frequency."""
    return top_k(terms.join(frequencies, "term"), most, ["query_id"], F.col("df"), F.col("term")).drop("rank", "df")


def weighted_postings(fields: list[tuple[DataFrame, float]]) -> DataFrame:
    """Postings (doc, term, tf) of several fields with tf weighted before saturation."""
    out = None
    for postings, weight in fields:
        part = postings.select("doc", "term", (F.col("tf") * F.lit(weight)).alias("tf"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """Exact inner-product top-k of queries (query_id, q) over a corpus (doc, v).

    Every query meets every vector, as an exact search must; each task keeps its own
    k best rows of a query and only those are shuffled.
    """
    scored = _with_queries(queries, "q", corpus, ["doc", "v"], ["query_id", "doc", "score"], lambda ids, groups, batches: _best(ids, groups, batches, k, digits))
    return top_k(scored, k, ["query_id"], F.desc("score"), F.col("doc"))


def cosine_pairs(queries: DataFrame, corpus: DataFrame, digits: int) -> DataFrame:
    """(a, b, cosine) of every query (a, q) with every vector (b, v) of another id; null where a vector is not usable."""
    return _with_queries(queries, "q", corpus, ["b", "v"], ["a", "b", "cosine"], lambda ids, groups, batches: _cosines(ids, groups, batches, digits))


def _with_queries(queries: DataFrame, vector: str, corpus: DataFrame, columns: list[str], names: list[str], run) -> DataFrame:
    """``run`` over the corpus's batches for each block of queries; work is dealt out by rows, as files need not be."""
    spark, (own,) = corpus.sparkSession, [c for c in queries.columns if c != vector]
    schema = StructType([StructField(names[0], queries.schema[own].dataType), StructField(names[1], corpus.schema[columns[0]].dataType), StructField(names[2], DoubleType())])
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, out = corpus.select(*columns).repartition(tasks), None
    for block in query_blocks(queries):
        found = block.select(own, vector).toArrow().combine_chunks()
        lists = pa.concat_arrays(found[vector].chunks) if len(found) else pa.array([], pa.list_(pa.float64()))
        groups = []
        for width in sorted(set(lists.value_lengths().to_pylist()) - {None}):
            q, ok = vectors.matrix(lists, width)
            groups.append((width, np.flatnonzero(ok), q[ok]))
        shared = spark.sparkContext.broadcast((found[own].to_numpy(), groups))
        part = rows.mapInArrow(lambda batches, shared=shared: (pa.RecordBatch.from_arrays(x, names=names) for x in run(*shared.value, batches)), schema)
        out = part if out is None else out.unionByName(part)
    return out


_MOST = np.finfo(float).max


def _best(ids: np.ndarray, groups: list, batches: Iterator[pa.RecordBatch], k: int, digits: int) -> Iterator[list[pa.Array]]:
    """Each query's k best documents of these batches by (score descending, doc): NaN first, null last."""
    held: tuple | None = None  # row, key, doc of the best so far, ordered by row and place
    floor, last = np.full(len(ids), -np.inf), None  # key and doc of each query's row k, while it has one
    full = np.zeros(len(ids), bool)
    doc_type = None
    for batch in batches:
        doc, lists = batch.column(0), batch.column(1)
        doc_type, names = doc.type, doc.to_numpy(zero_copy_only=False)
        if last is None:
            last = np.empty(len(ids), names.dtype)
        rows, keys, docs = [], [], []

        def keep(row: np.ndarray, key: np.ndarray, name: np.ndarray) -> None:
            """Those of a block (queries x documents) that may be among the best."""
            may = (key > floor[row, None]) | ~full[row, None] | (key == floor[row, None]) & (name[None, :] < last[row, None])
            if key.shape[1] > k and not full[row].all():
                may &= key >= np.partition(key, key.shape[1] - k, axis=1)[:, -k, None]
            i, j = np.nonzero(may)
            rows.append(row[i])
            keys.append(key[i, j])
            docs.append(name[j])

        met = []
        for width, own, q in groups:
            v, ok = vectors.matrix(lists, width)
            met.append((own, ok))
            fit = names[ok]
            for x, y, score in vectors.dots(q, v[ok]):
                score = vectors.rounded(score, digits)
                if not np.isfinite(score).all():
                    score = np.where(np.isnan(score), np.inf, np.clip(score, -_MOST, _MOST))
                keep(own[x], score, fit[y])
        # null scores rank last, by doc; the first k documents of a batch are enough
        every = np.arange(len(ids))
        for own, ok in [*met, (np.setdiff1d(every, np.concatenate([g[1] for g in groups]) if groups else every[:0]), np.zeros(len(names), bool))]:
            less = np.sort(names[~ok])[:k]
            if len(less) and len(own):
                keep(own, np.full((len(own), len(less)), -np.inf), less)
        if held is not None:
            for have, x in zip((rows, keys, docs), held, strict=True):
                have.append(x)
        if not rows:
            continue
        row, key, name = np.concatenate(rows), np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((name, -key, row))
        row, key, name = row[order], key[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        held = tuple(x[place < k] for x in (row, key, name))
        at = place == k - 1
        full[row[at]], floor[row[at]], last[row[at]] = True, key[at], name[at]
    if held is not None:
        row, key, name = held
        score = np.where(key == np.inf, np.nan, np.where(np.abs(key) == _MOST, np.copysign(np.inf, key), key))
        yield [pa.array(ids[row]), pa.array(name, doc_type), pa.array(score, mask=key == -np.inf)]


def _cosines(ids: np.ndarray, groups: list, batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[list[pa.Array]]:
    def rows(of: np.ndarray, name: np.ndarray, value: np.ndarray | None) -> Iterator[list[pa.Array]]:
        a, b = np.repeat(of, len(name)), np.tile(name, len(of))
        other = a != b
        every = bool(other.all())
        flat = pa.nulls(len(a), pa.float64()) if value is None else pa.array(value.ravel(), mask=np.isnan(value.ravel()))
        arrays = [pa.array(a), pa.array(b), flat]
        yield arrays if every else [x.filter(pa.array(other)) for x in arrays]

    norms = {width: vectors.squares(q) for width, _, q in groups}
    for batch in batches:
        names, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for width, own, q in groups:
            v, ok = vectors.matrix(lists, width)
            fit, squares = names[ok], vectors.squares(v[ok])
            for x, y, value in vectors.dots(q, v[ok]):
                with np.errstate(divide="ignore", invalid="ignore"):
                    value /= np.sqrt(norms[width][x, None] * squares[None, y])
                usable = np.isfinite(norms[width][x, None]) & np.isfinite(squares[None, y]) & (norms[width][x, None] > 0) & (squares[None, y] > 0)
                value = np.where(usable, vectors.rounded(np.clip(value, -1, 1), digits), np.nan)
                yield from rows(ids[own[x]], fit[y], value)
            for i in range(0, len(own), 64):
                if not ok.all():
                    yield from rows(ids[own[i : i + 64]], names[~ok], None)
        none = np.setdiff1d(np.arange(len(ids)), np.concatenate([g[1] for g in groups]) if groups else np.arange(0))
        for i in range(0, len(none), 64):
            yield from rows(ids[none[i : i + 64]], names, None)


SENT_BYTES, SENT_ROWS = 32 << 20, 20_000


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """A stated query set in parts small enough to send to every task; the size is checked, never assumed."""
    arrays = [c for c, kind in queries.dtypes if kind.startswith("array")]
    wide = sum((F.greatest(F.size(c), F.lit(0)) * 8 for c in arrays), F.lit(8 * len(queries.columns)))
    n, size = queries.agg(F.count("*"), F.sum(wide)).first()
    blocks = max(1, -(-n // SENT_ROWS), -(-(size or 0) // SENT_BYTES))
    if blocks == 1:
        return [queries]
    part = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    return [queries.where(part == i) for i in range(blocks)]


def against_all(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """A stated query set against all rows: sent to every task in blocks whose size is checked, never assumed."""
    out = None
    for block in query_blocks(queries):
        met = corpus.join(F.broadcast(block), F.lit(True))
        out = met if out is None else out.unionByName(met)
    return out


def first_per(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    return top_k(df, 1, group, *order).drop("rank")


def expansion_terms(seeds: DataFrame, tokens: Column, title: Column, frequencies: DataFrame, n: Column, most: int, widest: float) -> DataFrame:
    """Pseudo-relevance terms of seed documents (query_id, ...): (1 + ln tf) * idf, more if in the title, never too common."""
    t = seeds.select("query_id", F.explode(tokens).alias("term"), title.alias("title"))
    counted = t.groupBy("query_id", "term").agg(F.count("*").alias("tf"), F.max(F.array_contains("title", F.col("term"))).alias("in_title"))
    known = counted.join(frequencies, "term").where(F.col("df") / n <= widest)
    weight = (1 + F.ln("tf")) * F.ln((n + 1) / (F.col("df") + 1)) * F.when(F.col("in_title"), 1.25).otherwise(1.0)
    return top_k(known.withColumn("weight", F.round(weight, DIGITS)), most, ["query_id"], F.desc("weight"), F.col("term"))


def map_by_precedence(found: DataFrame, corpus: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """Match (result_id, url) to (id, url) at the first level of keys that finds anything; several ids are ambiguous."""
    out = None
    for order, (name, key) in enumerate(levels):
        left = found.select("result_id", key.alias("k"))
        right = corpus.select("id", key.alias("k")).distinct()
        hit = left.join(right, "k").groupBy("result_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        hit = hit.select("result_id", "id", "n", F.lit(order).alias("level"), F.lit(name).alias("how"))
        out = hit if out is None else out.unionByName(hit)
    best = first_per(out, ["result_id"], F.col("level"))
    best = best.select("result_id", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") > 1, "ambiguous").otherwise(F.col("how")).alias("how"))
    return found.select("result_id").join(best, "result_id", "left").withColumn("how", F.coalesce("how", F.lit("none")))
