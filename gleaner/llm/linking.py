"""From shared buckets to classes of similar texts: exact, without listing all pairs.

Candidates are (bucket, id) rows.  Every bucket elects a hub, the member whose
buckets are fullest, and each member is compared with the hubs of its buckets:
a number of pairs linear in the candidates.  Components of the links found make
most buckets of one class; those that still hold several classes are compared
whole, in square tiles of bounded size, so a group that a hub does not reach
loses no link.  Texts are fetched only for ids that take part.

Candidates may also come packed: rows of bytes that hold many (bucket, id) pairs
of one slice of the buckets, so that those alone in their bucket, nearly all of
them, are never rows of Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.components import components
from gleaner.llm.textkit import U64, Chunk, lean, mix, ngrams
from gleaner.llm.workspace import Workspace

THRESHOLD, TILE, WORDS, CHARS = 0.8, 512, 5, 8
SLICE_BITS, PACKED, HELD, BLOCK = 12, 1 << 19, 1 << 21, 1 << 16


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much cheaper than ``np.unique`` on short arrays."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def word_shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit shingles of five words; a shorter text is one shingle."""
    chunk = Chunk([text.lower().encode("utf-8")])
    starts, ends, doc = chunk.words()
    h = chunk.span_hash(starts, ends)
    if 0 < len(h) < WORDS:
        return short_shingle(h, doc, 1)[0]
    return distinct(ngrams(h, doc, WORDS)[0])


def short_shingle(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of fewer than five words: one shingle of them all, and the document."""
    n = np.bincount(doc, minlength=n_docs)
    at = np.cumsum(n) - n
    few = np.flatnonzero((n > 0) & (n < WORDS))
    out = np.zeros(len(few), U64)
    for j in range(WORDS - 1):
        has = n[few] > j
        out[has] = mix(out[has] * U64(0x880355F21E6D1965) + h[at[few][has] + j] + U64(j + 1))
    return out, few


def char_grams(points: np.ndarray) -> np.ndarray:
    """Hashes of all windows of eight code points, by doubling."""
    h = (points.astype(U64) + U64(0x51ED27)) * U64(0xC2B2AE3D27D4EB4F)
    for step, factor in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93), (4, 0x880355F21E6D1965)):
        if len(h) <= step:
            return h[:0]
        h = h[:-step] * U64(factor) + h[step:]
    return mix(h)


def char_shingles(text: str) -> np.ndarray:
    """Sorted distinct shingles of eight characters; a shorter text is one shingle."""
    grams = char_grams(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    if len(grams):
        return distinct(grams)
    chunk = Chunk([text.encode("utf-8")])
    return chunk.span_hash(chunk.starts, chunk.stops - 1) if text else np.empty(0, U64)


def char_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """``char_shingles`` of each text, with the windows of a block of texts made at once."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and size < BLOCK:
            size += len(texts[hi])
            hi += 1
        grams = char_grams(np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), np.uint32))
        spans, at = [], 0
        for t in texts[lo:hi]:
            spans.append((at, max(at, at + len(t) - CHARS + 1)))
            at += len(t)
        for a, z in spans:
            grams[a:z].sort()
        new = np.ones(len(grams), bool)
        np.not_equal(grams[1:], grams[:-1], out=new[1:])
        for t, (a, z) in zip(texts[lo:hi], spans, strict=True):
            if a == z:
                yield char_shingles(t)
            else:
                new[a] = True
                yield grams[a:z][new[a:z]]
        lo = hi


#: one text's set after the other, in the order given
SHINGLES: dict[str, Callable[[list[str]], Iterator[np.ndarray]]] = {"words": lambda texts: map(word_shingles, texts), "chars": char_sets}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    joined = np.concatenate((a, b))
    joined.sort()
    both = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return both / (len(a) + len(b) - both) if both else 0.0


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small > 0 and small >= threshold * large and jaccard(a, b) >= threshold


def _verify(kind: str, threshold: float):
    @lean
    def verify(batches):
        shingles = SHINGLES[kind]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                a, b, *texts = (batch.column(c).to_pylist() for c in range(4))
                text = dict(zip(a + b, texts[0] + texts[1], strict=True))
                known = dict(zip(text, shingles([t or "" for t in text.values()]), strict=True))
                keep = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if similar(known[x], known[y], threshold)]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return verify


def _tile_links(ids: list[int], labels: list[int], blocks: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of different labels (and, in a tile of two blocks, of different blocks)."""
    n = len(ids)
    cross = len(set(blocks)) > 1
    if n <= 12:
        pairs = [
            (i, j) for i in range(n) for j in range(i + 1, n)
            if labels[i] != labels[j] and not (cross and blocks[i] == blocks[j]) and similar(sets[i], sets[j], threshold)]
    else:
        size = np.array([len(x) for x in sets], np.float64)
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size.astype(np.int64))
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, len(values), 8192):
            a, z = np.searchsorted(at, [lo, lo + 8192])
            m = np.zeros((n, min(8192, len(values) - lo)), np.float32)
            m[owner[a:z], at[a:z] - lo] = 1
            both += m @ m.T
        label, block = np.array(labels), np.array(blocks)
        ok = (both > 0) & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9) & (label[:, None] != label[None, :])
        if cross:
            ok &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(ok, 1))
        pairs = list(zip(i.tolist(), j.tolist(), strict=True))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in pairs:
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((ids[x], ids[y]))
    return kept


def _compare_tiles(kind: str, threshold: float):
    """Over rows sorted by (bucket, i, j, id): one tile at a time, whatever batch its rows come in."""

    @lean
    def compare(batches):
        shingles = SHINGLES[kind]
        key, rows = None, {}
        for batch in batches:
            head = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            ids, labels, blocks = (batch.column(c).to_pylist() for c in (3, 4, 5))
            sets = shingles([t or "" for t in batch.column(6).to_pylist()])
            found = []
            for r, (now, own) in enumerate(zip(head, sets, strict=True)):
                if now != key:
                    found += _finish(rows, threshold)
                    key, rows = now, {}
                if ids[r] not in rows:
                    rows[ids[r]] = (labels[r], blocks[r], own)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = _finish(rows, threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return compare


def _finish(rows: dict, threshold: float) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    labels, blocks, sets = zip(*rows.values(), strict=True)
    return _tile_links(list(rows), list(labels), list(blocks), list(sets), threshold)


def pack(bucket: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Slices, and the (bucket, id) rows of each as bytes."""
    of = (bucket.view(U64) >> U64(64 - SLICE_BITS)).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
    data = np.stack((bucket, ids), axis=1)[order]
    ends = np.append(first, len(of)).astype(np.int32) * 16
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.array(of[first].astype(np.int32)), packed


def settle(bucket: np.ndarray, ids: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Rows of buckets with several ids, without those told before, and for every bucket one row to go on from."""
    order = np.argsort(bucket)
    bucket, ids, told = bucket[order], ids[order], told[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    low = np.minimum.reduceat(ids, first)
    several = np.logical_or.reduceat(told, first) | (low != np.maximum.reduceat(ids, first))
    out = np.repeat(several, np.diff(np.append(first, len(bucket)))) & ~told
    return bucket[out], ids[out], (bucket[first], low, several)


@lean
def _several(batches):
    """Over packed rows sorted by slice: the (bucket, id) rows of buckets with two distinct ids or more.

    Rows may come again.  What is held is bounded by ``HELD`` rows and one for each bucket of a slice, however full a bucket is.
    """
    now, rows, size, state = None, [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        of, packed = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
        data = np.frombuffer(packed.buffers()[2], np.int64, ends[-1])
        cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        found = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            if of[a] != now:
                found.append(_settled(rows, state))
                now, rows, size, state = of[a], [], 0, None
            rows.append(data[ends[a] : ends[z]].reshape(-1, 2))
            size += len(rows[-1])
            if size > HELD:
                found.append(_settled(rows, state))
                rows, size, state = [], 0, found[-1][2]
        yield _candidates(found)
    yield _candidates([_settled(rows, state)])


def _settled(rows: list[np.ndarray], state: tuple[np.ndarray, ...] | None):
    held = np.concatenate([np.empty((0, 2), np.int64), *rows])
    bucket, ids, told = held[:, 0], held[:, 1], np.zeros(len(held), bool)
    if state is not None:
        bucket, ids, told = (np.concatenate(x) for x in zip(state, (bucket, ids, told), strict=True))
    return settle(bucket, ids, told) if len(bucket) else (bucket, ids, state)


def _candidates(found: list) -> pa.RecordBatch:
    columns = [np.concatenate([np.empty(0, np.int64), *(x[c] for x in found)]) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id"])


def shared_buckets(bands: DataFrame, ws: Workspace) -> DataFrame:
    """(bucket, id, n) of the buckets with two distinct ids or more; ``bands`` may repeat rows.

    ``bands`` has columns bucket and id, or slice and packed as ``pack`` makes them.
    """
    whole = Window.partitionBy("bucket")
    if "packed" in bands.columns:
        dealt = bands.select("slice", "packed").repartition("slice").sortWithinPartitions("slice")
        several = dealt.mapInArrow(_several, "bucket long, id long").repartition("bucket")
    else:
        several = bands.withColumn("low", F.min("id").over(whole)).withColumn("high", F.max("id").over(whole)).where("low <> high")
    return ws.save(several.select("bucket", "id").distinct().withColumn("n", F.count("*").over(whole)))


def classes(bands: DataFrame, fetch: Callable[[DataFrame], DataFrame], kind: str, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component) of the ids that link with another; ``fetch(ids)`` gives (id, text)."""
    out, ws = ws, Workspace(ws.spark, "linking")
    held = shared_buckets(bands, ws)
    score = ws.save(held.groupBy("id").agg(F.sum("n").alias("score")))
    hubs = ws.save(
        held.join(score, "id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("hub"))
        .select("bucket", (-F.col("hub.minus")).alias("hub")))
    pairs = ws.save(
        held.join(hubs, "bucket").where("id <> hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    texts = ws.save(fetch(score.select("id")))
    side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    links = ws.save(joined.mapInArrow(_verify(kind, threshold), "a long, b long"))
    found = ws.save(components(links, ws))
    label = held.join(found.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    # of buckets with the same members one is enough; two members were compared already
    mixed = label.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"))
    mixed = mixed.where("n > 2 and low <> high").groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    mixed = ws.save(mixed.select("bucket", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("blocks")))
    rows = label.select("bucket", "id", "label").join(mixed, "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.join(texts, "id").select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "block", "text")
    dealt = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    more = ws.save(dealt.mapInArrow(_compare_tiles(kind, threshold), "a long, b long"))
    # the components found stand for their links
    known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = components(known.unionByName(more), ws) if more.limit(1).count() else found
    final = out.save(final)
    ws.clear()
    return final
