"""Vectorised tokenising and n-gram hashing over batches of whole texts.

A chunk of documents is laid out in one byte buffer (UTF-8, a newline after each
document).  Word boundaries come from a 256-entry byte class table; word and
n-gram identities are 64-bit polynomial hashes taken from one prefix sum, so the
work per byte is a handful of numpy operations and never a Python loop.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]

#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that are not one of the six ASCII blanks.
INK_BYTES = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _tables[k] = np.cumprod(t, dtype=U64)
    return _tables[0][:n], _tables[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on a copy."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


class Chunk:
    """Some documents laid out in one buffer."""

    def __init__(self, encoded: list[bytes]):
        self.n = len(encoded)
        sizes = np.fromiter(map(len, encoded), np.int64, self.n)
        self.buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        self.stops = np.cumsum(sizes + 1)  # one past each document's newline
        self.starts = self.stops - sizes - 1
        self._prefix: np.ndarray | None = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stops, positions, side="right")

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes."""
        power, inverse = _powers(len(self.buf))
        if self._prefix is None:
            self._prefix = np.zeros(len(self.buf) + 1, U64)
            np.cumsum((self.buf.astype(U64) + U64(1)) * power, out=self._prefix[1:])
        h = (self._prefix[ends] - self._prefix[starts]) * inverse[np.minimum(starts, len(inverse) - 1)]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def words(self, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all words, in order."""
        starts, ends = runs(table[self.buf])
        return starts, ends, self.doc_of(starts)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of consecutive whole texts of about ``limit`` bytes; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def ngrams(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` consecutive items of one owner, and their first item's index."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= U64(0x880355F21E6D1965)
        g ^= h[j : j + n]
        g ^= g >> U64(29)
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(g[first]), first


def string_rows(batch, column: str = "text", rows: int = 512) -> Iterator[tuple[int, list]]:
    """Slices of a string column of an Arrow batch as Python lists, a few rows at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    for i in range(0, len(col), rows):
        yield i, col.slice(i, rows).to_pylist()


BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Send texts to Python in batches of at most ``BATCH_ROWS`` rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return the memory that allocators kept to the system.

    Python workers live on between tasks and operators; what their allocators keep adds up.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A batch function that gives its memory back when its partition ends."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


FILTER_BITS = 1 << 27


def id_filter(ids: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hashed ``id``, of at most ``most`` bits however many ids there are: it lets strangers pass, never loses an id.

    Words of bits are made by an aggregation; the driver gets 16 bytes for each that is not empty.
    """
    bits = 1 << 12
    n = ids.count()
    while bits < min(16 * n, most):
        bits *= 2
    spot = F.col("id").bitwiseAND(F.lit(bits - 1))
    words = ids.select(F.shiftright(spot, 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(U64)


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be among those of the filter."""
    at = ids.view(U64) & U64(len(words) * 64 - 1)
    return (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)
