"""Word-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent words (counted over all documents) are encoded once, by one
task, and compiled into a minimal acyclic automaton: words share prefixes and suffixes,
each arc carries an additive output, and the sum along a word's path is the
number of its id sequence.  The automaton is three sorted arrays, broadcast as one
block; workers map Spark's own copy of the broadcast on their executor, so its
pages are shared and no file is written.  A batch's new words walk it together,
one byte position at a time.  Words it lacks are merged exactly by the rank
table, long ones through a heap.  Decoding joins the ids' tokens with blanks, as a tokenizer file without a
decoder does.

Cases: null and empty texts have no ids and decode to the empty text; the
special tokens' own strings in a text are those tokens; repeated rows are
separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.textkit import lean, small_batches, string_rows
from gleaner.llm.workspace import Workspace

LEXICON_WORDS, MEMO_WORDS, COUNTED_WORDS, LONG_WORD, LEXICON_PART = 1 << 18, 300_000, 250_000, 96, 1 << 20
END, MAGIC = "</w>", b"lexicon\nsuffixes"
_NO = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


SYMBOLS = byte_symbols()
_BYTE_OF = {c: b for b, c in enumerate(SYMBOLS)}


def _plain_classes() -> tuple[str, str, str]:
    """Letters, digits and blanks among the characters that the fast splitter handles, as class bodies."""
    letters, numbers = [], []
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)
        if kind[0] == "L":
            letters.append(c)
        elif kind[0] == "N":
            numbers.append(c)
    esc = lambda cs: "".join(map(re.escape, cs))
    return esc(letters), esc(numbers), "\t-\r \x85\xa0"


_L, _N, _S = _plain_classes()
#: Characters beyond these go through the tokenizers library's own normaliser and splitter.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Tokenizer:
    """A byte-level, word-end BPE vocabulary file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        if model["decoder"] is not None or model["model"]["end_of_word_suffix"] != END:
            raise ValueError("not a word-end BPE file without decoder")
        vocab = model["model"]["vocab"]
        self.token = [""] * (max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.byte = [vocab[c] for c in SYMBOLS]
        self.last = [vocab[c + END] for c in SYMBOLS]
        self.spec = spec
        self._library = None

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens, in order."""
        if _UNUSUAL.search(text) is None:
            return _SPLIT.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self.spec)
        normal = self._library.normalizer.normalize_str(text)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(_BYTE_OF[c] for c in p).decode("utf-8") for p, _ in pieces]

    def merge(self, word: str) -> list[int]:
        """Exact merges of one word, lowest rank first."""
        raw, rank, made = word.encode("utf-8"), self.rank.get, self.made
        ids = [self.byte[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        ranks = [rank(p, _NO) for p in pairwise(ids)]
        while ranks and (best := min(ranks)) < _NO:
            i = ranks.index(best)  # the leftmost
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NO)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NO)
        return ids


    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, place) over a linked list of symbols."""
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(pairwise(ids)) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or rank((ids[i], ids[j])) != best:
                continue  # a symbol of this pair was merged since
            ids[i], ids[j], after[i] = made[best], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank((ids[k], ids[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words with additive outputs, as one block of arrays.

    Words are added in byte order; a finished branch is replaced by an equal
    state made before (Daciuk's incremental construction), so suffixes are shared.
    """
    words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
    arcs: list[list[tuple[int, int]]] = []  # of each frozen state: (byte, target)
    final: list[bool] = []
    below: list[int] = []  # words accepted from the state
    known: dict[tuple, int] = {}

    def freeze(node: tuple[list, bool]) -> int:
        out, end = node
        key = (end, tuple(out))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(out)
            final.append(end)
            below.append(int(end) + sum(below[t] for _, t in out))
        return known[key]

    path: list[list] = [[[], False]]  # open nodes: arcs so far, final
    last = b""
    for w, _ in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        for depth in range(len(path) - 1, common, -1):
            node = path.pop()
            path[-1][0].append((last[depth - 1], freeze(tuple(node))))
        for _ in w[common:]:
            path.append([[], False])
        path[-1][1] = True
        last = w
    for depth in range(len(path) - 1, 0, -1):
        node = path.pop()
        path[-1][0].append((last[depth - 1], freeze(tuple(node))))
    root = freeze(tuple(path[0]))
    key, target, output = [], [], []
    for s, out in enumerate(arcs):
        passed = int(final[s])
        for b, t in out:
            key.append(s * 256 + b)
            target.append(t)
            output.append(passed)
            passed += below[t]
    order = np.argsort(key) if key else np.empty(0, np.int64)
    ids = [i for _, seq in words for i in seq]
    bounds = np.concatenate(([0], np.cumsum([len(seq) for _, seq in words]))).astype(np.int32)
    parts = [
        np.frombuffer(MAGIC, np.int64), np.array([root, len(key), len(final), len(bounds), len(ids)], np.int64),
        np.array(key, np.int64)[order], np.array(target, np.int32)[order], np.array(output, np.int32)[order],
        np.array(final, np.int32), bounds, np.array(ids, np.int32),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled automaton over a block of bytes or a memory map that has it."""

    def __init__(self, block: bytes | mmap.mmap):
        at = block.find(MAGIC, 0, 256) + len(MAGIC)

        def part(n: int, kind) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(block, kind, n, at - n * np.dtype(kind).itemsize)

        self.root, *sizes = part(5, np.int64).tolist()

        self.key, self.target, self.output = part(sizes[0], np.int64), part(sizes[0], np.int32), part(sizes[0], np.int32)
        self.final, self.bounds, self.ids = part(sizes[1], np.int32), part(sizes[2], np.int32), part(sizes[3], np.int32)

    def find(self, words: list[str]) -> list[list[int] | None]:
        """Each word's ids, or None if the lexicon lacks it; all words walk together."""
        if not words or not len(self.key):
            return [None] * len(words)
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        buf = np.frombuffer(b"".join(raw), np.uint8)
        start = (np.cumsum(size) - size)[order]
        long_first = size[order]
        state, number = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        for i in range(int(long_first[0])):
            n = int(np.searchsorted(-long_first, -i, side="left"))  # words longer than i
            live = np.flatnonzero(state[:n] >= 0)
            if not len(live):
                break
            k = state[live] * 256 + buf[start[live] + i]
            j = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[j] == k
            state[live] = np.where(hit, self.target[j], -1)
            number[live] += np.where(hit, self.output[j], 0)
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        out: list[list[int] | None] = [None] * len(raw)
        for i in np.flatnonzero(ok).tolist():
            n = number[i]
            out[order[i]] = self.ids[self.bounds[n] : self.bounds[n + 1]].tolist()
        return out


_opened: dict[str, tuple] = {}  # of this process, by kind: (broadcast, what was made of it)


def _once(kind: str, shared, make):
    """What ``make`` gives for a broadcast, kept for the next task of this worker."""
    if kind not in _opened or _opened[kind][0] is not shared:
        _opened[kind] = (shared, make(shared))
    return _opened[kind][1]


def _mapped(shared) -> Lexicon:
    """The lexicon in the file that Spark keeps for the broadcast on this executor, or in memory where it has none."""
    path = getattr(shared, "_path", None)
    if path:
        with open(path, "rb") as f:
            block = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if block.find(MAGIC, 0, 256) >= 0:
            return Lexicon(block)
    return Lexicon(shared.value)


class Encoder:
    """Encodes and decodes texts, remembering a bounded number of words as their ids in decimal and their tokens."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        self.tok, self.lexicon = tokenizer, lexicon
        self.text_of = list(map(str, range(len(tokenizer.token))))
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.ids))
        if len(self.ids) + len(new) > MEMO_WORDS:
            self.ids.clear()
            self.tokens.clear()
            new = list(words)
        for w, ids in zip(new, self.lexicon.find(new), strict=True):
            self._keep(w, self.tok.merge(w) if ids is None else ids)
        for w, i in self.tok.special.items():
            self._keep(w, [i])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = " ".join([self.text_of[i] for i in ids])
        self.tokens[word] = " ".join([self.tok.token[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids in decimal, decoded text) of each text; new words of all texts are learnt together."""
        split = []
        new: set[str] = set()
        for text in texts:
            if "<|" in text:
                words = []
                for k, part in enumerate(self.tok.between.split(text)):
                    if k % 2:
                        words.append(part)  # no word holds a special token's whole text
                    else:
                        own = self.tok.words(part)
                        new.update(own)
                        words += own
            else:
                words = self.tok.words(text)
                new.update(words)
            split.append(words)
        self.learn(new)
        for words in split:
            yield " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.tokens.__getitem__, words))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_words(docs: DataFrame, spec) -> DataFrame:
    """(word, n) over all documents; counts are summed in each task before they are shuffled."""

    @lean
    def count(batches):
        tok, seen = _once("spec", spec, lambda x: Tokenizer(x.value)), Counter()
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for _, texts in string_rows(batch):
                for t in texts:
                    if t:
                        for part in tok.between.split(t)[::2] if "<|" in t else (t,):
                            seen.update(tok.words(part))
                if len(seen) > COUNTED_WORDS:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, spec, size: int = LEXICON_WORDS) -> bytes:
    """The ``size`` most frequent words of the corpus, compiled; a bounded table however large the corpus is."""
    ws = Workspace(docs.sparkSession, "lexicon")
    words = ws.save(count_words(docs, spec))
    # how many words have each count, in eighths of powers of two: a table of bounded size
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted((r["level"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    low, room = 1 << 30, size
    while sizes and sizes[-1][1] <= room:
        low, n = sizes.pop()
        room -= n
    top = ws.save(words.where(level >= low).select("word"))  # never more than ``size``
    ws.drop(words)

    @lean
    def compiled(batches):
        tok = _once("spec", spec, lambda x: Tokenizer(x.value))
        block = compile_lexicon({w: tok.merge(w) for batch in batches for w in batch.column(0).to_pylist()})
        for i in range(0, len(block), LEXICON_PART):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([block[i : i + LEXICON_PART]], pa.binary())], names=["at", "part"])

    # in one task of an executor: the driver gets the finished block, not the words, their merges and the states
    parts = top.coalesce(1).mapInArrow(compiled, "at long, part binary").collect()
    ws.drop(top)
    return b"".join(r["part"] for r in sorted(parts, key=lambda r: r["at"]))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, spec: str, lexicon_words: int = LEXICON_WORDS, full: bool = False) -> DataFrame:
    """One row per document; with ``full`` also the ids themselves and the decoded text."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(spec)
    block = context.broadcast(build_lexicon(docs, shared, lexicon_words))

    @lean
    def encode(batches):
        encoder = Encoder(_once("spec", shared, lambda x: Tokenizer(x.value)), _once("lexicon", block, _mapped))
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            ids_of = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in string_rows(batch, rows=256):
                rows = []
                for ids, decoded in encoder.encode([t or "" for t in texts]):
                    row = (ids.count(" ") + 1 if ids else 0, sha(ids), sha(decoded))
                    rows.append((*row, np.array(ids.split(), np.int32), decoded) if full else row)
                columns = [pa.array(x) for x in zip(*rows, strict=True)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
                yield pa.RecordBatch.from_arrays([ids_of.slice(first, len(texts)), *columns], names=["doc_id", *names])

    schema = SCHEMA + (", ids array<int>, decoded string" if full else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def word_vocabulary() -> str:
    """The word BPE file of the installed public tokenizers, read on the driver."""
    import public_tokenizers

    return read_spec(public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
