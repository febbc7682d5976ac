"""Chunking with verbatim offsets: ``text[start:end]`` is always the chunk.

Where a chunk ends depends on the paragraph before it, so cutting one document is
sequential; documents are independent and run on Arrow batches.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[㐀-鿿]|[^\W_]+|[^\s\w]")
PARAGRAPH = re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class Size:
    """Target and overlap in tokens."""

    name: str
    target: int
    overlap: int


# The three standard sizes.
SIZES = (Size("small", 256, 32), Size("medium", 512, 64), Size("large", 768, 96))


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def ranges(sections: list[dict]) -> list[dict]:
    """A title goes with the section after it, unless that is a question or an answer."""
    out: list[dict] = []
    title = None
    for s in sections:
        qa = s["section_type"] in ("question", "answer")
        if title is not None and qa:
            out.append(title)
            title = None
        if s["section_type"] == "title" and title is None:
            title = s
            continue
        out.append({**s, "start": title["start"]} if title is not None else s)
        title = None
    return out + ([title] if title is not None else [])


def cuts(text: str, size: Size) -> list[tuple[int, int, int, int]]:
    """(first token, last token + 1, start, end) of the chunks of one range.

    A chunk that does not reach the end stops at the last paragraph break in its
    second half, if there is one; the next begins ``overlap`` tokens before its end.
    """
    tok = spans(text)
    ends = [z for _, z in tok]
    breaks = [bisect.bisect_right(ends, m.start()) for m in PARAGRAPH.finditer(text)]
    out, first = [], 0
    while first < len(tok):
        last = min(first + size.target, len(tok))
        if last < len(tok):
            least = first + max(size.overlap + 1, size.target // 2)
            k = bisect.bisect_right(breaks, last) - 1
            if k >= 0 and breaks[k] >= least:
                last = breaks[k]
        out.append((first, last, 0 if first == 0 else tok[first][0], len(text) if last == len(tok) else tok[last - 1][1]))
        if last == len(tok):
            break
        first = last - size.overlap
    return out


def chunk_id(doc_id: int, size: Size, index: int, start: int, end: int, text: str) -> str:
    key = "\0".join([str(doc_id), size.name, str(index), str(start), str(end), text])
    return f"{doc_id}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"


def chunks_of(doc_id: int, text: str, sections: list[dict], size: Size) -> list[dict]:
    out: list[dict] = []
    for r in ranges(sections):
        for first, last, a, z in cuts(text[r["start"] : r["end"]], size):
            start, end = r["start"] + a, r["start"] + z
            body = text[start:end]
            out.append({
                "chunk_id": chunk_id(doc_id, size, len(out), start, end, body), "doc_id": doc_id, "chunk_index": len(out), "chunk_text": body,
                "n_tokens": last - first, "start": start, "end": end, "section_type": r["section_type"], "heading_path": list(r["heading_path"])})
    return out


SCHEMA = (
    "chunk_id string, doc_id long, chunk_index int, chunk_text string, n_tokens int, start int, end int, section_type string, heading_path array<string>"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def chunk_documents(docs: DataFrame, size: Size) -> DataFrame:
    """Chunks of (doc_id, text, sections); a document without sections is one section."""
    if "sections" not in docs.columns:
        one = F.struct(F.lit("content").alias("section_type"), F.lit(0).alias("start"), F.length("text").alias("end"), F.array().cast("array<string>").alias("heading_path"))
        docs = docs.withColumn("sections", F.array(one))

    def run(frames):
        for pdf in frames:
            rows = []
            for d, t, sections in zip(pdf.doc_id, pdf.text, pdf.sections, strict=True):
                if t:
                    parts = [s.asDict() if hasattr(s, "asDict") else dict(s) for s in sections]
                    rows += chunks_of(int(d), t, parts, size)
            yield pd.DataFrame(rows, columns=_NAMES)

    return docs.select("doc_id", "text", "sections").mapInPandas(run, SCHEMA)


def pack_paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs joined while they fit; one that is too long alone is cut after sentence ends."""
    out: list[str] = []
    held = ""
    for p in (p for p in re.split(r"\n+", text) if p.strip()):
        pieces = [p] if len(p) <= most else _sentences(p, most)
        for piece in pieces:
            if held and len(held) + 1 + len(piece) > most:
                out.append(held)
                held = ""
            held = f"{held}\n{piece}" if held else piece
    return out + ([held] if held else [])


def _sentences(p: str, most: int) -> list[str]:
    out, rest = [], p
    while len(rest) > most:
        stops = [m.end() for m in re.finditer(r"[.!?;。；]", rest[:most])]
        at = stops[-1] if stops else most
        out.append(rest[:at])
        rest = rest[at:]
    return [x for x in [*out, rest] if x]


def answer_windows(text: str, most: int = 1200, least: int = 40, markers: tuple[str, ...] = ("Licensed under", "Released under")) -> list[str]:
    """Packed paragraphs up to the first marker of a page's tail, without short ones."""
    cut = min((i for m in markers if (i := text.find(m)) >= 0), default=len(text))
    return [w for w in pack_paragraphs(text[:cut], most) if len(w) >= least]


def windows(docs: DataFrame, f, schema: str = "doc_id long, window int, text string") -> DataFrame:
    """Explode a text-to-list function over (doc_id, text)."""
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(int(d), i, w) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for i, w in enumerate(f(t or ""))], columns=["doc_id", "window", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def centred(first: int, last: int, total: int, target: int) -> tuple[int, int]:
    """A token window around [first, last) of ``target`` tokens; what one side cannot use the other gets."""
    room = max(0, target - (last - first))
    left = min(first, room // 2)
    right = min(total - last, room - left)
    left = min(first, room - right)
    return first - left, last + right


def expand(text: str, start: int, end: int, target: int, snap: int = 32) -> tuple[int, int]:
    """Offsets of the expanded window: token bounds moved outwards to blanks within ``snap`` characters; holds the chunk."""
    tok = spans(text)
    if not tok:
        return start, end
    first = bisect.bisect_right([z for _, z in tok], start)
    last = bisect.bisect_left([a for a, _ in tok], end)
    a, z = centred(first, max(first, last), len(tok), target)
    lo, hi = tok[a][0] if a < len(tok) else start, tok[z - 1][1] if z > a else end
    lo, hi = min(lo, start), max(hi, end)
    back = re.search(r"\S*$", text[max(0, lo - snap) : lo]).group()
    if len(back) < min(snap, lo) or lo - len(back) == 0:
        lo -= len(back)
    on = re.match(r"\S*", text[hi : hi + snap]).group()
    if len(on) < snap or hi + len(on) == len(text):
        hi += len(on)
    return lo, hi


def expand_chunks(chunks: DataFrame, docs: DataFrame, target: int) -> DataFrame:
    """Each chunk's window in its document."""
    joined = chunks.join(docs.select("doc_id", "text"), "doc_id").select("chunk_id", "doc_id", "start", "end", "text")

    def run(frames):
        for pdf in frames:
            rows = []
            for c, d, a, z, t in zip(pdf.chunk_id, pdf.doc_id, pdf.start, pdf.end, pdf.text, strict=True):
                lo, hi = expand(t, int(a), int(z), target)
                rows.append((c, int(d), lo, hi, t[lo:hi]))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "start", "end", "window"])

    return joined.mapInPandas(run, "chunk_id string, doc_id long, start int, end int, window string")


def evidence_spans(text: str, most: int = 2400) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that end at a sentence, else at a blank, else anywhere."""
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            cut = max(text.rfind(". ", at, end) + 2, text.rfind(" ", at, end) + 1 if text.rfind(". ", at, end) < 0 else 0)
            end = cut if cut > at + 1 else end
        out.append((at, end))
        at = end
    return out


def row_ranges(df: DataFrame, key: str, width: int) -> DataFrame:
    """Rows with the number of the range of keys they belong to."""
    return df.withColumn("range_no", F.floor(F.col(key) / width).cast("long"))
