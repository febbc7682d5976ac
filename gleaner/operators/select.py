"""Greedy selections whose choices depend on earlier choices.

Each query's candidates are a bounded list (a pool of at most a few hundred rows),
folded in order by one function per rule in ``applyInPandas``; everything that a
window can express is in ``pool`` instead.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

NEAR = 0.85


def _key(text: str) -> str:
    return " ".join(text.lower().split())


def near_duplicate(a: str, b: str, threshold: float = NEAR) -> bool:
    """Equal after normalising, or token sets with Jaccard of at least ``threshold``."""
    if _key(a) == _key(b):
        return True
    x, y = set(_key(a).split()), set(_key(b).split())
    return bool(x | y) and len(x & y) >= threshold * len(x | y)


def grams(text: str, n: int = 5) -> frozenset[tuple[str, ...]]:
    w = _key(text).split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def containment(a: frozenset, b: frozenset) -> float:
    """Share of the smaller set that the other holds."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def controlled(rows: list[dict], most_per_doc: int, unique_text: bool, k: int) -> Iterable[dict]:
    """A suppressed text takes no place of its document; a row over its document's cap does not mark its text."""
    used: Counter = Counter()
    seen: set[str] = set()
    taken = 0
    for r in rows:
        if taken == k:
            return
        text = _key(r["chunk_text"])
        if unique_text and text in seen:
            continue
        if used[r["doc_id"]] >= most_per_doc:
            continue
        used[r["doc_id"]] += 1
        seen.add(text)
        taken += 1
        yield r


def domain_shares(rows: list[dict], depth: int, share: float, least_domains: int, weak: bool, reserve: int) -> Iterable[dict]:
    """Domain caps, a reserve of fallback rows for weak queries, then a fill without caps."""
    cap = max(1, min(math.ceil(depth * share), math.ceil(depth / least_domains)))
    main, spare = [r for r in rows if not r["fallback"]], [r for r in rows if r["fallback"]]
    kept = reserve if weak else 0
    used: Counter = Counter()
    chosen: set = set()
    out: list[dict] = []

    def take(candidates: list[dict], limit: int, capped: bool) -> None:
        for r in candidates:
            if len(out) >= limit:
                return
            if r["doc_id"] in chosen or (capped and used[r["domain"]] >= cap):
                continue
            used[r["domain"]] += 1
            chosen.add(r["doc_id"])
            out.append(r)

    take(main, depth - kept, True)
    take(spare, depth, True)
    take(main, depth, True)
    take([*main, *spare], depth, False)
    return out


def representatives(rows: list[dict], k: int) -> Iterable[dict]:
    """The best chunks of an owner, skipping near copies of those taken."""
    taken: list[dict] = []
    for r in rows:
        if len(taken) < k and not any(near_duplicate(r["chunk_text"], t["chunk_text"]) for t in taken):
            taken.append(r)
    return taken


def without_near_copies(rows: list[dict], k: int) -> Iterable[dict]:
    """The first ``k`` rows that repeat neither a chunk nor, nearly, a text."""
    ids: set = set()
    taken: list[dict] = []
    for r in rows:
        if len(taken) == k:
            break
        if r["chunk_id"] in ids or any(near_duplicate(r["chunk_text"], t["chunk_text"]) for t in taken):
            continue
        ids.add(r["chunk_id"])
        taken.append(r)
    return taken


def refined(rows: list[dict], k: int, overlap: float = 0.8) -> Iterable[dict]:
    """Skip chunks of one owner that mostly repeat each other; skipped ones fill what is left."""
    taken, skipped = [], []
    held: dict = {}
    for r in rows:
        own = grams(r["chunk_text"], 3)
        if any(containment(own, g) >= overlap for g in held.get(r["doc_id"], ())):
            skipped.append(r)
            continue
        held.setdefault(r["doc_id"], []).append(own)
        taken.append(r)
    return (taken + skipped)[:k]


def close_pairs(rows: list[dict], k: int) -> Iterable[dict]:
    """The ``k`` smallest score gaps between neighbours whose rows are all different."""
    gaps = sorted((round(a["score"] - b["score"], 9), i) for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)))
    used: set[int] = set()
    out = []
    for gap, i in gaps:
        if len(out) == k:
            break
        if i in used or i + 1 in used:
            continue
        used |= {i, i + 1}
        out.append({**rows[i], "other": rows[i + 1]["chunk_id"], "gap": gap})
    return out


def longest_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longest non-overlapping spans, ties to the first; returned in order."""
    out: list[tuple[int, int, str]] = []
    for a, z, name in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(z <= x or a >= y for x, y, _ in out):
            out.append((a, z, name))
    return sorted(out)


def per_owner(rows: list[dict], rule: Callable[[list[dict]], Iterable[dict]]) -> Iterable[dict]:
    """Apply a rule to each owner's rows of one query; one group per query costs far less than one per owner."""
    owners: dict = {}
    for r in rows:
        owners.setdefault(r["doc_id"], []).append(r)
    return [x for own in owners.values() for x in rule(own)]


def fold_groups(df: DataFrame, group: list[str], order: list[str], rule: Callable[[list[dict]], Iterable[dict]], schema: str, ascending=True) -> DataFrame:
    """Apply a rule to each group's ordered rows; adds ``position`` (from 1) if the schema has it."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, ascending=ascending, kind="stable").to_dict("records")
        out = [{**r, "position": i} for i, r in enumerate(rule(rows), 1)]
        return pd.DataFrame(out, columns=names)

    return df.groupBy(*group).applyInPandas(run, schema)
