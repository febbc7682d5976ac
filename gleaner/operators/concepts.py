"""Retrieval by lexicon: concept groups, gates, admission reasons and grounded anchors.

A lexicon is a small mapping from concepts to phrases, part of the configuration.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.retrieve import first_per, top_k
from gleaner.operators.select import longest_spans


def concept_hits(df: DataFrame, text: str, groups: dict[str, list[str]]) -> DataFrame:
    """``df`` with one boolean per group: whether any of its phrases is in the text."""
    lower = F.lower(F.col(text))
    for name, phrases in groups.items():
        df = df.withColumn(f"hit_{name}", F.exists(F.array(*map(F.lit, phrases)), lambda p: lower.contains(p)))
    return df


def gated(scored: DataFrame, groups: list[str], primary: str, answer: str, k: int) -> DataFrame:
    """Candidates hit some group; order: all groups and the answer signal, then primary and answer, hits, score, id.

    One row per document: its best.
    """
    hits = sum((F.col(f"hit_{g}").cast("int") for g in groups), F.lit(0))
    rows = scored.withColumn("n_hits", hits.cast("long")).where("n_hits > 0")
    rows = rows.withColumn("direct", (F.col("n_hits") == len(groups)) & F.col(f"hit_{answer}"))
    rows = rows.withColumn("partial", F.col(f"hit_{primary}") & F.col(f"hit_{answer}"))
    order = [F.desc("direct"), F.desc("partial"), F.desc("n_hits"), F.desc("score")]
    best = first_per(rows, ["query_id", "doc_id"], *order, F.col("chunk_id"))
    return top_k(best, k, ["query_id"], *order, F.col("doc_id"))


def admitted(concepts: DataFrame, scores: DataFrame, k: int, missing: float = 0.0) -> DataFrame:
    """Concept hits keep their place without a lexical score; each row says why it was admitted."""
    j = concepts.join(scores, ["query_id", "doc_id"], "full")
    reasons = F.array_compact(F.array(F.when(F.col("entity"), F.lit("entity")), F.when(F.col("relation"), F.lit("relation")), F.when(F.col("score").isNotNull(), F.lit("lexical"))))
    j = j.withColumn("reasons", reasons).withColumn("score", F.coalesce("score", F.lit(missing)))
    return top_k(j, k, ["query_id"], F.desc(F.coalesce("entity", F.lit(False))), F.desc("score"), F.col("doc_id"))


def anchors(queries: DataFrame, aliases: dict[str, str], column: str = "text") -> DataFrame:
    """(query_id, concept, alias, start): longest non-overlapping aliases of each query, with where they stand.

    A short alias inside a longer one's span gives way to it; the lexicon is part of the closure.
    """
    table = sorted(aliases.items(), key=lambda a: (-len(a[0]), a[0]))

    def run(frames):
        for pdf in frames:
            rows = []
            for q, t in zip(pdf.query_id, pdf[column], strict=True):
                low = f" {' '.join((t or '').lower().split())} "
                found = []
                for alias, concept in table:
                    at = low.find(f" {alias} ")
                    while at >= 0:
                        found.append((at, at + len(alias), concept))
                        at = low.find(f" {alias} ", at + 1)
                rows += [(int(q), c, low[a + 1 : z + 1], a) for a, z, c in longest_spans(found)]
            yield pd.DataFrame(rows, columns=["query_id", "concept", "alias", "start"])

    return queries.select("query_id", column).mapInPandas(run, "query_id long, concept string, alias string, start int")


def understand(text: str, lexicon: dict[str, str], negations: tuple[str, ...], scope: int = 3) -> dict:
    """Concepts of a question, whether each is negated, whether it asks yes or no, and the words left over."""
    words = text.lower().replace("?", " ?").split()
    spans = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 6) + 1):
            if (c := lexicon.get(" ".join(words[i:j]))) is not None:
                spans.append((i, j, c))
    kept = longest_spans(spans)
    covered = {k for a, z, _ in kept for k in range(a, z)}
    negated = [any(words[k] in negations for k in range(max(0, a - scope), a)) for a, _, _ in kept]
    return {
        "concepts": [c for _, _, c in kept], "negated": negated, "polar": bool(words) and words[0] in ("is", "are", "can", "does", "do") and words[-1] == "?",
        "residual": [w for k, w in enumerate(words) if k not in covered and w != "?" and w not in negations]}


def url_targets(urls: DataFrame, terms: dict[int, list[str]], text: str) -> DataFrame:
    """URLs whose decoded text holds a term of some query; the first such query has it."""
    low, first = F.lower(F.col(text)), None
    for q, phrases in sorted(terms.items()):
        hit = F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))
        first = F.when(hit, F.lit(q)) if first is None else first.when(hit, F.lit(q))
    return urls.withColumn("query_id", first.cast("long")).where("query_id is not null")
