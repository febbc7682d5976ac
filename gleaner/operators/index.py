"""Term statistics: postings, document lengths and frequencies.

A document's length counts all its tokens, before any vocabulary is pruned, and
documents without tokens count in the number of documents and the mean length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import words
from gleaner.session import scratch_dir

K1, B = 1.2, 0.75


class Index:
    """Lazy frames: ``postings`` (key, doc, term, tf), ``lengths`` (key, doc, dl), ``frequencies`` (key, term, df), ``stats`` (key, n, avgdl).

    ``key`` are partition columns (such as a source) that separate indexes built in one job.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, frequencies: DataFrame, stats: DataFrame, key: list[str]):
        self.postings, self.lengths, self.frequencies, self.stats, self.key = postings, lengths, frequencies, stats, key


def build(docs: DataFrame, doc: str, tokens: Column, key: list[str] | None = None, vocabulary: DataFrame | None = None) -> Index:
    """An index of ``docs``; with ``vocabulary`` (term) only the postings of its terms are kept.

    The texts are read and cut into tokens once and written with their lengths, so
    that postings, lengths and statistics, often several of each in one plan, read
    the columns they need.  Lengths count all tokens, before the vocabulary prunes.
    """
    key = key or []
    path = scratch_dir(docs.sparkSession, "tokens")
    cut = docs.select(*key, F.col(doc).alias("doc"), tokens.alias("_w"))
    cut = cut.withColumn("dl", F.size("_w").cast("long"))
    cut.write.parquet(path)
    held = docs.sparkSession.read.schema(cut.schema).parquet(path)
    lengths = held.select(*key, "doc", "dl")
    stats = lengths.groupBy(*key).agg(F.count("*").cast("double").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    terms = held.select(*key, "doc", F.explode("_w").alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary.select("term").distinct(), "term", "left_semi")
    postings = terms.groupBy(*key, "doc", "term").agg(F.count("*").alias("tf"))
    frequencies = postings.groupBy(*key, "term").agg(F.count("*").alias("df"))
    return Index(postings, lengths, frequencies, stats, key)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Keys that occur more than once; an index build must find none."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two-way anti join: keys of one side only, with the side that has them."""
    a = left.select(on).distinct().join(right, on, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(on).distinct().join(left, on, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def query_terms(queries: DataFrame, query: str, tokens: Column, distinct: bool = False) -> DataFrame:
    """(query_id, term, qf); with ``distinct`` every qf is 1."""
    t = queries.select(F.col(query).alias("query_id"), F.explode(F.array_distinct(tokens) if distinct else tokens).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 of one term in one document."""
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + b * dl / avgdl))


def document_words(docs: DataFrame) -> Column:
    return words(F.col("text"))
