"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``:

1. ``quality``: documents that the classifier predicts 0 go.
2. ``lines``: repeated lines are cut from the texts; a document left without any
   line that counts keeps its row.
3. ``near_dedup``: one document of each group of near copies stays.
4. ``mix``: the words that the mix takes, as documents; a document taken several
   times has several rows, one taken in part has the words taken.
5. ``encode``: token counts and digests of ids and decoded text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.bpe import encode_documents, word_vocabulary
from gleaner.llm.line_dedup import without_repeated_lines
from gleaner.llm.mixing import mixed_documents
from gleaner.llm.near_dedup import deduplicated
from gleaner.llm.quality_pu import classify
from gleaner.llm.workspace import Workspace, owned, release


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage before is written, so its scratch tables go; tables made by anyone else stay."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline stage")
        with owned("pipeline stage"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_rows=True)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, word_vocabulary())


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mix), ("BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = ws.save(docs)
    return docs
