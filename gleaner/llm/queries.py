"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.bpe import op6_bpe
from gleaner.llm.embeddings import op1_embedding_near_dedup
from gleaner.llm.licences import op2_licence_scan
from gleaner.llm.line_dedup import op7_line_dedup
from gleaner.llm.mixing import op10_mixing
from gleaner.llm.near_dedup import op8_minhash_near_dedup
from gleaner.llm.quality_pu import op3_quality_classifier
from gleaner.llm.quality_rules import op4_quality_rules
from gleaner.llm.sharding import op5_sharding
from gleaner.llm.warc import FIXITY_SQL, op9_warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_licence_scan": op2_licence_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op9_warc_fixity": FIXITY_SQL}
