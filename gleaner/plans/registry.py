"""Registration of queries with their SQL, and SQL fragments that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) under ``name``, with DuckDB SQL of the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Three scored arms per query, one row per (query, arm, chunk): suppliers are queries, return flags are arms,
#: parts are documents and (part, line number mod 4) are chunks.
HITS = """hits AS (
  SELECT l_suppkey::BIGINT AS query_id, l_returnflag AS arm, l_partkey::BIGINT AS doc_id,
    (l_partkey * 4 + l_linenumber % 4)::BIGINT AS chunk_id, max(l_extendedprice) AS score
  FROM lineitem GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM hits
)"""

#: The chunks that the arms rank: text, owner and address.
CHUNKS = """chunks AS (
  SELECT p_partkey * 4 + k AS chunk_id, p_partkey::BIGINT AS doc_id, k::BIGINT AS chunk_index,
    p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) || ' lot ' || (k // 2)::VARCHAR AS chunk_text,
    lower(p_brand) AS domain, 'https://' || replace(lower(p_brand), '#', '') || '.example.org/' || p_partkey::VARCHAR AS source_url
  FROM part, range(4) t(k)
)"""

#: Word tokens of documents and benchmark items.
TOKENS = r"""tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
qtok AS (
  SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')) AS term FROM benchmark
), qf AS (SELECT query_id, term, count(*) AS qf FROM qtok GROUP BY ALL)"""

_BM25 = TOKENS + """, bm25 AS (
  SELECT query_id, doc_id, round(sum({w} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY ALL
)"""


def bm25_sql(weight: str) -> str:
    """BM25 scores of every (query, document); ``weight`` is the query term's."""
    return _BM25.replace("{w}", weight)
