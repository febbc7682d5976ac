"""Merkle fixity audit of two replicas of a WARC archive, on plain DataFrames.

Records are ordered by (page_id, digest), so a record's ordinal fixes its file
and its byte offset.  Leaf ``i`` of a tree is the SHA-256 of record ``i``; a node
of level ``k`` covers the ordered range of ``FANOUT**k`` records and hashes the
range's byte bounds with its children's digests.  Two replicas are compared at
the root; only the children of nodes that differ are looked at, level by level,
until single records remain.

Cases: null url or html are written as empty; rows equal in every used column
are one record, whose copies are counted; a null page_id orders first; an empty
archive has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.workspace import Workspace

FANOUT, FILE_RECORDS = 16, 1024


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record as text (UTF-8 when hashed or measured)."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """Give records (page_id, digest, length) an ordinal and a byte offset; returns them and their number.

    Ranges of (page_id, digest), cut at sampled bounds, are sorted and numbered each in
    its own task, so a page id with many records spreads over several; their totals give
    each range its first ordinal and offset.
    """
    rows = records.groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies"))
    return numbered(rows, ["page_id", "digest", "length"], "ordinal", ws, "length")


def numbered(rows: DataFrame, keys: list[str], name: str, ws: Workspace, size: str | None = None) -> tuple[DataFrame, int]:
    """``rows`` with ``name``, their rank from 0 by ``keys``, and with a ``size`` column the ``offset`` of each; and their number."""
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = ws.save(rows.withColumn("_r", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    amount = F.col(size) if size else F.lit(0)
    totals = rows.groupBy("_r").agg(F.count("*").alias("_n"), F.sum(amount).alias("_len"))
    n = totals.agg(F.sum("_n")).first()[0] or 0
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_k"), F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_o"))
    placed = rows.join(starts, "_r").withColumn(name, (F.col("_k") + F.col("_i")).cast("long"))
    if size:
        inside = Window.partitionBy("_r").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("offset", (F.col("_o") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long"))
    return placed.drop("_r", "_i", "_k", "_o"), n


def tree(leaves: DataFrame, n: int, ws: Workspace, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (node, digest, lo, hi) from the leaves (ordinal, digest, offset, length) up to the root."""
    level = ws.save(leaves.select(
        F.col("ordinal").alias("node"), "digest", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi")))
    levels, width = [level], n
    while width > 1:
        parts = F.sort_array(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform(parts, lambda x: x["digest"]), "")
        level = level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
            joined.alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        level = ws.save(level.select(
            "node", F.sha2(F.concat_ws(":", F.col("lo").cast("string"), F.col("hi").cast("string"), "parts"), 256).alias("digest"), "lo", "hi"))
        levels.append(level)
        width = -(-width // fanout)
    return levels


def mismatches(a: list[DataFrame], b: list[DataFrame], ws: Workspace, fanout: int = FANOUT) -> DataFrame:
    """Ordinals of records that differ, found by descending mismatching branches only."""

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select("node", F.col("digest").alias("other"))
        return x.join(y, "node", "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("node")

    bad = ws.save(differing(a[-1], b[-1]))
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        parents = bad.select(F.col("node").alias("_up"))
        below = lambda d: d.withColumn("_up", F.floor(F.col("node") / fanout)).join(parents, "_up", "left_semi")  # noqa: E731, B023
        bad = ws.save(differing(below(x), below(y)))
    return bad.select(F.col("node").alias("ordinal"))


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """Compare two replicas of (page_id, digest, length); ``replica_b`` also names the ``expected`` digest it stores.

    The manifest of replica A gives each record its leaf and byte range.  A leaf of
    B hashes what B itself holds there: the digests of all copies, how often each
    comes, and, where ``replica_b`` has its own byte ``offset``, the record's rank in
    B's order among the records that both hold; a missing one leaves its leaf empty.
    Without ``offset`` B is in the manifest's order.

    One row per record of A, and one of status ``extra`` and no ordinal per record
    that only B holds.  ``held`` and ``good`` count B's copies and the unaltered
    ones; ``status`` names the worst: ``altered`` (a copy), ``missing`` (all copies or
    some), ``extra`` (more copies than A's), ``moved`` (out of order), ``ok``.
    """
    ws = Workspace(replica_a.sparkSession, "warc")
    placed, n = lay_out(replica_a, ws)
    placed = ws.save(placed)
    ordered = "offset" in replica_b.columns
    own = F.min("offset") if ordered else F.lit(None).cast("long")
    kinds = replica_b.groupBy("page_id", "expected", F.col("digest").alias("found")).agg(F.count("*").alias("n"), own.alias("own"))
    sound = F.when(F.col("found").eqNullSafe(F.col("expected")), F.col("n")).otherwise(0)
    held = kinds.groupBy("page_id", "expected").agg(
        F.sum("n").alias("held"), F.sum(sound).alias("good"), F.min("own").alias("found_offset"),
        F.to_json(F.array_sort(F.collect_list(F.struct("found", "n")))).alias("content"))
    same = [F.col("m.page_id").eqNullSafe(F.col("h.page_id")), F.col("m.digest") == F.col("h.expected")]
    met = ws.save(placed.alias("m").join(held.alias("h"), reduce(lambda x, y: x & y, same), "full").select(
        F.when(F.col("m.ordinal").isNull(), F.col("h.page_id")).otherwise(F.col("m.page_id")).alias("page_id"),
        F.coalesce("m.digest", "h.expected").alias("digest"), "m.ordinal", "m.offset", F.col("m.length").cast("long").alias("length"),
        F.coalesce("m.copies", F.lit(0)).cast("long").alias("copies"),
        F.coalesce("h.held", F.lit(0)).alias("held"), F.coalesce("h.good", F.lit(0)).alias("good"), "h.found_offset", "h.content"))
    known = met.where("ordinal is not null")
    if ordered:
        common = known.where("held > 0").select("ordinal", "found_offset")
        ranks, _ = numbered(common, ["ordinal"], "rank_a", ws)
        ranks, _ = numbered(ranks, ["found_offset", "ordinal"], "rank_b", ws)
        ranks = ranks.drop("found_offset")
        known = ws.save(known.join(ranks, "ordinal", "left"))
    else:
        known = known.withColumn("rank_a", F.lit(None).cast("long")).withColumn("rank_b", F.lit(None).cast("long"))
    good = F.to_json(F.array(F.struct(F.col("digest").alias("found"), F.col("copies").alias("n"))))
    leaf = lambda content, rank: known.select(
        "ordinal", F.sha2(F.concat_ws("@", content, F.col(rank).cast("string")), 256).alias("digest"), "offset", "length")
    bad = mismatches(tree(leaf(good, "rank_a"), n, ws), tree(leaf(F.coalesce("content", F.lit("missing")), "rank_b"), n, ws), ws)
    status = (
        F.when(F.col("ordinal").isNull(), "extra").when(F.col("bad").isNull(), "ok").when(F.col("held") > F.col("good"), "altered")
        .when(F.col("held") < F.col("copies"), "missing").when(F.col("held") > F.col("copies"), "extra").otherwise("moved"))
    return met.join(bad.withColumn("bad", F.lit(True)), "ordinal", "left").select(
        "page_id", "ordinal", F.floor(F.col("ordinal") / FILE_RECORDS).cast("long").alias("file_no"), "offset",
        "length", "copies", "digest", status.alias("status"), "held", "good", "found_offset")


def replica_with_faults(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` as a store with faults would return it.

    By CRC-32 of the page id: every 101st record comes back with its body cut to
    half, every 103rd with an altered first byte, every 107th not at all.
    """
    crc = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    html = F.coalesce("html", F.lit(""))
    broken = (
        F.when(crc % 101 == 0, F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int")))
        .when(crc % 103 == 0, F.concat(F.lit("~"), F.substring(html, F.lit(2), F.length(html))))
        .otherwise(html)
    )
    stored = F.sha2(warc_record(F.col("page_id"), F.col("url"), html), 256)
    return pages.where(crc % 107 != 0).select(
        "page_id", stored.alias("expected"), F.sha2(warc_record(F.col("page_id"), F.col("url"), broken), 256).alias("digest"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit all pages against a replica with faults: place, digest and status of each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    good = pages.select("page_id", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    return audit(good, replica_with_faults(pages)).drop("held", "good", "found_offset")


def _sql_record(body: str) -> str:
    end = "chr(13) || chr(10)"
    return (
        f"'WARC/1.1' || {end} || 'WARC-Type: resource' || {end} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '')"
        f" || '>' || {end} || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Type: text/html' || {end}"
        f" || 'Content-Length: ' || strlen({body})::varchar || {end} || {end} || {body} || {end} || {end}"
    )


#: The same result by comparing every record; page ids are unique in the test tables, and the faults are
#: taken from the page id by a CRC-32 that DuckDB lacks, so the SQL computes it bit by bit.
FIXITY_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM crc_table WHERE k < 8
), crc_list AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
page AS (SELECT page_id, url, coalesce(html, '') AS body, coalesce(page_id::varchar, '') AS id FROM pages),
crc AS (
  SELECT page.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) AS crc
  FROM page, crc_list
), records AS (
  SELECT page_id, crc % 107 = 0 AS missing, {_sql_record("body")} AS good,
    {_sql_record("broken")} AS bad
  FROM (SELECT *, CASE WHEN crc % 101 = 0 THEN substr(body, 1, length(body) // 2)
    WHEN crc % 103 = 0 THEN '~' || substr(body, 2) ELSE body END AS broken FROM crc)
)
SELECT page_id, (row_number() OVER w - 1)::BIGINT AS ordinal, ((row_number() OVER w - 1) // {FILE_RECORDS})::BIGINT AS file_no,
  (sum(strlen(good)) OVER w - strlen(good))::BIGINT AS "offset", strlen(good)::BIGINT AS length, 1::BIGINT AS copies,
  sha256(good) AS digest, CASE WHEN missing THEN 'missing' WHEN good <> bad THEN 'altered' ELSE 'ok' END AS status
FROM records WINDOW w AS (ORDER BY page_id)
"""
