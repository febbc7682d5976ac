"""Writers and readers of files at the edges: Parquet, JSON, CSV, ZIP and XML."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace a table; Spark's commit protocol makes it visible as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def canonical_json(value) -> str:
    """Sorted keys, no blanks, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json_array(rows: Iterable[dict], path: str) -> int:
    """Stream records into one JSON array on the driver's disk; returns how many."""
    n, tmp = 0, Path(f"{path}.part")
    with tmp.open("w", encoding="utf-8") as f:
        f.write("[")
        for row in rows:
            f.write((",\n" if n else "\n") + canonical_json(row))
            n += 1
        f.write("\n]\n")
    tmp.replace(path)
    return n


def write_records(df: DataFrame, path: str, order: str) -> int:
    """Ordered records of a frame, one partition at a time."""
    return write_json_array((r.asDict(recursive=True) for r in df.orderBy(order).toLocalIterator()), path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_stable_zip(member: str, data: bytes, path: str) -> None:
    """The same bytes for the same content: one member with a fixed time."""
    info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
    info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(info, data, zipfile.ZIP_DEFLATED, 9)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def rss_items(payload: str, depth: int) -> list[dict]:
    """(rank, url, title) of a feed, each URL once, up to ``depth``."""
    seen: dict[str, str] = {}
    for item in ElementTree.fromstring(payload).iter("item"):
        url = (item.findtext("link") or "").strip()
        if url and len(seen) < depth:
            seen.setdefault(url, (item.findtext("title") or "").strip())
    return [{"rank": i, "url": u, "title": t} for i, (u, t) in enumerate(seen.items(), 1)]


def feed_results(feeds: DataFrame, depth: int) -> DataFrame:
    """Parse (query_id, payload) feeds to result rows."""
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([{"query_id": int(q), **r} for q, p in zip(pdf.query_id, pdf.payload, strict=True) for r in rss_items(p, depth)], columns=["query_id", "rank", "url", "title"])

    return feeds.mapInPandas(run, "query_id long, rank int, url string, title string")


def article_record(payload: str) -> dict:
    """One article: labelled abstract parts, headings with qualifiers, the first year there is, and how much there is of it."""
    root = ElementTree.fromstring(payload)
    parts = [(p.get("Label"), " ".join("".join(p.itertext()).split())) for p in root.iter("AbstractText")]
    abstract = "\n".join(f"{label}: {t}" if label else t for label, t in parts if t)
    title = " ".join("".join(t.itertext()).split()) if (t := next(root.iter("ArticleTitle"), None)) is not None else ""
    headings = []
    for h in root.iter("MeshHeading"):
        names = [(h.findtext("DescriptorName") or "").strip(), *((q.text or "").strip() for q in h.findall("QualifierName"))]
        headings.append(" / ".join(n for n in names if n))
    year = next((y.text[:4] for tag in ("Year", "MedlineDate") for y in root.iter(tag) if y.text), None)
    status = "ABSTRACT" if abstract else "TITLE_ONLY" if title else "METADATA_ONLY"
    return {"title": title, "abstract": abstract, "headings": headings, "year": year, "status": status}


def article_records(xml: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([{"id": int(i), **article_record(p)} for i, p in zip(pdf.id, pdf.payload, strict=True)], columns=["id", "title", "abstract", "headings", "year", "status"])

    return xml.mapInPandas(run, "id long, title string, abstract string, headings array<string>, year string, status string")
