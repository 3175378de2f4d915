"""Sinks and sources besides Parquet tables: JSON lines, CSV, model snapshots and files of text."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


CSV_COLUMNS = ("dataset_id", "document_id", "summary_id", "summary_type", "document_name", "document_type", "court", "judge", "case_number", "language", "ai_provider", "input_text", "output_text", "created_at")
CSV_LIMIT, CSV_MOST = 10_000, 50_000


def append_json_lines(examples: DataFrame, path: str) -> None:
    """Appends the examples whose id isn't in the file yet, each once; the index is an anti join against what is there."""
    spark = examples.sparkSession
    fresh = examples.dropDuplicates(["id"])
    try:
        fresh = fresh.join(spark.read.schema("id string").json(path), "id", "left_anti")
    except Exception as e:  # no file yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, limit: int = CSV_LIMIT) -> None:
    """The rows in the order of their summaries, the limit held between 1 and 50 000, with a header."""
    rows.orderBy("summary_id").limit(max(1, min(limit, CSV_MOST))).select(*CSV_COLUMNS).write.mode("overwrite").option("quote", '"').option("escape", '"').csv(path, header=True)


def write_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, weight double, examples_seen long").parquet(path)


_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml")


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if _PARTS.fullmatch(n)), key=lambda n: (not n.endswith("document.xml"), n))
        xml = "\n".join(z.read(n).decode("utf-8", "replace") for n in names)
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", xml)
    xml = re.sub(r"</w:p>|<w:br\b[^>]*/>", "\n", xml)
    xml = re.sub(r"<[^>]+>", "", xml)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        xml = xml.replace(a, b)
    return re.sub(r"\n{3,}", "\n\n", xml).strip()


def _doc(content: bytes) -> str:
    """Runs of 12 readable characters or more of an old binary file, in either encoding, each once."""
    wide = [m.group().decode("utf-16le", "ignore") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff]\x00){12,}", content)]
    narrow = [m.group().decode("latin-1") for m in re.finditer(rb"[\x20-\x7e\xa0-\xff]{12,}", content)]
    return "\n".join(dict.fromkeys(x.strip() for x in wide + narrow if x.strip()))


def text_of(name: str, content: bytes) -> str | None:
    """The text of a file by its ending; null for one that can't be read."""
    low = name.lower()
    try:
        if low.endswith(".docx"):
            return _docx(content)
        if low.endswith(".doc"):
            return _doc(content)
        return content.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n").strip()
    except (zipfile.BadZipFile, KeyError):
        return None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every text, .docx or .doc file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [text_of(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]})

    return files.mapInPandas(work, "path string, text string")


