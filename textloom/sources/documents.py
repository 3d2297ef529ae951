"""Readers of document snapshots, texts, curated tables, configuration and histories."""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCORES = "score DOUBLE, passed_checks BIGINT, failed_checks BIGINT, skipped_checks BIGINT, total_checks BIGINT"
_CHECKS = f"STRUCT<{_SCORES}, checks ARRAY<STRUCT<id STRING, label STRING, category STRING, standard STRING, passed BOOLEAN, details STRING>>>"
#: A document: raw header fields, history and what was found in it.  Unknown members are dropped, absent ones null.
DOCUMENT = f"""raw STRUCT<preamble MAP<STRING, VARIANT>>,
meta STRUCT<last_commit STRING, total_commits BIGINT, git_history ARRAY<ARRAY<STRING>>>,
insights STRUCT<
  formal_compliance STRUCT<{_SCORES}, bip2 {_CHECKS}, bip3 {_CHECKS}, slip {_CHECKS}, nip {_CHECKS}>,
  word_list MAP<STRING, BIGINT>,
  changes_in_status ARRAY<STRUCT<commit STRING, timestamp STRING, date STRING, author STRING, path STRING, status STRING, standard STRING>>,
  interrelations STRUCT<
    preamble_extracted ARRAY<STRUCT<target STRING, type STRING>>,
    body_extracted_regex ARRAY<STRUCT<target STRING, count BIGINT>>,
    body_extracted_llm ARRAY<STRUCT<run_id STRING, model STRING, timestamp STRING, status STRING, error_message STRING,
      findings ARRAY<STRUCT<target STRING, type STRING, evidence STRING, reason STRING, confidence STRING>>>>>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file that can be read, with ``file``, its name without the ending."""
    read = spark.read.schema(DOCUMENT.replace("\n", " ")).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return read.withColumn("file", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1))


def read_texts(spark: SparkSession, path: str, name_pattern: str = ".*") -> DataFrame:
    """file and text of the files whose names match the pattern from their start, case aside."""
    names = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(names.alias("file"), F.col("value").alias("text")).filter(F.col("file").rlike(f"(?i)^(?:{name_pattern})"))


def read_curated(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of text columns: tab- or comma-separated as its header says, comments and blank lines left out, trimmed."""
    head = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).first()
    if head is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    read = spark.read.option("header", True).option("sep", "\t" if "\t" in head[0] else ",").option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    found = {c.strip(): c for c in read.columns}
    return read.select(*[(F.trim(F.col(f"`{found[c]}`")) if c in found else F.lit(None).cast("string")).alias(c) for c in columns])


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: lower-case lines, comments and blank ones left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter(~F.col("word").rlike("^(#|$)")).distinct()


def load_registry(texts: dict[str, str]) -> dict[str, dict]:
    """Configurations by slug (or file name) from YAML texts by file name, in order of names."""
    out = {}
    for name in sorted(texts):
        config = yaml.safe_load(texts[name]) or {}
        out[config.get("slug") or name.rsplit(".", 1)[0]] = config
    return out


def identity_aliases(config: dict) -> dict[str, str]:
    """alias: canonical name, from authorship.identities; a later alias wins."""
    return {a: person["name"] for person in config.get("authorship", {}).get("identities", []) for a in person.get("aliases", [])}


def git_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """commit, author_date, author_name, author_email and day of log lines ``hash|date|name|mail``."""
    part = F.split(text, r"\|", 4)
    rows = lines.filter(F.col(text).rlike(r"^[0-9a-f]{7,40}\|")).select(part[0].alias("commit"), part[1].alias("author_date"), part[2].alias("author_name"), F.get(part, F.lit(3)).alias("author_email"))
    return rows.withColumn("day", F.try_to_date(F.substring("author_date", 1, 10), "yyyy-MM-dd"))


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """snapshot (text) of a table partitioned by it, in order, from the names of its files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", "/snapshot=([^/]+)/", 1).alias("snapshot")).filter("snapshot <> ''").distinct().orderBy("snapshot")


def common_snapshots(listed: DataFrame) -> DataFrame:
    """Snapshots that every source has (source, snapshot)."""
    n = F.broadcast(listed.agg(F.countDistinct("source").alias("sources")))  # one row
    return listed.groupBy("snapshot").agg(F.countDistinct("source").alias("n")).crossJoin(n).filter("n = sources").select("snapshot")


def read_sheet(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """Rows of a sheet of XLSX workbooks as text columns; workbooks are small and parsed whole in a task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for content in batch.column(0) for r in sheet_rows(content.as_py(), sheet, columns)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns))


def sheet_rows(content: bytes, sheet: str | None, columns: list[str]) -> list[tuple]:
    """Rows of a sheet (the first by default): shared and inline texts, cells by their letters, empty rows left out."""

    def local(e) -> str:
        return e.tag.rsplit("}", 1)[-1]

    def text(e) -> str:
        return "".join(t.text or "" for t in e.iter() if local(t) == "t")

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        listed = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for e in book.iter() if local(e) == "sheet"]
        target = targets[next(i for n, i in listed if sheet in (None, n))]
        data = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    header, out = None, []
    for row in (e for e in data.iter() if local(e) == "row"):
        cells = {}
        for i, c in enumerate(x for x in row if local(x) == "c"):
            letters = re.match("[A-Z]*", c.get("r", "")).group()
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else i
            value = next((v.text or "" for v in c if local(v) == "v"), "")
            cells[at] = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value else value
        if header is None:
            header = {v.strip(): k for k, v in cells.items()}
        elif any(v.strip() for v in cells.values()):
            out.append(tuple(cells.get(header[c], "").strip() if c in header else None for c in columns))
    return out
