"""Curated tables: the workbook before the text file, strict or lenient."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.validation import raise_on_errors
from textloom.sources.documents import read_curated, read_sheet


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_curated(spark: SparkSession, workbook: str, text: str, sheet: str, columns: list[str], keys: list[str], validate: Callable[[DataFrame], DataFrame] | None = None, strict: bool = True) -> DataFrame:
    """Rows of a curated table, with ``line``, from the sheet of a workbook where there is one, else from a text file; none where neither is there.

    Rows without a value in every key are no rows.  Strict: all errors that ``validate`` finds
    (a table of them) are raised together; lenient: rows are returned as they are.
    """
    if _exists(spark, workbook):
        rows = read_sheet(spark, workbook, columns, sheet)
    elif _exists(spark, text):
        rows = read_curated(spark, text, columns)
    else:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", line long")
    for key in keys:
        rows = rows.filter(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    # curated tables are small files, of one partition each
    rows = rows.withColumn("line", F.monotonically_increasing_id() + 1)
    if strict and validate is not None:
        raise_on_errors(validate(rows))
    return rows


def appended_rows(spark: SparkSession, workbook: str, sheet: str, columns: list[str]) -> DataFrame:
    """Rows waiting in a workbook of additions, those without any value left out; none without the workbook."""
    if not _exists(spark, workbook):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = read_sheet(spark, workbook, columns, sheet)
    given = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in columns]
    some = given[0]
    for other in given[1:]:
        some |= other
    return rows.filter(some)
