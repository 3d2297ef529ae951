"""Writers of result tables, payload bundles and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, separator: str = ",", whole: bool = True) -> None:
    """Header and rows, columns in the order of the table; an empty table leaves its header.

    One file, for tables that people open; a large table is written by all tasks, not whole.
    """
    (rows.coalesce(1) if whole else rows).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_network_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes with list columns joined by " | ", and edges."""
    flat = [F.array_join(c, " | ").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in nodes.dtypes if not kind.startswith(("map", "struct"))]
    write_csv(nodes.select(*flat), f"{path}/nodes")
    write_csv(edges.select("source", "target", "extraction_method", "relation_type", "value"), f"{path}/edges")


def write_payloads(payloads: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON rows for each payload; the index is written last and marks the bundle as whole."""
    for name, rows in payloads.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(payloads.values())).sparkSession
    spark.createDataFrame([(name,) for name in sorted(payloads)], "payload string").coalesce(1).write.mode("overwrite").json(f"{path}/dataset_index")


def write_snapshot(rows: DataFrame, root: str, snapshot: str) -> None:
    """Replaces one snapshot's partition, so that rows absent from this run go; other snapshots stay."""
    rows.withColumn("snapshot", F.lit(snapshot)).write.mode("overwrite").partitionBy("snapshot").option("partitionOverwriteMode", "dynamic").parquet(root)


def merged_snapshot(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows; where a new value is null, or a column is missing, the old row's value of the same key."""
    before = old.select(*[F.col(c).alias(f"_{c}") for c in old.columns])
    both = new.join(before, F.col(key) == F.col(f"_{key}"), "left")
    kept = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in old.columns else F.col(c) for c in new.columns]
    return both.select(*kept, *[F.col(f"_{c}").alias(c) for c in old.columns if c not in new.columns])


def appended_runs(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest with new runs; a run of a known run_id replaces the old one."""
    return manifest.join(runs.select("run_id"), "run_id", "left_anti").unionByName(runs, allowMissingColumns=True)


def file_manifest(documents: DataFrame) -> DataFrame:
    """id and file, one row for each document, the first file by name."""
    return documents.groupBy("id").agg(F.min("file").alias("file"))


def stale_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the last run whose keys this run lacks."""
    return old.join(new.select(key), key, "left_anti")
