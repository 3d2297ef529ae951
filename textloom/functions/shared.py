"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_textloom_path"
#: Rows of a task that sorts or groups, about, where more than ``FEW_TASKS`` such tasks are needed.
TASK_ROWS, FEW_TASKS = 500_000, 4


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one on a local master, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    It cuts the lineage, is computed once, and outlives lost executors.  Tables of one
    application lie in one folder, which may be removed when it has ended; loops remove
    the tables of earlier rounds with ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, _PATH)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has so many rows, dealt by keys to tasks of about ``TASK_ROWS``; a few tasks' rows are left to Spark.

    Spark sizes tasks by shuffled bytes, and narrow rows are many times larger once sorted or grouped.
    """
    return df if rows <= FEW_TASKS * TASK_ROWS else df.repartition(math.ceil(rows / TASK_ROWS), *keys)
