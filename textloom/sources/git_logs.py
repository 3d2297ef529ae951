"""Exported histories of repositories: a data source with one partition for each log, and paths followed over renames.

A log is what ``git log --first-parent --name-status`` prints, newest commits first, each
headed by a line ``__COMMIT__hash|date|author`` (with ``|mail`` behind where exported).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions.shared import forget, written

#: Fixed value: what heads a commit of an exported log.
MARK = "__COMMIT__"
CHANGES = "repo string, seq long, commit string, timestamp string, author string, mail string, change string, old_path string, path string"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
#: Rows handed on at once.
_ROWS = 10_000


@dataclass
class LogFile(InputPartition):
    """The log of one repository."""

    path: str
    repo: str


class GitLogs(DataSource):
    """Format ``git_logs``: the changed paths of all commits in the logs of a folder, a repository for each file.

    Options: path (a folder or one log, of any file system that Arrow knows), suffix (``.log``),
    onError (``fail``, or ``empty``: a log that cannot be read has no rows).
    seq counts a repository's commits from the newest, 0.
    """

    @classmethod
    def name(cls) -> str:
        return "git_logs"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"], self.options.get("suffix", ".log"), self.options.get("onerror", self.options.get("onError", "fail")) == "empty")


class LogReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, lenient: bool):
        self.path, self.suffix, self.lenient = path, suffix, lenient

    def partitions(self) -> list[LogFile]:
        """Only names are listed here; each log is read where its task runs."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.Directory:
            files = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        elif found.type == fs.FileType.File or not self.lenient:
            files = [root]
        else:
            files = []
        return [LogFile(f, f.rsplit("/", 1)[-1].removesuffix(self.suffix)) for f in sorted(files)]

    def read(self, partition: LogFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no log was found
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        try:
            with system.open_input_stream(partition.path) as stream:
                yield from batches(io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"), partition.repo)
        except OSError:
            if not self.lenient:
                raise


def batches(lines: Iterator[str], repo: str) -> Iterator[pa.RecordBatch]:
    """Rows of a log, read a line at a time; lines before the first commit and commits without paths give none."""
    rows, head, seq = [], None, -1
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(MARK):
            head, seq = (line[len(MARK) :].split("|", 3) + ["", "", ""])[:4], seq + 1
        elif head is not None and line.strip():
            # a letter (renames and copies with their likeness behind it), then one path or two
            kind, *paths = [x.strip() for x in line.split("\t")]
            if paths:
                rows.append((repo, seq, *head, kind[:1], paths[0] if len(paths) > 1 else None, paths[-1]))
        if len(rows) >= _ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "seq" else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def read_changes(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """All changes in the logs of a folder."""
    spark.dataSource.register(GitLogs)
    return spark.read.format("git_logs").option("path", path).option("onError", "empty" if lenient else "fail").load()


def followed(changes: DataFrame) -> DataFrame:
    """Changes with ``file``, the last path of the file that each one is about, over all renames.

    A path is a new file each time it is added or renamed to.  Files are linked by renames, and
    each one's pointer to the file after it is doubled until it points to the last: rounds grow
    with the logarithm of the longest chain of renames, and only links are in them.
    A path that is changed without having been added has been there from the start.
    """
    starts = F.col("change").isin("A", "R", "C")
    here = changes.select("*", F.col("path").alias("_at"), starts.cast("int").alias("_start"), F.lit(1).alias("_side"))
    # what is renamed away leaves before anything comes to its place in the same commit
    gone = changes.filter("change = 'R'").select("*", F.col("old_path").alias("_at"), F.lit(0).alias("_start"), F.lit(0).alias("_side"))
    earlier = Window.partitionBy("repo", "_at").orderBy(F.desc("seq"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = written(here.unionByName(gone).withColumn("_nth", F.sum("_start").over(earlier)))
    mine = numbered.filter("_side = 1").withColumn("_own", F.struct("_at", "_nth"))
    left = numbered.filter("_side = 0").select("repo", "seq", "path", "old_path", F.struct("_at", "_nth").alias("node"))
    links = left.join(mine.filter("change = 'R'").select("repo", "seq", "path", "old_path", F.col("_own").alias("after")), ["repo", "seq", "path", "old_path"]).select("repo", "node", "after")
    # of one file renamed to several places in a commit, the first by name goes on
    links = written(links.groupBy("repo", "node").agg(F.min("after").alias("after")))
    while True:
        onward = links.select("repo", F.col("node").alias("after"), F.col("after").alias("beyond"))
        step = written(links.join(onward, ["repo", "after"], "left").select("repo", "node", F.coalesce("beyond", "after").alias("after"), F.col("beyond").isNotNull().alias("moved")))
        moved = not step.filter("moved").isEmpty()
        forget(links)
        links = step.select("repo", "node", "after")
        if not moved:
            break
        links = written(links)
        forget(step)
    last = mine.join(links.withColumnRenamed("node", "_own"), ["repo", "_own"], "left")
    return last.select(*changes.columns, F.coalesce("after._at", "path").alias("file"))


def path_history(changes: DataFrame) -> DataFrame:
    """repo, file, seq, commit, timestamp, author and path: each file's commits with the path that it had then.

    Of several lines of a commit about one file the last path by name stands; deletions have none.
    """
    rows = followed(changes).filter("change <> 'D'")
    return rows.groupBy("repo", "file", "seq").agg(*(F.max_by(c, F.struct("path", c)).alias(c) for c in ("commit", "timestamp", "author")), F.max("path").alias("path"))


def file_history(changes: DataFrame) -> DataFrame:
    """repo, file, seq, commit, timestamp, author, mail and day: the history of each file over its renames, deletions included."""
    rows = followed(changes).groupBy("repo", "file", "seq").agg(*(F.first(c).alias(c) for c in ("commit", "timestamp", "author", "mail")))
    return rows.withColumn("day", F.try_to_date(F.substring("timestamp", 1, 10), "yyyy-MM-dd"))
