"""Stored results by snapshot, found from the names of files alone: resolution, loading, links and removal.

A listing is Spark's file index of a folder, with the parts of each path; no file is opened for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a stored payload is called, by the name of its loader.
PAYLOADS = ("authorship", "centrality_comparison", "classification", "conformity", "contributors", "dependency_consistency", "dependency_metrics", "evolution", "network")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length, snapshot (the first folder below the root, without ``snapshot=``) and artifact (the rest of the path up to the file, or the file of a plain folder)."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.regexp_replace("path", "^[a-z0-9]+:/{0,2}(?=/)|^[a-z0-9]+://", "")
    plain = root.split("://", 1)[-1] if "://" in root else root
    parts = F.split(F.substring(below, F.length(F.lit(plain)) + 2, F.length(below)), "/")
    inner = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    named = files.select("path", "length", F.regexp_replace(parts[0], "^snapshot=", "").alias("snapshot"), F.when(inner != "", inner).otherwise(F.element_at(parts, -1)).alias("artifact"), F.size(parts).alias("_n"))
    return named.filter("_n > 1").drop("_n")


def ranked_snapshots(listed: DataFrame, wanted: str | None = None) -> DataFrame:
    """artifact, snapshot and place of all snapshots that have an artifact: the wanted one first, then ``latest``, then the others from the newest."""
    have = listed.select("artifact", "snapshot").distinct()
    first = F.when(F.col("snapshot") == wanted, 0).when(F.col("snapshot") == "latest", 1).otherwise(2)
    return have.withColumn("place", F.row_number().over(Window.partitionBy("artifact").orderBy(first, F.desc("snapshot"))))


def resolved(listed: DataFrame, wanted: str | None = None) -> DataFrame:
    """artifact and the snapshot to read it from: the wanted one, else ``latest``, else the newest dated one as a whole.

    The newest dated snapshot is the root's, as a folder that lacks the artifact is no candidate beyond it.
    """
    newest = listed.filter("snapshot <> 'latest'").agg(F.max("snapshot").alias("_newest"))  # one row
    candidates = ranked_snapshots(listed, wanted).join(F.broadcast(newest))
    kept = candidates.filter((F.col("snapshot") == F.lit(wanted)) | (F.col("snapshot") == "latest") | (F.col("snapshot") == F.col("_newest")))
    return kept.groupBy("artifact").agg(F.min_by("snapshot", "place").alias("snapshot"))


def artifact_path(spark: SparkSession, root: str, artifact: str, wanted: str | None = None) -> str:
    """The folder or file of an artifact in its resolved snapshot; an error names what was tried."""
    listed = listing(spark, root).filter(F.col("artifact") == artifact)
    every = listing(spark, root).filter("snapshot <> 'latest'").agg(F.max("snapshot")).first()[0]
    found = ranked_snapshots(listed, wanted).filter(F.col("snapshot").isin([s for s in (wanted, "latest", every) if s])).orderBy("place").first()
    if found is None:
        raise FileNotFoundError(f"no {artifact} in {', '.join(s for s in (wanted, 'latest', every) if s)}")
    path = listed.filter(F.col("snapshot") == found.snapshot).agg(F.min("path")).first()[0]
    return path.rsplit("/", 1)[0] if not path.endswith(f"/{artifact}") else path


def load_payload(spark: SparkSession, root: str, payload: str, wanted: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of a stored payload (one of PAYLOADS, or any other folder of JSON rows) from its resolved snapshot."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(artifact_path(spark, root, payload, wanted))


def default_branches(refs: DataFrame) -> DataFrame:
    """repo and its default branch: what origin/HEAD points to, else master, else main, else null (repo, ref, target)."""
    has = lambda name: F.max(F.when(F.col("ref") == f"refs/remotes/origin/{name}", F.lit(f"origin/{name}")))
    head = F.max(F.when((F.col("ref") == "refs/remotes/origin/HEAD") & F.startswith("target", F.lit("refs/remotes/")), F.substring("target", 14, 1 << 20)))
    return refs.groupBy("repo").agg(F.coalesce(head, has("master"), has("main")).alias("branch"))


def link_index(manifests: DataFrame, head: DataFrame) -> DataFrame:
    """source, snapshot (null: current), id, file and commit: links of every snapshot, and current ones.

    manifests: source, snapshot, commit, id, file; a snapshot without a commit has no links.
    head: source, id, file of the repository's newest state; a source without any falls back to
    the files of its newest snapshot.
    """
    dated = manifests.filter((F.coalesce(F.trim("commit"), F.lit("")) != "") & F.col("file").isNotNull())
    last = manifests.groupBy("source").agg(F.max("snapshot").alias("snapshot"))
    fallback = dated.join(last, ["source", "snapshot"], "left_semi").join(head.select("source").distinct(), "source", "left_anti")
    none = F.lit(None).cast("string")
    current = head.select("source", "id", "file").unionByName(fallback.select("source", "id", "file"))
    current = current.select("source", none.alias("snapshot"), "id", "file", none.alias("commit"))
    return dated.select("source", "snapshot", "id", "file", "commit").unionByName(current)


def removal_targets(spark: SparkSession, roots: dict[str, list[str]], snapshot: str, source: str | None = None) -> list[tuple[str, str, int, int]]:
    """source, folder, files and bytes of a snapshot in the given folders of each source (or of one source), in order; absent folders are left out."""
    targets = []
    for name in sorted(roots if source is None else [source]):
        for root in sorted(roots[name]):
            for folder in (f"{root.rstrip('/')}/{snapshot}", f"{root.rstrip('/')}/snapshot={snapshot}"):
                place = spark._jvm.org.apache.hadoop.fs.Path(folder)
                system = place.getFileSystem(spark._jsc.hadoopConfiguration())
                if system.exists(place):
                    held = system.getContentSummary(place)
                    targets.append((name, folder, held.getFileCount(), held.getLength()))
    return targets


def remove_snapshot(spark: SparkSession, roots: dict[str, list[str]], snapshot: str, source: str | None = None, dry_run: bool = True) -> list[tuple[str, str, int, int]]:
    """What removing a snapshot deletes; deleted only where it is no dry run."""
    if not snapshot.strip() or "/" in snapshot or snapshot in (".", ".."):
        raise ValueError(f"no snapshot: {snapshot!r}")
    targets = removal_targets(spark, roots, snapshot, source)
    if not dry_run:
        for _, folder, _, _ in targets:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return targets
