"""Dashboard selections and the remaining set and list operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_source(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different catalogues (keys catalogue:id)."""
    return edges.filter(F.split_part("source", F.lit(":"), F.lit(1)) != F.split_part("target", F.lit(":"), F.lit(1)))


def cross_source_authors(authored: DataFrame) -> DataFrame:
    """Rows (source, id, author) of authors with documents in more than one catalogue."""
    many = authored.groupBy("author").agg((F.min("source") != F.max("source")).alias("_many")).filter("_many")
    return authored.join(many.select("author"), "author", "left_semi")


def at_least_authored(authored: DataFrame, least: int) -> DataFrame:
    """Rows of authors with at least so many documents."""
    busy = authored.groupBy("author").agg(F.countDistinct("id").alias("_n")).filter(F.col("_n") >= least)
    return authored.join(busy.select("author"), "author", "left_semi")


def cluster_edges(edges: DataFrame, components: DataFrame, least: int = 1) -> DataFrame:
    """component, nodes and edges of each connected group with at least so many edges."""
    inside = edges.join(components, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("edges"))
    return components.groupBy("component").agg(F.count("*").alias("nodes")).join(inside, "component").filter(F.col("edges") >= least)


def component_sizes(components: DataFrame) -> DataFrame:
    """Size distribution of connected groups."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def merge_sums(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Values of several tables added up by key."""
    every = parts[0].select(key, value)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, value))
    return every.groupBy(key).agg(F.sum(value).alias(value))


def padded(id: Column, width: int = 4) -> Column:
    """Zeros before an id of digits up to a width; longer ones and others stay whole."""
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(id), F.lit(0)))
    return F.when(id.rlike("^[0-9]+$"), F.concat(zeros, id)).otherwise(id)


def located_files(wanted: DataFrame, files: DataFrame, endings: list[str], folder: list[str] | None = None, names: list[Column] | None = None) -> DataFrame:
    """id and file of each wanted id: its names in turn (padded to four digits, bare, lower case), each by the order of endings.

    With columns of the folder, on both sides, a file is looked for in the id's own folder; they are returned too.
    """
    folder = folder or []
    stem = F.split_part("file", F.lit("."), F.lit(1))
    listed = files.select(*folder, "file", stem.alias("stem"), F.array_position(F.array(*map(F.lit, endings)), F.split_part("file", F.lit("."), F.lit(-1))).alias("rank")).filter("rank > 0")
    tries = names or [padded(F.col("id")), F.col("id"), F.lower("id")]
    tried = wanted.select(*folder, "id", F.inline(F.array(*[F.struct(name.alias("stem"), F.lit(kind).alias("kind")) for kind, name in enumerate(tries)]))).join(listed, [*folder, "stem"])
    return tried.groupBy(*folder, "id").agg(F.min_by("file", F.struct("kind", "rank")).alias("file"))


def model_statistics(findings: DataFrame) -> DataFrame:
    """Documents and edges of each model (model, id)."""
    return findings.groupBy("model").agg(F.countDistinct("id").alias("documents"), F.count("*").alias("edges"))


def review_days(edges: DataFrame, reviewed: DataFrame, day: str = "reviewed_at") -> DataFrame:
    """Distinct valid days of review, in order."""
    return edges.select(day).unionByName(reviewed.select(day)).filter(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$")).distinct().orderBy(day)


def scaled_sizes(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Square-root scale of values between two sizes, over the whole table."""
    span = F.broadcast(rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high")))  # one row
    part = F.try_divide(F.sqrt(F.col(value) - F.col("_low")), F.sqrt(F.col("_high") - F.col("_low")))
    return rows.crossJoin(span).withColumn("size", low + (high - low) * F.coalesce(part, F.lit(0.5))).drop("_low", "_high")


def marked_gaps(counts: DataFrame, value: str, least: int = 3) -> DataFrame:
    """A sparse series with the size of the gap before each value, 0 where it is below ``least``."""
    gap = F.col(value) - F.lag(value).over(Window.orderBy(value))
    return counts.withColumn("gap", F.when(gap >= least, gap).otherwise(F.lit(0)).cast("long"))
