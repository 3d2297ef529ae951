"""Counts of documents by their classification: years, statuses, types and layers."""

from __future__ import annotations

from itertools import combinations
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def or_unknown(column: str, label: str = UNKNOWN) -> Column:
    """The trimmed text, or the label where it is missing or empty."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(label))


def base_status(column: str) -> Column:
    """The part of a status before a parenthesis."""
    return F.trim(F.split_part(F.col(column), F.lit("("), F.lit(1)))


def apply_alias(docs: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Replaces exact values by their canonical form; the rest and nulls stay."""
    pairs = [x for kv in aliases.items() for x in map(F.lit, kv)]
    return docs.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)) if pairs else F.col(column))


def count_over_time(docs: DataFrame, column: str, label: str = UNKNOWN, year: str = "year") -> DataFrame:
    """Documents by year and value; documents without a year are left out."""
    return docs.filter(F.col(year).isNotNull()).groupBy(year, or_unknown(column, label).alias(column)).count()


def pivot_over_time(docs: DataFrame, column: str, values: list[str], year: str = "year") -> DataFrame:
    """A row for each year and a column for each value, 0 where none."""
    return docs.groupBy(year).pivot(column, sorted(values)).count().na.fill(0)


def sankey_links(docs: DataFrame, grouped: bool = True) -> DataFrame:
    """Links layer - status - type with counts.

    Grouped: unknown values fold into one name.  Else documents with any unknown value are left out.
    """
    known = docs.select(*[or_unknown(c).alias(c) for c in ("layer", "status", "type")])
    if not grouped:
        known = known.filter(reduce(Column.__and__, [F.col(c) != UNKNOWN for c in known.columns]))
    sides = known.select(F.inline(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("target")) for a, b in (("layer", "status"), ("status", "type"))])))
    return sides.groupBy("source", "target").count()


def facet_distribution(docs: DataFrame, facets: list[str]) -> DataFrame:
    """Documents by facet and category."""
    return docs.unpivot([], [F.col(f).cast("string").alias(f) for f in facets], "facet", "category").groupBy("facet", F.coalesce("category", F.lit("Unspecified")).alias("category")).count()


def facet_timeline(docs: DataFrame, facet: str, year: str = "year") -> DataFrame:
    """Years without gaps by category, zeros filled in."""
    counts = docs.groupBy(year, facet).count()
    span = docs.agg(F.min(year).alias("low"), F.max(year).alias("high"))
    years = span.filter("low is not null").select(F.explode(F.sequence("low", "high")).alias(year))
    spine = years.crossJoin(F.broadcast(docs.select(facet).distinct()))  # years times categories: both short lists
    return spine.join(counts, [year, facet], "left").select(year, facet, F.coalesce("count", F.lit(0)).alias("count"))


def chord_matrix(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Symmetric counts of category pairs from different dimensions of one document."""
    pairs = [F.struct(F.concat_ws(":", F.lit(a), F.col(a)).alias("a"), F.concat_ws(":", F.lit(b), F.col(b)).alias("b")) for a, b in combinations(dimensions, 2)]
    counts = docs.select(F.inline(F.array(*pairs))).groupBy("a", "b").count()
    return counts.select(F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "count"), F.struct(F.col("b").alias("source"), F.col("a").alias("target"), "count"))))


def relation_rows(docs: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Counts of pairs (a, b) and of triplets (a, b, c), the pairs with a null c."""
    return docs.rollup(a, b, c).agg(F.count("*").alias("count"), F.grouping_id().alias("level")).filter("level <= 1").drop("level")


def crosstab(docs: DataFrame, row: str, column: str) -> DataFrame:
    """Counts with their share of the column and whether they are its largest, ties included."""
    of_column = Window.partitionBy(column)
    counts = docs.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.select(row, column, "n", (F.col("n") / F.sum("n").over(of_column)).alias("share"), (F.col("n") == F.max("n").over(of_column)).alias("is_mode"))


def all_groupings(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by every subset of the columns; null stands for all."""
    return docs.cube(*columns).agg(F.count("*").alias("count"))


def in_preferred_order(counts: DataFrame, column: str, preferred: list[str]) -> DataFrame:
    """Position of each category: the preferred ones first, then by name."""
    rank = F.when(F.col(column).isin(preferred), F.array_position(F.array(*map(F.lit, preferred)), F.col(column))).otherwise(len(preferred) + 1)
    return counts.withColumn("position", F.row_number().over(Window.orderBy(rank, column)))


def top_categories(docs: DataFrame, column: str, n: int) -> DataFrame:
    """The n largest categories, ties by name, and the number of all documents."""
    counts = docs.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)
    return counts.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))  # one row
