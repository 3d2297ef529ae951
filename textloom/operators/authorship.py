"""Who wrote what, alone and together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import dealt


def clean_name(column: str) -> Column:
    """The name before an e-mail address in angle brackets."""
    return F.trim(F.split_part(F.col(column), F.lit("<"), F.lit(1)))


def clean_names(column: str) -> Column:
    """Cleaned distinct names of a list, in order, empty ones dropped."""
    names = F.transform(F.col(column), lambda a: F.trim(F.split_part(a, F.lit("<"), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda a: a != ""))


def author_counts(authored: DataFrame) -> DataFrame:
    return authored.groupBy("author").agg(F.countDistinct("id").alias("documents"))


def top_authors(authored: DataFrame, n: int = 15) -> DataFrame:
    """Most documents first, then by name as text."""
    name = F.col("author").cast("string")
    return author_counts(authored).orderBy(F.desc("documents"), F.lower(name), name).limit(n)


def histogram(counts: DataFrame, value: str) -> DataFrame:
    """How many rows have each value; zeros are left out."""
    return counts.filter(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("n"))


def top_share(authored: DataFrame, n: int = 10) -> DataFrame:
    """Documents of the n busiest authors as a percentage of all; joint ones count for each author."""
    top = top_authors(authored, n).agg(F.sum("documents").alias("top"))
    every = authored.agg(F.countDistinct("id").alias("documents"))
    return top.crossJoin(every).select("top", "documents", (F.col("top") * 100.0 / F.col("documents")).alias("percent"))  # one row each


def collaboration_edges(authored: DataFrame) -> DataFrame:
    """Pairs of authors a < b and the number of documents that they share.

    Give declared authors, not all contributors: the pairs of a document grow with the square of its authors.
    """
    per = authored.groupBy("id").agg(F.count("*").alias("n"))
    pairs = per.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    mates = authored.alias("x").join(authored.alias("y"), F.expr("x.id = y.id and x.author < y.author"))
    return dealt(mates.select(F.col("x.author").alias("a"), F.col("y.author").alias("b")), pairs, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Partners and summed weights of each author."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("author"), "weight"), F.struct(F.col("b").alias("author"), "weight"))))
    return ends.groupBy("author").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def network_summary(authored: DataFrame, edges: DataFrame) -> DataFrame:
    """Authors, pairs, density, mean degree and authors without a partner."""
    authors = authored.select("author").distinct()
    n = authors.agg(F.count("*").alias("authors"))
    m = edges.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    alone = authors.join(degrees(edges), "author", "left_anti").agg(F.count("*").alias("isolated"))
    both = n.crossJoin(m).crossJoin(alone)  # one row each
    possible = F.col("authors") * (F.col("authors") - 1)
    return both.select("authors", "pairs", "weight", "isolated", F.try_divide(2 * F.col("pairs"), possible).alias("density"), F.try_divide(2 * F.col("pairs"), "authors").alias("mean_degree"))


def contributor_coverage(authors: DataFrame, contributors: DataFrame) -> DataFrame:
    """Sizes of both groups and of their overlap, and documents that no author contributed to."""
    people = authors.select("author").distinct().withColumn("declared", F.lit(1)).join(contributors.select("author").distinct().withColumn("contributed", F.lit(1)), "author", "full")
    sets = people.agg(
        F.count("contributed").alias("contributors"),
        F.count("declared").alias("declared"),
        F.count(F.when(F.col("declared").isNotNull() & F.col("contributed").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("declared").isNull(), 1)).alias("never_declared"),
    )
    touched = contributors.select("id").distinct()
    credited = authors.join(contributors, ["id", "author"], "left_semi").select("id").distinct()
    documents = touched.agg(F.count("*").alias("with_contributors")).crossJoin(touched.join(credited, "id", "left_anti").agg(F.count("*").alias("uncredited")))
    return sets.crossJoin(documents)  # one row each


def overlap_breakdown(authors: DataFrame, contributors: DataFrame) -> DataFrame:
    """Documents edited by their authors only, by some of them, by none."""
    marks = contributors.select("id", "author").distinct().join(authors.select("id", "author", F.lit(1).alias("own")).distinct(), ["id", "author"], "left")
    per = marks.groupBy("id").agg(F.count("*").alias("editors"), F.count("own").alias("own"))
    kind = F.when(F.col("own") == F.col("editors"), "only authors").when(F.col("own") > 0, "some authors").otherwise("no author")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("documents"))


def log2_bins(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Sums of weights in bins [2^k, 2^(k+1)), empty ones up to the largest included; values below 1 dropped."""
    bins = counts.filter(F.col(value) >= 1).groupBy((F.length(F.bin(F.col(value).cast("long"))) - 1).alias("bin")).agg(F.sum(weight).alias("n"))
    spine = bins.agg(F.max("bin").alias("most")).filter("most is not null").select(F.explode(F.sequence(F.lit(0), "most")).alias("bin"))
    return spine.join(bins, "bin", "left").select("bin", F.expr("shiftleft(1L, bin)").alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def cumulative(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Running sums over a short ordered list, such as years."""
    return counts.withColumn("running", F.sum(value).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))


def weighted_ecdf(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Share of the weight at or below each value of a histogram."""
    total = F.sum(weight).over(Window.partitionBy())
    return cumulative(counts, value, weight).select(value, (F.col("running") / total).alias("share"))


def densify(counts: DataFrame, value: str, n: str = "n", gap: int = 3) -> DataFrame:
    """A histogram without missing values; runs of at least ``gap`` zeros become one row with their length."""
    span = counts.agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low is not null")
    spine = span.select(F.explode(F.sequence("low", "high")).alias(value))
    full = spine.join(counts, value, "left").select(value, F.coalesce(n, F.lit(0)).alias(n))
    runs = full.withColumn("run", F.col(value) - F.row_number().over(Window.partitionBy(F.col(n) == 0).orderBy(value)))
    sized = runs.withColumn("size", F.when(F.col(n) == 0, F.count("*").over(Window.partitionBy(F.col(n) == 0, "run"))).otherwise(1))
    first = F.row_number().over(Window.partitionBy(F.col(n) == 0, "run").orderBy(value)) == 1
    shown = sized.withColumn("first", first).filter((F.col(n) > 0) | (F.col("size") < gap) | F.col("first"))
    return shown.select(value, n, F.when((F.col(n) == 0) & (F.col("size") >= gap), F.col("size")).otherwise(F.lit(0)).alias("skipped"))
