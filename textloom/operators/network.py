"""Builds the network of documents: nodes and the edges of all methods, from read documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ["source", "target", "extraction_method", "relation_type", "value"]


def field(name: str) -> Column:
    """A header field as text."""
    return F.expr(f"try_variant_get(raw.preamble['{name}'], '$', 'string')")


def fields(name: str) -> Column:
    """A list-valued header field; a single text is a list of one."""
    return F.coalesce(F.expr(f"try_variant_get(raw.preamble['{name}'], '$', 'array<string>')"), F.when(field(name).isNotNull(), F.array(field(name))))


def graph_key(slug: str, value: Column) -> Column:
    return F.concat_ws(":", F.lit(slug), value)


def build_nodes(docs: DataFrame, slug: str, dimensions: tuple[str, ...] = ("layer", "status", "type")) -> DataFrame:
    """One node for each id, the first file's by name."""
    row = F.struct(
        F.col("file"), field("title").alias("title"), F.col("insights.formal_compliance.score").alias("compliance_score"), field("created").alias("created"),
        fields("author").alias("author"), *[field(d).alias(d) for d in dimensions],
    )
    best = docs.filter("id is not null").groupBy("id").agg(F.min_by(row, "file").alias("n"))
    return best.select(F.col("id"), graph_key(slug, F.col("id")).alias("graph_key"), F.col("n.title"), "n.compliance_score", "n.created", "n.author", *[f"n.{d}" for d in dimensions])


def latest_llm_run(runs: Column) -> Column:
    """The newest run; a failed newest run hides older successes, as its findings are empty."""
    newest = F.element_at(F.array_sort(F.filter(runs, lambda r: r["timestamp"].isNotNull()), lambda a, b: F.when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1).otherwise(0)), -1)
    return F.when(F.size(runs) > 0, newest)


def build_edges(docs: DataFrame, slug: str) -> DataFrame:
    """Edges found by header fields, by pattern and by language model, from every document."""
    found = docs.select(graph_key(slug, F.col("id")).alias("source"), F.col("insights.interrelations").alias("r"))
    one = F.lit(1).cast("long")
    header = found.select("source", F.inline("r.preamble_extracted")).select("source", "target", F.lit("preamble_extracted").alias("extraction_method"), F.col("type").alias("relation_type"), one.alias("value"))
    pattern = found.select("source", F.inline("r.body_extracted_regex")).select("source", "target", F.lit("body_extracted_regex").alias("extraction_method"), F.lit("reference").alias("relation_type"), F.col("count").alias("value"))
    run = found.select("source", F.explode_outer(F.array(F.when(F.size("r.body_extracted_llm") > 0, latest_llm_run(F.col("r.body_extracted_llm"))))).alias("run")).filter("run is not null")
    model = run.select("source", F.inline("run.findings")).select("source", "target", F.lit("body_extracted_llm").alias("extraction_method"), F.coalesce("type", F.lit("references")).alias("relation_type"), one.alias("value"))
    edges = header.unionByName(pattern).unionByName(model)
    return edges.filter("target is not null").withColumn("target", F.when(F.col("target").contains(":"), F.col("target")).otherwise(graph_key(slug, F.col("target")))).filter("source <> target")


def first_day_authors(history: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """id and author: distinct committers of each document's earliest day (id, day, author_name)."""
    people = history.filter(F.col("day").isNotNull() & ~F.col("author_name").isin(list(bots)))
    first = people.groupBy("id").agg(F.min("day").alias("day"))
    return people.join(first, ["id", "day"]).select("id", F.col("author_name").alias("author")).distinct()


def contributors(history: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """id, author and since: everyone who changed the document, and when first."""
    people = history.filter(~F.col("author_name").isin(list(bots)))
    return people.groupBy("id", F.col("author_name").alias("author")).agg(F.min("day").alias("since"))
