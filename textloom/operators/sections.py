"""Whole payloads of authorship, classification and conformity as tables of sections.

A row is section, key, other (a second key, else null) and value (a number as double).  What
several sections need is written once; sections are unions of small counts beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.operators import authorship as au
from textloom.operators import classification as cl
from textloom.operators import conformity as co
from textloom.operators.components import connected_components


def _rows(table: DataFrame, section: str, key: Column | str, value: Column | str, other: Column | str | None = None) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return table.select(F.lit(section).alias("section"), text(key).alias("key"), (F.lit(None).cast("string") if other is None else text(other)).alias("other"), number.alias("value"))


def _members(row: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """Columns of a single row as rows."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.lit(None).cast("string").alias("other"), F.col(c).cast("double").alias("value")) for c in columns])))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _people(authored: DataFrame, top: int, names: tuple[str, str, str]) -> list[DataFrame]:
    """Top list, histogram of contributions, and authors by document (names: their sections)."""
    counts = written(au.author_counts(authored))
    text = F.col("author").cast("string")
    first = counts.orderBy(F.desc("documents"), F.lower(text), text).limit(top)
    per = authored.groupBy("id").agg(F.countDistinct("author").alias("authors"))
    return [_rows(first, names[0], "author", "documents"), _rows(au.histogram(counts, "documents"), names[1], "documents", "n"), _rows(au.histogram(per, "authors"), names[2], "authors", "n")]


def authorship_payload(docs: DataFrame, authored: DataFrame, contributed: DataFrame | None = None, top: int = 15, shared: int = 10) -> DataFrame:
    """The authorship payload of documents (id, year) and their authors (id, author); contributors (id, author) add their counts, never their network."""
    authored = written(authored.select("id", "author").distinct())
    edges = written(au.collaboration_edges(authored))
    degrees = written(au.degrees(edges))
    totals = docs.agg(F.countDistinct("id").alias("documents")).join(authored.agg(F.countDistinct("author").alias("authors")))  # one row each
    share = au.top_authors(authored, shared).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("by_top")).join(docs.agg(F.countDistinct("id").alias("documents")))
    share = share.withColumn("percentage", F.coalesce(F.round(F.try_divide(100.0 * F.col("by_top"), "documents"), 2), F.lit(0.0)))
    groups = connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    parts = [
        _members(totals, "meta", ["documents", "authors"]),
        *_people(authored, top, ("top_authors", "contribution_histogram", "authors_per_document")),
        _rows(docs.filter("year is not null").groupBy("year").agg(F.countDistinct("id").alias("n")), "documents_per_year", "year", "n"),
        _members(share, "top_share", ["documents", "by_top", "percentage"]),
        _rows(edges, "collaboration_network", "a", "weight", "b"),
        _rows(degrees, "collaboration_degrees", "author", "degree"),
        _rows(au.histogram(degrees, "degree"), "degree_distribution", "degree", "n"),
        _rows(groups.groupBy("size").agg(F.count("*").alias("n")), "cluster_sizes", "size", "n"),
    ]
    if contributed is not None:
        contributed = written(contributed.select("id", "author").distinct())
        parts += _people(contributed, top, ("top_contributors", "contributor_histogram", "contributors_per_document"))
        coverage = au.contributor_coverage(authored, contributed)
        parts.append(_members(coverage, "coverage", coverage.columns))
    return _all(parts)


def classification_payload(docs: DataFrame) -> DataFrame:
    """The classification payload of documents (id, year, status, type, layer)."""
    kept = written(docs.select("id", "year", "status", "type", "layer"))
    return _all(
        [
            _members(kept.agg(F.count("*").alias("nodes")), "meta", ["nodes"]),
            _rows(cl.sankey_links(kept, grouped=False), "sankey_full", "source", "count", "target"),
            _rows(cl.sankey_links(kept), "sankey_grouped", "source", "count", "target"),
            _rows(cl.count_over_time(kept, "status"), "status_over_time", "year", "count", "status"),
        ]
    )


def conformity_payload(checks: DataFrame) -> DataFrame:
    """The conformity payload of checked documents (id, check, category, standard, passed).

    A document's score is in per_document (overall without, of a standard with other); only
    standards with an evaluated check have a mean, and only evaluated checks a pass rate.
    """
    scores = written(co.document_scores(checks))
    summary = written(co.check_summary(checks))
    means = scores.filter("standard is not null and score is not null").groupBy("standard").agg(F.round(F.avg("score"), 2).alias("mean"))
    counts = [_rows(summary, f"check_{name}", "check", name, "standard") for name in ("passed", "failed", "skipped")]
    return _all(
        [
            _rows(means, "average_score_by_standard", "standard", "mean"),
            *counts,
            _rows(summary.filter("pass_rate is not null"), "check_pass_rate", "check", "pass_rate", "standard"),
            _rows(scores, "per_document", "id", "score", "standard"),
        ]
    )


def comparison_rates(pairs: DataFrame) -> DataFrame:
    """Pairwise agreement (approach_only, baseline_only, overlap) with each part's share of its side: null where the side has no edges."""
    own, other = F.col("approach_only") + F.col("overlap"), F.col("baseline_only") + F.col("overlap")
    return pairs.withColumns(
        {"approach_only_rate": F.try_divide("approach_only", own), "baseline_only_rate": F.try_divide("baseline_only", other), "shared_of_approach": F.try_divide("overlap", own), "shared_of_baseline": F.try_divide("overlap", other)}
    )


def run_record(runs: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """run_id, model, started, ended, documents, findings, failed and the settings that a run's results rest on, a row for each run (run_id, model, timestamp, id, status, findings: a number)."""
    settings = F.create_map(*[F.lit(x) for kv in sorted(pinned.items()) for x in kv]) if pinned else F.create_map().cast("map<string,string>")
    summed = runs.groupBy("run_id", "model").agg(
        F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.countDistinct("id").alias("documents"), F.sum(F.coalesce("findings", F.lit(0))).alias("findings"), F.count_if(F.col("status") != "success").alias("failed")
    )
    return summed.withColumn("settings", settings)
