"""Composed results: concordance of centralities, consistency of relations, combinations of sources, runs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.operators import graph, ranking
from textloom.operators.agreement import reciprocal_facts


def merge_placeholders(payload: DataFrame, mergeable: bool, columns: list[str]) -> DataFrame:
    """A payload for a combination of sources; values that cannot be merged are null."""
    return payload if mergeable else payload.withColumns({c: F.lit(None).cast(payload.schema[c].dataType) for c in columns})


def top_scope(scores: DataFrame, n: int) -> DataFrame:
    """item: those in the top n of any method and metric (columns method, metric, item, score)."""
    return ranking.top_n(scores, ["method", "metric"], n).select("item").distinct()


def concordance(scores: DataFrame, across: str, within: str) -> DataFrame:
    """Kendall's W of the judges in column ``across`` for each ``within``, with the number of items and judges."""
    w = ranking.kendall_w(scores.withColumnRenamed(across, "judge"), [within])
    return w.join(scores.groupBy(within).agg(F.countDistinct("item").alias("items"), F.countDistinct(across).alias("judges")), within)


def pairwise_tau(scores: DataFrame) -> DataFrame:
    """metric, left, right and tau-b of each pair of methods."""
    left = scores.select("metric", "item", F.col("method").alias("left"), F.col("score").alias("x"))
    right = scores.select("metric", "item", F.col("method").alias("right"), F.col("score").alias("y"))
    return ranking.kendall_tau_b(left.join(right, ["metric", "item"]).filter(F.col("left") < F.col("right")), ["metric", "left", "right"])


def centrality_comparison(scores: DataFrame, n: int = 10) -> DataFrame:
    """scope (all, top), metric, w and items of the methods' concordance, over all items and over those in any top list."""
    scores = written(scores)
    inside = scores.join(top_scope(scores, n), "item", "left_semi")
    parts = [concordance(s, "method", "metric").withColumn("scope", F.lit(name)) for name, s in (("all", scores), ("top", inside))]
    return parts[0].unionByName(parts[1])


def relation_checks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """method, kind (dependency or supersession), self_relations and unresolved targets of distinct edges (method, source, target, rel; keys slug:id).

    A target is unresolved if its slug has nodes (column key) and it is none of them.
    """
    kind = F.when(F.col("rel") == "depends_on", "dependency").when(F.col("rel").isin("supersedes", "superseded_by"), "supersession")
    distinct = edges.select("method", kind.alias("kind"), "source", "target", "rel").filter("kind is not null").distinct()
    keys = nodes.select(F.col("key").alias("target"), F.lit(True).alias("known")).distinct()
    slugs = nodes.select(F.substring_index("key", ":", 1).alias("slug"), F.lit(True).alias("listed")).distinct()
    seen = distinct.join(keys, "target", "left").withColumn("slug", F.substring_index("target", ":", 1)).join(slugs, "slug", "left")
    return seen.groupBy("method", "kind").agg(F.count_if(F.col("source") == F.col("target")).alias("self_relations"), F.count_if(F.col("listed").isNotNull() & F.col("known").isNull()).alias("unresolved"))


def dependency_groups(edges: DataFrame) -> DataFrame:
    """method, edges, cyclic groups and the nodes in them, of depends_on edges; methods are few."""
    chosen = written(edges.filter("rel = 'depends_on'").select("method", "source", "target").distinct())
    keyed = chosen.select("method", F.struct("method", F.col("source").alias("node")).alias("source"), F.struct("method", F.col("target").alias("node")).alias("target"))
    # methods share no node, so their components do not mix
    groups = graph.strong_components(keyed.select("source", "target")).groupBy(F.col("node.method").alias("method")).agg(F.countDistinct("component").alias("cyclic_groups"), F.count("*").alias("involved"))
    return chosen.groupBy("method").agg(F.count("*").alias("edges")).join(groups, "method", "left").na.fill(0, ["cyclic_groups", "involved"])


def supersession_summary(edges: DataFrame) -> DataFrame:
    """method, facts, how many both sides declare, and their percentage to one place."""
    parts = edges.filter(F.col("rel").isin("supersedes", "superseded_by"))
    facts = reciprocal_facts(parts.select(F.struct("method", "source").alias("source"), F.struct("method", F.col("target").alias("source")).alias("target"), "rel"))
    counts = facts.groupBy(F.col("newer.method").alias("method")).agg(F.count("*").alias("facts"), F.count_if("reciprocal").alias("reciprocal"))
    return counts.withColumn("percentage", F.round(F.try_divide(100 * F.col("reciprocal"), F.col("facts")), 1))


def run_statistics(runs: DataFrame) -> DataFrame:
    """model, runs, documents, and those whose latest run failed (id, model, timestamp, status)."""
    latest = runs.groupBy("model", "id").agg(F.count("*").alias("runs"), F.max_by("status", "timestamp").alias("status"))
    return latest.groupBy("model").agg(F.sum("runs").alias("runs"), F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"))


def replaced_runs(stored: Column, new: Column, model: Column) -> Column:
    """New runs of a model in place of its stored ones; other models' runs stay, before them."""
    return F.concat(F.filter(stored, lambda r: r["model"] != model), new)


def review_counts(nodes: DataFrame, reviewed: DataFrame) -> DataFrame:
    """slug, nodes and reviewed ones (key slug:id)."""
    marked = nodes.select("key").distinct().join(reviewed.select("key", F.lit(1).alias("done")).distinct(), "key", "left")
    return marked.groupBy(F.substring_index("key", ":", 1).alias("slug")).agg(F.count("*").alias("nodes"), F.count("done").alias("reviewed"))


def edges_by_slugs(edges: DataFrame) -> DataFrame:
    """Edges between each two sources."""
    return edges.groupBy(F.substring_index("source", ":", 1).alias("from"), F.substring_index("target", ":", 1).alias("to")).agg(F.count("*").alias("edges"))


def prefilled_sample(sample: DataFrame, rows: DataFrame, key: str, strata: list[str]) -> DataFrame:
    """Rows already begun and, for sampled keys without one, pending rows, with status; then counts are by stratum."""
    begun = rows.withColumn("status", F.lit("begun"))
    pending = sample.join(rows.select(key), key, "left_anti").select(key, *strata).withColumn("status", F.lit("pending"))
    return begun.unionByName(pending, allowMissingColumns=True)


def latest_metadata(docs: DataFrame) -> DataFrame:
    """key, title, created and last_commit of documents in the newest snapshot of their source (slug, snapshot, id, title, created, last_commit)."""
    newest = docs.groupBy("slug").agg(F.max("snapshot").alias("snapshot"))
    return docs.join(F.broadcast(newest), ["slug", "snapshot"], "left_semi").select(F.concat_ws(":", "slug", "id").alias("key"), "title", "created", F.when(F.try_to_date("last_commit", "yyyy-MM-dd").isNotNull(), F.col("last_commit")).otherwise("").alias("last_commit"))


def backfilled(docs: DataFrame, commits: DataFrame) -> DataFrame:
    """docs (id, author, created) with absent authors from the committers of the first day and absent days from the oldest commit (id, day, name)."""
    first = commits.groupBy("id").agg(F.min("day").alias("_day"))
    names = commits.join(first, "id").filter("day = _day").groupBy("id", "_day").agg(F.array_join(F.sort_array(F.collect_set("name")), "\n").alias("_names"))
    full = docs.join(names, "id", "left")
    absent = lambda c: F.nullif(F.col(c), F.lit(""))
    return full.withColumns({"author": F.coalesce(absent("author"), "_names"), "created": F.coalesce(absent("created"), "_day")}).drop("_day", "_names")


def normal_events(events: DataFrame) -> DataFrame:
    """Status events with texts trimmed, days real or null, and absent members empty."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c)
    return events.select("id", *map(text, ("commit", "path", "author", "status", "standard")), F.try_to_date(F.substring(F.trim("date"), 1, 10), "yyyy-MM-dd").alias("date"))


def labelled_cases(facts: DataFrame, titles: DataFrame) -> DataFrame:
    """facts (newer, older) as texts ``key (title)``, the key alone where there is none (key, title)."""
    def named(side: str) -> DataFrame:
        return titles.select(F.col("key").alias(side), F.col("title").alias(f"_{side}"))

    full = facts.join(named("newer"), "newer", "left").join(named("older"), "older", "left")
    shown = lambda c: F.when(F.coalesce(F.col(f"_{c}"), F.lit("")) != "", F.format_string("%s (%s)", F.col(c), F.col(f"_{c}"))).otherwise(F.col(c).cast("string")).alias(c)
    return full.select(shown("newer"), shown("older"))


def ranked_positions(scores: DataFrame, n: int) -> DataFrame:
    """method, metric, item, score, position and competition rank of the n largest."""
    order = Window.partitionBy("method", "metric")
    top = ranking.top_n(scores, ["method", "metric"], n)
    return top.withColumn("rank", F.rank().over(order.orderBy(F.desc("score"))))
