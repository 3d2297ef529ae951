"""Iterated scores of many graphs at once: PageRank and eigenvector scores, with what became of each graph.

edges have graph, source and target, nodes have graph and node.  One plan runs a round of all
graphs; sums are taken by graph, so no graph's numbers reach another.  A graph that has
converged or failed is taken out of the iteration with the scores that it has then, and the
others go on; its outcome is a row of data, not a message.  Only the number of graphs that
finish in a round reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import forget, written


@dataclass(frozen=True)
class Iterated:
    """scores: graph, node, score.  outcomes: graph, nodes, rounds, change (the last one) and outcome: converged, exhausted (rounds ended), vanished (all scores became 0)."""

    scores: DataFrame
    outcomes: DataFrame


def page_ranks(edges: DataFrame, nodes: DataFrame, node: str = "node", weight: str | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, scaled: bool = True) -> Iterated:
    """PageRank of each graph, dangling weight spread evenly; converged when absolute changes add up to less than the tolerance (times the graph's nodes if scaled)."""
    w = F.col(weight) if weight else F.lit(1)
    out = edges.groupBy("graph", "source").agg(F.sum(w).alias("total"))
    # the share of its source's rank that each edge carries, computed once
    shares = edges.join(out, ["graph", "source"]).select("graph", "source", "target", (w / F.col("total")).alias("w"))
    names, links = _numbered(shares, nodes, node)
    dangling = out.select("graph", F.col("source").alias("node"), F.lit(False).alias("dangling"))
    start = names.join(dangling, ["graph", "node"], "left").select("graph", "id", "nodes", F.coalesce("dangling", F.lit(True)).alias("dangling"), (1.0 / F.col("nodes")).alias("score"))

    def step(state: DataFrame) -> DataFrame:
        lost = written(state.groupBy("graph").agg(F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost")))
        new = damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("nodes")) + (1 - damping) / F.col("nodes")
        return state.hint("merge").join(_flows(state, links), "id", "left").join(lost, "graph").select("graph", "id", "nodes", "dangling", new.alias("score"), F.abs(new - F.col("score")).alias("change"))

    limit = tolerance * (F.col("nodes") if scaled else 1)
    return _iterate(start, names, step, lambda moved: moved.withColumn("norm", F.lit(1.0)), limit, rounds, node, False)


def eigenvectors(edges: DataFrame, nodes: DataFrame, node: str = "node", weight: str | None = None, shifted: bool = False, rounds: int = 1000, tolerance: float = 1e-6, zero_on_failure: bool = False) -> Iterated:
    """Power iteration of each graph over incoming edges, from equal scores, scaled to length 1.

    Shifted adds each node's own score.  Zeros where the length becomes 0 and, if asked for,
    where the rounds end before convergence.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names, links = _numbered(edges.select("graph", "source", "target", w.alias("w")), nodes, node)
    start = names.select("graph", "id", "nodes", (1.0 / F.sqrt("nodes")).alias("score"))

    def step(state: DataFrame) -> DataFrame:
        raw = F.coalesce("flow", F.lit(0.0)) + (F.col("score") if shifted else F.lit(0.0))
        return state.hint("merge").join(_flows(state, links), "id", "left").select("graph", "id", "nodes", raw.alias("raw"), F.col("score").alias("old"))

    def scaled_to_one(moved: DataFrame) -> DataFrame:
        norms = written(moved.groupBy("graph").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")))
        new = F.coalesce(F.try_divide("raw", "norm"), F.lit(0.0))
        return moved.join(norms, "graph").select("graph", "id", "nodes", "norm", new.alias("score"), F.abs(new - F.col("old")).alias("change"))

    return _iterate(start, names, step, scaled_to_one, tolerance * F.col("nodes"), rounds, node, zero_on_failure)


def _numbered(edges: DataFrame, nodes: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """graph, node, id and nodes (of the graph) of each node, and links: from (an id) and its edges as an array of id and w.

    Rounds move numbers and lists instead of names and edges.  Few-row tables by graph are
    written, so that their size is known and no join deals nodes by graph.  A source whose
    edges Spark splits to several tasks has a list for each.
    """
    every = written(nodes.select("graph", F.col(node).alias("node")).distinct())
    sizes = written(every.groupBy("graph").agg(F.count("*").alias("nodes")))
    names = written(every.join(sizes, "graph").withColumn("id", F.monotonically_increasing_id()))
    forget(every)
    target = names.select("graph", F.col("node").alias("target"), "id")
    source = names.select("graph", F.col("node").alias("source"), F.col("id").alias("from"))
    ends = edges.join(target.hint("merge"), ["graph", "target"]).join(source.hint("merge"), ["graph", "source"])
    pieces = ends.select("from", F.spark_partition_id().alias("piece"), F.struct("id", "w").alias("link"))
    return names, written(pieces.groupBy("from", "piece").agg(F.collect_list("link").alias("links")).drop("piece"))


def _flows(state: DataFrame, links: DataFrame) -> DataFrame:
    """id and flow: the scores that reach each node over its edges.

    Files of lists and of equal scores are small for their rows, so Spark is told not to broadcast them.
    """
    sent = links.hint("merge").join(state.select(F.col("id").alias("from"), "score"), "from").select("score", F.inline("links"))
    return sent.groupBy("id").agg(F.sum(F.col("score") * F.col("w")).alias("flow"))


def _iterate(start: DataFrame, names: DataFrame, step, scaled, limit: Column, rounds: int, node: str, zero_on_failure: bool) -> Iterated:
    """Rounds of ``step`` until every graph is finished or no round is left: a round is one table, removed by the next, and one count.

    scaled: a round's table with score, change and norm.
    """
    table = state = written(start)
    finished, ended = [], []
    columns = state.columns
    vanished, near = ~(F.col("norm") > 0), F.col("change") < limit
    for k in range(1, rounds + 1):
        moved = written(step(state))
        scores = scaled(moved)
        outcome = F.when(vanished, "vanished").when(near, "converged").when(F.lit(k == rounds), "exhausted")
        by_graph = scores.groupBy("graph").agg(F.first("nodes").alias("nodes"), F.sum("change").alias("change"), F.first("norm").alias("norm"))
        report = by_graph.select("graph", "nodes", F.lit(k).alias("rounds"), "change", outcome.alias("outcome"))
        graphs, done = report.agg(F.count("*"), F.count("outcome")).first()
        forget(table)
        table, state = moved, scores.select(*columns)
        if done:
            over = written(report.filter("outcome is not null"))
            ended.append(over)
            zero = (F.col("outcome") == "exhausted") & F.lit(zero_on_failure)
            finished.append(written(state.join(over.select("graph", "outcome"), "graph").select("id", F.when(zero, 0.0).otherwise(F.col("score")).alias("score"))))
            if done < graphs:
                table = state = written(state.join(over.select("graph"), "graph", "left_anti"))
            forget(moved)
        if done == graphs:
            break
    if not ended:  # no round, or no graph
        finished = [state.select("id", "score")]
        ended = [state.select("graph", "nodes", F.lit(0).alias("rounds"), F.lit(0.0).alias("change"), F.lit("exhausted").alias("outcome")).distinct()]
    scores, outcomes = finished[0], ended[0]
    for part, more in zip(finished[1:], ended[1:]):
        scores, outcomes = scores.unionByName(part), outcomes.unionByName(more)
    return Iterated(scores.hint("merge").join(names, "id").select("graph", F.col("node").alias(node), "score"), outcomes)


def degrees(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """graph, node, in_degree and out_degree of all nodes of all graphs; repeated edges count once."""
    ends = edges.select("graph", "source", "target").distinct()
    ends = ends.select("graph", F.inline(F.array(F.struct(F.col("source").alias(node), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("target").alias(node), F.lit(0).alias("out"), F.lit(1).alias("in")))))
    sums = ends.groupBy("graph", node).agg(F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"))
    return nodes.select("graph", node).distinct().join(sums, ["graph", node], "left").na.fill(0, ["in_degree", "out_degree"])


def summaries(scores: DataFrame) -> DataFrame:
    """graph, nodes, edges, isolated nodes and density (0 for a single node), from degrees."""
    counts = scores.groupBy("graph").agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"))
    return counts.withColumn("density", F.coalesce(F.try_divide("edges", F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))


def method_graphs(edges: DataFrame, own: str, model_method: str, model: str = "model", published: str | None = None) -> DataFrame:
    """Edges by graph: each method on its own, a method's relation types within it, and each model in the place of the model method.

    edges: source, target, ``own`` (the method), rel, and the model for the model method's edges.
    The graph ``method`` holds a method's edges (the published model's only, where one is named),
    ``method/rel`` one relation type, ``method@model`` the edges of one model.
    """
    shown = (F.col(own) != model_method) | (F.lit(True) if published is None else F.col(model) == published)
    kinds = F.array_compact(
        F.array(
            F.when(shown, F.col(own)),
            F.when(shown & F.col("rel").isNotNull() & (F.col(own) != model_method), F.concat_ws("/", own, "rel")),
            F.when((F.col(own) == model_method) & F.col(model).isNotNull(), F.concat_ws("@", own, model)),
        )
    )
    return edges.select(F.explode(kinds).alias("graph"), "source", "target").filter("source is not null and target is not null").distinct()


def dependency_metrics(edges: DataFrame, nodes: DataFrame, node: str = "node", rounds: int = 1000) -> DataFrame:
    """graph, node, in_degree, out_degree, pagerank, weighted_eigenvector, and the competition rank of each, of all graphs in one plan.

    Every graph has all nodes (column node, without graph).
    """
    from textloom.operators import ranking

    edges = written(edges)
    graphs = edges.select("graph").distinct()
    # graphs are methods and models: a row for each of their nodes is what is returned
    grid = written(ranking.in_every_group(nodes.select(node).distinct(), graphs, node))
    ranked = page_ranks(edges, grid, node).scores.withColumnRenamed("score", "pagerank")
    valued = eigenvectors(edges, grid, node, rounds=rounds).scores.withColumnRenamed("score", "weighted_eigenvector")
    full = written(degrees(edges, grid, node).join(ranked, ["graph", node]).join(valued, ["graph", node]))
    for field in ("in_degree", "out_degree", "pagerank", "weighted_eigenvector"):
        full = ranking.competition_rank(full, ["graph"], field).withColumnRenamed("rank", f"{field}_rank")
    return full
