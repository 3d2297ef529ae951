"""Iterated scores of many graphs against each graph on its own and plain loops."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import centrality as ce
from textloom.operators import graph as gr

GRAPHS = {
    "ring": [("a", "b"), ("b", "c"), ("c", "a")],
    "path": [("a", "b"), ("b", "c")],
    "pair": [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c")],
    "flip": [("a", "b"), ("b", "a")],
}


def tables(spark):
    edges = spark.createDataFrame([(g, s, t) for g, e in GRAPHS.items() for s, t in e], "graph string, source string, target string")
    nodes = spark.createDataFrame([(g, n) for g in [*GRAPHS, "bare"] for n in "abcd"], "graph string, node string")
    return edges, nodes


def plain_rank(edges, tolerance=1e-6, rounds=100):
    out = {n: [t for s, t in edges if s == n] for n in "abcd"}
    score = dict.fromkeys("abcd", 0.25)
    for k in range(1, rounds + 1):
        lost = sum(score[n] for n in out if not out[n])
        new = {n: 0.15 / 4 + 0.85 * (lost / 4 + sum(score[s] / len(out[s]) for s in out if n in out[s])) for n in "abcd"}
        change = sum(abs(new[n] - score[n]) for n in new)
        score = new
        if change < 4 * tolerance:
            return score, k, "converged"
    return score, rounds, "exhausted"


def test_ranks_of_all_graphs_equal_single_runs(spark):
    edges, nodes = tables(spark)
    found = ce.page_ranks(edges, nodes)
    got = {(r.graph, r.node): r.score for r in found.scores.collect()}
    how = {r.graph: (r.rounds, r.outcome) for r in found.outcomes.collect()}
    for g in [*GRAPHS, "bare"]:
        want, k, outcome = plain_rank(GRAPHS.get(g, []))
        assert {n: got[g, n] for n in "abcd"} == pytest.approx(want, abs=1e-12) and how[g] == (k, outcome)
    alone = gr.page_rank(edges.filter("graph = 'pair'"), nodes.filter("graph = 'pair'"))
    assert {r.node: r.score for r in alone.collect()} == pytest.approx({n: got["pair", n] for n in "abcd"})


def test_rounds_that_end_are_told(spark):
    edges, nodes = tables(spark)
    found = ce.page_ranks(edges, nodes, rounds=2)
    assert {r.graph: r.outcome for r in found.outcomes.collect()} == {g: plain_rank(GRAPHS.get(g, []), rounds=2)[2] for g in [*GRAPHS, "bare"]}
    assert found.scores.count() == 20


def test_eigenvectors_vanish_fail_and_converge(spark):
    edges, nodes = tables(spark)
    edges = edges.unionByName(spark.createDataFrame([("flip", "a", "c"), ("flip", "c", "a")], edges.schema))
    found = ce.eigenvectors(edges, nodes, rounds=9, zero_on_failure=True)
    how = {r.graph: (r.outcome, r.rounds) for r in found.outcomes.collect()}
    # a path's scores run out after two rounds; equal scores of a ring's nodes settle; the middle of a star swaps with its ends for ever
    assert how["path"] == ("vanished", 3) and how["bare"] == ("vanished", 1) and how["ring"][0] == "converged" and how["flip"] == ("exhausted", 9)
    score = {(r.graph, r.node): r.score for r in found.scores.collect()}
    assert {score["path", n] for n in "abcd"} == {score["flip", n] for n in "abcd"} == {0.0}
    assert score["ring", "a"] == pytest.approx(3**-0.5, abs=1e-5)
    last = ce.eigenvectors(edges, nodes, rounds=9).scores.filter("graph = 'flip'")
    assert last.agg(F.sum(F.col("score") * F.col("score"))).first()[0] == pytest.approx(1)
    shifted = ce.eigenvectors(gr.both_ways(edges.filter("graph = 'flip'")).withColumn("graph", F.lit("flip")), nodes, shifted=True).outcomes
    assert shifted.filter("graph = 'flip'").first().outcome == "converged"


def test_no_graphs(spark):
    edges, nodes = tables(spark)
    found = ce.page_ranks(edges.limit(0), nodes.limit(0))
    assert found.scores.count() == 0 and found.outcomes.count() == 0
    assert gr.eigenvector(edges.limit(0).drop("graph"), nodes.limit(0).drop("graph")).count() == 0


def test_methods_types_and_models(spark):
    rows = [("a", "b", "text", "cites", None), ("a", "b", "text", "needs", None), ("b", "c", "llm", "cites", "m1"), ("c", "a", "llm", "cites", "m2"), (None, "a", "text", "x", None)]
    edges = spark.createDataFrame(rows, "source string, target string, method string, rel string, model string")
    got = {(r.graph, r.source, r.target) for r in ce.method_graphs(edges, "method", "llm", published="m2").collect()}
    assert got == {("text", "a", "b"), ("text/cites", "a", "b"), ("text/needs", "a", "b"), ("llm", "c", "a"), ("llm@m1", "b", "c"), ("llm@m2", "c", "a")}
    full = ce.dependency_metrics(ce.method_graphs(edges, "method", "llm"), spark.createDataFrame([(x,) for x in "abcd"], "node string"), rounds=4)
    rows = {(r.graph, r.node): r for r in full.collect()}
    assert len(rows) == 6 * 4 and rows["llm", "a"].in_degree == 1 and rows["llm", "d"].in_degree_rank == 3 and rows["text", "b"].pagerank_rank == 1
    assert ce.summaries(full).filter("graph = 'llm'").first()[1:4] == (4, 2, 1)


def test_grid_of_nodes_in_one_file(spark):
    from textloom.operators import ranking

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = spark.range(0, 4000, 1, 1).selectExpr("concat('n', id) as node")
        graphs = spark.createDataFrame([("a",), ("b",), ("c",)], "graph string").repartition(1)
        grid = ranking.in_every_group(nodes, graphs, "node")
        sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 12000 and max(sizes) < 6000 and grid.distinct().count() == 12000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_move_numbers_and_no_round_deals_nodes_by_graph(spark, monkeypatch):
    import contextlib
    import io

    edges, nodes = tables(spark)
    rounds, write = [], ce.written

    def kept(df):
        if {"raw", "change"} & set(df.columns) and "outcome" not in df.columns:
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                df.explain()
            rounds.append((df.columns, out.getvalue()))
        return write(df)

    monkeypatch.setattr(ce, "written", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        ce.eigenvectors(edges, nodes, rounds=3)
        ce.page_ranks(edges, nodes, rounds=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rounds) == 6
    for columns, plan in rounds:
        assert "node" not in columns and "source#" not in plan
        assert "SortMergeJoin [graph" not in plan and "Exchange hashpartitioning(graph" not in plan


def test_ends_outside_the_nodes_and_weights(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "a", "x", 3.0), ("g", "y", "a", 2.0), ("h", "a", "b", 5.0), ("h", "b", "a", 5.0)], "graph string, source string, target string, w double")
    nodes = spark.createDataFrame([(g, n) for g in "gh" for n in "ab"], "graph string, node string")
    got = {(r.graph, r.node): r.score for r in ce.page_ranks(edges, nodes, weight="w", rounds=1).scores.collect()}
    # a's rank goes to b by a quarter, b's is spread, y gives nothing
    assert got == pytest.approx({("g", "a"): 0.075 + 0.85 * 0.25, ("g", "b"): 0.075 + 0.85 * (0.25 + 0.125), ("h", "a"): 0.5, ("h", "b"): 0.5})
