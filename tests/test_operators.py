"""Operators on tiny tables with results worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from textloom.operators import agreement as ag
from textloom.operators import authorship as au
from textloom.operators import classification as cl
from textloom.operators import conformity as co
from textloom.operators import evolution as ev
from textloom.operators import graph as gr
from textloom.operators import ranking as rk
from textloom.operators import references as rf
from textloom.operators import review as rv
from textloom.operators import text as tx
from textloom.operators import views as vw
from textloom.operators.components import connected_components


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_kappa(spark):
    nodes = nodes_of(spark, "abcd")
    found = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "b", "y"), ("c", "d", "y")], "source string, target string, method string")
    got = {(r.approach, r.baseline): r for r in ag.pairwise_agreement(found, nodes).collect()}
    assert got["x", "y"].kappa == pytest.approx(0.4) and got["x", "x"].kappa == pytest.approx(1.0)
    assert (got["x", "y"].overlap, got["x", "y"].approach_only, got["x", "y"].baseline_only, got["x", "y"].union) == (1, 1, 1, 3)


def test_concordance(spark):
    def w(*judges):
        data = [("g", j, i, s) for j, scores in enumerate(judges) for i, s in enumerate(scores)]
        return rk.kendall_w(spark.createDataFrame(data, "g string, judge int, item int, score int"), ["g"]).first().w

    assert w([4, 3, 2, 1], [40, 30, 20, 10]) == 1.0
    assert w([4, 3, 2, 1], [1, 2, 3, 4]) == 0.0
    assert w([2, 2, 1], [8, 8, 3]) == 1.0
    assert w([1, 1, 1], [2, 2, 2]) is None

    def tau(x, y):
        return rk.kendall_tau_b(spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(zip(x, y))], "g string, item int, x int, y int"), ["g"]).first().tau

    assert tau([4, 3, 2, 1], [40, 30, 20, 10]) == pytest.approx(1.0) and tau([4, 3, 2, 1], [1, 2, 3, 4]) == pytest.approx(-1.0)
    assert tau([2, 2, 1], [8, 8, 3]) == pytest.approx(1.0) and tau([1, 1, 1], [1, 2, 3]) is None


def test_concordance_beyond_longs(spark):
    # cubes of 2.2 million are beyond a long, as are the cubes of ties
    scores = spark.range(2_200_000).selectExpr("'g' as g", "explode(array(0, 1)) as judge", "id as item", "int(id % 2000000 = 0) as score")
    assert rk.kendall_w(scores, ["g"]).first().w == pytest.approx(1.0)


def test_ranks(spark):
    scores = spark.createDataFrame([("in", "a", 2), ("in", "b", 0), ("in", "c", 0), ("out", "a", 1), ("out", "b", 1), ("out", "c", 0)], "m string, item string, score int")
    assert rows(rk.competition_rank(scores, ["m"]), "m", "item", "rank") == [("in", "a", 1), ("in", "b", 2), ("in", "c", 2), ("out", "a", 1), ("out", "b", 1), ("out", "c", 3)]
    assert rows(rk.average_rank(scores.filter("m = 'in'"), ["m"]), "item", "average_rank") == [("a", 1.0), ("b", 2.5), ("c", 2.5)]


def test_graph_measures(spark):
    ring = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("x", "x"))
    nodes = nodes_of(spark, "abcdxyz")
    assert rows(gr.strong_components(ring)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert rows(gr.simple_cycles(ring, 4), "length", "cycles") == [(2, 0), (3, 1), (4, 0)]
    assert gr.depth(ring, nodes).first().depth == 1
    assert rows(connected_components(gr.simple_edges(ring), "source", "target")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    star = gr.both_ways(edges_of(spark, ("h", "a"), ("h", "b"), ("h", "c")))
    hub = nodes_of(spark, "habc")
    assert dict(rows(gr.betweenness(star, hub))) == {"h": 1.0, "a": 0.0, "b": 0.0, "c": 0.0}
    close = dict(rows(gr.closeness(gr.shortest_paths(star, hub), hub)))
    assert close["h"] == pytest.approx(1.0) and close["a"] == pytest.approx(3 / 5)
    line = dict(rows(gr.eigenvector(star, hub, shifted=True)))
    assert line["h"] == pytest.approx(2**-0.5, abs=1e-4) and line["a"] == pytest.approx(6**-0.5, abs=1e-4)
    assert set(dict(rows(gr.eigenvector(edges_of(spark, ("a", "b")), nodes_of(spark, "ab")))).values()) == {0.0}
    rank = dict(rows(gr.page_rank(edges_of(spark, ("a", "b"), ("b", "a"), ("c", "a")), nodes_of(spark, "abcd"))))
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] > rank["b"] > rank["c"] == pytest.approx(rank["d"])


def test_transitions_and_periods(spark):
    first = ev.Regime("old", None, date(2020, 2, 14))
    second = ev.Regime("new", date(2020, 2, 15), None, {}, {"Draft": "Open"})
    events = spark.createDataFrame([("p", date(2020, 1, 5), 1, "Draft"), ("q", date(2020, 1, 5), 1, "Draft"), ("q", date(2020, 2, 15), 2, "Final"), ("r", date(2020, 3, 1), 1, "Draft")], "entity string, date date, seq long, status string")
    full = ev.with_transitions(events, [first, second])
    assert rows(full.filter("synthetic"), "entity", "date", "status") == [("p", date(2020, 2, 15), "Open")]
    spans = ev.periods(spark, date(2020, 1, 1), date(2020, 6, 30), [date(2020, 2, 15), date(2020, 4, 1)])
    assert rows(spans, "key", "start", "end") == [
        ("2020-Q1a", date(2020, 1, 1), date(2020, 2, 14)),
        ("2020-Q1b", date(2020, 2, 15), date(2020, 3, 31)),
        ("2020-Q2", date(2020, 4, 1), date(2020, 6, 30)),
    ]
    series = ev.series(ev.state_at_periods(full, spans), spans, ["status"])
    assert {(k, s): n for k, s, n in rows(series, "key", "status", "n")} == {
        ("2020-Q1a", "Draft"): 2, ("2020-Q1a", "Open"): 0, ("2020-Q1a", "Final"): 0, ("2020-Q1b", "Draft"): 1, ("2020-Q1b", "Open"): 1, ("2020-Q1b", "Final"): 1,
        ("2020-Q2", "Draft"): 1, ("2020-Q2", "Open"): 1, ("2020-Q2", "Final"): 1,
    }


def test_texts(spark):
    docs = spark.createDataFrame([(1, "BIPs 33/99, BIP-0053/2-x.pdf and BIP 32, 39 and 44; bip#7")], "id int, text string")
    assert [t for _, _, t, _ in rows(rf.find_references(docs, [rf.Source("bips", "BIP")]).orderBy(F.col("target").cast("int")))] == sorted(["33", "99", "53", "32", "39", "44", "7"])
    one = spark.createDataFrame([("5a", "0007", "Mon Mar 3 10:00:00 2014 +0100", "2020-1-5", "ABCDEFGHIJK")], "hex string, dec string, git string, day string, title string")
    got = one.select(tx.reference_id(F.col("hex"), 255, True), tx.reference_id(F.col("dec"), 5), tx.git_day(F.col("git")), ev.strict_day(F.col("day")), tx.short_title(F.col("title"))).first()
    assert tuple(got) == ("5A", None, "2014-03-03", date(2020, 1, 5), "ABCDEFG")


def test_scores_and_authors(spark):
    docs = spark.createDataFrame([("a", "x", None), ("b", "", "2020-02-30")], "id string, title string, day string")
    checks = co.assess(docs, [co.Rule("title", "s", co.required(F.col("title"))), co.Rule("day", "s", co.valid_day(F.col("day")))])
    assert rows(co.document_scores(checks).filter("standard is not null"), "id", "passed", "failed", "skipped", "score") == [("a", 1, 0, 1, 100.0), ("b", 0, 2, 0, 0.0)]
    authored = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "C")], "id int, author string")
    people = spark.createDataFrame([(1, "A"), (2, "D"), (3, "E")], "id int, author string")
    assert tuple(au.contributor_coverage(authored, people).first()) == (3, 3, 1, 2, 3, 2)
    assert rows(au.collaboration_edges(authored)) == [("A", "B", 1)]
    assert rows(cl.sankey_links(spark.createDataFrame([("x", "s", None)], "layer string, status string, type string"))) == [("s", "Unknown", 1), ("x", "s", 1)]


def test_timeline_fills_gaps(spark):
    docs = spark.createDataFrame([(2001, "a"), (2001, "a"), (2003, "a"), (2003, "b"), (None, "b")], "year int, layer string")
    assert rows(cl.facet_timeline(docs, "layer")) == [(2001, "a", 2), (2001, "b", 0), (2002, "a", 0), (2002, "b", 0), (2003, "a", 1), (2003, "b", 1)]


def test_files_of_long_ids(spark):
    wanted = spark.createDataFrame([("12345",), ("7",), ("5A",)], "id string")
    files = spark.createDataFrame([("1234.md",), ("12345.md",), ("12345.mediawiki",), ("0007.rst",), ("7.md",), ("5a.md",)], "file string")
    assert rows(vw.located_files(wanted, files, ["mediawiki", "md", "rst"])) == [("12345", "12345.mediawiki"), ("5A", "5a.md"), ("7", "0007.rst")]


def test_sampling_and_ranges(spark):
    docs = spark.createDataFrame([(i, date(2020, 1, 1 + i)) for i in range(7)] + [(9, None)], "id int, created date")
    assert [b for _, b in rows(rv.era_buckets(docs, 3).filter("created is not null"), "id", "bucket")] == [0, 0, 0, 1, 1, 2, 2]
    assert rv.parse_focus("1-3, 85,a0") == [(1, 3, None), (None, None, "85"), (None, None, "a0"), (None, None, "A0")]
    ranges = spark.createDataFrame([("s", 1, 3), ("s", 4, 5), ("s", 9, 9)], "k string, low int, high int")
    assert rows(rv.merged_ranges(ranges, ["k"]), "low", "high") == [(1, 5), (9, 9)]
    drawn = rv.stratified_sample(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, s string"), ["s"], 5, 1)
    assert rows(drawn.groupBy("s").count()) == [("a", 3), ("b", 2)]
