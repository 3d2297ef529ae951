"""Combinations, timelines, digests and known ids on small tables."""

import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import combinations as co
from textloom.operators import digests as dg
from textloom.operators import evolution as ev
from textloom.operators import known_ids as ki
from textloom.operators import timelines as tl


def test_combined_payload_equals_filters(spark):
    rng = random.Random(1)
    nodes = [(f"n{i}", rng.choice("abc")) for i in range(30)] + [("odd", None)]
    edges = [(f"n{rng.randrange(32)}", f"n{rng.randrange(30)}", rng.choice("xy")) for _ in range(80)] * 2
    authored = [(rng.choice("abc"), f"p{rng.randrange(12)}") for _ in range(40)] + [(None, "p0")]
    got = co.combined_payload(spark.createDataFrame(nodes, "key string, source string"), spark.createDataFrame(edges, "source string, target string, method string"), spark.createDataFrame(authored, "source string, author string"))
    got = {(r.combination, r.section, r.name): (r.value, r.status) for r in got.collect()}
    home = {k: s for k, s in nodes if s}
    for n in (2, 3):
        for part in itertools.combinations("abc", n):
            name = "+".join(part)
            inside = {e for e in edges if home.get(e[0]) in part and home.get(e[1]) in part}
            want = {("dependencies", "nodes"): sum(s in part for s in home.values()), ("authorship", "authors"): len({p for s, p in authored if s in part}), ("dependencies", "edges between sources"): len({e for e in inside if home[e[0]] != home[e[1]]})}
            want |= {("dependencies", f"edges {m}"): sum(e[2] == m for e in inside) for m in "xy"}
            assert {k[1:]: v for k, v in got.items() if k[0] == name and v[1] == "merged"} == {k: (v, "merged") for k, v in want.items() if v}
            assert all(got[name, s, None] == (None, "not_mergeable") for s in co.NOT_MERGEABLE)
    assert co.masks(["b", "a"], 1) == [(1, "a"), (2, "b"), (3, "a+b")]
    with pytest.raises(ValueError, match="more than 12"):
        co.listed_sources(spark.range(20).selectExpr("cast(id as string) as source"))
    listed = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "2"), ("c", "3")], "source string, snapshot string")
    assert {tuple(r) for r in co.expected_targets(listed).collect()} == {("a+b", "1"), ("a+b", "2"), ("a+c", "2"), ("b+c", "2"), ("a+b+c", "2")}


FIRST = ev.Regime("old", None, date(2020, 2, 14))
SECOND = ev.Regime("new", date(2020, 2, 15), date(2020, 5, 1), {"Draft": "Idea"}, {"Final": "Done"})
PLAN = tl.Plan((FIRST, SECOND, ev.Regime("next", date(2020, 5, 2), None, {"Idea": "Idea"}, {"Idea": "Shelved", "Done": "Closed"})), (("a", date(2020, 1, 31)), ("b", date(2020, 2, 15)), ("c", date(2020, 5, 2)), ("d", date(2020, 6, 30))))
UNTIL = date(2020, 7, 1)
EVENTS = "entity string, date date, seq long, status string"


def some_events():
    rng = random.Random(7)
    rows = [(f"e{rng.randrange(9)}", date(2020, 1, 1) + timedelta(days=rng.choice([0, 30, 31, 45, 46, 100, 121, 122, 170, rng.randrange(180)])), n, rng.choice(["Draft", "Final", "Idea"])) for n in range(60)]
    return rows + [("alone", date(2020, 6, 30), 1, "Draft")]


def test_one_pass_equals_separate_operators(spark):
    events = spark.createDataFrame(some_events(), EVENTS)
    got = tl.walked(events, PLAN, UNTIL)
    full = ev.with_transitions(events, list(PLAN.regimes))
    want = {(r.entity, "transition" if r.synthetic else "event", r.date, r.seq, r.status) for r in full.collect()}
    assert {(r.entity, r.kind, r.date, r.seq, r.status) for r in got.filter("kind <> 'state'").collect()} == want
    spans = spark.createDataFrame(list(PLAN.periods), "key string, end date")
    states = ev.state_at_periods(full.drop("synthetic"), spans)
    assert {(r.entity, r.key, r.status) for r in got.filter("kind = 'state'").collect()} == {(r.entity, r.key, r.status) for r in states.collect()}
    assert any(r.standard == "next" for r in got.collect()) and tl.walked(events.limit(0), PLAN, UNTIL).count() == 0
    odd = spark.createDataFrame([(None, date(2020, 1, 1), 1, "x"), ("a", None, 1, "x"), ("b", date(2020, 1, 1), 1, None)], EVENTS)
    assert tl.walked(odd, PLAN, UNTIL).count() == 0
    payload = {tuple(r) for r in tl.evolution_payload(got, events.select("entity").distinct()).collect()}
    n = len({r[0] for r in some_events()})
    assert {("meta", None, None, "timelines", n), ("meta", None, None, "entities", n)} <= payload


def test_stream_equals_batch(spark, tmp_path):
    """Events in three files by date, then a clock row for each entity; and one late event."""
    rows = sorted(some_events(), key=lambda r: r[1])
    parts = [[r for r in rows if r[1] < date(2020, 2, 20)], [r for r in rows if date(2020, 2, 20) <= r[1] < date(2020, 5, 10)], [r for r in rows if r[1] >= date(2020, 5, 10)]]
    parts[2] += [(e, UNTIL, None, None) for e in sorted({r[0] for r in rows})] + [("alone", date(2020, 8, 1), 2, "Final")]
    parts.append([("alone", date(2020, 7, 15), 3, "Draft")])
    (tmp_path / "in").mkdir()
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = tl.walked_stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), PLAN)
        for part in parts:  # a micro-batch each
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset(provider)
    got = [tuple(r) for r in spark.read.schema(tl.WALKED).parquet(f"{tmp_path}/out").collect()]
    more = [("alone", "event", None, date(2020, 8, 1), 2, "Final", "next"), ("alone", "late", None, date(2020, 7, 15), 3, "Draft", "next")]
    want = [tuple(r) for r in tl.walked(spark.createDataFrame(some_events(), EVENTS), PLAN, UNTIL).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want + more))


def test_digests(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else 1.5) for i in range(200)] + [(1, "v1", None)] * 3 + [(None, None, None)]
    one = spark.createDataFrame(rows, "k int, v string, x double")
    same = spark.createDataFrame(rows[::-1], "k int, v string, x double").repartition(7).select("x", "k", "v")
    trees = dg.digest_tree(one, ["k"]), dg.digest_tree(same, ["k"])
    assert dg.differing_ranges(*trees).isEmpty() and not dg.is_stale(*trees) and dg.stale_rows(one, same, ["k"]).isEmpty()
    changed = spark.createDataFrame([(7, "other", None) if r[0] == 7 else r for r in rows[:-2]], "k int, v string, x double")
    other = dg.digest_tree(changed, ["k"])
    # one row changed, one of four repeats and the null row gone: three leaves of 4096 at most, and their ancestors
    apart = dg.differing_ranges(trees[0], other).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in apart}[3] == 3 and dg.is_stale(trees[0], other)
    assert {(r.k, r.v, r.side) for r in dg.stale_rows(one, changed, ["k"]).collect()} == {(7, "v0", "stored"), (7, "other", "computed"), (1, "v1", "stored"), (None, None, "stored")}
    nulls = [spark.createDataFrame([r], "a string, b string") for r in ((None, "x"), ("x", None))]
    assert dg.is_stale(*(dg.digest_tree(t, ["a"]) for t in nulls))
    assert not dg.is_stale(*(dg.digest_tree(one.limit(0), ["k"]) for _ in range(2)))


def test_known_ids(spark):
    rows = [("a", "1", "s1"), ("a", "70000", "s2"), ("a", "x7", "s1"), ("a", "1", "s2"), ("b", "007", "s1"), ("b", "2", "s1"), ("b", None, "s1"), ("b", "99999999999", "s1")]
    known = ki.merged(ki.known_ids(spark.createDataFrame(rows, "source string, id string, snapshot string"), ("source", "snapshot")))
    assert {tuple(r) for r in ki.counts(known).collect()} == {("a", 3), ("b", 3)}
    asked = spark.createDataFrame([(s, i) for s in ("a", "b", "c") for i in ("0", "1", "2", "7", "007", "x7", "70000", "99999999999", None)], "source string, id string")
    assert {tuple(r) for r in ki.only_known(asked, known).collect()} == {("a", "1"), ("a", "70000"), ("a", "x7"), ("b", "007"), ("b", "2"), ("b", "99999999999")}
    assert ki.only_known(asked, known, wanted=False).count() == 27 - 6
    every = spark.range(40_000).select(F.lit("z").alias("source"), "id")
    assert ki.counts(ki.known_ids(every)).collect()[0].ids == 40_000 and ki.only_known(every, ki.known_ids(every.filter("id % 3 = 0"))).filter("id % 3 > 0").isEmpty()
