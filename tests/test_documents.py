"""Standards, other headers, references and identities on small documents."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import conformity as c
from textloom.operators import graph, ranking
from textloom.operators import parsers as p
from textloom.operators import payloads as y
from textloom.operators import references as r
from textloom.operators import standards as s
from textloom.operators import text as t
from textloom.operators import validation as v

GOOD = """﻿BIP: 7
Title: Short
Authors: A B <a@b>
  C D <c@d>
Status: Complete
Type: Specification
Assigned: 2024-02-29
License: MIT
Discussion: 2024-01-01: http://x
Version: 1.10.0
Requires: 1, 2

==Abstract==
a
== Motivation ==
b
==Specification==
c
==Change  Log==
1.9.0, then 1.10.0
==Copyright==
d
"""


def checks(spark, text):
    docs = spark.createDataFrame([(1, text)], "id long, text string").select("id", *s.parsed_columns(F.col("text")))
    return {row.check.split(".", 1)[1]: row.passed for row in c.assess(docs, s.new_standard(s.parsed())).collect()}


def test_new_standard_passes_a_sound_document(spark):
    got = checks(spark, GOOD)
    assert len(got) == 29
    assert {k for k, passed in got.items() if passed is None} == {"header_value.deputies", "header_value.replaces", "header_value.proposed_replacement"}
    assert all(passed for passed in got.values() if passed is not None)


@pytest.mark.parametrize(
    "old, new, failed",
    [
        ("Title: Short", "Title: " + "x" * 51, {"header_value.title"}),
        ("Status: Complete", "Status: Done", {"header_value.status"}),
        ("2024-02-29", "2024-02-30", {"header_value.assigned"}),
        ("1.10.0\nReq", "1.9.0\nReq", {"changelog.version_matches"}),
        ("Version: 1.10.0\n", "", {"changelog.version_header"}),
        ("==Change  Log==", "", {"changelog.changelog_section", "changelog.version_matches"}),
        ("==Specification==\n", "", {"type_specific.specification_section"}),
        ("BIP: 7\nTitle: Short", "Title: Short\nBIP: 07", {"header_order", "header_value.bip"}),
        ("Requires: 1, 2", "Requires: 1,2", {"header_value.requires"}),
        ("License: MIT\n", "License:\n", {"required_header.license", "header_value.license"}),
        ("  C D <c@d>", "  C D", {"header_value.authors"}),
    ],
)
def test_each_fault_fails_its_check(spark, old, new, failed):
    assert old in GOOD
    assert {k for k, passed in checks(spark, GOOD.replace(old, new)).items() if passed is False} == failed


@pytest.mark.parametrize("log, latest", [("1.2.9, then 1.2.10", "1.2.10"), ("2.0.12 of 2.0.9", "2.0.12"), ("1.2.34x and v1.9.9, 1.0.1", "1.0.1"), ("99999999999.0.1", "99999999999.0.1"), ("1.2.3.4", "1.2.3"), ("none", None), ("", None)])
def test_latest_version(spark, log, latest):
    assert spark.range(1).select(c.latest_version(F.lit(log))).first()[0] == latest


def test_headings(spark):
    lines = {"== A ==": (2, "a"), "===  B  c ===  ": (3, "b c"), "=== D ==": (2, "d"), "= E =": (0, ""), "========G========": (6, "g"), "======": (0, ""), "text == x ==": (0, ""), "==H== z": (0, ""), "": (0, "")}
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", t.heading_level(F.col("line")), t.heading_name(F.col("line"))).collect()
    for line, level, name in got:
        assert level == lines[line][0] and (not level or name == lines[line][1]), line
    text = "x\n== A ==\none\n\ntwo\n=== B ===\n== A ==\n"
    entries = spark.range(1).select(s.section_entries(F.lit(text)).alias("e")).first().e
    assert [tuple(e) for e in entries] == [("a", 2, "one\n\ntwo"), ("b", 3, ""), ("a", 2, "")]


def test_contacts(spark):
    lines = {"A B <a@b>": True, "A <x> <a@b>": True, "<a@b>": False, " <a@b>": False, "A <a@b": False, "A <a>": False, "A <a@b@c>": False, "A <a @b>": False, "A<a@b>": False, "A <@b>": False, "A": False}
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", s._is_contact(F.col("line"))).collect()
    assert {line: ok for line, ok in got} == lines


LISTS = {
    "BIP 1, 2 and 3 or 4": ["1", "2", "3", "4"], "BIPs 33/99": ["33", "99"], "bip-0053/2-Merkle.pdf": ["53"], "BIP 1/2.pdf": ["1"], "BIP 1/2. Then": ["1", "2"], "BIP 1/2/x": ["1"], "BIP 1/2/ 3": ["1", "2", "3"],
    "BIP 1/2and 3": ["1"], "BIP 1/2 and 3": ["1", "2", "3"], "BIP 12abc, 3": ["12"], "BIP 1, 23x and 4": ["1", "23"], "BIP 1234567": [], "BIP 1, 1234567, 2": ["1"], "BIP 1 sandbox 5": ["1"], "BIP 1 and roid": ["1"], "BIP and 5": [],
    "xBIP 1": [], "BIP#7 BIPS-8": ["7", "8"], "BIP 1,2BIP 3": ["1", "2"], "BIP 007": ["7"], "": [], "BIP": [],
}


def test_lists_of_references(spark):
    frame = spark.createDataFrame([(x,) for x in [*LISTS, None]], "text string").select("text", r.hits(F.col("text"), r.Source("bips", "BIP")).alias("ids"))
    assert {x.text: x.ids for x in frame.collect()} == {**LISTS, None: None}
    coded = {"NIP 5 and 0a, FF": ["05", "0A", "FF"], "NIP 01 for 02": ["01"], "nips 1/2": ["01", "02"], "NIP zz": []}
    frame = spark.createDataFrame([(x,) for x in coded], "text string").select("text", r.hits(F.col("text"), r.Source("nips", "NIP", hexadecimal=True)).alias("ids"))
    assert {x.text: x.ids for x in frame.collect()} == coded


def test_header_blocks(spark):
    texts = [None, "", "no header\nTitle: x", "<pre>\nTitle: x\n more\nbad line\n</pre>", "\n\nTitle: x\r\nno colon\nOther: y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", s.top_headers(F.col("text")).alias("t")).orderBy("id").collect()
    assert [(x.t.valid, [tuple(h) for h in x.t.headers]) for x in rows] == [(False, []), (False, []), (False, []), (False, [("title", "x\nmore")]), (True, [("title", "x")])]


def test_references_in_text(spark):
    # fixed values: this text and its ids are the agreed example of the list grammar
    text = "BIPs 33/99, BIP-0053/2-x.pdf and BIP 32, 39 and 44; bip#7 SLIP-0044 NIP 5a and 1, NIP-B"
    sources = [r.Source("bips", "BIP"), r.Source("slips", "SLIP", most=40), r.Source("nips", "NIP", hexadecimal=True)]
    row = spark.createDataFrame([(text,)], "text string").select(r.reference_list(F.col("text"), sources).alias("refs")).first()
    assert row.refs == ["BIP 7", "BIP 32", "BIP 33", "BIP 39", "BIP 44", "BIP 53", "BIP 99", "NIP 01", "NIP 0B", "NIP 5A"]
    items = ["BIP 5", "5", "slip-3", "slips:3", "nips:b", "other:9", "", None, "SLIP 99", "bips:x"]
    keys = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "id long, item string").select("id", r.resolve_target(F.col("item"), sources, sources[0]).alias("key")).orderBy("id").collect()
    assert [k.key for k in keys] == ["bips:5", "bips:5", "slips:3", "slips:3", "nips:0B", "bips:9", None, None, None, None]
    lists = spark.createDataFrame([("NIP-1, 5a ,x y, 0B",)], "v string").select(r.id_list(F.col("v"), "NIP", True).alias("a"), r.id_list(F.lit("007, BIP 12"), "BIP").alias("b")).first()
    assert (lists.a, lists.b) == (["01", "5A", "0B"], ["7", "12"])
    assert r.published_model(None, []) is None and r.published_model("m", ["a", "b"]) == "m" and r.published_model(None, ["a"]) == "a"
    with pytest.raises(ValueError):
        r.published_model(None, ["a", "b"])


def test_tag_lines(spark):
    aliases = {"status": {"draft": "Draft", "final": "Final"}, "type": {"optional": "optional"}, "layer": {"relay": "relay"}}
    texts = ["NIP-01\n===\n\nA title\n------\n\n`draft` `optional` `more` `final`\n", "# NIP-5A\n\nintro\n## Other title\n**Status:** Final\n`relay`", "no heading", None, "X\n==\nT\n--\ntext with `draft`"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = p.tag_line_headers(got, aliases).orderBy("id").collect()
    assert [(x.title, x.status, x.type, x.layer, x.kind) for x in got] == [("A title", "Draft", "optional", None, "more, final"), ("Other title", "Final", None, None, None), ("", None, None, None, None), ("", None, None, None, None), ("T", None, None, None, None)]


def test_identities(spark):
    rows = [("0012", "A  Title!", "2024-01-02 x", "X\nY", "bip-0001.md"), (None, None, None, None, "docs/bip-0034.mediawiki"), ("xxx", "t", "?", "", "bip-xx.md"), (None, "t", None, "y", "bip-draft.md"), (None, None, None, None, "a2b.txt"), (None, "t", None, None, "x/bip-wallet-XXXX.md"), (None, None, None, None, "bip-0322-draft.md"), (None, None, None, None, "bip-????")]
    frame = spark.createDataFrame(rows, "n string, t string, d string, a string, f string")
    got = frame.select(p.identity(*map(F.col, "ntdaf"), "bip").alias("i")).collect()
    assert [(x.i.number, x.i.title, x.i.created, x.i.authors) for x in got] == [("12", "a title", "2024-01-02", ["x", "y"]), ("34", "", "", []), ("", "t", "", []), ("draft", "t", "", ["y"]), ("a2b", "", "", []), ("", "t", "", []), ("322", "", "", []), ("", "", "", [])]
    both = frame.limit(1).select(p.identity(*map(F.col, "ntdaf"), "bip").alias("target")).crossJoin(frame.select(p.identity(*map(F.col, "ntdaf"), "bip").alias("c"), "f"))
    same = {x.f: x.same for x in both.select("f", p.same_document(F.col("c"), F.col("target"), F.col("f")).alias("same")).collect()}
    assert same == {"bip-0001.md": True, "docs/bip-0034.mediawiki": False, "bip-xx.md": True, "bip-draft.md": False, "a2b.txt": False, "x/bip-wallet-XXXX.md": False, "bip-0322-draft.md": False, "bip-????": False}
    fields = spark.range(1).select(p.with_aliases(F.create_map(*map(F.lit, ("a", "1", "b", "2", "c", "3"))), {"a": "x", "b": "c"}).alias("m")).first().m
    assert fields == {"x": "1", "c": "3"}


def test_strict_and_lenient_validation(spark):
    rows = spark.createDataFrame([(1, "bips:1", "R", "2024-02-29", "3"), (2, "bips:1", "R", "", ""), (3, "nope", " ", "2024-2-1", "-1")], "line long, ip string, reviewer string, reviewed_at string, extracted_target_count string")
    rows = rows.withColumns({k: F.lit("") for k in ("sampling_strategy", "density_bucket", "density_basis", "created")})
    errors = v.reviewed_violations(rows, ["bips"], [], [], [])
    assert {(x.line, x.rule) for x in errors.collect()} == {(2, "duplicate"), (3, "bad key"), (3, "no reviewer"), (3, "bad review day"), (3, "bad target count")}
    with pytest.raises(ValueError, match="5 errors"):
        v.raise_on_errors(errors)
    v.raise_on_errors(errors.limit(0))
    assert v.contract_gaps(["a"], ["a", "contributors"]) == ["contributors"]
    events = spark.createDataFrame([([("c", "p")],), ([("c", None)],), ([],)], "e array<struct<commit string, path string>>")
    assert [x[0] for x in events.select(v.needs_paths(F.col("e"))).collect()] == [False, True, False]


def test_strong_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(i, i + 1) for i in range(40, 48)} | {(48, 40), (5, 5)}
    reach = {n: {n} for e in edges for n in e}
    for _ in reach:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {(n, min(m for m in reach[n] if n in reach[m])) for n in reach if any(m != n and n in reach[m] for m in reach[n])}
    frame = spark.createDataFrame(sorted(edges), "source long, target long")
    assert {tuple(x) for x in graph.strong_components(frame).collect()} == want and len(want) > 9
    assert graph.strong_components(frame.limit(0)).count() == 0
    # a long chain, a ring, a ring behind it, and a chain that leads back to where it starts take a few rounds
    rings = [(i, i + 1) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(230, 200), (300, 301), (301, 302), (302, 300), (160, 300), (400, 401), (401, 402), (402, 400), (400, 403)]
    got = {tuple(x) for x in graph.strong_components(spark.createDataFrame(rings, "source long, target long")).collect()}
    assert got == {(i, 200) for i in range(200, 231)} | {(300, 300), (301, 300), (302, 300), (400, 400), (401, 400), (402, 400)}
    typed = spark.createDataFrame([("m", f"b:{a}", f"b:{b}", "depends_on") for a, b in edges] + [("k", "b:1", "b:2", "depends_on")], "method string, source string, target string, rel string")
    groups = {x.method: (x.edges, x.cyclic_groups, x.involved) for x in y.dependency_groups(typed).collect()}
    assert groups == {"m": (len(edges), len({k for _, k in want}), len(want)), "k": (1, 0, 0)}


def test_batches_of_origins_give_one_result(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame(sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)}), "source long, target long")
    nodes = spark.range(9).withColumnRenamed("id", "node")
    whole, parts = ({x.node: round(x.score, 12) for x in graph.betweenness(edges, nodes, batches=b).collect()} for b in (1, 3))
    assert whole == parts and max(whole.values()) > 0


def test_ranks_and_tau_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([0, 0, 0, rng.randrange(400)]), rng.choice([7, rng.randrange(300)])) for g in "ab" for i in range(700)] + [("c", 1, 4, 4), ("d", 1, 1, 2), ("d", 2, 1, 3)]
    frame = spark.createDataFrame(rows, "g string, item long, x long, y long")
    got = {x.g: x.tau for x in ranking.kendall_tau_b(frame, ["g"]).collect()}
    for g in "ab":
        points = [(a, b) for h, _, a, b in rows if h == g]
        sign = lambda n: (n > 0) - (n < 0)
        z = [(sign(a - c_), sign(b - d)) for (a, b), (c_, d) in itertools.combinations(points, 2)]
        want = sum(i * j for i, j in z) / (sum(i != 0 for i, _ in z) ** 0.5 * sum(j != 0 for _, j in z) ** 0.5)
        assert abs(got[g] - want) < 1e-12
    assert got["c"] is None and got["d"] is None
    ranks = ranking.average_rank(frame.withColumnRenamed("x", "score"), ["g"])
    for x in ranking.competition_rank(ranks, ["g"]).filter("item < 60").collect():
        larger = sum(h == x.g and a > x.score for h, _, a, _ in rows)
        ties = sum(h == x.g and a == x.score for h, _, a, _ in rows)
        assert x["rank"] == larger + 1 and x.average_rank == larger + 1 + (ties - 1) / 2


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_lines_are_split_once(spark):
    from textloom.operators import standards as st

    docs = spark.createDataFrame([("BIP: 1\nTitle: a\n\n== Change Log ==\nx\n=== End ===\n",), (None,), ("",), ("== a",)], "text string")
    parsed = docs.select(*st.parsed_columns(F.col("text")))
    assert [(r.top, r.sections and [tuple(s) for s in r.sections]) for r in parsed.collect()][0][1] == [("changelog", 2, "x"), ("end", 3, "")]
    # one for the sections, two for the header block: in a <pre> block or in lines
    assert _plan(parsed).count("split(") <= 3


def test_shapes_are_looked_at_once(spark):
    from textloom.operators import schema_rules as sr

    files = spark.createDataFrame([("a", '{"meta": 1}'), ("b", None)], "file string, text string")
    problems = sr.document_violations(files, [], ["requires"], ["requires"])
    reported = sr.report(files, problems)
    assert [tuple(r)[:4] for r in reported.orderBy("file").collect()] == [("a", "failed", 2, 0), ("b", "failed", 1, 0)]
    once = _plan(problems).count("schema_of_variant")
    assert once <= 30 and _plan(reported).count("schema_of_variant") == once
