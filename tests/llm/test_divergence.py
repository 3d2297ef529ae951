import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from textloom.llm import divergence as dv


def brute(rows, least=3, top=200):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for text, lang, source in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        peers = {s: c for (x, s), c in groups.items() if x == lang}
        sizes = {s: sum(c[t] for t in kept) for s, c in peers.items()}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + v)
        mine = {t: share(peers[source][t], sizes[source]) for t in kept}
        found = {"pair": [], "term": []}
        for s, c in peers.items():
            if s != source:
                other = {t: share(c[t], sizes[s]) for t in kept}
                found["pair"].append((s, sum((mine[t] - other[t]) ** 2 // other[t] for t in kept)))
        for t in kept:
            q = share(sum(c[t] for c in peers.values()), sum(sizes.values()))
            if peers[source][t] and mine[t] > q:
                found["term"].append((t, (mine[t] - q) ** 2 // q))
        for part, items in found.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def some_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "été", "ÉTÉ", "İx", "日本", "a1b", "it's", "x_y", "\U0001f600"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "s3"])
        rows.append((rng.choice([" ", "\n", "\x85", "-"]).join(rng.choices(words[: rng.choice([5, 20, 91])], k=rng.randrange(40))), lang, source))
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("one two", "de", "s1"), ("three", "de", "s2"), ("alone", "it", "s1"), ("word " * 50_000 + "x" * 3_000_000 + " the the", "en", "s1")]
    return rows


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("block", [1 << 14, 9])
def test_audit_equals_brute_force(spark, block):
    rows = some_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as n", "3 as rank", "7 as doc_id")
    got = dv.audit_sources(frame, block=block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.value for r in got if r.lang == "de"} == {0}


def test_ranks_stop_at_the_top(spark):
    rows = some_rows()
    got = dv.audit_sources(spark.createDataFrame(rows, SCHEMA), top=3).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == brute(rows, top=3)
    assert dv.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    frame = spark.createDataFrame([(t, x, s) for t, x, s in some_rows() if len(t or "") < 10_000], SCHEMA)
    frame.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(dv.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(map(tuple, dv.audit_sources(frame).select(*[d[0] for d in con.description]).collect()))


def test_terms_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(dv, "HELD", 3)
    monkeypatch.setattr(dv, "PIECE", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "fr"]), pa.array(["a", "a", ""]), pa.array(["One two three two", "TWO four", ""])], ["lang", "source", "text"])
    sums = defaultdict(lambda: [0, 0, 0])
    for out in dv.count_terms(iter([batch, batch])):
        for r in out.to_pylist():
            at = sums[r["lang"], r["source"], r["term"]]
            at[0], at[1], at[2] = at[0] + r["n"], at[1] + r["docs"], at[2] + 1
    assert {k: v[:2] for k, v in sums.items() if k[2]} == {("en", "a", "one"): [2, 2], ("en", "a", "two"): [6, 4], ("en", "a", "three"): [2, 2], ("en", "a", "four"): [2, 2]}
    assert sums["en", "a", None] == [0, 0, 1] and sums["fr", "", None] == [0, 0, 1]


def test_shares_stay_whole():
    import numpy as np

    for count, size in ((0, 1), (6, 7), (10**13, 2 * 10**13), (3, 9 * 10**13), (9 * 10**13 - 2, 9 * 10**13)):
        assert int(dv.share(np.array([count]), np.array([size]))[0]) == 1 + 10**9 * (count + 1) // size
