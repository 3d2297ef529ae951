from itertools import permutations

import duckdb
import numpy as np

from textloom.llm import filter_audit as fa

WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None,
    "",
    WORDS,
    WORDS,
    "A B C " + WORDS,
    "few words # here",
    "same " * 70,
    "SHOUT " * 80 + "$",
    " \t\x0b" + WORDS + "\n\x0c\r",
    WORDS.replace(" ", " "),
    "ÉÉ " + WORDS + " \U0001f600|",
    "x" * 300_000,
]


def brute(rows, labels):
    """What is kept, removed and so on, by trying all orders on all rows."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    judged = []
    for d, text, source in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if d is not None and least[text] < d:
            fails.add("E")
        judged.append((source or "", fails, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(1 for x in judged if x[0] == part and f in x[1]) - len(gone)
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                only = sum(1 for x in judged if x[0] == part and x[1] == {f})
                out[part, "".join(order), step] = [len(left), len(gone), redundant, only, sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def tables(spark):
    rows = [(i, t, ["a", "b", "", None][i % 4]) for i, t in enumerate(TEXTS * 3)]
    rows += [(2, WORDS, "a"), (2, WORDS, "b"), (2, "other", "a"), (None, WORDS, "a"), (None, None, None), (-5, "A B C " + WORDS, "c")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(30)] + [(1, 1, None), (7, None, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "2 as id", "3 as part")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as digest", "1 as good")


def test_audit_equals_brute_force(spark):
    rows, labels, docs, judged = tables(spark)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in fa.audit_filters(docs, judged).collect()}
    assert got == brute(rows, labels)
    assert {p for p, _, _ in got} == {"a", "b", "c", ""} and len(got) == 4 * 600


def test_empty_tables(spark):
    _, _, docs, labels = tables(spark)
    assert fa.audit_filters(docs.limit(0), labels).count() == 0
    assert fa.audit_filters(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    _, _, docs, labels = tables(spark)
    con = duckdb.connect()
    for name, table in (("documents", docs), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = sorted(con.execute(fa.ORACLE_SQL).fetchall())
    assert want == sorted(map(tuple, fa.audit_filters(docs, labels).select(*[d[0] for d in con.description]).collect()))


def test_removal_is_the_first_failing_step():
    names, positions, removal = fa.removal_steps()
    assert len(names) == 120 and np.isinf(removal[0]).all()
    for mask in range(1, 32):
        for k, name in enumerate(names):
            assert removal[mask, k] == 1 + min(name.index(f) for i, f in enumerate("ABCDE") if mask >> i & 1)
    a, b = np.array([[0.0, 3.0], [2.0, 5.0]]), np.array([[1.0, 7.0], [-4.0, 0.0]])
    assert fa.min_plus(a, b).tolist() == [[-1.0, 3.0], [1.0, 5.0]]
