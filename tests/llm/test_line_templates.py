import random

import duckdb

from textloom.llm import line_templates as lt


def brute(rows):
    """Lines and sentences by doc that an earlier document shares a template with."""

    def words(line):
        return [t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t]

    def toks(some):
        return ["<*>" if any(c in "0123456789" for c in t) else t for t in some]

    def fixed(t):
        return sum(x != "<*>" for x in t)

    def sentences(line):
        out = [[]]
        for w in words(line):
            if out[-1] and out[-1][-1][-1] in ".!?":
                out.append([])
            out[-1].append(w)
        return out

    def alike(a, b):
        if a == b:
            return True
        n = len(a)
        if n != len(b) or n < lt.LONG or a[: lt.DEPTH] != b[: lt.DEPTH]:
            return False
        m = n - lt.DEPTH
        cuts = [lt.DEPTH + m * i // lt.SEGMENTS for i in range(lt.SEGMENTS + 1)]
        return any(a[:x] == b[:x] and a[y:] == b[y:] for x, y in zip(cuts, cuts[1:]))

    lines = [(d, line, sentences(line)) for d, t in rows for line in t.split("\n")]
    several = lambda s: len(s) > 1 and sum(map(len, s)) >= lt.LONG
    # (doc, tokens, whether runs may be open)
    units = [(d, toks(words(line)), not several(s)) for d, line, s in lines if fixed(toks(words(line))) >= lt.LEAST]
    units += [(d, toks(x), False) for d, _, s in lines if several(s) for x in s if fixed(toks(x)) >= lt.LEAST_SENTENCE]
    short = [(d, toks(words(line))) for d, line, _ in lines if 0 < fixed(toks(words(line))) < lt.LEAST]

    def shared(d, t, opened):
        return any(e < d and (t == u or (opened and o and alike(t, u))) for e, u, o in units)

    def often(d, t):
        docs = {e for e, u in short if u == t}
        return len(docs) >= lt.SHORT_DOCS and min(docs) < d

    out = []
    for d, t in rows:
        kept, cut = [], 0
        for line in t.split("\n"):
            x, s = toks(words(line)), sentences(line)
            if fixed(x) >= lt.LEAST and shared(d, x, not several(s)) or 0 < fixed(x) < lt.LEAST and often(d, x):
                continue
            stay = [p for p in s if not (several(s) and fixed(toks(p)) >= lt.LEAST_SENTENCE and shared(d, toks(p), False))]
            if stay:
                cut += len(s) - len(stay)
                kept.append(line if len(stay) == len(s) else " ".join(w for p in stay for w in p))
        out.append((d, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept), cut))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocab = [f"tok{c}" for c in "abcdefghij"]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 24))) for _ in range(25)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice(pool).split(" ")
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = f"v{rng.randrange(9)}x"
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(vocab)
            lines.append(" ".join(t))
        lines += [rng.choice([". ", " ", "\t", "! "]).join(rng.sample(pool, 3)) + rng.choice(["", ".", " "]) for _ in range(2)]
        lines += rng.sample(["so it is", "Page 3", "12", "End.", "Of."], rng.randint(0, 2))
        rows.append((d, "\n".join(lines)))
    return rows


def test_equals_brute_force_and_sql(spark):
    for seed in (1, 2):
        rows = [*rows_of(seed), (100, ""), (101, "\n\n"), (102, "x" * 50000), (103, "1 2 3 4 5 6\n9 8 7 6 5 4"), (104, "1 2 3 4 5 7")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as template", "3 as doc", "4 as _gone", "5 as _own", "6 as row", "7 as own", "8 as found")
        result = lt.drop_recurring_lines(docs)
        assert all((r.line, r._gone, r._own, r.row, r.found) == (1, 4, 5, 6, 8) for r in result.collect())
        got = sorted(tuple(r) for r in result.select("doc_id", "text", "n_lines", "n_dropped", "n_cut").collect())
        assert sum(r[3] for r in got) > 20 and sum(r[4] for r in got) > 5
        assert got == brute(rows)
        con = duckdb.connect()
        con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?, ?)", rows)
        assert sorted(con.execute(lt.ORACLE_SQL.format(docs="t")).fetchall()) == got


def test_nulls_ties_and_nothing(spark):
    line = "one two three four five six"
    rows = [(None, line), (1, line), (1, line), (2, None), (3, f"{line}\n{line}\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lt.drop_recurring_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got if r.text is not None) == [(0, "", 1, 1), (1, line, 1, 0), (1, line, 1, 0), (3, "short", 3, 2)]
    assert [tuple(r) for r in got if r.text is None] == [(2, None, 0, 0, 0)]
    assert lt.drop_recurring_lines(docs.limit(0)).count() == 0


def test_passages_inside_other_words_go(spark):
    passage = " ".join(f"Sentence {w} of a passage that many pages share with each other, word by word." for w in ("one", "two", "three", "four", "five"))
    rows = [(1, f"Own words here. {passage} And own ones after."), (2, f"Quite different start of it; then comes this. {passage}"), (3, f"{passage} The last of them all here."), (4, "Nothing shared in this one. It stays whole, as long as it is.")]
    got = {r.doc_id: r for r in lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert got[2].text == "Quite different start of it; then comes this." and got[3].text == "The last of them all here."
    assert (got[2].n_dropped, got[2].n_cut) == (0, 5)


def test_rows_without_an_id_are_documents_of_their_own(spark):
    line = "one passage of plain words that several rows without any name share among them"
    rows = [(None, line), (None, line), (None, line + "\nits own words stand here and nowhere else in any other row")]
    got = lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 2 and sum(line in r.text for r in got) == 1 and any("its own words" in r.text for r in got)
    named = spark.createDataFrame([(5, line), (None, line)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in lt.drop_recurring_lines(named).collect()} == {(5, line), (None, "")}
