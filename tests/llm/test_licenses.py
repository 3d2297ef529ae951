import random
import re

import duckdb

from textloom.llm import licenses as lic


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in [*lic.BASE.items(), *lic.PHRASES.items()]:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            labels.add(label)
            if phrase in lic.BASE:
                places += [(i, label) for i in at]
    return len(words), places, labels


TEXTS = [
    "Released under the MIT License. Licensed under CC BY-NC 4.0. All rights reserved.",
    "the GNU General Public License and the gnu general public, license; mit mit license license",
    "cc by cc by cc-by apache License",
    None,
    "",
    "word",
    "\u212a MIT License \u0130",
    "É mit_license ÀB mit" + " x" * 30000 + " Apache License",
]


def test_base_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[2]), (0, "other mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as gram")
    got = lic.scan(docs).collect()
    key = lambda r: (str(r[0]), r[1:4], str(r[4:]))
    want = []
    for d, t in rows:
        n, places, labels = brute(t)
        want.append((d, n, len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if labels else 0.0))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert lic.scan(docs.limit(0)).count() == 0


def covers(words):
    """Best share of each notice that hits within DRIFT words of one diagonal on cover, by trying all."""
    out = {}
    for label, text in lic.NOTICES.items():
        n = text.split()
        hits = [(i - k, k) for i in range(len(words) - 1) for k in range(len(n) - 1) if words[i : i + 2] == n[k : k + 2]]
        out[label] = max((len({k for d, k in hits if d0 <= d <= d0 + lic.DRIFT}) / (len(n) - 1) for d0, _ in hits), default=0)
    return out


def test_notices_equal_brute_force_and_stray_words_are_none(spark):
    rng = random.Random(3)
    rows = []
    for label, text in lic.NOTICES.items():
        words = text.split()
        for gap in (0, 1, 2, 3, 5, 9):  # words put in, and words lost
            changed = list(words)
            for _ in range(gap):
                changed.insert(rng.randrange(len(changed)), "really")
            rows.append((len(rows), " ".join(["start", *changed, *words[:9]])))
            rows.append((len(rows), " ".join(w for w in words if rng.random() > gap / 30)))
        pairs = [words[i : i + 2] for i in range(len(words) - 1)]
        rows.append((len(rows), " ".join(w for p in pairs for w in (*p, "and", "some", "other"))))  # its pairs in order, far apart
        rng.shuffle(pairs)
        rows.append((len(rows), " ".join(w for p in pairs for w in p)))
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        want = {label: c for label, c in covers(text.split()).items() if c >= lic.COVER}
        assert {x for x in got[d].labels.split(",") if x.endswith(("notice", "disclaimer"))} == set(want), d
        assert got[d].score == max([*want.values(), 1.0 if brute(text)[2] else 0.0], default=0), d
    far = [d for d, text in rows if " and some other " in text]
    assert far and not any(x.endswith("notice") for d in far for x in got[d].labels.split(","))


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, "a " + t[: 20 + 9 * i]) for i, t in enumerate(lic.NOTICES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(lic.ORACLE_SQL).df().sort_values("doc_id", ignore_index=True)
    got = lic.scan(docs).toPandas().sort_values("doc_id", ignore_index=True)[list(want.columns)]
    assert got.astype(str).equals(want.astype(got.dtypes).astype(str))


def test_changed_notice_is_found_and_half_a_notice_is_not(spark):
    words = lic.NOTICES["mit-notice"].split()
    changed = [*words[:20], "really", *words[20:30], *words[31:]]
    rows = [(1, "intro text " + " ".join(changed)), (2, " ".join(words[:25])), (3, " ".join(words))]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit-notice" and 0.8 <= got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "mit-notice" and got[3].score == 1
