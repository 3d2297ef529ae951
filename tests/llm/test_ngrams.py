import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from textloom.llm import ngrams as ng


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), "</s>"]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def brute(rows):
    train = [["<s>", *tokens(t)] for i, t in rows if not held(i)]
    c = [None, Counter(), Counter(), Counter()]
    for s in train:
        c[1].update(s[1:])
        c[2].update(zip(s, s[1:]))
        c[3].update(zip(s, s[1:], s[2:]))
    n, v = sum(c[1].values()), len(c[1])
    context = {2: Counter({**c[1], "<s>": len(train)}), 3: c[2]}
    d, b = {}, {}
    for k in (2, 3):
        times = Counter(c[k].values())
        d[k] = min(0.95, max(0.05, times[1] / max(times[1] + 2 * times[2], 1)))
        sums = [sum(x**e for x in (c[1] if k == 2 else c[2]).values()) for e in ng.EXPONENTS]
        b[k] = float(np.interp(len(c[k]), sums, ng.EXPONENTS)) if c[k] else 1.0

    def p(*gram):
        if len(gram) == 1:
            return (c[1][gram[0]] + 1) / (n + v + 1)
        h = gram[0] if len(gram) == 2 else gram[:2]
        ch = context[len(gram)][h]
        g = d[len(gram)] * ch ** (b[len(gram)] - 1) if ch else 1.0
        return (1 - g) * (c[len(gram)][gram] / ch if ch else 0) + g * p(*gram[1:])

    out = []
    for i, t in rows:
        s = ["<s>", *tokens(t)]
        base = sum(math.log10(p(w)) for w in s[1:])
        score = math.log10(p(*s[:2])) + sum(math.log10(p(*g)) for g in zip(s, s[1:], s[2:]))
        out.append((i, held(i), len(s) - 1, sum(c[1][w] > 0 for w in s[1:]), n, base, score))
    return out, p, set(c[1])


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"Wörd{i}" for i in range(60)] + ["the", "The", "of", "a\x1cb"]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \r\n"), (503, "z" * 60000), (504, "the of " * 9000), (None, "the of"), (7, rows[7][1]), (7, "other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'x' as held_out")
    got = sorted((tuple(r) for r in ng.score_documents(frame).collect()), key=str)
    want, p, seen = brute(rows)
    want.sort(key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2]))):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[6] - b[6]) <= ng.CODE * a[2]
    total = sum(p("the", "of", w) for w in seen) + p("the", "of", "<never>")
    assert abs(total - 1) < 1e-9
    assert ng.score_documents(frame.limit(0)).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(2)
    for n, most in ((0, 10), (1, 2**63), (1000, 2**48), (5000, 2**13), (3000, 2**64 - 1)):
        values = np.sort(rng.integers(0, most, n, dtype=np.uint64))
        assert np.array_equal(ng.ef_unpack(ng.ef_pack(values)), values)
        counts = rng.integers(0, 400, n)
        assert np.array_equal(ng.counts_unpack(ng.counts_pack(counts)), counts)
    for most in (100, 2**20, 2**44):
        values = np.unique(rng.integers(0, most, 4000))
        code = ng.EliasFano(values)
        code.map(ng.mapped(code.arrays))
        assert np.array_equal(code.access(np.arange(len(values))), values)
        wanted = np.concatenate([values, values + 1, rng.integers(0, most + 9, 500)])
        lo = rng.integers(0, len(values), len(wanted))
        hi = np.minimum(lo + rng.integers(0, 900, len(wanted)), len(values))
        got, same = code.successor(wanted, lo, hi)
        for w, a, b, i, s in zip(wanted, lo, hi, got, same):
            want = a + int(np.searchsorted(values[a:b], w))
            assert i == want and s == (want < b and values[want] == w)


def test_levels_find_pairs_between_their_context_s_pointers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 900):
        pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, n), rng.integers(0, 300, n))})
        level = ng.Level(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64), 40)
        arrays = ng.mapped([*level.pointers.arrays, *level.values.arrays])
        level.pointers.map(arrays)
        level.values.map(arrays)
        every = [(a, b) for a in range(40) for b in range(0, 301)]
        at, there = level.find(*(np.array(side) for side in zip(*every)))
        where = {p: i for i, p in enumerate(pairs)}
        assert [int(i) if t else None for i, t in zip(at, there)] == [where.get(p) for p in every]


def test_the_trie_lacks_what_training_lacks():
    """Texts learnt and not learnt share a chunk; the latter's own n-grams are searched for and not found."""
    texts = ["a b c d a b", "c a b x y", "b x a b c", "new words b c d"]
    t = ng.Tokens([x.encode() for x in texts])
    learnt = [s for s in (["<s>", *tokens(x)] for x in texts[:2])]
    spelled = [["<s>", *tokens(x)] for x in texts]
    c = {k: Counter(g for s in learnt for g in zip(*(s[i:] for i in range(k)))) for k in (1, 2, 3)}
    c[1].pop(("<s>",))
    counts = {
        1: np.array([c[1][(w,)] for s in spelled for w in s[1:]]),
        2: np.array([c[2][g] for s in spelled for g in zip(s, s[1:])]),
        3: np.array([c[3][g] for s in spelled for g in zip(s, s[1:], s[2:])]),
    }
    stats = [(k, ng.shard_stats(np.array(list(c[k].values())))) for k in (1, 2, 3)]
    trie = ng.Trie(t, counts, ng.Totals(stats))
    ids = {w: int(np.searchsorted(trie.words, ng.Tokens([w.encode()]).tokens[0])) for w in "abcdxy"} | {"<s>": trie.size - 1}
    find = lambda u, v: bool(trie.level2.find(np.array([ids[u]]), np.array([ids[v]]))[1][0])
    assert find("a", "b") and find("b", "x") and find("<s>", "c")
    assert not find("x", "a") and not find("<s>", "b") and not find("d", "b")
    assert trie.level2.values.n == len(c[2]) and trie.level3.values.n == len(c[3])
    want, p, _ = brute([(i, x) for i, x in zip([i for i in range(99) if not held(i)][:2] + [i for i in range(99) if held(i)][:2], texts)])
    logs = trie.log_probabilities(t)
    got = np.add.reduceat(logs, t.starts[:-1])
    for g, w in zip(got, want):
        assert abs(g - w[6]) <= ng.CODE * w[2]


def test_slices_of_any_size_give_equal_scores(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["", "a b " * 300]
    docs = pa.table(
        [pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([int(i % 7 == 2) for i in range(len(texts))], pa.int32())],
        names=["chunk", "doc_id", "text", "held_out"],
    )
    asked = pa.Table.from_batches(ng._requests(4)(iter(docs.to_batches()))).sort_by([("shard", "ascending"), ("level", "ascending")])
    answers = pa.Table.from_batches(list(ng._answers(iter(asked.to_batches()))))
    whole = ng._score(docs, answers)
    for size in (1, 50, 700):
        monkeypatch.setattr(ng, "TRIE_TOKENS", size)
        assert ng._score(docs, answers).equals(whole)


def test_a_triple_counted_by_chance_is_not_in_the_trie():
    t = ng.Tokens([b"a b c", b"x y z"])
    counts = {1: np.ones(8, np.int64), 2: np.array([1, 1, 1, 1, 0, 0, 0, 0]), 3: np.array([1, 1, 1, 1, 1, 1])}
    trie = ng.Trie(t, counts, ng.Totals([(k, ng.shard_stats(counts[k])) for k in (1, 2, 3)]))
    assert (trie.level2.values.n, trie.level3.values.n) == (4, 3)
    assert np.isfinite(trie.log_probabilities(t)).all()


def test_memory_of_a_chunk(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(ng, "TRIE_TOKENS", 1 << 14)  # so that the slices that are scored count for little
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(60_000)])
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(100)]
    rows = pa.record_batch([pa.array([0] * 100, pa.int32()), pa.array(range(100)), pa.array(texts), pa.array([0] * 100)], ["chunk", "doc_id", "text", "held_out"])
    asked = [r for batch in ng._requests(4)(iter([rows])) for r in batch.to_pylist()]
    batch = pa.RecordBatch.from_pylist(sorted(asked, key=lambda r: (r["shard"], r["level"])), ng._REQUEST)
    answers = pa.Table.from_batches(list(ng._answers(iter([batch]))))
    docs = pa.Table.from_batches([rows]).select(["doc_id", "text", "held_out"])
    tracemalloc.start()
    scored = ng._score(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored.num_rows == 100 and peak < 230 * scored["n_tokens"].to_numpy().sum(), peak / scored["n_tokens"].to_numpy().sum()
