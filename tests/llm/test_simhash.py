import random

import numpy as np
import xxhash

from textloom.llm import simhash


def brute(rows):
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    ids = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    return {(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, ids)}


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, "One two"), (903, "ONE  two"), (904, "É a b c É"), (905, "x" * 70000)]
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 300))]
        for k in range(rng.choice([1, 1, 2, 4])):
            changed = list(words)
            if k > 1:
                changed[rng.randrange(len(words))] = "other"
            rows.append((len(rows) * 3, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as fp", "1 as component_id")
    got = simhash.group_documents(docs).select("doc_id", simhash.fingerprint_hex(simhash.F.col("fp")), "component_id").collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)
    clashing = docs.unionByName(docs).selectExpr("*", "1 as _rows", "2 as _kept", "3 as rows", "4 as kept")
    kept = simhash.first_of_each_group(clashing).collect()
    assert all(len(r) == len(clashing.columns) and (r._rows, r._kept, r.rows, r.kept) == (1, 2, 3, 4) for r in kept)
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in brute(rows)})
    assert simhash.group_documents(docs.limit(0)).count() == 0


def test_links_in_dense_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_MAX", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            v = int(b)
            for bit in rng.integers(0, 63, rng.integers(1, 7)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    from textloom.operators.components import connected_components

    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all((r.a ^ r.b).bit_count() <= 2 for r in links.collect())
    want = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for x in values:
            for y in values:
                if (x ^ y).bit_count() <= 2 and want[x] > want[y]:
                    want[x], changed = want[y], True
    assert {v: got.get(v, v) for v in values} == want
