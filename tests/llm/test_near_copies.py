import random

import xxhash

import corpus_pipeline as cp
from textloom.llm import near_copies
from textloom.operators.components import connected_components


def brute(rows):
    """doc_id and the smallest doc_id that links of 0.8 or more lead to."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    return {(d, c) for (d, _), c in zip(rows, label)}


def rows_of(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, "One two"), (903, "ONE  two"), (904, "one two three four five six seven eight"), (905, "one two three four five six seven eight nine")]
    for _ in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 300))]
        for k in range(4):
            changed = list(words)
            for _ in range(k * len(words) // 60):
                changed[rng.randrange(len(words))] = "other"
            rows.append((len(rows) * 3, " ".join(changed)))
    return rows


def test_groups_equal_brute_force(spark):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as body", "2 as component")
    got = near_copies.group_documents(docs).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)
    more = docs.unionByName(docs.limit(3).withColumn("doc_id", near_copies.F.lit(None).cast("long")))
    assert {tuple(r) for r in near_copies.group_documents(more).collect()} == brute(rows)
    assert near_copies.group_documents(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    rows = rows_of(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    kept = [r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted({c for _, c in brute(rows)})
    assert len(kept) < len({" ".join((t or "").lower().split()) for _, t in rows})


def test_groups_of_a_component():
    groups = near_copies.Groups()
    sets = [near_copies.np.arange(s, s + 100, dtype="uint64") for s in (0, 20, 10, 400, 0)]
    for s in sets:
        groups.add(s)
    assert len(groups.links) == 2 and sorted(map(len, groups.members)) == [1, 3]


def test_simhash_fingerprints_give_candidates(spark):
    texts = ["a b c d e f g", "A b  c d e f g", None, "one two"]
    batch = near_copies.pa.RecordBatch.from_arrays([near_copies.pa.array(range(4)), near_copies.pa.array(texts)], ["doc_id", "text"])
    sketches = next(near_copies._sketches(iter([batch]))).to_pylist()
    shingles = [xxhash.xxh64_intdigest(" ".join("abcdefg"[i : i + 5]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in shingles) > 3)
    assert [r["fp"] % (1 << 64) for r in sketches] == [want, want, 0, xxhash.xxh64_intdigest("one two", 42)]
    # no band in common: 1, 2, 3 and 4 have fingerprints that are equal or lead from one to the next within two bits
    rows = [(1, 0b1010, [1]), (2, 0b1010, [2]), (3, 0b1111, [3]), (4, 0b111111, [4]), (5, -1, [5]), (6, 1 << 40, [6])]
    classes = spark.createDataFrame(rows, "body long, fp long, bands array<long>")
    found = {r.node: r.component for r in connected_components(near_copies.near_prints(classes)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1} and near_copies.near_bands(classes).isEmpty()
