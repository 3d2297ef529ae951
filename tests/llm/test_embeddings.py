import numpy as np
import pytest

from textloom.llm import embeddings as em


def brute(rows):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
                link[i, j] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(link[i]):
                label[i] = label[j] = min(label[i], label[j])
    out = []
    for i in range(n):
        c = min(rows[j][0] for j in range(n) if label[j] == label[i])
        out.append((rows[i][0], int(link[i].sum()), c, rows[i][0] == c))
    return sorted(out)


@pytest.mark.parametrize("size", [16, 48])
@pytest.mark.parametrize("tile", [1024, 7])
def test_links_equal_brute_force(spark, tile, size):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        base = rng.standard_normal(size) + (0.6 if i % 3 == 0 else 0)
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows) * 7 % 1009, [float(np.float32(x)) for x in base + 0.12 * rng.standard_normal(size)]))
    rows += [(2000 + i, rows[0][1]) for i in range(9)] + [(2100, [2 * x for x in rows[0][1]])]
    rows += [(3000, None), (3001, [0.0] * size), (3002, [1.0, None] + [0.0] * (size - 2)), (3003, [float("nan")] * size), (3004, []), (3005, [1.0, 2.0]), (3006, [1.0, 2.1]), (3007, [float("inf")] * size)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as key")
    got = em.link_vectors(frame, tile=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert em.link_vectors(frame.limit(0)).count() == 0


def test_each_pair_within_budget_meets_once():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 48))
    x = np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    for split in (1, 3, 9):
        met = np.zeros((len(x), len(x)), int)
        cells = {}
        for names, home, rows in em._places(x, 0.9, split):
            for c, r in zip(names.tolist(), rows.tolist()):
                cells.setdefault(c, ([], []))[0 if home else 1].append(r)
        for block in range(3):
            once = np.zeros_like(met)
            for c, (own, visiting) in cells.items():
                if em._block_of(c, 48) == block:
                    for a in own:
                        once[a, own] += 1
                        once[a, visiting] += 1
                        once[visiting, a] += 1
            assert once.max() == 1
            met += once
        assert met[near].min() >= 1


def test_very_large_and_small_doubles(spark):
    """Six vectors that point almost the same way, and as many the other way, at lengths whose squares leave the doubles."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32)
    rows = [(i, ((1 if i < 6 else -1) * (base + 0.01 * rng.standard_normal(32)) * 10.0 ** (200, -200, 0, 250, -250, 3)[i % 6]).tolist()) for i in range(12)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in em.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (5, 0 if i < 6 else 6) for i in range(12)}


def test_vectors_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(em, "_hash", lambda column: em.F.lit(7).cast("long"))
    rows = [(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, em.link_vectors(frame).collect())) == brute(rows)
