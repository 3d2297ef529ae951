import math

import numpy as np
import pytest

from textloom.llm import stable_search as st


def brute(rows, every, nearest):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in ok:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in ok if j != i and len(w) == len(v))[:nearest]
            out += [(i, k, j, d) for k, (d, j) in enumerate(near, 1)]
    return sorted(out)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12)


def vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    base[n // 2 :] = base[: n - n // 2] + 0.2 * rng.standard_normal((n - n // 2, size))
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]


ODD = [(None, [1.0] * 6), (7000, None), (7010, []), (7020, [0.0] * 6), (7030, [1.0, None] + [0.0] * 4), (7040, [float("nan")] * 6), (7050, [float("inf")] * 6), (7060, [1.0, 2.0]), (7061, [1.0, 2.5]), (7070, [0.0, -0.0, 1.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("shard_min, chunk", [(1 << 10, 1 << 13), (16, 5)])
def test_sure_search_equals_brute_force(spark, shard_min, chunk):
    """At a probability of all but certainty nothing is missed, through shards, chunks, copies and odd rows."""
    rows = vectors(300, 6) + ODD
    rows += [(8000 + i, rows[0][1]) for i in range(40)] + rows[:3]  # many copies of a vector, and repeated rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as vector", "3 as shard")
    got = st.nearest_neighbours(frame, every=10, trust=1 - 1e-12, shard_min=shard_min, chunk=chunk)
    same(sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())), brute(rows, 10, 10))


def test_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert st.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    assert st.nearest_neighbours(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    assert st.nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)).count() == 0
    rows = [(0, [1.0, 1.0]), (5, [1.0, 2.0]), (4, [1.0, 0.0])]
    same(sorted(map(tuple, st.nearest_neighbours(spark.createDataFrame(rows, schema)).collect())), [(0, 1, 4, 1.0), (0, 2, 5, 1.0)])


def test_very_large_and_small_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(5) * 10.0 ** (200 if i % 2 else -200)).tolist()) for i in range(60)]
    got = st.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=5, trust=1 - 1e-12)
    same(sorted(map(tuple, got.collect())), brute(rows, 5, 10))


def test_recall_and_work(spark):
    """The stopping test finds at least its share of all true neighbours, and looks at few pairs where some are near."""
    rng = np.random.default_rng(8)
    centres = 4 * rng.standard_normal((40, 32))
    near = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(32)).tolist()) for i in range(4000)]
    even = [(i, rng.standard_normal(32).tolist()) for i in range(4000)]
    for rows, most in ((near, 0.2), (even, 1.0)):
        found, tables = st._searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 10, 0.95, 256, 64)
        want = {x[:1] + x[2:3] for x in brute(rows, 50, 10)}
        got = {(r.query_id, r.vec_id) for r in found.collect()}
        assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)
        verified = sum(t.agg({"verified": "sum"}).first()[0] or 0 for t in tables)
        assert verified <= most * 80 * 4000


def test_chi_square_quantile_and_projections():
    for trust in (0.5, 0.9, 0.999):
        x = st.chi_square_quantile(trust, 2)
        assert 1 - math.exp(-x / 2) == pytest.approx(trust)
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2000, 24)), rng.standard_normal((2000, 24))
    ratio = ((st.project(x, 1.0) - st.project(y, 1.0)) ** 2).sum(1) / ((x - y) ** 2).sum(1)
    assert np.mean(ratio <= st.chi_square_quantile(0.9)) == pytest.approx(0.9, abs=0.04)


def test_boxes_cover_the_space():
    rng = np.random.default_rng(6)
    points = rng.standard_normal((500, 3)).round(1)
    boxes = st.Boxes(points, 13)
    more = np.concatenate([points, 50 * rng.standard_normal((200, 3))])
    leaf = boxes.of(more)
    assert len(boxes.low) == 13 and set(leaf) <= set(range(13))
    assert (boxes.away(more)[np.arange(len(more)), leaf] == 0).all()
    assert st.Boxes(np.ones((9, 2)), 4).of(np.ones((3, 2))).tolist() == [0, 0, 0] and len(st.Boxes(np.empty((0, 2)), 4).low) == 1


def test_tree_holds_every_point():
    points = np.random.default_rng(4).standard_normal((1000, 4))
    points[300:700] = points[0]
    tree = st.Tree(points)
    assert sorted(tree.rows.tolist()) == list(range(1000)) and np.diff(tree.edges).max() <= st.LEAF
