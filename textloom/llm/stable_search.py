"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to ``DIMS`` dimensions by fixed Gaussian directions.  The normal law
is 2-stable, so the squared projected distance of two vectors over their squared distance
follows the chi-square law with ``DIMS`` degrees of freedom, whatever the vectors are.  A
query's projected neighbours are taken in ascending distance from a kd-tree, a leaf at a
time, and verified by their whole vectors, until the next one is so far that a vector nearer
than the k-th best so far would lie as near in projection with probability ``TRUST``: until
its squared projected distance exceeds the chi-square quantile times the k-th best squared
distance.  Each true neighbour is so found with that probability at least.

The upper levels of the kd-tree deal vectors to shards, whose splits are medians of a bounded
sample of projections; every vector is in a shard.  A query first searches the shard that it
falls into, which bounds its k-th distance, and then all shards that the test has not ruled
out by the distance of their box.  Queries of a shard are dealt to chunks, so that neither
shards nor queries make a task large.  Only the k + 1 smallest ids of equal vectors can be
among the k nearest of any query, so the others stay out of the shards.

Cases: null, empty, zero and not finite vectors, and rows without an id, take no part;
vectors of other lengths are no neighbours; rows that share id and vector are one; rows that
share an id alone are no neighbours of each other, and each of them is a query whose
neighbours have ranks of their own; of equal distances the smaller id is nearer; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import written

#: Neighbours of a query.
NEAREST = 10
#: Ids of queries are divisible by this.
EVERY = 100
#: Dimensions of a projection: even, for the closed form of the chi-square law.
DIMS = 8
#: Probability with which a nearer vector lies within the radius where the search stops.
TRUST = 0.99
#: Projections that the shards' splits are fitted on, at most.
SAMPLE = 1 << 16
#: Shards that vectors are dealt to before shards grow; then vectors of a shard, about.
SHARDS = 64
SHARD_MAX = 1 << 16
#: Vectors of a shard, about, that further shards need.
SHARD_MIN = 1 << 10
#: Queries searched by one task in one shard, about.
CHUNK = 1 << 13
#: Vectors of a leaf, at most.
LEAF = 128
#: Pairs verified at once.
PANEL = 1 << 16


def chi_square_quantile(trust: float, dims: int = DIMS) -> float:
    """Where the chi-square law with an even number of degrees of freedom reaches a probability."""
    low, high = 0.0, 16.0 * dims + 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))
        low, high = (x, high) if 1 - tail < trust else (low, x)
    return high


def directions(size: int, dims: int = DIMS) -> np.ndarray:
    """Fixed Gaussian directions for vectors of a length, with the mean square that the law has."""
    drawn = np.random.default_rng((size, dims)).standard_normal((dims, size))
    return drawn / np.sqrt((drawn**2).mean())


def project(x: np.ndarray, unit: float) -> np.ndarray:
    """Projections of vectors, counted in units of the largest component so that none overflows."""
    return (x / unit) @ directions(x.shape[1]).T


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, without overflow or underflow of squares."""
    apart = x - y
    square = (apart * apart).sum(axis=1)
    out = np.sqrt(square)
    odd = (square < 1e-280) | (square > 1e280)
    if odd.any():
        largest = np.abs(apart[odd]).max(axis=1)
        scale = np.where((largest > 0) & np.isfinite(largest), largest, 1.0)
        out[odd] = scale * np.sqrt(((apart[odd] / scale[:, None]) ** 2).sum(axis=1))
    return out


class Boxes:
    """A kd-tree of half-open boxes that cover the space: splits at medians, the widest dimension first."""

    def __init__(self, points: np.ndarray, n: int):
        self.lower, self.upper, self.splits = [], [], []
        self._grow(points, max(1, n), np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))
        self.low, self.high = np.array(self.lower), np.array(self.upper)

    def _grow(self, points: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        """The node of a box: its number in ``splits``, or -1 - the number of its leaf."""
        if n > 1 and len(points):
            dim = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            at = float(np.quantile(points[:, dim], (n // 2) / n))
            left = points[:, dim] < at
            if left.any():
                place = len(self.splits)
                self.splits.append(None)
                below, above = high.copy(), low.copy()
                below[dim] = above[dim] = at
                self.splits[place] = (dim, at, self._grow(points[left], n // 2, low, below), self._grow(points[~left], n - n // 2, above, high))
                return place
        self.lower.append(low)
        self.upper.append(high)
        return -len(self.lower)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.splits else []
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                dim, at, left, right = self.splits[node]
                lower = points[rows, dim] < at
                todo += [(left, rows[lower]), (right, rows[~lower])]
        return out

    def away(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to all boxes, at least."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        out += np.maximum(0, np.maximum(low[:, d] - p, p - high[:, d])) ** 2
    return out


class Tree:
    """A kd-tree over projections: leaves with the bounds of what they hold, in order of place."""

    def __init__(self, points: np.ndarray):
        order, leaves, todo = [], [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            if len(rows) <= LEAF or not spread.max() > 0:
                leaves += [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
            else:
                half = len(rows) // 2
                parted = rows[np.argpartition(points[rows, int(spread.argmax())], half)]
                todo += [parted[:half], parted[half:]]
        order = np.concatenate(leaves)
        self.rows, self.points = order, points[order]
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.low = np.minimum.reduceat(self.points, self.edges[:-1], axis=0)
        self.high = np.maximum.reduceat(self.points, self.edges[:-1], axis=0)


def search(ids: np.ndarray, x: np.ndarray, points: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_points: np.ndarray, bound: np.ndarray, unit: float, nearest: int, trust: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Distances and ids of the best candidates of each query, nearest first; and how many pairs were verified.

    bound: a distance within which the query has as many neighbours elsewhere, or infinity.
    """
    tree, reach = Tree(points), chi_square_quantile(trust)
    x, ids = x[tree.rows], ids[tree.rows]
    found, verified = [], 0
    for at in range(len(q)):
        away = box_distances(q_points[at : at + 1], tree.low, tree.high)[0]
        order = np.argsort(away, kind="stable")
        best, best_ids = np.empty(0), np.empty(0, np.int64)
        kth = bound[at]
        for leaf in order:
            stop = reach * (kth / unit) ** 2
            if away[leaf] > stop:
                break
            rows = np.arange(tree.edges[leaf], tree.edges[leaf + 1])
            rows = rows[(((tree.points[rows] - q_points[at]) ** 2).sum(axis=1) <= stop) & (ids[rows] != query_ids[at])]
            if len(rows):
                verified += len(rows)
                far = distances(x[rows], q[at])
                near = far <= kth
                best, best_ids = np.concatenate([best, far[near]]), np.concatenate([best_ids, ids[rows[near]]])
                if len(best) > nearest:
                    first = np.lexsort((best_ids, best))[:nearest]
                    best, best_ids = best[first], best_ids[first]
                if len(best) == nearest:
                    kth = min(kth, best.max())
        first = np.lexsort((best_ids, best))
        found.append((best[first], best_ids[first]))
    return found, verified


_FOUND = pa.schema([("vec_id", pa.int64()), ("query", pa.int64()), ("other", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def _search_chunk(unit: float, nearest: int, trust: float):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").is_valid().to_numpy()
        queries, rows = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not len(queries) or not len(rows):
            return _FOUND.empty_table()
        x, q = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
        query_ids = queries.column("vec_id").to_numpy()
        found, verified = search(rows.column("vec_id").to_numpy(), x, project(x, unit), query_ids, q, project(q, unit), queries.column("bound").to_numpy(), unit, nearest, trust)
        sizes = [len(d) for d, _ in found]
        scores, others = (np.concatenate(c) if c else np.empty(0) for c in zip(*found))
        columns = [np.repeat(query_ids, sizes), np.repeat(queries.column("query").to_numpy(), sizes), others, scores, np.full(len(scores), 0)]
        if len(scores):
            columns[4][0] = verified
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


_BATCH = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("query", pa.int64()), ("bound", pa.float64()), ("vector", pa.binary())])
_DEALT = "size int, shard long, vec_id long, query long, bound double, vector binary"


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    lengths = np.array([len(v) // 8 for v in batch.column(column).to_pylist()])
    for size in np.unique(lengths).tolist():
        rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
        yield rows, np.frombuffer(b"".join(rows.column(column).to_pylist()), np.float64).reshape(-1, size)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles."""
    for batch in batches:
        vectors = [np.asarray(v.values, np.float64).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["vec_id", "vector"])


def _projections(unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_size(batch, "vector"):
                yield pa.RecordBatch.from_arrays([pa.array(list(project(x, unit)), pa.list_(pa.float64()))], ["point"])

    return run


def _deal(boxes: Boxes, unit: float, trust: float, beyond: bool):
    """Sends vectors to the shard they fall into; beyond: queries with a bound to all other shards within the reach of the stopping test."""
    reach = chi_square_quantile(trust)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_size(batch, "vector"):
                points = project(x, unit)
                home = boxes.of(points)
                at, shard = np.arange(len(x)), home
                if beyond:
                    stop = reach * (rows.column("bound").to_numpy() / unit) ** 2
                    at, shard = np.nonzero(boxes.away(points) <= stop[:, None])
                    other = shard != home[at]
                    at, shard = at[other], shard[other]
                for k in range(0, len(at), 1 << 14):
                    some = rows.take(pa.array(at[k : k + (1 << 14)]))
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, x.shape[1], np.int32)), pa.array(shard[k : k + (1 << 14)]), some.column("vec_id"), some.column("query"), some.column("bound"), some.column("vector")], schema=_BATCH
                    )

    return run


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, trust: float = TRUST, shard_min: int = SHARD_MIN, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows found for each row whose id is divisible by ``every``."""
    return _searched(vectors, every, nearest, trust, shard_min, chunk)[0]


def _searched(vectors: DataFrame, every: int, nearest: int, trust: float, shard_min: int, chunk: int) -> tuple[DataFrame, list[DataFrame]]:
    """The neighbours, and the tables of both searches with the pairs that they verified."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    # zeros of both signs are equal
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    largest = F.array_max(F.transform("vector", F.abs)).alias("largest")
    packed = written(rows.select("vec_id", "vector", largest).groupBy("vec_id", "vector").agg(F.max("largest").alias("largest")))
    n, unit = packed.agg(F.count("*"), F.max("largest")).first()
    unit = unit or 1.0
    binary = packed.select("vec_id", "vector").mapInArrow(_pack, "vec_id long, vector binary")
    of_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = binary.withColumn("nth", F.row_number().over(of_vector)).filter(F.col("nth") <= nearest + 1)
    none = F.lit(None).cast("long").alias("query"), F.lit(None).cast("double").alias("bound")
    candidates = written(few.select("vec_id", *none, "vector"))

    # the splits, from projections of a bounded share of all vectors
    share = min(1.0, 0.9 * SAMPLE / max(1, n))
    sample = candidates.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE)
    points = np.array([r.point for r in sample.select("vector").mapInArrow(_projections(unit), "point array<double>").collect()]).reshape(-1, DIMS)
    boxes = Boxes(points, max(-(-n // SHARD_MAX), min(SHARDS, n // shard_min)))

    # a task takes one chunk of queries in one shard, with the vectors of the shard
    asking = binary.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = written(asking.select("vec_id", F.xxhash64("vector").alias("query"), F.lit(math.inf).alias("bound"), "vector"))
    placed = candidates.mapInArrow(_deal(boxes, unit, trust, False), _DEALT)
    home = queries.mapInArrow(_deal(boxes, unit, trust, False), _DEALT)
    first = written(_meet(placed, home, unit, nearest, trust, chunk))
    kth = first.groupBy("vec_id", "query").agg(F.count("*").alias("n"), F.max("score").alias("kth"))
    bounded = queries.drop("bound").join(kth, ["vec_id", "query"], "left")
    bounded = bounded.select("vec_id", "query", F.when(F.col("n") >= nearest, F.col("kth")).otherwise(math.inf).alias("bound"), "vector")
    away = bounded.mapInArrow(_deal(boxes, unit, trust, True), _DEALT)
    second = written(_meet(placed, away, unit, nearest, trust, chunk))
    order = Window.partitionBy("vec_id", "query").orderBy("score", "other")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select(F.col("vec_id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score"), [first, second]


def _meet(placed: DataFrame, asked: DataFrame, unit: float, nearest: int, trust: float, chunk: int) -> DataFrame:
    """Searches each chunk of queries in its shard."""
    asked = written(asked)
    chunks = asked.groupBy("size", "shard").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    # one row for each shard
    held = placed.join(F.broadcast(chunks), ["size", "shard"]).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    spread = asked.join(F.broadcast(chunks), ["size", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "query"), "chunks"))
    both = held.drop("chunks").unionByName(spread.drop("chunks"))
    return both.groupBy("size", "shard", "chunk").applyInArrow(_search_chunk(unit, nearest, trust), "vec_id long, query long, other long, score double, verified long")


#: All distances in DuckDB, for tables of some thousand vectors; the search finds the same there, as its directions are fixed.
ORACLE_SQL = f"""
WITH sound AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), apart AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM apart) WHERE rank <= {NEAREST}
"""
