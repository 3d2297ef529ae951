"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are made unit length and rotated by one fixed random rotation.  A cosine of
at least ``COSINE`` is a squared distance of at most 2 - 2 ``COSINE``; split into blocks
of ``DEPTH`` coordinates, such a pair has at least one block in which its squared
distance is within the block's share of that budget.  Each block is range-joined: a grid of
cells as wide as the block's radius, over as many of its coordinates as there are vectors
to fill (cells of about a tile), puts every such pair into one cell or two adjoining ones;
cells that the budget cannot reach are not visited.  Candidates (block distance within
budget) are verified by the exact cosine, and a pair counts in the first block that finds
it, so the union over blocks has each link once.  Tasks give link counts by vector and a
spanning forest, never all pairs.  Cells with many vectors are dealt out as pairs of tiles:
tiles of the cell's own vectors with each other, and with tiles of its visitors.

Blocks of 16 coordinates let some two of a million unlike pairs of random 64-dimensional
vectors through; blocks of 8 one of a thousand, each of which is then held against its
whole vector.  The grid itself spares few pairs as long as one block's radius exceeds the
spread of its coordinates; that share falls with each coordinate that more vectors add.

Cases: null, empty, zero, and not finite vectors link with nothing; so do vectors of
different lengths; equal vectors are joined as one row that stands for all; repeated vec_ids
are rows of their own; null ids are rows, but name no component.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.operators.components import connected_components

COSINE = 0.9
#: Coordinates of a block, about.
DEPTH = 16
#: Vectors of a cell in one tile: a pair of tiles is some 35 MB, and each tile more is another copy of a cell's vectors.
TILE = 65_536
#: Distances of a block worked on at once.
PANEL = 1 << 22
#: Allows for rounding of rotated coordinates; candidates are verified exactly.
SLACK = 1e-9
#: Allows for rounding of distances in single precision.
SINGLE = 1e-5
#: Bits of a cell's name that its coordinates share; length and block of the vectors have the others.
_CELL_BITS = 36


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of so many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _blocks(size: int) -> list[slice]:
    n = max(1, size // DEPTH)
    edges = [size * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _budget(part: slice, size: int, cosine: float) -> float:
    return (2 - 2 * cosine) * (part.stop - part.start) / size + SLACK


def _places(x: np.ndarray, cosine: float, split: int) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """Cells of unit vectors: their own in each block and, as visitors, those after it within reach; with the rows concerned."""
    size = x.shape[1]
    turned = x @ rotation(size).T
    for k, part in enumerate(_blocks(size)):
        width = math.sqrt(_budget(part, size, cosine)) * (1 + 1e-9)
        bits = int(2 / width + 4).bit_length()
        middle = 1 << (bits - 1)
        # rows, cell so far, budget left, and whether a coordinate before was passed by one
        rows, cell = np.arange(len(x)), np.full(len(x), size << 12 | k, np.int64)
        left, later = np.full(len(x), width**2 * (1 + 1e-9)), np.zeros(len(x), bool)
        for column in range(part.start, part.start + min(split, part.stop - part.start, max(1, _CELL_BITS // bits))):
            at = np.floor(turned[:, column] / width).astype(np.int64)
            above, below = turned[:, column] - at * width, (at + 1) * width - turned[:, column]
            steps = []
            for step, gap in ((0, None), (1, below), (-1, above)):
                rest = left if gap is None else left - gap[rows] ** 2
                # of two adjoining cells the one before is home, so the first step leads up
                go = np.flatnonzero((rest >= 0) & (later if step < 0 else True))
                steps.append((rows[go], cell[go] << bits | (at[rows[go]] + step + middle), rest[go], later[go] | (step > 0)))
            rows, cell, left, later = (np.concatenate(c) for c in zip(*steps))
        for home in (True, False):
            chosen = later != home
            yield cell[chosen], home, rows[chosen]


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of each vector length with their vectors as a matrix."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
        yield rows, np.array(rows.column(column).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two, which change no digit, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell_counts(cosine: float, split: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch, 0):
                for cells, home, _ in _places(_unit(x), cosine, split):
                    names, n = np.unique(cells, return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names, *((n, none) if home else (none, n)))], ["cell", "own", "visiting"])

    return count


def _deal(cosine: float, split: int, tiles: dict[int, tuple[int, int]]):
    """Sends each vector to the tile pairs (i, j) of its cells.

    i is a tile of the cell's own vectors; j is another one from i on, or -v for tile v of
    its visitors; visitors' tile 0 comes with the pair (i, i).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch, 1):
                keys, copies = (rows.column(k).to_numpy() for k in (0, 2))
                for cells, home, at in _places(_unit(x), cosine, split):
                    counts = np.array([tiles.get(c, (1, 1)) for c in cells.tolist()], np.int64).reshape(-1, 2)
                    tile = (keys[at] % counts[:, 0 if home else 1]).astype(np.int64)
                    for own, visiting in np.unique(counts, axis=0).tolist():
                        here = (counts == (own, visiting)).all(axis=1)
                        if home:
                            sent = [(i, tile, here & (tile > i)) for i in range(own)]
                            sent += [(tile, j, here & (tile <= j)) for j in range(own)]
                            sent += [(tile, -v, here) for v in range(1, visiting)]
                        else:
                            sent = [(i, np.where(tile == 0, i, -tile), here) for i in range(own)]
                        for i, j, chosen in sent:
                            r = np.flatnonzero(chosen)
                            if len(r):
                                data = np.ascontiguousarray(x[at[r]])
                                offsets = np.arange(len(r) + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
                                vector = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                                i, j = (np.broadcast_to(side, len(tile))[r] for side in (i, j))
                                arrays = [cells[r], i, j, home & (tile[r] == i), keys[at[r]]]
                                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), vector, pa.array(copies[at[r]])], _DEALT_NAMES)

    return deal


_DEALT_NAMES = ["cell", "i", "j", "left", "key", "vector", "copies"]
_DEALT = "cell long, i long, j long, left boolean, key long, vector binary, copies long"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _near(x: np.ndarray, y: np.ndarray, budget: float, after: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the budget, a panel at a time; after: y is x, and only pairs in order are wanted."""
    half_x, half_y = (x**2).sum(1, keepdims=True) / 2, (y**2).sum(1, keepdims=True) / 2
    # one product gives minus half the squared distance
    left = np.hstack([x, -half_x, np.ones_like(half_x)]).astype(np.float32)
    right = np.hstack([y, np.ones_like(half_y), -half_y]).astype(np.float32).T
    least = np.float32(-(budget + SINGLE) / 2)
    panel = max(1, PANEL // max(1, len(y)))
    for at in range(0, len(x), panel):
        start = at if after else 0
        i, j = np.nonzero(left[at : at + panel] @ right[:, start:] >= least)
        i, j = i + at, j + start
        if after:
            i, j = i[i < j], j[i < j]
        yield i, j


def _links_of(cosine: float, kind: type):
    """Verifies one pair of tiles: how many copies each vector links with, and joining links."""

    def join(table: pa.Table) -> pa.Table:
        key, copies = (table.column(c).to_numpy() for c in ("key", "copies"))
        is_left = table.column("left").to_numpy(zero_copy_only=False)
        left, others = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        if not len(left):
            return _LINKS.empty_table()
        size = table.column("vector")[0].as_buffer().size // np.dtype(kind).itemsize
        parts, turn = _blocks(size), rotation(size)
        block = _block_of(table.column("cell")[0].as_py(), size)
        part, budget = parts[block], _budget(parts[block], size, cosine)
        data = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, size)
        turned, norm = np.empty((len(data), part.stop - part.start)), np.empty(len(data))
        for at in range(0, len(data), 1 << 13):
            some = slice(at, at + (1 << 13))
            x = _scaled(data[some])
            norm[some] = np.linalg.norm(x, axis=1)
            turned[some] = (x / norm[some, None]) @ turn[part].T
        names, name = np.unique(key, return_inverse=True)
        counts, forest = np.zeros(len(names), np.int64), Forest(len(names))
        itself = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for right, after in ((left, True), (others, False)) if itself else ((others, False),):
            for p, q in _near(turned[left], turned[right], budget, after):
                for at in range(0, len(p), 1 << 15):
                    a, b = left[p[at : at + (1 << 15)]], right[q[at : at + (1 << 15)]]
                    x, y = _scaled(data[a]), _scaled(data[b])
                    close = (x * y).sum(1) / (norm[a] * norm[b]) >= cosine
                    a, b = a[close], b[close]
                    apart = ((x[close] / norm[a, None] - y[close] / norm[b, None]) @ turn.T) ** 2
                    within = np.column_stack([apart[:, s].sum(1) <= _budget(s, size, cosine) for s in parts])
                    mine = within.argmax(axis=1) == block
                    a, b = a[mine], b[mine]
                    if len(a):
                        np.add.at(counts, name[a], copies[b])
                        np.add.at(counts, name[b], copies[a])
                        forest.join(name[a], name[b])
        linked, joined = np.flatnonzero(counts), np.array(forest.links, np.int64).reshape(-1, 2)
        columns = [np.concatenate([names[linked], names[joined[:, side]]]) for side in (0, 1)] + [np.concatenate([counts[linked], np.zeros(len(joined), np.int64)])]
        return pa.table([pa.array(c) for c in columns], schema=_LINKS)

    return join


def _block_of(cell: int, size: int) -> int:
    """The block in a cell's name: the name starts with the length, then 12 bits."""
    return cell >> max(0, cell.bit_length() - size.bit_length() - 12) & 0xFFF


class Forest:
    """Groups of the numbers below n, and the links that joined them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds links a[k] - b[k]; only those between different groups take a step each."""
        apart = self.root[a] != self.root[b]
        _, first = np.unique(np.column_stack([self.root[a[apart]], self.root[b[apart]]]), axis=0, return_index=True)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for x, y in zip(a[apart][first].tolist(), b[apart][first].tolist()):
            r, s = top(int(self.root[x])), top(int(self.root[y]))
            if r != s:
                parent[s] = r
                self.links.append((x, y))
        if parent:
            self.root[list(parent)] = list(map(top, list(parent)))
            self.root = self.root[self.root]


def _hash(column: str) -> Column:
    return F.xxhash64(column)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    rows = rows if kind is np.float32 else rows.withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(sound, F.col("vector"))).withColumn("hash", _hash("vector"))
    linked = rows.filter("vector is not null")
    # classes are numbered where they are written, so that vectors of one hash stay apart
    classes = written(linked.groupBy("hash", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")).withColumn("key", F.monotonically_increasing_id()))
    # each coordinate of the grid about halves a cell
    split = max(1, (classes.count() // tile).bit_length())
    # only cells of several tiles are listed: one row for a tile's worth of visits at most
    sizes = classes.select("vector").mapInArrow(_cell_counts(cosine, split), "cell long, own long, visiting long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("visiting").alias("visiting"))
    tiles = {r.cell: (max(1, -(-r.own // tile)), max(1, -(-r.visiting // tile))) for r in sizes.filter((F.col("own") > tile) | (F.col("visiting") > tile)).collect()}
    dealt = classes.select("key", "vector", "copies").mapInArrow(_deal(cosine, split, tiles), _DEALT)
    found = written(dealt.groupBy("cell", "i", "j").applyInArrow(_links_of(cosine, kind), "a long, b long, n long"))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.filter("a <> b")).withColumnRenamed("node", "key")
    rooted = classes.join(counts, "key", "left").join(parts, "key", "left").withColumn("root", F.coalesce("component", "key"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = rooted.join(lowest, "root").select("hash", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    same = linked.join(result, ["hash", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return same.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same by brute force in DuckDB, for tables of some thousand vectors.
ORACLE_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), parts AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM parts
"""
