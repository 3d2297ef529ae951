"""Groups of near copies: word shingles whose exact Jaccard similarity is SIMILARITY or more.

Each set of shingles has a SimHash fingerprint, and fingerprints within ``simhash.RADIUS``
bits, found by its BK-trees, are candidates: equal and nearly equal texts.  Two texts of
similarity 0.8 are expected to differ in some ten of 64 bits, and in up to twenty; no block
of the bits is then sure to agree, so the radius alone cannot find them.  Candidates also
share a band of MinHash values: a pair of similarity 0.8 has none of the ``BANDS`` bands of
``ROWS`` values in common in (1 - 0.8^4)^24 = 3 of a million cases, a closer pair less
often.  Candidates of both kinds are joined to components; in each component every link is
held against the exact sets of shingles, and only pairs that pass are linked.
Texts with one set of shingles meet as one row; a component gives links that join its
groups (a spanning forest), which keeps every connection.

Cases: null and empty texts have no shingles and are copies of each other; fewer words than
a shingle are one shingle; rows of one doc_id share a group if one of them has it; null ids
are not grouped.
"""

from __future__ import annotations

from math import ceil
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.llm.bpe import slabs
from textloom.llm.simhash import majority_bits, near_links, shingle_hashes
from textloom.operators.components import connected_components

SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 24, 4
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
_KIND = pa.list_(pa.int64())


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text or "", size))


def body_of(shingles: np.ndarray) -> int:
    """One signed long for each set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A signed long for each band of MinHash values; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return ((least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is SIMILARITY or more."""
    over, under = SIMILARITY
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * under >= (len(a) + len(b) - both) * over


class Groups:
    """Links that join the groups of one component; the rest would close cycles."""

    def __init__(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.prefixes: dict[int, set[int]] = {}
        self.members: list[list[int]] = []
        self.links: list[tuple[int, int]] = []

    def add(self, shingles: np.ndarray) -> None:
        body, n = body_of(shingles), len(shingles)
        if body in self.sets:
            return
        # sets that are alike share one of so many smallest shingles
        prefix = set(shingles[: n - ceil(n * SIMILARITY[0] / SIMILARITY[1]) + 1].tolist())
        joined, apart = [body], []
        for group in self.members:
            near = next((m for m in group if not prefix.isdisjoint(self.prefixes[m]) and alike(shingles, self.sets[m])), None)
            if near is None:
                apart.append(group)
                continue
            self.links.append((body, near))
            if len(group) > len(joined):
                group, joined = joined, group
            joined += group
        self.members = [*apart, joined]
        self.sets[body], self.prefixes[body] = shingles, prefix


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, prints, keys = [], [], []
        for texts in slabs(batch.column(1)):
            for text in texts:
                shingles = shingle_set(text)
                bodies.append(body_of(shingles))
                prints.append(majority_bits(shingles))
                keys.append(bands(shingles))
        fps = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.int64()), pa.array(fps), pa.array(keys, _KIND)], ["doc_id", "body", "fp", "bands"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    this, groups = None, Groups()
    for batch in batches:
        parts, at = batch.column(0).to_pylist(), 0
        for texts in slabs(batch.column(1)):
            for text in texts:
                if parts[at] != this:
                    yield _links(groups.links)
                    this, groups = parts[at], Groups()
                groups.add(shingle_set(text))
                at += 1
    yield _links(groups.links)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def near_prints(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of bodies that join all whose fingerprints (column fp) are equal or linked within the radius."""
    heads = written(classes.groupBy("fp").agg(F.min("body").alias("head"), F.count("*").alias("rows")))
    links = near_links(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head")) for side in ("a", "b")]
    apart = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    alike_prints = classes.join(heads.filter("rows > 1"), "fp").filter("body <> head").select(F.col("body").alias("a"), F.col("head").alias("b"))
    return apart.unionByName(alike_prints)


def near_bands(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of bodies that join all that share a band (column bands)."""
    keyed = classes.select("body", F.explode("bands").alias("key"))
    least = keyed.withColumn("least", F.min("body").over(Window.partitionBy("key")))
    return least.filter("body > least").select(F.col("body").alias("a"), F.col("least").alias("b"))


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each row that has an id; the component is named by its smallest."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(texts.mapInArrow(_sketches, "doc_id long, body long, fp long, bands array<long>"))
    # texts of one body have one set of shingles, so one fingerprint and the same bands
    classes = written(sketches.groupBy("body").agg(F.min("doc_id").alias("first_id"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    parts = connected_components(near_prints(classes).unionByName(near_bands(classes)))
    asked = written(classes.join(parts, F.col("body") == F.col("node")).select(F.col("first_id").alias("_asked"), "component").distinct())
    held = texts.join(asked, F.col("doc_id") == F.col("_asked")).select("component", "text")
    links = held.repartition("component").sortWithinPartitions("component").mapInArrow(_verified, "a long, b long")
    groups = connected_components(links).withColumnRenamed("node", "body")
    rooted = classes.select("body", "first_id").join(groups, "body", "left").withColumn("root", F.coalesce("component", "body"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return sketches.select("doc_id", "body").join(rooted.select("body", "root").join(lowest, "root"), "body").select("doc_id", "component_id")
