"""SimHash fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprints within ``RADIUS`` = 2 bits agree on at least two of four 16-bit blocks,
so each distinct fingerprint goes to six shards, keyed by two blocks and their values.
A shard holds its fingerprints in a BK-tree (children keyed by their whole Hamming
distance to the parent); each new fingerprint first searches the tree, following only
edges within the radius, then joins it.  A shard with many fingerprints is split by the
same rule on the bits that are still free: those shards agree on 48 bits and hold at most
2^16 fingerprints, whatever the input.  The forest of all trees has no size bound, so
fingerprints are sent to the shard trees instead of trees to all tasks.
Copies meet as one row; a shard gives links that join its own groups (a spanning forest),
which keeps every connection.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle are one shingle; repeated rows share all results; null ids stay rows, but
name no component; a bit that is set in exactly half the hashes is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.llm.bpe import slabs
from textloom.operators.components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints above which a shard is split on its free bits.
SHARD_MAX = 1024


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of so many words, ASCII letters lowered; none for no words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, n = b" ".join(words), len(words) - size + 1
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip([0, *ends], ends[size - 1 :])), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8")[0]


def fingerprints(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """Majority bits of each text's shingle hashes."""
    return np.array([majority_bits(shingle_hashes(text, size)) for text in texts], np.uint64)


def fingerprint_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprints(texts, size) for texts in slabs(batch.column(1))]
            values = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of all members at most so far away."""
        found, stack = [], [0] if self.nodes else []
        while stack:
            i = stack.pop()
            d = (self.nodes[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            children = self.children[i]
            if len(children) <= 2 * radius:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found

    def add(self, value: int) -> int:
        new = len(self.nodes)
        self.nodes.append(value)
        self.children.append({})
        i = 0
        while new:
            d = (self.nodes[i] ^ value).bit_count()
            nxt = self.children[i].get(d)
            if nxt is None:
                self.children[i][d] = new
                break
            i = nxt
        return new


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a shard that join its groups; the rest would close cycles."""
    tree, parent, out = BkTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        new = tree.add(value)
        parent.append(new)
        for i in near:
            if (r := root(i)) != root(new):
                parent[root(new)] = r
                out.append((value, tree.nodes[i]))
    return out


def _block(fp: Column, width: int, i: int) -> Column:
    return F.shiftrightunsigned(fp, width * i).bitwiseAND((1 << width) - 1)


def _agreeing(fp: Column, picks: list[tuple[int, int]]) -> Column:
    """Shard keys: for each pair of blocks (width, place), the pair and both values."""
    pairs = combinations(range(len(picks)), 2)
    return F.array(*[F.struct(F.lit(10 * i + j).alias("table"), F.shiftleft(_block(fp, *picks[i]), picks[j][0]).bitwiseOR(_block(fp, *picks[j])).alias("key")) for i, j in pairs])


def _free_bits(fp: Column, table: Column) -> Column:
    """In a shard of two agreeing 16-bit blocks, the other two side by side (32 bits)."""
    out = F.lit(None).cast("long")
    for i, j in combinations(range(4), 2):
        k, m = [x for x in range(4) if x not in (i, j)]
        out = F.when(table == 10 * i + j, F.shiftleft(_block(fp, 16, k), 16).bitwiseOR(_block(fp, 16, m))).otherwise(out)
    return out


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct longs of column fp that keep all connections within the radius."""
    shards = prints.select("fp", F.inline(_agreeing(F.col("fp"), [(16, i) for i in range(4)])))
    sizes = shards.groupBy("table", "key").count().filter("count > 1")
    shards = shards.join(sizes, ["table", "key"])
    small = shards.filter(F.col("count") <= SHARD_MAX).select("fp", "table", "key", F.lit(0).alias("subtable"), F.lit(0).cast("long").alias("subkey"))
    split = shards.filter(F.col("count") > SHARD_MAX).select("fp", "table", "key", F.inline(_agreeing(_free_bits(F.col("fp"), F.col("table")), [(8, i) for i in range(4)])).alias("subtable", "subkey"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            keys = np.stack(columns[1:])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            values = columns[0].view(np.uint64).tolist()
            links = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if (this := tuple(keys[:, i].tolist())) != shard:
                    links += spanning_links(members) if len(members) > 1 else []
                    shard, members = this, []
                members += values[i:j]
            yield _links(links)
        yield _links(spanning_links(members) if len(members) > 1 else [])

    key = ["table", "key", "subtable", "subkey"]
    dealt = small.unionByName(split).repartition(*key).sortWithinPartitions(*key, "fp")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each document."""
    prints = written(fingerprint_documents(docs))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(near_links(classes.select("fp")))
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(lowest, "root"), "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = group_documents) -> DataFrame:
    """The documents whose doc_id is their component's smallest, one row for each; all columns stay.

    Of rows with one doc_id any one stays; rows without an id name no group and all stay.
    """
    groups = written(grouped(docs))
    keep = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).select(F.struct("doc_id", "rows").alias("kept"))
    # docs as one column, so that no name of theirs can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    named = packed.join(keep, F.col("row.doc_id") == F.col("kept.doc_id"))
    single = named.filter("kept.rows = 1").select("row")
    repeated = named.filter("kept.rows > 1").select("row", "kept.doc_id").dropDuplicates(["doc_id"]).select("row")
    return single.unionByName(repeated).unionByName(packed.filter("row.doc_id is null")).select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
