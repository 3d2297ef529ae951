"""Fingerprints of content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its top bits are zero.
Chunk lengths are normalised: a stricter mask applies below ``NORMAL`` bytes, a looser
one above, within ``LEAST`` and ``MOST``.  Boundaries depend on the bytes near them
only, so an insertion moves chunks without changing their digests.  The fingerprint is
the set of chunk digests with lengths; likeness is containment weighted by length.

Documents are dealt in blocks that follow each other in descending order of ids; the
borders of the blocks are quantiles by bytes, so outlying and hash-like ids are no matter.

Cases: a null text counts as empty; an empty text has an empty fingerprint, like itself
(1) and like nothing else (0); equal texts have equal fingerprints; rows of one doc_id
follow each other by the hash of their texts, and may be dealt to several blocks; null ids
come last; an empty table gives an empty result; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import slabs

LEAST, NORMAL, MOST = 16, 48, 192
#: Zero bits asked for at the top of the hash: below and from NORMAL on.
STRICT_BITS, LOOSE_BITS = 6, 4
#: Bytes of texts in a block, about, or more where there would be over BLOCKS blocks.
BLOCK_BYTES, BLOCKS = 4 << 20, 1 << 16
#: Keys drawn for each block to place its border.
KEYS_A_BLOCK = 20

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_CHUNK = np.dtype([("digest", ">u8"), ("length", ">u2")])


def _candidates(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Places after which the strict and the loose mask allow a cut."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # sum of the last 32 bytes' values, each shifted by its age
        h[step:] += h[:-step] << np.uint32(step)
    return (np.flatnonzero(h < 1 << (32 - STRICT_BITS)) + 1).tolist(), (np.flatnonzero(h < 1 << (32 - LOOSE_BITS)) + 1).tolist()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    strict, loose = _candidates(np.frombuffer(data, np.uint8))
    out, at = [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        end = strict[i] if i < len(strict) else n
        if end >= at + NORMAL:
            i = bisect_left(loose, at + NORMAL)
            end = min(loose[i] if i < len(loose) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunk_set(data: bytes) -> np.ndarray:
    """Distinct chunks, sorted by digest."""
    digest, at, chunks = xxhash.xxh3_64_intdigest, 0, {}
    for end in cuts(data):
        chunks[digest(data[at:end])] = end - at
        at = end
    out = np.empty(len(chunks), _CHUNK)
    out["digest"] = np.fromiter(chunks, np.uint64, len(chunks))
    out["length"] = np.fromiter(chunks.values(), np.int64, len(chunks))
    return out[np.argsort(out["digest"])]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's chunk lengths whose chunks b has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = np.isin(a["digest"].astype(np.uint64), b["digest"].astype(np.uint64))
    return float(a["length"][shared].sum(dtype=np.int64) / a["length"].sum(dtype=np.int64))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each with its documents and then the next block's first one."""
    before = None  # (block, doc_id, text, chunks)
    for batch in batches:
        out, i = [], 0
        block, ahead, doc_id = (batch.column(k).to_pylist() for k in range(3))
        for texts in slabs(batch.column(3)):
            for text in texts:
                if before is not None and before[0] == block[i]:
                    same = before[2] == text
                    chunks = before[3] if same else chunk_set(text.encode())
                    out.append(_row(before, text, chunks))
                else:
                    chunks = chunk_set(text.encode())
                before = None if ahead[i] else (block[i], doc_id[i], text, chunks)
                i += 1
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _RESULT.split(", ")])


def _row(doc: tuple, following: str, following_chunks: np.ndarray) -> tuple:
    _, doc_id, text, chunks = doc
    changed = edited(text, following).encode()
    changed_chunks = chunk_set(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed).hexdigest(),
        chunks.tobytes().hex(),
        changed_chunks.tobytes().hex(),
        containment(chunks, changed_chunks),
        containment(chunks, following_chunks),
    )


#: What a row's place in the order is made of; ids without nulls, as nulls would make them floats.
_PLACE = ("no_id", "id", "digest", "row")


def _keys(rows: pd.DataFrame) -> np.ndarray:
    """Byte strings that sort as the rows do: descending id, nulls last, text hash, row number."""
    out = np.zeros((len(rows), 25), np.uint8)
    out[:, 0] = rows["no_id"]
    parts = [rows["id"].to_numpy(np.int64) ^ -1, rows["digest"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)]
    out[:, 1:] = (np.column_stack(parts).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8)
    return np.ascontiguousarray(out).view("S25").ravel()


def _borders(docs: DataFrame, block_bytes: int) -> np.ndarray:
    """Keys that cut the rows into blocks of about equal bytes, from a bounded sample of keys as Spark's own range partitioning does; they decide which task works, not results."""
    n, size = docs.agg(F.count("*"), F.sum("bytes")).first()
    blocks = min(BLOCKS, max(1, (size or 0) // block_bytes))
    if blocks == 1:
        return np.zeros(0, "S25")
    drawn = docs.select(*_PLACE, "bytes").sample(min(1.0, KEYS_A_BLOCK * blocks / n), seed=1).toPandas()
    keys = _keys(drawn)
    order = np.argsort(keys)
    reached = np.cumsum(drawn["bytes"].to_numpy(np.float64)[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, blocks) / blocks) if len(order) else np.zeros(0, np.int64)
    return np.unique(keys[order][at])


def fingerprint_with_next(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edit with the document next in descending doc_id.

    Each block also gets the first document of the one after it.  Texts are dealt once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # rows that agree in id and text are the same whatever their number
    docs = docs.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id(), "bytes": F.octet_length("text"), "no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    borders = _borders(docs, block_bytes)

    @F.pandas_udf("int")
    def block(key: pd.DataFrame) -> pd.Series:
        return pd.Series(np.searchsorted(borders, _keys(key), "right").astype(np.int32))

    docs = docs.withColumn("block", block(F.struct(*_PLACE)))
    # a head for each block: at most BLOCKS rows
    place = F.struct("no_id", F.bitwise_not("id").alias("order"), "digest", "row", "doc_id")
    heads = docs.groupBy("block").agg(F.min(place).alias("head")).select("block", "head.doc_id", "head.digest").orderBy("block").collect()
    after = [(heads[i - 1]["block"], *heads[i][1:]) for i in range(len(heads))]  # of the first one comes last
    following = docs.sparkSession.createDataFrame(after, "to int, head long, head_digest long")
    ahead = docs.join(F.broadcast(following), docs["doc_id"].eqNullSafe(following["head"]) & (docs["digest"] == following["head_digest"]))
    # rows of one id and text are one
    ahead = ahead.groupBy(F.col("to").alias("block"), "doc_id").agg(F.first("text").alias("text")).select("block", F.lit(True).alias("ahead"), "doc_id", "text", F.lit(0).cast("long").alias("digest"))
    rows = docs.select("block", F.lit(False).alias("ahead"), "doc_id", "text", "digest").unionByName(ahead)
    dealt = rows.repartition("block").sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), "digest").drop("digest")
    return dealt.mapInArrow(_rows, _RESULT)
