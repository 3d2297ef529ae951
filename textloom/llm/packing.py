"""Best-fit packing of documents into token sequences, with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt in turn, in order
of length, to partitions of about ``target`` pieces (and ``LEAST_BINS`` bins), so that each
has its share of all lengths; each packs its own by best-fit decreasing and compares its bins
with a lower bound from dual-feasible functions.  It gives back its emptiest bins until the
room left in the others is within ``WASTE``, some of them also where its count is certified:
bounds of partitions are rounded up one by one, and what they lose together is bins.  The
documents of those bins are exchanged (dealt anew, to fewer partitions) and packed again,
until the pool fits one partition.  A partition gives back half of its bins at most, so
rounds grow with the logarithm of the input and need no cap.
``certificate`` holds the number of sequences against the bound of all pieces, from counts
of lengths (at most ``capacity`` rows).  Only piece descriptions move, never texts.

Cases: a null or empty text gives one piece with just the end id; a text of
exactly ``capacity`` ids is one full piece; repeated rows are packed as rows of
their own; an empty table gives an empty result; ties in length go by doc_id, piece;
columns besides doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from itertools import count
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.llm.bpe import LIBRARY_CHARS, library_encoder, slabs

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Pieces in a packing partition, about, and bins of one, at least.
TARGET, LEAST_BINS = 16_384, 1024
#: Bins given back by each partition, at least, and share of room that the bins it keeps may have.
RELEASE, WASTE = 4, 0.0002


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_encoder(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            i = 0
            for texts in slabs(batch.column(1), LIBRARY_CHARS):
                for _, ids in bpe.encode_slab(texts):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs at least."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The bound by two families of dual-feasible functions; counts: pieces of each length from 0 to capacity."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    # below e: nothing; above capacity - e: a whole bin; between: their own size
    tokens = np.concatenate([[0], np.cumsum(counts * sizes)])
    items = np.concatenate([[0], np.cumsum(counts)])
    e = np.arange(1, capacity // 2 + 1)
    rounded = (items[-1] - items[capacity - e + 1]) * capacity + tokens[capacity - e + 1] - tokens[e]
    best = max(best, int(np.max(-(-rounded // capacity))))
    # sizes in steps of 1 / (k + 1), kept where they fall on a step
    for k in range(2, 33):
        whole = (sizes * (k + 1)) % capacity == 0
        scaled = np.where(whole, sizes * k, (sizes * (k + 1)) // capacity * capacity)
        best = max(best, -(-int(counts @ scaled) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (sorted from the longest), and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r left
    left: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room = room - size
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins, offsets, left = best_fit_decreasing(lengths)
    gap = len(left) - lower_bound(lengths)
    emptiest = np.argsort(-left, kind="stable")
    # room and bins kept when so many bins and one more are given back
    room = left.sum() - np.cumsum(left[emptiest])
    tight = np.flatnonzero(room <= WASTE * CAPACITY * (len(left) - 1 - np.arange(len(left))))
    given = min(max(RELEASE, int(tight[0]) + 1 if len(tight) else len(left)), max(1, len(left) // 2))
    given_back = np.zeros(len(left), bool)
    given_back[emptiest[:given]] = left[emptiest[:given]] > 0
    out = pdf[["doc_id", "piece", "start", "length", "ids_crc32", "part"]].copy()
    out["bin"], out["offset"], out["gap"], out["released"] = bins, offsets, gap, given_back[bins]
    return out


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, gap long, released boolean"


def pack_pieces(pieces: DataFrame, target: int = TARGET, least_bins: int = LEAST_BINS) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    done, pool = [], pieces
    before = None
    for k in count():
        n, tokens = pool.agg(F.count("*"), F.sum("length")).first()
        if n == 0:
            break
        parts = max(1, min(math.ceil(n / target), tokens // (least_bins * CAPACITY)))
        dealt = pool.sortWithinPartitions("length").withColumn("part", F.pmod(F.monotonically_increasing_id() + k, F.lit(parts)))
        packed = written(dealt.groupBy("part").applyInPandas(_pack_group, _PACKED))
        # pieces that only partitions of one bin hold could come back for ever
        last = parts == 1 or n == before
        kept = packed if last else packed.filter(~F.col("released"))
        # bins of a partition are fewer than its pieces: 2^24 bins and 2^34 partitions are room enough
        done.append(kept.withColumn("sequence_id", (F.lit(k) * F.lit(1 << 34) + F.col("part")) * F.lit(1 << 24) + F.col("bin")))
        if last:
            break
        before, pool = n, packed.filter("released")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not done:
        done = [pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done])


def certificate(packed: DataFrame) -> tuple[int, int]:
    """The number of sequences, and the bound below which no packing of the same pieces can go."""
    counts = np.zeros(CAPACITY + 1, np.int64)
    for row in packed.groupBy("length").count().collect():  # at most CAPACITY rows
        counts[row["length"]] = row["count"]
    return packed.select("sequence_id").distinct().count(), bound_of_counts(counts)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return pack_pieces(written(tokenize_pieces(docs, tokenizer_path)))
