"""Staleness by digests: order-free digests of key ranges in a tree, so that only ranges that differ are compared.

A leaf holds the rows whose key hashes into a range; its digest is the number of rows and the
sums of two hashes of them, which any order of rows and any partitioning give alike, and in
which repeated rows count as often as they occur.  A node above sums its children.  Digests of
a stored payload can be kept beside it: a payload that has not changed is then known by one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root, each of which splits a range in 2^STEP.
LEVELS = 3
STEP = 4


def _leaf(key: list[str], levels: int, step: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(1 << (levels * step)))


def _row_hashes(columns: list[str]) -> list[Column]:
    """Two hashes of a row; a marker for each null keeps (null, x) and (x, null) apart."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (1, 2)]


def digest_tree(rows: DataFrame, key: list[str], levels: int = LEVELS, step: int = STEP) -> DataFrame:
    """level (0: the root), range, n, first and second: the digests of all ranges that hold rows."""
    one, two = _row_hashes(sorted(rows.columns))
    leaves = rows.groupBy(_leaf(key, levels, step).alias("range")).agg(F.count("*").alias("n"), F.sum(one).alias("first"), F.sum(two).alias("second"))
    ups = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("range") / (1 << ((levels - k) * step))).alias("at")) for k in range(levels + 1)])
    spread = leaves.select(F.explode(ups).alias("u"), "n", "first", "second")
    return spread.groupBy(F.col("u.level").alias("level"), F.col("u.at").alias("range")).agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second"))


def differing_ranges(one: DataFrame, other: DataFrame, level: int | None = None) -> DataFrame:
    """level and range whose digests differ or that one tree lacks; of one level where it is given."""
    left, right = (t if level is None else t.filter(F.col("level") == level) for t in (one, other))
    right = right.select("level", "range", *[F.col(c).alias(f"_{c}") for c in ("n", "first", "second")])
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("first").eqNullSafe(F.col("_first")) & F.col("second").eqNullSafe(F.col("_second"))
    return left.join(right, ["level", "range"], "full").filter(~same).select("level", "range")


def is_stale(stored: DataFrame, computed: DataFrame) -> bool:
    """Whether the roots of two trees differ."""
    return not differing_ranges(stored, computed, 0).isEmpty()


def stale_rows(stored: DataFrame, computed: DataFrame, key: list[str], levels: int = LEVELS, step: int = STEP) -> DataFrame:
    """Rows that only the stored or only the newly computed payload has, repeats counted, with side and range.

    Only rows of ranges with unequal digests are compared; the list of ranges has 2^(levels step) rows at most.
    """
    computed = computed.select(*stored.columns)
    changed = differing_ranges(digest_tree(stored, key, levels, step), digest_tree(computed, key, levels, step), levels).select("range")
    sides = []
    for rows in (stored, computed):
        sides.append(rows.withColumn("range", _leaf(key, levels, step)).join(F.broadcast(changed), "range", "left_semi"))
    a, b = sides
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("computed")))
