"""Ranks, concordance of rankings, and top lists.

Groups (methods, metrics) are few and may each hold most rows, so ranks come from counts of
scores in buckets between quantiles: no task orders a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles between which scores are dealt.
BUCKETS = 64


def _bucketed(rows: DataFrame, by: list[str], score: str, bucket: str) -> DataFrame:
    """Adds the number of the scores' bucket, ascending; a score that is a quantile has a bucket of its own."""
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(score, cuts, 10_000)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    # a row for each group: a short list
    return rows.join(F.broadcast(edges), by).withColumn(bucket, 2 * below + F.array_contains("_edges", F.col(score)).cast("int")).drop("_edges")


def larger_counts(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, score, larger (rows of the group with a larger score) and ties (with this one), a row for each score."""
    counts = _bucketed(scores.groupBy(*by, score).agg(F.count("*").alias("ties")), by, score, "_bucket")
    totals = counts.groupBy(*by, "_bucket").agg(F.sum("ties").alias("_n"))
    # at most 2 BUCKETS rows of a group
    above = totals.select(*by, "_bucket", (F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("_bucket"))) - F.col("_n")).alias("_above"))
    within = F.sum("ties").over(Window.partitionBy(*by, "_bucket").orderBy(F.desc(score))) - F.col("ties")
    return counts.withColumn("_within", within).join(F.broadcast(above), [*by, "_bucket"]).select(*by, score, (F.col("_above") + F.col("_within")).alias("larger"), "ties")


def competition_rank(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Rank 1, 1, 3 from the largest score within each group."""
    ranked = scores.join(larger_counts(scores, by, score), [*by, score])
    return ranked.select(*scores.columns, (F.col("larger") + 1).cast("int").alias("rank"))


def average_rank(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean rank of ties, from the largest score."""
    ranked = scores.join(larger_counts(scores, by, score), [*by, score])
    return ranked.select(*scores.columns, (F.col("larger") + 1 + (F.col("ties") - 1) / 2.0).alias("average_rank"))


def kendall_w(scores: DataFrame, by: list[str], judge: str = "judge", item: str = "item", score: str = "score") -> DataFrame:
    """Kendall's W with tie correction of each group's judges, within 0 and 1; null where undefined."""
    ranks = average_rank(scores, [*by, judge], score)
    # cubes of a million and more are beyond a long
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cubed = lambda c: wide(c) * wide(c) * wide(c) - wide(c)
    ties = scores.groupBy(*by, judge, score).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(cubed("t")).alias("ties"), F.countDistinct(judge).alias("m"))
    sums = ranks.groupBy(*by, item).agg(F.sum("average_rank").alias("r"))
    # squared deviations from the mean rank sum m (n + 1) / 2, from sums that add up in any order
    spread = sums.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("r").alias("rs"), F.count("*").alias("n"))
    s = F.col("rr") - F.col("rs") * F.col("rs") / F.col("n")
    below = (wide("m") * wide("m") * cubed("n") - wide("m") * F.col("ties")).cast("double")
    return spread.join(ties, by).select(*by, F.when((F.col("n") > 1) & (F.col("m") > 1) & (below > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(12 * s, below)))).alias("w"))


def signed_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Concordant less discordant pairs of points with counts, by merging halves in order of y."""
    order = np.lexsort((y, x))
    x, y, c = x[order], np.unique(y[order], return_inverse=True)[1], c[order].astype(np.int64)
    total = 0
    # blocks of equal x never pair with themselves; a pair counts where its two halves are merged
    width = 1
    block = np.cumsum(np.concatenate([[0], (x[1:] != x[:-1]).astype(np.int64)])) if len(x) else np.zeros(0, np.int64)
    n = int(block[-1]) + 1 if len(x) else 0
    while width < n:
        group = block // (2 * width)
        left = (block // width) % 2 == 0
        key = group * (int(y.max()) + 1) + y
        at = np.argsort(key, kind="stable")
        k, g, is_left, w = key[at], group[at], left[at], c[at]
        lefts = np.cumsum(np.where(is_left, w, 0))
        first = np.searchsorted(g, g, "left")
        base = np.where(first > 0, lefts[np.maximum(first, 1) - 1], 0)
        whole = lefts[np.searchsorted(g, g, "right") - 1] - base
        lo, hi = np.searchsorted(k, k, "left"), np.searchsorted(k, k, "right")
        below = np.where(lo > 0, lefts[np.maximum(lo, 1) - 1], 0) - base
        above = whole - (lefts[hi - 1] - base)
        total += int(((below - above) * w)[~is_left].sum())
        width *= 2
    return total


def kendall_tau_b(scores: DataFrame, by: list[str], item: str = "item", x: str = "x", y: str = "y") -> DataFrame:
    """Kendall's tau-b of two scores of the items of each group; null where undefined.

    Items are counted by (x, y), and both scores dealt into buckets between quantiles.  Pairs that
    differ in both buckets come from counts of bucket pairs; others are counted inside one bucket of x
    or of y in n log n steps, and pairs in one bucket of both once less.
    """
    cells = scores.groupBy(*by, x, y).agg(F.count("*").alias("c"))
    dealt = _bucketed(_bucketed(cells, by, x, "_x"), by, y, "_y")
    parts = F.array(*[F.struct(F.lit(k).alias("_kind"), a.alias("_a"), b.alias("_b")) for k, a, b in ((1, F.col("_x"), F.lit(-1)), (2, F.lit(-1), F.col("_y")), (3, F.col("_x"), F.col("_y")))])
    local = dealt.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "c", F.inline(parts))
    # one value of either score makes no pairs; a score that many share is such a bucket
    keys = [*by, "_kind", "_a", "_b"]
    mixed = local.groupBy(*keys).agg((F.min("x") < F.max("x")).alias("_dx"), (F.min("y") < F.max("y")).alias("_dy")).filter("_dx and _dy").select(*keys)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.select(*by).schema)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        s = signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["c"].to_numpy())
        return pd.DataFrame([[*pdf[by].iloc[0], -s if pdf["_kind"].iloc[0] == 3 else s]], columns=[*by, "s"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((4 * BUCKETS, 4 * BUCKETS), np.int64)
        table[pdf["_x"], pdf["_y"]] = pdf["c"]
        sums = np.zeros((4 * BUCKETS + 1, 4 * BUCKETS + 1), np.int64)
        sums[1:, 1:] = table.cumsum(axis=0).cumsum(axis=1)
        i, j = np.nonzero(table)
        lower = sums[i, j]
        higher = sums[i, -1] - sums[i, j + 1]
        return pd.DataFrame([[*pdf[by].iloc[0], int(((lower - higher) * table[i, j]).sum())]], columns=[*by, "s"])

    one = local.join(mixed, keys, "left_semi").groupBy(*keys).applyInPandas(inside, f"{names}, s long")
    # at most (2 BUCKETS)^2 rows of a group
    two = dealt.groupBy(*by, "_x", "_y").agg(F.sum("c").alias("c")).groupBy(*by).applyInPandas(across, f"{names}, s long")
    score = one.unionByName(two).groupBy(*by).agg(F.sum("s").alias("s"))

    def tied(column: str | None) -> DataFrame:
        sizes = cells.groupBy(*by, *([column] if column else [])).agg(F.sum("c").alias("t"))
        return sizes.groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias(f"ties_{column}"))

    full = tied(None).join(tied(x), by).join(tied(y), by).join(score, by, "left")
    below = F.sqrt((F.col("ties_None") - F.col(f"ties_{x}")).cast("double")) * F.sqrt((F.col("ties_None") - F.col(f"ties_{y}")).cast("double"))
    return full.select(*by, F.when(below > 0, F.try_divide(2.0 * F.coalesce("s", F.lit(0)), below)).alias("tau"))


def in_every_group(nodes: DataFrame, groups: DataFrame, node: str = "item") -> DataFrame:
    """Every node with every group; groups are a short list.

    Nodes are dealt anew and stay where they are: a file of few bytes holds a million names,
    and one task would otherwise make the rows of all groups.
    """
    return nodes.select(node).repartition(node).crossJoin(F.broadcast(groups))


def score_grid(nodes: DataFrame, scores: DataFrame, by: list[str], node: str = "item") -> DataFrame:
    """A score for every node in every group, 0 where none."""
    # methods and metrics: a short list
    return in_every_group(nodes, scores.select(*by).distinct(), node).join(scores, [*by, node], "left").select(*by, node, F.coalesce("score", F.lit(0)).alias("score"))


def top_n(scores: DataFrame, by: list[str], n: int, score: str = "score", tie: str = "item") -> DataFrame:
    """The n largest of each group, ties by key."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scores.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def highlights(top: DataFrame, item: str = "item", order: str = "seq") -> DataFrame:
    """Items in more than one top list, numbered by how many, then by first place."""
    seen = top.groupBy(item).agg(F.count("*").alias("cells"), F.min(order).alias("first")).filter("cells > 1")
    return seen.withColumn("index", F.row_number().over(Window.orderBy(F.desc("cells"), "first", item)) - 1)
