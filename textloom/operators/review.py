"""Reviewed entities and curated relations: validation, sampling and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def valid_iso_day(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def edge_violations(edges: DataFrame, slugs: list[str], kinds: list[str]) -> DataFrame:
    """source, target and rule of each broken rule of curated edges (text columns source, target, rel, reviewer, reviewed_at)."""
    key = r"^[a-z0-9_-]+:\S+$"
    pair = Window.partitionBy("source", "target")
    seen = edges.withColumns({"_same": F.count("*").over(Window.partitionBy("source", "target", "rel")), "_low": F.min("rel").over(pair), "_high": F.max("rel").over(pair)})
    rules = {
        "bad key": ~(F.col("source").rlike(key) & F.col("target").rlike(key)),
        "unknown catalogue": ~(F.split_part("source", F.lit(":"), F.lit(1)).isin(slugs) & F.split_part("target", F.lit(":"), F.lit(1)).isin(slugs)),
        "unknown type": ~F.coalesce(F.col("rel").isin(kinds), F.lit(False)),
        "no reviewer": F.coalesce(F.trim("reviewer"), F.lit("")) == "",
        "bad day": ~valid_iso_day(F.col("reviewed_at")),
        "duplicate": F.col("_same") > 1,
        "conflicting types": F.col("_low") != F.col("_high"),
    }
    found = F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()])
    return seen.select("source", "target", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def violation_summary(violations: DataFrame, examples: int = 5) -> DataFrame:
    """Counts by rule with the first examples in order."""
    ranked = violations.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy("source", "target")))
    shown = ranked.filter(F.col("_n") <= examples).groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("examples"))
    return violations.groupBy("rule").agg(F.count("*").alias("n")).join(shown, "rule")


def era_buckets(docs: DataFrame, k: int, day: str = "created", key: str = "id") -> DataFrame:
    """Bucket min(rank * k // n, k - 1) of dated documents in order of their day; undated ones: null.

    Ranks come from counts by day, so no task sorts all documents.
    """
    per_day = docs.filter(F.col(day).isNotNull()).groupBy(day).agg(F.count("*").alias("_c"))
    before = per_day.withColumn("_before", F.sum("_c").over(Window.orderBy(day)) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    within = F.row_number().over(Window.partitionBy(day).orderBy(key)) - 1
    ranked = docs.filter(F.col(day).isNotNull()).withColumn("_rank", within).join(before, day)
    bucket = F.least(F.floor((F.col("_before") + F.col("_rank")) * k / F.col("_n")), F.lit(k - 1)).cast("int")
    dated = ranked.withColumn("bucket", bucket).select(*docs.columns, "bucket")
    return dated.unionByName(docs.filter(F.col(day).isNull()).withColumn("bucket", F.lit(None).cast("int")))


def density_bucket(out_degree: Column, high: int) -> Column:
    return F.when(out_degree <= 0, "none").when(out_degree < high, "low").otherwise("high")


def stratified_sample(candidates: DataFrame, strata: list[str], n: int, seed: int, key: str = "id") -> DataFrame:
    """n candidates, one from each stratum in turn, in an order drawn by a hash of key and seed."""
    draw = F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return candidates.withColumn("draw", draw).filter(F.col("draw") <= n).orderBy("draw", *strata).limit(n)


def in_review_window(rows: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows reviewed in the window (bounds in either order); rows without a day never count."""
    bounds = sorted(b for b in (first, last) if b)
    out = rows.filter(F.col(day).isNotNull())
    if first and last:
        return out.filter(F.col(day).between(*bounds))
    if first:
        return out.filter(F.col(day) >= first)
    return out.filter(F.col(day) <= last) if last else out


def parse_focus(text: str) -> list[tuple[int | None, int | None, str | None]]:
    """``1-9,30-44,85,A0`` as ranges (low, high, None) and literal ids (None, None, id)."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        if dash and low.isdigit() and high.isdigit():
            out.append((*sorted((int(low), int(high))), None))
        else:
            out += [(None, None, part)] + ([(None, None, part.upper())] if part.upper() != part else [])
    return out


def in_focus(docs: DataFrame, text: str, key: str = "id") -> DataFrame:
    """Documents whose id is in the focus: a filter, so it reaches the scan."""
    number = F.col(key).try_cast("long")
    tests = [number.between(low, high) if literal is None else F.col(key).cast("string") == literal for low, high, literal in parse_focus(text)]
    return docs.filter(reduce(Column.__or__, tests, F.lit(False)))


def filter_ranges(spark: SparkSession, expression: str, sources: list[str]) -> DataFrame:
    """source, low, high and id of an expression like ``SRC 3-7, SRC, 12``; parts without a source mean all."""
    rows = []
    for part in filter(None, (p.strip() for p in expression.split(","))):
        head, _, rest = part.partition(" ")
        named = [s for s in sources if s.lower() == head.lower()]
        over, body = (named, rest.strip()) if named else (sources, part)
        low, dash, high = body.partition("-")
        for s in over:
            if not body:
                rows.append((s, None, None, None))
            elif dash and low.strip().isdigit() and high.strip().isdigit():
                rows.append((s, *sorted((int(low), int(high))), None))
            else:
                rows.append((s, None, None, body.lstrip("0") or body))
    return spark.createDataFrame(rows, "source string, low long, high long, id string")


def matching(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents (source, id) that any range or id asks for: a semi join with the short parsed list."""
    d, r = docs.alias("d"), F.broadcast(ranges.alias("r"))
    number = F.col("d.id").try_cast("long")
    every = F.col("r.low").isNull() & F.col("r.id").isNull()
    return d.join(r, (F.col("d.source") == F.col("r.source")) & (every | number.between(F.col("r.low"), F.col("r.high")) | (F.col("d.id").cast("string") == F.col("r.id"))), "left_semi")


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and adjoining ranges (low, high) of each group as one."""
    order = Window.partitionBy(*by).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("low") > reach + 1), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*by, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def latest_runs(runs: DataFrame, by: list[str], succeeded: bool = True) -> DataFrame:
    """The newest run (run_id, timestamp, status) of each group, ties by run_id; only successful ones if asked."""
    chosen = runs.filter("status = 'success'") if succeeded else runs
    fields = [c for c in runs.columns if c not in by]
    return chosen.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct("timestamp", "run_id")).alias("run")).select(*by, "run.*")
