"""Results for every combination of a few sources, from one scan.

A source is a bit.  Rows are counted once by the mask of the sources that they need; the few
rows that are left then add up over all combinations that hold their mask (what lies within
a combination) or meet it (what any source of a combination has).  Adding up takes rows by
mask, never the table again, and no combination is a filter of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources at most: combinations double with each.
MOST_SOURCES = 12
#: Sections of a payload that combinations cannot merge.
NOT_MERGEABLE = ("classification", "conformity", "evolution")


def listed_sources(rows: DataFrame, source: str = "source", most: int = MOST_SOURCES) -> list[str]:
    """The sources of a table in order; an error if there are more than combinations allow."""
    found = sorted(r[0] for r in rows.select(source).filter(F.col(source).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} sources")
    return found


def masks(sources: list[str], least: int = 2) -> list[tuple[int, str]]:
    """mask and name (sources joined by +, in order) of every combination of at least so many sources."""
    sources = sorted(sources)
    named = ((m, [s for i, s in enumerate(sources) if m >> i & 1]) for m in range(1 << len(sources)))
    return [(m, "+".join(part)) for m, part in named if len(part) >= least]


def combinations(rows: DataFrame, source: str = "source", least: int = 2) -> DataFrame:
    """mask and combination of every two and more sources of a table."""
    return rows.sparkSession.createDataFrame(masks(listed_sources(rows, source), least), "mask int, combination string")


def bit(source: Column, sources: list[str]) -> Column:
    """The bit of a source, null for others."""
    place = F.array_position(F.array(*map(F.lit, sorted(sources))), source)
    return F.when(place > 0, F.call_function("shiftleft", F.lit(1), (place - 1).cast("int")))


def over_combinations(rows: DataFrame, mask: str, by: list[str], sources: list[str], within: bool) -> DataFrame:
    """combination, by and n: rows whose mask lies within each combination, or meets it."""
    partial = rows.filter(F.col(mask).isNotNull()).groupBy(*by, mask).agg(F.count("*").alias("_n"))
    every = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(name).alias("combination")) for m, name in masks(sources)])
    fits = (lambda c: F.col(mask).bitwiseAND(F.bitwise_not(c["mask"])) == 0) if within else (lambda c: F.col(mask).bitwiseAND(c["mask"]) != 0)
    spread = partial.select(*by, "_n", F.explode(F.filter(every, fits)).alias("_c"))
    return spread.groupBy(F.col("_c.combination").alias("combination"), *by).agg(F.sum("_n").alias("n"))


def combined_payload(nodes: DataFrame, edges: DataFrame, authored: DataFrame) -> DataFrame:
    """combination, section, name, value and status: what the sources of each combination have together.

    nodes: key, source.  edges: source, target (keys), method; an edge belongs to a combination
    that holds the sources of both ends, once for each method.  authored: source, author; an
    author belongs where any of an author's sources does.  Sections that cannot be merged have
    no value and say so.
    """
    sources = listed_sources(nodes)
    if len(sources) < 2:
        return nodes.select(F.lit("").alias("combination"), F.lit("").alias("section"), F.lit("").alias("name"), F.lit(0).cast("long").alias("value"), F.lit("").alias("status")).limit(0)
    own = nodes.select("key", bit(F.col("source"), sources).alias("mask")).filter("mask is not null").distinct()
    ends = edges.select("source", "target", "method").distinct()
    ends = ends.join(own.withColumnsRenamed({"key": "source", "mask": "_s"}), "source").join(own.withColumnsRenamed({"key": "target", "mask": "_t"}), "target")
    ends = ends.select("method", F.col("_s").bitwiseOR(F.col("_t")).alias("mask"), (F.col("_s") != F.col("_t")).alias("crossing"))
    people = authored.groupBy("author").agg(F.bit_or(bit(F.col("source"), sources)).alias("mask"))
    parts = [
        over_combinations(own, "mask", [], sources, True).select("combination", F.lit("dependencies").alias("section"), F.lit("nodes").alias("name"), "n"),
        over_combinations(ends, "mask", ["method"], sources, True).select("combination", F.lit("dependencies").alias("section"), F.concat(F.lit("edges "), "method").alias("name"), "n"),
        over_combinations(ends.filter("crossing"), "mask", [], sources, True).select("combination", F.lit("dependencies").alias("section"), F.lit("edges between sources").alias("name"), "n"),
        over_combinations(people, "mask", [], sources, False).select("combination", F.lit("authorship").alias("section"), F.lit("authors").alias("name"), "n"),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    spark = nodes.sparkSession
    apart = spark.createDataFrame([(name, section) for _, name in masks(sources) for section in NOT_MERGEABLE], "combination string, section string")
    merged = merged.select("combination", "section", "name", F.col("n").alias("value"), F.lit("merged").alias("status"))
    return merged.unionByName(apart.select("combination", "section", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("value"), F.lit("not_mergeable").alias("status")))


def expected_targets(listed: DataFrame) -> DataFrame:
    """combination and snapshot: the snapshots that all sources of a combination have (source, snapshot)."""
    sources = listed_sources(listed)
    if len(sources) < 2:
        return listed.select(F.col("source").alias("combination"), "snapshot").limit(0)
    held = listed.groupBy("snapshot").agg(F.bit_or(bit(F.col("source"), sources)).alias("has"))
    every = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(name).alias("combination")) for m, name in masks(sources)])
    return held.select(F.explode(F.filter(every, lambda c: c["mask"].bitwiseAND(F.bitwise_not(F.col("has"))) == 0)).alias("c"), "snapshot").select("c.combination", "snapshot")
