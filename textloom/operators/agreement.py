"""Agreement between methods that find relations, and with curated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "target"]


def in_catalogue(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select(F.col(node).alias("_id"))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")


def referential(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose target is a known (slug, id), or whose target's catalogue is not known; no self edges.

    edges: slug, source, target_slug, target; known: slug, id.
    """
    slugs = known.select(F.col("slug").alias("target_slug")).distinct()
    ids = known.select(F.col("slug").alias("target_slug"), F.col("id").alias("target"))
    proper = edges.filter(~((F.col("slug") == F.col("target_slug")) & (F.col("source") == F.col("target"))))
    return proper.join(ids, ["target_slug", "target"], "left_semi").unionByName(proper.join(slugs, "target_slug", "left_anti"))


def without_null_keys(edges: DataFrame) -> DataFrame:
    return edges.dropna(subset=KEY)


def edges_of(edges: DataFrame, method: str, rel: str | None = None) -> DataFrame:
    """Distinct edges of a method, of one relation type if given."""
    chosen = edges.filter(F.col("method") == method)
    return (chosen if rel is None else chosen.filter(F.col("rel") == rel)).select(*KEY).distinct()


def overlap_classes(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Each edge of either set: in both, or in one only."""
    left, right = a.select(*keys, F.lit(1).alias("l")).distinct(), b.select(*keys, F.lit(1).alias("r")).distinct()
    kind = F.when(F.col("l").isNull(), "baseline_only").when(F.col("r").isNull(), "approach_only").otherwise("overlap")
    return left.join(right, keys, "full").select(*keys, kind.alias("kind"))


def typed_with_wildcards(pairs: DataFrame, typed: DataFrame, types: list[str]) -> DataFrame:
    """Untyped pairs take the types that the typed side has for them, else all types."""
    untyped = pairs.select(*KEY).distinct()
    seen = untyped.join(typed.select(*KEY, "rel").distinct(), KEY, "left")
    return seen.select(*KEY, F.explode(F.when(F.col("rel").isNotNull(), F.array("rel")).otherwise(F.array(*map(F.lit, types)))).alias("rel"))


def kappa(both: Column, a: Column, b: Column, universe: Column) -> Column:
    """Cohen's kappa of two sets of sizes a and b with ``both`` shared, over a universe; null where undefined."""
    agree = F.try_divide(universe - a - b + 2 * both, universe)
    chance = F.try_divide(a, universe) * F.try_divide(b, universe) + F.try_divide(universe - a, universe) * F.try_divide(universe - b, universe)
    return F.when((universe > 0) & (chance != 1), F.try_divide(agree - chance, 1 - chance))


def pairwise_agreement(edges: DataFrame, nodes: DataFrame, by: list[str] = KEY, types: int = 1) -> DataFrame:
    """For each ordered pair of methods: overlap, what only one has, hit rate and kappa.

    The universe are the ordered pairs of nodes, times the number of types in the typed scope.
    """
    sets = edges.select("method", *by).distinct()
    sizes = sets.groupBy("method").agg(F.count("*").alias("size"))
    mine, other = sets.withColumnRenamed("method", "approach"), sets.withColumnRenamed("method", "baseline")
    shared = mine.join(other, by).groupBy("approach", "baseline").agg(F.count("*").alias("overlap"))
    # a row for each method, and one for the number of nodes
    grid = sizes.toDF("approach", "approach_total").crossJoin(F.broadcast(sizes.toDF("baseline", "baseline_total")))
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    full = grid.join(shared, ["approach", "baseline"], "left").na.fill(0, ["overlap"]).crossJoin(n)
    universe = F.col("n") * (F.col("n") - 1) * types
    a, b, both = F.col("approach_total"), F.col("baseline_total"), F.col("overlap")
    return full.select(
        "approach", "baseline", "overlap", (a - both).alias("approach_only"), (b - both).alias("baseline_only"), (a + b - both).alias("union"),
        F.try_divide(both, b).alias("hit_rate"), kappa(both.cast("double"), a.cast("double"), b.cast("double"), universe.cast("double")).alias("kappa"),
    )


def evaluate(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1."""
    kinds = overlap_classes(predicted, gold, keys)
    tally = kinds.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(name) for k, name in (("overlap", "tp"), ("approach_only", "fp"), ("baseline_only", "fn"))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tally.select("tp", "fp", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def first_wins_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; of rows with one key, the earliest part's stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "_part")]
    # min_by folds on the map side: a key that many rows share is not gathered
    best = every.groupBy(key).agg(F.min(F.struct("_part", *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def replace_slice(edges: DataFrame, method: str, slice_: DataFrame) -> DataFrame:
    """Edges with one method's rows exchanged for another slice of that method."""
    return edges.filter(F.col("method") != method).unionByName(slice_.withColumn("method", F.lit(method)).select(*edges.columns))


def composition(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts and shares of each value of each dimension."""
    long = rows.unpivot([], [F.col(d).cast("string").alias(d) for d in dimensions], "dimension", "value")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def reciprocal_facts(edges: DataFrame) -> DataFrame:
    """Facts (newer, older) of supersession and whether both sides declare them.

    edges: source, target and rel, ``supersedes`` or ``superseded_by``.
    """
    forward = F.col("rel") == "supersedes"
    facts = edges.select(F.when(forward, F.col("source")).otherwise(F.col("target")).alias("newer"), F.when(forward, F.col("target")).otherwise(F.col("source")).alias("older"), "rel")
    return facts.groupBy("newer", "older").agg((F.min("rel") != F.max("rel")).alias("reciprocal"))
