"""Relations named in headers and found by models, as targets of one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.references import Source, number_of, resolve_target

#: How sure a finding may be, and what one is without a known type.
CONFIDENCES = ("low", "medium", "high")
DEFAULT_TYPE = "references"


def _place(key: Column, sources: list[Source]) -> Column:
    """What targets sort by: the order of sources, then the number of the id, then the id."""
    slug, rest = F.substring_index(key, ":", 1), F.substring(key, F.instr(key, ":") + 1, F.length(key))
    order = F.array_position(F.array(*[F.lit(s.slug) for s in sources]), slug)
    number = F.lit(None).cast("long")
    for s in sources:
        number = F.when(slug == s.slug, number_of(rest, s)).otherwise(number)
    return F.struct(order.alias("source"), number.alias("number"), rest.alias("id"))


def header_targets(fields: DataFrame, sources: list[Source], own: Source) -> DataFrame:
    """id, type, position (from 1) and target of relations in header fields (id, type, value: a comma list).

    Items that are no reference are left out; a target counts once for each type.  All within a row.
    """
    keys = F.transform(F.split("value", ","), lambda item: resolve_target(F.trim(item), sources, own))
    found = F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))
    placed = F.array_sort(F.transform(found, lambda k: F.struct(_place(k, sources).alias("place"), k.alias("target"))))
    rows = fields.select("id", "type", F.posexplode(F.transform(placed, lambda x: x["target"])).alias("pos", "target"))
    return rows.select("id", "type", (F.col("pos") + 1).alias("position"), "target")


def model_findings(findings: DataFrame, sources: list[Source], own: Source, types: list[str]) -> DataFrame:
    """id, target, type, evidence, reason and confidence of a model's findings (id, pos, target, type, evidence, reason, confidence).

    A finding about the document itself, or without a target, goes; of several about one target
    the first stays; an unknown type is a reference, and an unknown confidence low.
    """
    key = resolve_target(F.trim("target"), sources, own)
    self_key = resolve_target(F.col("id").cast("string"), sources, own)
    known = findings.select("id", "pos", "type", "evidence", "reason", "confidence", key.alias("_key"), self_key.alias("_self")).filter("_key is not null and not _key <=> _self")
    text = lambda c: F.coalesce(F.trim(F.col(f"_first.{c}")), F.lit("")).alias(c)
    first = known.groupBy("id", F.col("_key").alias("target")).agg(F.min_by(F.struct("type", "evidence", "reason", "confidence"), "pos").alias("_first"))
    lowered = lambda c: F.lower(F.trim(F.col(f"_first.{c}")))
    one_of = lambda c, allowed, default: F.when(F.coalesce(lowered(c).isin(list(allowed)), F.lit(False)), lowered(c)).otherwise(default).alias(c)
    return first.select("id", "target", one_of("type", types, DEFAULT_TYPE), text("evidence"), text("reason"), one_of("confidence", CONFIDENCES, "low"))
