"""Rule checks with three outcomes (passed, failed, skipped) and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check of a standard; a null result means skipped."""

    id: str
    standard: str
    passed: Column
    category: str = ""


def assess(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """id, check, category, standard and passed: every rule on every document."""
    checks = [F.struct(F.lit(r.id).alias("check"), F.lit(r.category).alias("category"), F.lit(r.standard).alias("standard"), r.passed.cast("boolean").alias("passed")) for r in rules]
    return docs.select("id", F.inline(F.array(*checks)))


def _tally() -> list[Column]:
    return [F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("skipped")]


def score(passed: Column, failed: Column) -> Column:
    """Share of passed checks in percent to two places, half to even; null where none was evaluated."""
    return F.bround(F.try_divide(passed, passed + failed) * 100, 2)


def document_scores(checks: DataFrame) -> DataFrame:
    """Counts and score of each document, by standard and overall (null standard)."""
    sides = checks.groupingSets([["id"], ["id", "standard"]], "id", "standard").agg(*_tally())
    return sides.withColumn("score", score(F.col("passed"), F.col("failed")))


def check_summary(checks: DataFrame) -> DataFrame:
    """Counts and pass rate of each check."""
    return checks.groupBy("standard", "check").agg(*_tally()).withColumn("pass_rate", score(F.col("passed"), F.col("failed")))


def average_scores(scores: DataFrame) -> DataFrame:
    """Mean score by standard, documents without a score left out."""
    return scores.groupBy("standard").agg(F.avg("score").alias("mean"), F.count("score").alias("documents"))


def most_failed(checks: DataFrame, n: int = 10) -> DataFrame:
    """The n most failed checks of each standard, ties by check."""
    counts = checks.filter(~F.col("passed")).groupBy("standard", "check").agg(F.count("*").alias("documents"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("standard").orderBy(F.desc("documents"), "check"))).filter(F.col("position") <= n)


def failed_only(docs: DataFrame, column: str = "checks") -> DataFrame:
    """Documents with their failed checks' ids only, for payloads."""
    return docs.withColumn(column, F.transform(F.filter(column, lambda c: ~c["passed"]), lambda c: c["check"]))


def required(value: Column) -> Column:
    """Whether a field has a value: not null and not blank."""
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def valid_day(value: Column) -> Column:
    """Whether the text is a real day, year-month-day; null where empty."""
    return F.when(required(value), value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull())


def valid_contacts(value: Column) -> Column:
    """Whether every line is a name with an address in angle brackets; null where empty."""
    lines = F.filter(F.transform(F.split(value, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(required(value), F.forall(lines, lambda v: v.rlike(r"^[^<>]+ <[^<>@\s]+@[^<>\s]+>$")))


def valid_number_list(value: Column) -> Column:
    """Whether the text is a comma list of numbers; null where empty."""
    return F.when(required(value), value.rlike(r"^\s*\d+(\s*,\s*\d+)*\s*$"))


def latest_version(text: Column) -> Column:
    """The largest x.y.z in the text, by number; a version has no letter, digit or underscore on either side."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\w)\d+\.\d+\.\d+(?!\w)"), F.lit(0))
    versions = F.transform(found, lambda v: F.transform(F.split(v, r"\."), lambda x: x.try_cast("decimal(38,0)")))
    return F.array_join(F.transform(F.array_max(versions), lambda x: x.cast("string")), ".")


def in_header_order(names: Column, order: list[str]) -> Column:
    """Whether recognised names come in the given order, none twice."""
    places = F.filter(F.transform(names, lambda n: F.array_position(F.array(*map(F.lit, order)), n)), lambda p: p > 0)
    return (places == F.sort_array(places)) & (F.size(F.array_distinct(places)) == F.size(places))
