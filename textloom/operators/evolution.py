"""Status timelines: events, regimes of validity, calendar periods and their counts.

events: entity, date, seq, status.  The state of an entity is that of its last event by (date, seq).
Regimes and periods are short configured lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Regime:
    """A standard that holds from one day to another (both included, None: open)."""

    standard: str
    valid_from: date | None = None
    valid_until: date | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    transitions: dict[str, str] = field(default_factory=dict)


def _ordered(columns: tuple[str, ...] = ("date", "seq")):
    return Window.partitionBy("entity").orderBy(*columns)


def standard_on(regimes: list[Regime], day: Column) -> Column:
    """The first regime whose window holds the day, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(regimes):
        inside = day.isNotNull()
        if r.valid_from:
            inside &= day >= F.lit(r.valid_from)
        if r.valid_until:
            inside &= day <= F.lit(r.valid_until)
        out = F.when(inside, F.lit(r.standard)).otherwise(out)
    return out


def event_standard(regimes: list[Regime], day: Column, given: Column, owners: dict[str, str], status: Column) -> Column:
    """By date, else as given, else the only standard that knows the status, else empty."""
    owner = F.try_element_at(F.create_map(*[F.lit(x) for kv in owners.items() for x in kv]), status) if owners else F.lit(None).cast("string")
    return F.coalesce(standard_on(regimes, day), F.nullif(F.trim(given), F.lit("")), owner, F.lit(""))


def map_status(regime: Regime, status: Column) -> Column:
    """The regime's alias, else its transition, else the status itself."""

    def lookup(pairs: dict[str, str]) -> list[Column]:
        return [F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), status)] if pairs else []

    return F.coalesce(*lookup(regime.aliases), *lookup(regime.transitions), status)


def changes(events: DataFrame, columns: tuple[str, ...] = ("status",)) -> DataFrame:
    """Events whose values differ from the entity's event before."""
    state = F.struct(*columns)
    # a null lag: no event before
    return events.withColumn("_last", F.lag(state).over(_ordered())).filter(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(state)).drop("_last")


def with_previous(events: DataFrame) -> DataFrame:
    """Events with the status before them."""
    return events.withColumn("previous", F.lag("status").over(_ordered()))


def seed_events(events: DataFrame, created: DataFrame, status: str) -> DataFrame:
    """A first event on each entity's day of creation (entity, created) that lies before its events."""
    first = events.groupBy("entity").agg(F.min("date").alias("_first"))
    seeds = created.join(first, "entity").filter("created < _first").select("entity", F.col("created").alias("date"), F.lit(-1).cast("long").alias("seq"), F.lit(status).alias("status"))
    return events.unionByName(seeds)


def fallback_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """One event for each entity (entity, created, status) that has none."""
    missing = entities.join(events, "entity", "left_anti")
    return events.unionByName(missing.select("entity", F.col("created").alias("date"), F.lit(0).cast("long").alias("seq"), "status"))


def state_before(events: DataFrame, day: date, strict: bool = True) -> DataFrame:
    """Each entity's last status before the day (or on it)."""
    seen = events.filter(F.col("date") < F.lit(day) if strict else F.col("date") <= F.lit(day))
    return seen.groupBy("entity").agg(F.max_by("status", F.struct("date", "seq")).alias("status"))


def with_transitions(events: DataFrame, regimes: list[Regime]) -> DataFrame:
    """Adds, at each regime's start, the mapped status of entities that changes and have no event that day.

    Starts are taken in order of time: later ones see the events that earlier ones added.
    """
    out = events.withColumn("synthetic", F.lit(False))
    for r in sorted((r for r in regimes if r.valid_from), key=lambda r: r.valid_from):
        day = F.lit(r.valid_from)
        on_day = out.filter(F.col("date") == day).select("entity").distinct()
        before = state_before(out, r.valid_from).join(on_day, "entity", "left_anti")
        mapped = before.withColumn("new", map_status(r, F.col("status"))).filter("new <> status")
        out = out.unionByName(mapped.select("entity", day.alias("date"), F.lit(-1).cast("long").alias("seq"), F.col("new").alias("status"), F.lit(True).alias("synthetic")))
    return out


def quarter_label(day: Column) -> Column:
    return F.format_string("%d-Q%d", F.year(day), F.quarter(day))


def periods(spark: SparkSession, first: date, last: date, milestones: list[date] = ()) -> DataFrame:
    """Quarters (key, start, end, label); a quarter with a milestone is split before it, but not on its first day."""
    quarters = spark.range(1).select(F.explode(F.expr(f"sequence(date_trunc('quarter', date'{first}')::date, date'{last}', interval 3 months)")).alias("start"))
    end = F.date_add(F.add_months("start", 3), -1)
    inside = F.array(*map(F.lit, sorted(milestones))) if milestones else F.array().cast("array<date>")
    cut = F.get(F.filter(inside, lambda m: (m > F.col("start")) & (m <= end)), F.lit(0))
    whole = F.struct(F.col("start"), end.alias("end"), F.lit("").alias("suffix"))
    parts = F.array(F.struct(F.col("start"), F.date_add(cut, -1).alias("end"), F.lit("a").alias("suffix")), F.struct(cut.alias("start"), end.alias("end"), F.lit("b").alias("suffix")))
    rows = quarters.select(quarter_label(F.col("start")).alias("label"), F.inline(F.when(cut.isNotNull(), parts).otherwise(F.array(whole))))
    return rows.select(F.concat("label", "suffix").alias("key"), "start", "end", "label")


def state_at_periods(events: DataFrame, spans: DataFrame) -> DataFrame:
    """entity, key and status at the end of each period from the entity's first event on.

    Each event holds from its date to the day before the next one's: one sort by entity, then
    a range join with the short list of periods.
    """
    last_of_day = events.groupBy("entity", "date").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("entity", "date")]), "seq").alias("e")).select("entity", "date", "e.*")
    until = F.lead("date").over(_ordered(("date",)))
    held = last_of_day.withColumn("_until", until)
    spans = F.broadcast(spans.select("key", F.col("end").alias("_end")))  # quarters of the years covered
    return held.join(spans, (F.col("date") <= F.col("_end")) & (F.col("_until").isNull() | (F.col("_until") > F.col("_end")))).drop("_end", "_until", "date", "seq")


def series(states: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Entities in each state at each period's end, zeros filled in."""
    counts = states.groupBy("key", *by).agg(F.count("*").alias("n"))
    spine = spans.select("key").crossJoin(F.broadcast(states.select(*by).distinct()))  # periods times states: short lists
    return spine.join(counts, ["key", *by], "left").select("key", *by, F.coalesce("n", F.lit(0)).alias("n"))


def share_of_total(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.try_divide(F.col(n), F.sum(n).over(Window.partitionBy(*by))))


def first_of_year(spans: DataFrame) -> DataFrame:
    """The first period of each year, for axis ticks."""
    return spans.groupBy(F.year("start").alias("year")).agg(F.min_by("key", "start").alias("key"))


def as_of_commit(commits: DataFrame, day: date) -> DataFrame:
    """Each repository's last commit up to the end of the day (repo, commit, ts)."""
    cutoff = F.to_timestamp(F.lit(f"{day} 23:59:59"))
    return commits.filter(F.col("ts") <= cutoff).groupBy("repo").agg(F.max_by("commit", F.struct("ts", "commit")).alias("commit"))


def strict_day(text: Column) -> Column:
    """A date of the form year-month-day, with or without leading zeros, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
