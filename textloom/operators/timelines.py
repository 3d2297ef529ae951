"""Status timelines in one pass over each entity's events: regimes, transitions between them, and states of periods together.

``Walk`` holds an entity's state, a few values, and moves it from event to event.  In batch,
partitions sorted by entity and time stream through it, so an entity with most of all events
needs no more memory than another.  In a stream, the same walk lives in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from textloom.operators.evolution import Regime

#: kind: event, transition (a regime's start changes the status), state (at a period's end, key) or late (a stream's event before the time it has reached).
WALKED = "entity string, kind string, key string, date date, seq long, status string, standard string"
_NAMES = [c.split()[0] for c in WALKED.split(", ")]
#: The same as types, which executors can build, and a walk in the state store.
_ROWS = StructType([StructField(n, DateType() if n == "date" else LongType() if n == "seq" else StringType()) for n in _NAMES])
_STATE = StructType([StructField("passed", IntegerType()), StructField("day", DateType()), StructField("status", StringType()), StructField("standard", StringType())])


@dataclass(frozen=True)
class Plan:
    """What time brings: regimes by their starts and periods (key, end), in order of days; short configured lists."""

    regimes: tuple[Regime, ...]
    periods: tuple[tuple[str, date], ...] = ()

    def bounds(self) -> list[tuple[date, int, object]]:
        starts = [(r.valid_from, 0, r) for r in self.regimes if r.valid_from]
        return sorted([*starts, *((end, 1, key) for key, end in self.periods)], key=lambda b: b[:2])

    def standard_on(self, day: date) -> str | None:
        """The first regime whose window holds the day."""
        return next((r.standard for r in self.regimes if (r.valid_from is None or day >= r.valid_from) and (r.valid_until is None or day <= r.valid_until)), None)


@dataclass
class Walk:
    """An entity between two events: bounds passed, and the last status with its day and standard."""

    passed: int = 0
    day: date | None = None
    status: str | None = None
    standard: str | None = None

    def move(self, plan: Plan, bounds: list, day: date, seq: int | None, status: str | None) -> Iterator[tuple]:
        """kind, key, date, seq, status and standard of what happens up to a day; a null status lets time pass without an event."""
        if (self.day is not None and day < self.day) or (self.passed and day <= bounds[self.passed - 1][0]):
            if status is not None:
                yield "late", None, day, seq, status, plan.standard_on(day)
            return
        # a regime starts before the day's events but knows of them; a period ends after them
        while self.passed < len(bounds) and bounds[self.passed][0] < day:
            at, is_end, what = bounds[self.passed]
            self.passed += 1
            if self.status is None:
                continue
            if is_end:
                yield "state", what, at, None, self.status, self.standard
            elif self.day != at:
                mapped = what.aliases.get(self.status) or what.transitions.get(self.status) or self.status
                if mapped != self.status:
                    self.day, self.status, self.standard = at, mapped, plan.standard_on(at)
                    yield "transition", None, at, -1, mapped, self.standard
        if status is not None:
            self.day, self.status, self.standard = day, status, plan.standard_on(day)
            yield "event", None, day, seq, status, self.standard


def walked(events: DataFrame, plan: Plan, until: date) -> DataFrame:
    """All rows (WALKED) of all entities' events (entity, date, seq, status) up to a day after the last period."""
    bounds = plan.bounds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, walk, out = None, Walk(), []

        def close() -> None:
            if entity is not None:
                out.extend((entity, *row) for row in walk.move(plan, bounds, until, None, None))

        for batch in batches:
            for e, day, seq, status in zip(*(c.to_pylist() for c in batch.columns)):
                if e != entity:
                    close()
                    entity, walk = e, Walk()
                out.extend((e, *row) for row in walk.move(plan, bounds, day, seq, status))
                if len(out) > 10_000:
                    yield _batch(out)
                    out.clear()
        close()
        if out:
            yield _batch(out)

    rows = events.select(F.col("entity").cast("string").alias("entity"), "date", F.col("seq").cast("long").alias("seq"), "status").filter("entity is not null and date is not null and status is not null")
    return rows.repartition("entity").sortWithinPartitions("entity", "date", "seq", "status").mapInArrow(run, WALKED)


_KINDS = [pa.string(), pa.string(), pa.string(), pa.date32(), pa.int64(), pa.string(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


class Walking(StatefulProcessor):
    """The walk of each entity in the state store; rows of a micro-batch are taken in order of time."""

    def __init__(self, plan: Plan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bounds = self.plan.bounds()
        self.state = handle.getValueState("walk", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walk = Walk(*self.state.get()) if self.state.exists() else Walk()
        # a clock row (no status) of a day comes before the day's events
        arrived = pd.concat(list(rows)).sort_values(["date", "seq", "status"], na_position="first")
        out = []
        for day, seq, status in zip(arrived["date"], arrived["seq"], arrived["status"]):
            day, status = pd.Timestamp(day).date(), None if pd.isna(status) else status
            out.extend((key[0], *row) for row in walk.move(self.plan, self.bounds, day, None if pd.isna(seq) else int(seq), status))
        self.state.update((walk.passed, walk.day, walk.status, walk.standard))
        frame = pd.DataFrame(out, columns=_NAMES)
        frame["seq"] = frame["seq"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def walked_stream(events: DataFrame, plan: Plan) -> DataFrame:
    """The same rows from a stream of events; a row with a day and no status lets an entity's time pass.

    Needs the RocksDB state store.  Events before the time that an entity has reached come out as late, none is lost.
    """
    rows = events.selectExpr("cast(entity as string) as entity", "date", "cast(seq as long) as seq", "status").filter("entity is not null and date is not null")
    return rows.groupBy("entity").transformWithStateInPandas(Walking(plan), _ROWS, "append", "none")


def evolution_payload(walks: DataFrame, entities: DataFrame) -> DataFrame:
    """section, standard, key, status and n from walked rows: counts by period (status_evolution), by period and standard (status_evolution_by_standard), and the numbers of entities and timelines (meta)."""
    states = walks.filter("kind = 'state'")
    series = states.groupingSets([["key", "status"], ["key", "standard", "status"]], "key", "standard", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    series = series.select(F.when(F.col("_g") > 0, "status_evolution").otherwise("status_evolution_by_standard").alias("section"), "standard", "key", "status", "n")
    none = [F.lit(None).cast("string").alias(c) for c in ("standard", "key")]
    timelines = walks.filter("kind = 'event'").agg(F.countDistinct("entity").alias("n")).select(F.lit("meta").alias("section"), *none, F.lit("timelines").alias("status"), "n")
    known = entities.agg(F.countDistinct("entity").alias("n")).select(F.lit("meta").alias("section"), *none, F.lit("entities").alias("status"), "n")
    return series.unionByName(timelines).unionByName(known)
