"""Filter interaction audit by min-plus removal ranks.

Each document fails a set of the filters A to E, its mask.  Masks are counted by part first,
so at most 32 rows of a part reach the matrices.  The mask matrix has 0 where a mask fails a
filter and infinity elsewhere; the position matrix is the inverse of each order, the step at
which it applies a filter.  Their min-plus product, the minimum over filters of mask plus
position, is the step at which each order removes each mask; counts are scattered to the
steps by it, once for each weight (documents, good and toxic ones), and what fails a filter
but went before its step is redundant there.

Filter E needs the first document of each text.  Texts are held as SHA-256 digests, and rows
of a digest, part and mask meet as one row that knows its smallest id, so a text that a third
of all documents share is never one task's work.

Cases: a null text is empty, and null and empty texts are identical; a null source is the
empty part; rows without an id are identical to texts of ids before but no text comes after
them, so they never fail E, and have no labels; rows that share an id and a text are documents
of their own, and fail E only if a smaller id has the text; a document is good or toxic if
any of its label rows says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written

FILTERS = "ABCDE"
WEIGHTS = ("docs", "good", "toxic")
WORD_BREAK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """Whether a text that is not null fails A, B, C and D."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return [n_words < 50, 100 * distinct < 65 * n_words, 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]")]


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails the k-th filter), docs, good and toxic: the documents of each mask in each part."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")))]
    rows = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", sum(bits[1:], bits[0]).alias("mask"))
    # rows without an id match no label, and are spread by their digests
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("spread"))
    said = said.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    judged = rows.join(said, ["id", "spread"], "left").fillna(0, ["good", "toxic"])
    sums = [F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    by_id = judged.groupBy("id", "spread", "digest", "part", "mask").agg(*sums)
    # of each text in a part: all its rows, and those of its smallest id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *WEIGHTS))).alias("first")
    unnamed = [F.sum(F.when(F.col("id").isNull(), F.col(w)).otherwise(0)).alias(f"unnamed_{w}") for w in WEIGHTS]
    texts = written(by_id.groupBy("digest", "part", "mask").agg(*(F.sum(w).alias(w) for w in WEIGHTS), first, *unnamed))
    least = texts.groupBy("digest").agg(F.min("first.id").alias("least"))
    holds = F.coalesce(F.col("first.id") == F.col("least"), F.lit(False))
    new = {w: F.when(holds, F.col(f"first.{w}")).otherwise(0) + F.col(f"unnamed_{w}") for w in WEIGHTS}
    both = F.array(
        F.struct("mask", *(new[w].alias(w) for w in WEIGHTS)),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), *((F.col(w) - new[w]).alias(w) for w in WEIGHTS)),
    )
    halves = texts.join(least, "digest").select("part", F.inline(both))
    return halves.filter("docs > 0").groupBy("part", "mask").agg(*(F.sum(w).alias(w) for w in WEIGHTS))


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices with + for times and the minimum for the sum."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def removal_steps() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; the position of each filter (rows) in each order (columns), from 1; the step that removes each mask (rows) in each order, infinity for mask 0."""
    orders = np.array(list(permutations(range(len(FILTERS)))))
    positions = np.argsort(orders, axis=1).T + 1.0
    fails = np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1
    return ["".join(FILTERS[f] for f in order) for order in orders], positions, min_plus(np.where(fails, 0.0, np.inf), positions)


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All orders and steps of each part, from its counts by mask."""
    names, positions, removal = removal_steps()
    n_orders, steps = len(names), np.arange(1, len(FILTERS) + 1)
    masks = np.arange(len(removal))
    fails = (masks[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)
    goes, order = np.nonzero(np.isfinite(removal))
    cell = order * len(steps) + removal[goes, order].astype(np.int64) - 1
    # the filter of each step of each order
    acts = np.argsort(positions, axis=0).T
    for batch in batches:
        for row in batch.to_pylist():
            counts = {w: np.zeros(len(masks), np.int64) for w in WEIGHTS}
            for at in row["masks"]:
                for w in WEIGHTS:
                    counts[w][at["mask"]] = at[w]
            lost = {}
            for w in WEIGHTS:
                lost[w] = np.zeros(n_orders * len(steps), np.int64)
                np.add.at(lost[w], cell, counts[w][goes])
            removed = lost["docs"].reshape(n_orders, -1)
            kept = counts["docs"].sum() - removed.cumsum(axis=1)
            failing = counts["docs"] @ fails
            only = counts["docs"][1 << np.arange(len(FILTERS))]
            credit = np.zeros(len(FILTERS), np.int64)
            np.add.at(credit, acts, removed)
            columns = (kept, removed, failing[acts] - removed, only[acts], lost["good"], lost["toxic"], credit[acts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * removed.size, pa.string()),
                    pa.array(np.repeat(names, len(steps)).tolist(), pa.string()),
                    pa.array(np.tile(steps, n_orders), pa.int32()),
                    *(pa.array(c.ravel(), pa.int64()) for c in columns),
                ],
                ["part", "filter_order", "step", *_COUNTS],
            )


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of each part, order and step."""
    masks = F.collect_list(F.struct("mask", *WEIGHTS)).alias("masks")
    return mask_counts(documents, labels).groupBy("part").agg(masks).mapInArrow(_audit, SCHEMA)


#: The same in DuckDB; each order is a row of five letters, and a document goes at the first that it fails.
ORACLE_SQL = r"""
WITH said AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT doc_id AS id, coalesce(text, '') AS text, coalesce(source, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), judged AS (
  SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(id > min(id) OVER (PARTITION BY text), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM docs LEFT JOIN said USING (id)
), masks AS (
  SELECT part, [f FOR f IN [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] IF f IS NOT NULL] AS fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic
  FROM judged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM orders
), acts AS (SELECT filter_order, step, filter_order[step] AS f FROM steps
), gone AS (
  SELECT m.*, o.filter_order, list_min([strpos(o.filter_order, f) FOR f IN m.fails]) AS gone_at FROM masks m, orders o
), counted AS (
  SELECT g.part, s.filter_order, s.step, s.f, sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN docs ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN gone_at < step AND list_contains(fails, s.f) THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN fails = [s.f] THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone g JOIN acts s ON s.filter_order = g.filter_order GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
