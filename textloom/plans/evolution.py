"""Timeline, regime and period queries."""

from datetime import date

from pyspark.sql import functions as F

from textloom.operators import evolution as e
from textloom.plans.bindings import EVENTS, Tables, timeline

OLD = e.Regime("old", None, date(1997, 5, 14), {}, {})
NEW = e.Regime("new", date(1997, 5, 15), date(1999, 12, 31), {}, {"P": "O"})
NEXT = e.Regime("next", date(2000, 1, 1), None, {"F": "Final"}, {"O": "Open"})
REGIMES = [OLD, NEW, NEXT]
_FIRST, _LAST = date(1995, 1, 1), date(2001, 8, 1)

_STANDARD = "CASE WHEN date <= DATE '1997-05-14' THEN 'old' WHEN date <= DATE '1999-12-31' THEN 'new' ELSE 'next' END"
_PERIODS = """q AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 3 MONTH)) AS DATE) AS s),
  spans AS (
    SELECT year(s) || '-Q' || quarter(s) AS label, '' AS suffix, s AS start, CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end" FROM q WHERE s <> DATE '1997-04-01'
    UNION ALL SELECT '1997-Q2', 'a', DATE '1997-04-01', DATE '1997-05-14' UNION ALL SELECT '1997-Q2', 'b', DATE '1997-05-15', DATE '1997-06-30')"""
_TRANSITIONS = """b1 AS (SELECT entity, max_by(status, (date, seq)) AS status FROM timeline WHERE date < DATE '1997-05-15' GROUP BY entity),
  t1 AS (SELECT *, false AS synthetic FROM timeline UNION ALL
    SELECT entity, DATE '1997-05-15', -1, 'O', true FROM b1 WHERE status = 'P' AND entity NOT IN (SELECT entity FROM timeline WHERE date = DATE '1997-05-15')),
  b2 AS (SELECT entity, max_by(status, (date, seq)) AS status FROM t1 WHERE date < DATE '2000-01-01' GROUP BY entity),
  full_line AS (SELECT * FROM t1 UNION ALL
    SELECT entity, DATE '2000-01-01', -1, CASE status WHEN 'F' THEN 'Final' ELSE 'Open' END, true FROM b2 WHERE status IN ('F', 'O') AND entity NOT IN (SELECT entity FROM t1 WHERE date = DATE '2000-01-01'))"""
_STATES = """states AS (SELECT entity, label || suffix AS key, max_by(status, (date, seq)) AS status, max_by({standard}, (date, seq)) AS standard
  FROM {events} JOIN spans ON date <= "end" GROUP BY ALL)"""


def _spans(t: Tables):
    return e.periods(t.spark, _FIRST, _LAST, [NEW.valid_from, NEXT.valid_from])


def _full(t: Tables):
    return e.with_transitions(timeline(t), REGIMES)


def _states(t: Tables):
    return e.state_at_periods(_full(t).withColumn("standard", e.standard_on(REGIMES, F.col("date"))), _spans(t))


QUERIES = {
    "dat01_quarters": (
        lambda t: timeline(t).groupBy(e.quarter_label(F.col("date")).alias("quarter")).agg(F.count("*").alias("n")),
        f"WITH {EVENTS} SELECT year(date) || '-Q' || quarter(date) AS quarter, count(*) AS n FROM timeline GROUP BY ALL",
    ),
    "dat02_period_spine": (_spans, f"""WITH {_PERIODS} SELECT label || suffix AS key, start, "end", label FROM spans"""),
    "dat04_event_standard": (
        lambda t: timeline(t)
        .select("status", e.event_standard([NEW], F.col("date"), F.when(F.col("seq") % 2 == 0, "given").otherwise(" "), {"F": "old"}, F.col("status")).alias("standard"))
        .groupBy("status", "standard")
        .agg(F.count("*").alias("n")),
        f"""WITH {EVENTS} SELECT status, CASE WHEN date BETWEEN DATE '1997-05-15' AND DATE '1999-12-31' THEN 'new' WHEN seq % 2 = 0 THEN 'given' WHEN status = 'F' THEN 'old' ELSE '' END AS standard, count(*) AS n
          FROM timeline GROUP BY ALL""",
    ),
    "dat05_mapped_status": (
        lambda t: timeline(t).select(e.map_status(NEXT, F.col("status")).alias("status")).groupBy("status").agg(F.count("*").alias("n")),
        f"WITH {EVENTS} SELECT CASE status WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE status END AS status, count(*) AS n FROM timeline GROUP BY ALL",
    ),
    "jon06_regime_of_event": (
        lambda t: timeline(t).groupBy(e.standard_on(REGIMES, F.col("date")).alias("standard"), "status").agg(F.count("*").alias("n")),
        f"WITH {EVENTS} SELECT {_STANDARD} AS standard, status, count(*) AS n FROM timeline GROUP BY ALL",
    ),
    "jon07_state_at_periods": (
        lambda t: _states(t).select("entity", "key", "status"),
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATES.format(standard=_STANDARD, events="full_line")} SELECT entity, key, status FROM states""",
    ),
    "jon08_state_before_milestone": (
        lambda t: e.state_before(timeline(t), NEW.valid_from),
        f"WITH {EVENTS} SELECT entity, max_by(status, (date, seq)) AS status FROM timeline WHERE date < DATE '1997-05-15' GROUP BY entity",
    ),
    "win04_status_changes": (
        lambda t: e.changes(timeline(t)),
        f"""WITH {EVENTS}, l AS (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY date, seq) AS p FROM timeline) SELECT entity, date, seq, status FROM l WHERE p IS DISTINCT FROM status""",
    ),
    "win05_previous_status": (
        lambda t: e.with_previous(timeline(t)),
        f"WITH {EVENTS} SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY date, seq) AS previous FROM timeline",
    ),
    "win06_seed_events": (
        lambda t: e.seed_events(timeline(t), t.customer.select(F.col("c_custkey").alias("entity"), F.lit(date(1995, 6, 1)).alias("created")), "Draft"),
        f"""WITH {EVENTS} SELECT * FROM timeline UNION ALL SELECT entity, DATE '1995-06-01', -1, 'Draft' FROM timeline GROUP BY entity HAVING min(date) > DATE '1995-06-01'""",
    ),
    "win07_regime_transitions": (_full, f"WITH {EVENTS}, {_TRANSITIONS} SELECT * FROM full_line"),
    "win08_fallback_events": (
        lambda t: e.fallback_events(timeline(t), t.customer.select(F.col("c_custkey").alias("entity"), F.lit(date(1995, 1, 1)).alias("created"), F.lit("Draft").alias("status"))),
        f"""WITH {EVENTS}, k AS (SELECT * FROM timeline) SELECT * FROM k UNION ALL
          SELECT c_custkey, DATE '1995-01-01', 0, 'Draft' FROM customer WHERE c_custkey NOT IN (SELECT entity FROM k)""",
    ),
    "win14_status_shares": (
        lambda t: e.share_of_total(e.series(_states(t), _spans(t), ["status"]), ["key"]),
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATES.format(standard=_STANDARD, events="full_line")},
          n AS (SELECT label || suffix AS key, s.status, count(states.entity) AS n FROM spans CROSS JOIN (SELECT DISTINCT status FROM states) s LEFT JOIN states ON states.key = label || suffix AND states.status = s.status GROUP BY ALL)
          SELECT key, status, n, n / sum(n) OVER (PARTITION BY key) AS share FROM n""",
    ),
    "win15_year_ticks": (
        lambda t: e.first_of_year(_spans(t)),
        f"""WITH {_PERIODS} SELECT CAST(year(start) AS INT) AS year, min_by(label || suffix, start) AS key FROM spans GROUP BY ALL""",
    ),
    "agg31_evolution_series": (
        lambda t: e.series(_states(t), _spans(t), ["status"]),
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATES.format(standard=_STANDARD, events="full_line")}
          SELECT label || suffix AS key, s.status, count(states.entity) AS n FROM spans CROSS JOIN (SELECT DISTINCT status FROM states) s LEFT JOIN states ON states.key = label || suffix AND states.status = s.status GROUP BY ALL""",
    ),
    "agg32_segmented_series": (
        lambda t: e.series(_states(t), _spans(t), ["standard", "status"]),
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATES.format(standard=_STANDARD, events="full_line")}
          SELECT label || suffix AS key, s.standard, s.status, count(states.entity) AS n FROM spans CROSS JOIN (SELECT DISTINCT standard, status FROM states) s
          LEFT JOIN states ON states.key = label || suffix AND states.status = s.status AND states.standard = s.standard GROUP BY ALL""",
    ),
    "src03_as_of_snapshot": (
        lambda t: e.as_of_commit(t.events.select(F.col("user_id").alias("repo"), F.col("event_id").cast("string").alias("commit"), "ts"), date(2024, 1, 10)),
        "SELECT user_id AS repo, max_by(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS commit FROM events WHERE ts <= TIMESTAMP '2024-01-10 23:59:59' GROUP BY user_id",
    ),
    "dat07_strict_days": (
        lambda t: t.orders.select("o_orderkey", e.strict_day(F.date_format("o_orderdate", "yyyy-M-d")).alias("day"), e.strict_day(F.date_format("o_orderdate", "yyyyMMdd")).alias("none")),
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DATE) AS none FROM orders",
    ),
}
