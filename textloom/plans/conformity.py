"""Rule check queries."""

from pyspark.sql import functions as F

from textloom.operators import conformity as c
from textloom.plans.bindings import Tables

_DOCS = """docs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS price, o_orderpriority AS priority FROM orders)"""
_CHECKS = f"""{_DOCS}, checks AS (
  SELECT id, 'has-status' AS "check", 'header' AS category, 'old' AS standard, status IS NOT NULL AS passed FROM docs
  UNION ALL SELECT id, 'final', 'header', 'old', status = 'F' FROM docs
  UNION ALL SELECT id, 'day', 'value', 'new', true FROM docs
  UNION ALL SELECT id, 'priority', 'value', 'new', CASE WHEN priority <> '4-NOT SPECIFIED' THEN priority < '3' END FROM docs
  UNION ALL SELECT id, 'cheap', 'value', 'new', price < 150000 FROM docs)"""
_TALLY = "count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS skipped"
_SCORE = "round_even(CASE WHEN passed + failed > 0 THEN passed / (passed + failed) * 100 END, 2)"
_SCORES = f"scores AS (SELECT id, standard, passed, failed, skipped, {_SCORE} AS score FROM (SELECT id, standard, {_TALLY} FROM checks GROUP BY GROUPING SETS ((id), (id, standard))))"


def _checks(t: Tables):
    docs = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    )
    rules = [
        c.Rule("has-status", "old", c.required(F.col("status")), "header"),
        c.Rule("final", "old", F.col("status") == "F", "header"),
        c.Rule("day", "new", c.valid_day(F.col("day")), "value"),
        c.Rule("priority", "new", F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("priority") < "3"), "value"),
        c.Rule("cheap", "new", F.col("price") < 150000, "value"),
    ]
    return c.assess(docs, rules)


QUERIES = {
    "chk01_assess": (lambda t: _checks(t), f"WITH {_CHECKS} SELECT * FROM checks"),
    "agg25_check_summary": (
        lambda t: c.check_summary(_checks(t)),
        f"""WITH {_CHECKS} SELECT standard, "check", passed, failed, skipped, {_SCORE} AS pass_rate FROM (SELECT standard, "check", {_TALLY} FROM checks GROUP BY ALL)""",
    ),
    "agg26_average_scores": (
        lambda t: c.average_scores(c.document_scores(_checks(t))).select("standard", F.round("mean", 6).alias("mean"), "documents"),
        f"WITH {_CHECKS}, {_SCORES} SELECT standard, round(avg(score), 6) AS mean, count(score) AS documents FROM scores GROUP BY standard",
    ),
    "agg27_document_scores": (lambda t: c.document_scores(_checks(t)), f"WITH {_CHECKS}, {_SCORES} SELECT * FROM scores"),
    "agg28_most_failed": (
        lambda t: c.most_failed(_checks(t), 2),
        f"""WITH {_CHECKS}, n AS (SELECT standard, "check", count(*) AS documents FROM checks WHERE NOT passed GROUP BY ALL)
          SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY standard ORDER BY documents DESC, "check") AS INT) AS position FROM n) WHERE position <= 2""",
    ),
    "txt08_valid_contacts": (
        lambda t: t.customer.select("c_custkey", c.valid_contacts(F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, " <a@b>").otherwise(" <ab>"))).alias("ok")),
        "SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer",
    ),
    "txt08_latest_version": (
        lambda t: t.part.select("p_partkey", c.latest_version(F.concat(F.lit("v1.2.3 "), F.col("p_size"), F.lit(".0.1 and 1.10.0"))).alias("version")),
        "SELECT p_partkey, CASE WHEN p_size <= 1 THEN '1.10.0' ELSE p_size || '.0.1' END AS version FROM part",
    ),
    "chk03_header_order": (
        lambda t: t.part.select("p_partkey", c.in_header_order(F.split(F.col("p_type"), " "), ["STANDARD", "LARGE", "BRUSHED", "STEEL"]).alias("ok")),
        """WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(p_type, ' '), lambda n: list_position(['STANDARD', 'LARGE', 'BRUSHED', 'STEEL'], n)), lambda p: coalesce(p, 0) > 0) AS places FROM part)
          SELECT p_partkey, places = list_sort(places) AND len(list_distinct(places)) = len(places) AS ok FROM p""",
    ),
}
