"""Results composed of many operators: combinations of sources, timelines in one pass, staleness by digests, known ids."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from textloom.operators import authorship as au
from textloom.operators import combinations as co
from textloom.operators import digests as dg
from textloom.operators import known_ids as ki
from textloom.operators import parsers as pa
from textloom.operators import sections as se
from textloom.operators import timelines as tl
from textloom.plans.bindings import AUTHORED, EDGES, EVENTS, NODES, Tables, authored, links, nodes, timeline
from textloom.plans.conformity import _CHECKS, _SCORE, _SCORES, _TALLY, _checks
from textloom.plans.evolution import _PERIODS, _STANDARD, _STATES, _TRANSITIONS, REGIMES


def _parts(t: Tables):
    """Parts as documents, their types as sources."""
    return t.part.select(F.concat(F.lit("PART_"), "p_partkey").alias("key"), F.col("p_type").alias("source"))


def _makers(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("source"), F.col("l_suppkey").alias("author"))


#: Every combination as a filter of its own.
_COMBOS = """s AS (SELECT p_type AS source, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)),
  c AS (SELECT mask, string_agg(source, '+' ORDER BY source) AS combination FROM range(1, CAST(1 << (SELECT count(*) FROM s) AS BIGINT)) r(mask), s WHERE (mask >> i) & 1 = 1 GROUP BY mask HAVING count(*) > 1),
  cs AS (SELECT combination, source FROM c, s WHERE (mask >> i) & 1 = 1)"""


def _plan() -> tl.Plan:
    """Quarters of the years covered, the second one of 1997 in two parts."""
    ends, start = [], date(1995, 1, 1)
    while start <= date(2001, 8, 1):
        after = date(start.year + (start.month > 9), (start.month + 2) % 12 + 1, 1)
        label, end = f"{start.year}-Q{(start.month + 2) // 3}", after - timedelta(days=1)
        ends += [(f"{label}a", date(1997, 5, 14)), (f"{label}b", end)] if start == date(1997, 4, 1) else [(label, end)]
        start = after
    return tl.Plan(tuple(REGIMES), tuple(ends))


def _walked(t: Tables):
    return tl.walked(timeline(t), _plan(), date(2002, 1, 1))


_STATE_ROWS = _STATES.format(standard=_STANDARD, events="full_line")


def _stored(t: Tables, since: str):
    """A payload as it was stored before the orders from a day on came."""
    return _status_payload(t.orders.filter(F.col("o_orderdate") < F.to_date(F.lit(since))))


def _status_payload(orders):
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


_STALE = """SELECT year(o_orderdate) AS year, o_orderstatus AS status, count(*) AS n FROM orders {where} GROUP BY ALL"""

QUERIES = {
    "set02_combinations": (
        lambda t: co.combinations(t.part, "p_type").select("combination"),
        f"WITH {_COMBOS} SELECT combination FROM c",
    ),
    "cmp07_combined_payload": (
        lambda t: co.combined_payload(_parts(t), links(t), _makers(t)),
        f"""WITH {EDGES}, {_COMBOS}, k AS (SELECT 'PART_' || p_partkey AS key, p_type AS source FROM part), e AS (SELECT DISTINCT l.source, l.target, method, a.source AS sa, b.source AS sb FROM links l JOIN k a ON a.key = l.source JOIN k b ON b.key = l.target),
          inside AS (SELECT x.combination, e.* FROM e JOIN cs x ON x.source = sa JOIN cs y ON y.source = sb AND y.combination = x.combination),
          p AS (SELECT DISTINCT p_type AS source, l_suppkey AS author FROM lineitem JOIN part ON p_partkey = l_partkey)
          SELECT combination, 'dependencies' AS section, 'nodes' AS name, count(*) AS value, 'merged' AS status FROM cs JOIN k USING (source) GROUP BY combination
          UNION ALL SELECT combination, 'dependencies', 'edges ' || method, count(*), 'merged' FROM inside GROUP BY combination, method
          UNION ALL SELECT combination, 'dependencies', 'edges between sources', count(*), 'merged' FROM inside WHERE sa <> sb GROUP BY combination
          UNION ALL SELECT combination, 'authorship', 'authors', count(DISTINCT author), 'merged' FROM cs JOIN p USING (source) GROUP BY combination
          UNION ALL SELECT combination, unnest(['classification', 'conformity', 'evolution']), NULL, NULL, 'not_mergeable' FROM c""",
    ),
    "src18_expected_targets": (
        lambda t: co.expected_targets(t.orders.select(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot"))),
        """WITH l AS (SELECT DISTINCT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS snapshot FROM orders), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM l)),
          c AS (SELECT mask, string_agg(source, '+' ORDER BY source) AS combination, count(*) AS size FROM range(1, CAST(1 << (SELECT count(*) FROM s) AS BIGINT)) r(mask), s WHERE (mask >> i) & 1 = 1 GROUP BY mask HAVING count(*) > 1)
          SELECT combination, snapshot FROM c, s JOIN l USING (source) WHERE (mask >> i) & 1 = 1 GROUP BY combination, size, snapshot HAVING count(*) = size""",
    ),
    "cmp05_walked_timelines": (
        _walked,
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATE_ROWS}
          SELECT CAST(entity AS VARCHAR) AS entity, CASE WHEN synthetic THEN 'transition' ELSE 'event' END AS kind, NULL AS key, date, seq, status, {_STANDARD} AS standard FROM full_line
          UNION ALL SELECT CAST(entity AS VARCHAR), 'state', states.key, "end", NULL, status, standard FROM states JOIN spans ON label || suffix = states.key""",
    ),
    "cmp05_evolution_payload": (
        lambda t: tl.evolution_payload(_walked(t), t.customer.select(F.col("c_custkey").alias("entity"))),
        f"""WITH {EVENTS}, {_PERIODS}, {_TRANSITIONS}, {_STATE_ROWS}
          SELECT 'status_evolution' AS section, NULL AS standard, key, status, count(*) AS n FROM states GROUP BY ALL UNION ALL SELECT 'status_evolution_by_standard', standard, key, status, count(*) FROM states GROUP BY ALL
          UNION ALL SELECT 'meta', NULL, NULL, 'timelines', count(DISTINCT entity) FROM timeline UNION ALL SELECT 'meta', NULL, NULL, 'entities', count(*) FROM customer""",
    ),
    "val05_stale_status_payload": (
        lambda t: dg.stale_rows(_stored(t, "1998-01-01"), _status_payload(t.orders), ["year", "status"]).select("year", "status", "n", "side"),
        f"""WITH old AS ({_STALE.format(where="WHERE o_orderdate < DATE '1998-01-01'")}), new AS ({_STALE.format(where="")})
          SELECT CAST(year AS INT) AS year, status, n, 'stored' AS side FROM (FROM old EXCEPT ALL FROM new) UNION ALL SELECT CAST(year AS INT), status, n, 'computed' FROM (FROM new EXCEPT ALL FROM old)""",
    ),
    "val05_stale_author_payload": (
        # one order's authors are gone from what was stored
        lambda t: dg.stale_rows(au.author_counts(authored(t).filter("id <> 7")), au.author_counts(authored(t)), ["author"]).drop("range"),
        f"""WITH {AUTHORED}, old AS (SELECT author, count(*) AS documents FROM authored WHERE id <> 7 GROUP BY author), new AS (SELECT author, count(*) AS documents FROM authored GROUP BY author)
          SELECT *, 'stored' AS side FROM (FROM old EXCEPT ALL FROM new) UNION ALL SELECT *, 'computed' FROM (FROM new EXCEPT ALL FROM old)""",
    ),
    "agg42_known_ids": (
        lambda t: ki.counts(ki.merged(ki.known_ids(_snapshot_ids(t), ("source", "snapshot")))),
        """SELECT coalesce(o_orderpriority, '') AS source, count(DISTINCT CASE WHEN o_custkey % 5 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END) AS ids FROM orders GROUP BY ALL""",
    ),
    "agg42_unknown_references": (
        lambda t: ki.only_known(_references(t), ki.merged(ki.known_ids(_snapshot_ids(t), ("source", "snapshot"))), wanted=False).groupBy("source").count(),
        """WITH k AS (SELECT DISTINCT o_orderpriority AS source, CASE WHEN o_custkey % 5 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders),
          r AS (SELECT o_orderpriority AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || (o_orderkey % 2000) AS id FROM orders) SELECT source, count(*) AS count FROM r WHERE (source, id) NOT IN (FROM k) GROUP BY source""",
    ),
}


#: A document of one of four layouts, the same expression in Spark and DuckDB.
_LAYOUTS = """CASE doc_id % 4 WHEN 0 THEN 'Intro' || chr(10) || '<pre>' || chr(10) || '  Title: One' || chr(10) || '  Status: Draft' || chr(10) || '</pre>' || chr(10) WHEN 1 THEN 'Title: Two' || chr(10) || 'Status: Final' || chr(10) || 'Status: Active' || chr(10) || chr(10)
  WHEN 2 THEN 'NIP-' || doc_id || chr(10) || '======' || chr(10) || chr(10) || 'Three' || chr(10) || '-----' || chr(10) || chr(10) || '`draft` `extra`' || chr(10) ELSE 'no header' || chr(10) END"""


def _historic(t: Tables):
    found = pa.historic_fields(t.documents.select(F.col("doc_id").alias("id"), F.expr(_LAYOUTS).alias("text")), {"status": {"draft": "Draft"}})
    return found.select("id", "layout", F.try_element_at("fields", F.lit("title")).alias("title"), F.try_element_at("fields", F.lit("status")).alias("status"), F.try_element_at("fields", F.lit("kind")).alias("kind"))


_NUM = "CAST({} AS DOUBLE)"
_AUTHORSHIP = f"""WITH {NODES}, {AUTHORED}, n AS (SELECT author, count(*) AS documents FROM authored GROUP BY author), pairs AS (SELECT x.author AS a, y.author AS b, count(*) AS weight FROM authored x JOIN authored y ON x.id = y.id AND x.author < y.author GROUP BY ALL),
  d AS (SELECT author, count(*) AS degree FROM (SELECT a AS author FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY author), top AS (SELECT *, row_number() OVER (ORDER BY documents DESC, lower(CAST(author AS VARCHAR)), CAST(author AS VARCHAR)) AS k FROM n)
  SELECT 'meta' AS section, 'documents' AS key, NULL AS other, {_NUM.format("(SELECT count(*) FROM nodes)")} AS value UNION ALL SELECT 'meta', 'authors', NULL, count(*) FROM n
  UNION ALL SELECT 'top_authors', CAST(author AS VARCHAR), NULL, documents FROM top WHERE k <= 15 UNION ALL SELECT 'contribution_histogram', CAST(documents AS VARCHAR), NULL, count(*) FROM n GROUP BY documents
  UNION ALL SELECT 'authors_per_document', CAST(k AS VARCHAR), NULL, count(*) FROM (SELECT count(*) AS k FROM authored GROUP BY id) GROUP BY k UNION ALL SELECT 'documents_per_year', CAST(year AS VARCHAR), NULL, count(*) FROM nodes GROUP BY year
  UNION ALL SELECT 'top_share', 'documents', NULL, count(*) FROM nodes UNION ALL SELECT 'top_share', 'by_top', NULL, sum(documents) FROM top WHERE k <= 10 UNION ALL SELECT 'top_share', 'percentage', NULL, round(100.0 * sum(documents) / (SELECT count(*) FROM nodes), 2) FROM top WHERE k <= 10
  UNION ALL SELECT 'collaboration_network', CAST(a AS VARCHAR), CAST(b AS VARCHAR), weight FROM pairs UNION ALL SELECT 'collaboration_degrees', CAST(author AS VARCHAR), NULL, degree FROM d UNION ALL SELECT 'degree_distribution', CAST(degree AS VARCHAR), NULL, count(*) FROM d GROUP BY degree"""


def _snapshot_ids(t: Tables):
    """Customers known to a source in each snapshot, some under names that are no numbers."""
    key = F.col("o_custkey")
    return t.orders.select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("snapshot"), F.when(key % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string")).alias("id"))


def _references(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(F.col("o_orderpriority").alias("source"), F.concat(F.when(key % 3 == 0, "x").otherwise(""), key % 2000).alias("id"))


QUERIES |= {
    "prj19_historic_fields": (
        _historic,
        """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'headers' WHEN 2 THEN 'tags' ELSE '' END AS layout, CASE doc_id % 4 WHEN 0 THEN 'One' WHEN 1 THEN 'Two' WHEN 2 THEN 'Three' END AS title,
          CASE doc_id % 4 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Active' WHEN 2 THEN 'Draft' END AS status, CASE WHEN doc_id % 4 = 2 THEN 'extra' END AS kind FROM documents""",
    ),
    "cmp03_authorship_payload": (lambda t: se.authorship_payload(nodes(t), authored(t)).filter("section <> 'cluster_sizes'"), _AUTHORSHIP),
    "cmp04_classification_payload": (
        lambda t: se.classification_payload(nodes(t)),
        f"""WITH {NODES}, k AS (SELECT year, coalesce(nullif(trim(layer), ''), 'Unknown') AS layer, coalesce(nullif(trim(status), ''), 'Unknown') AS status, coalesce(nullif(trim(type), ''), 'Unknown') AS type FROM nodes),
          f AS (SELECT * FROM k WHERE layer <> 'Unknown' AND status <> 'Unknown' AND type <> 'Unknown')
          SELECT 'meta' AS section, 'nodes' AS key, NULL AS other, CAST(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'sankey_full', layer, status, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'sankey_full', status, type, count(*) FROM f GROUP BY ALL
          UNION ALL SELECT 'sankey_grouped', layer, status, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'sankey_grouped', status, type, count(*) FROM k GROUP BY ALL
          UNION ALL SELECT 'status_over_time', CAST(year AS VARCHAR), status, count(*) FROM k WHERE year IS NOT NULL GROUP BY year, status""",
    ),
    "cmp06_conformity_payload": (
        lambda t: se.conformity_payload(_checks(t)),
        f"""WITH {_CHECKS}, {_SCORES}, c AS (SELECT standard, "check", passed, failed, skipped, {_SCORE} AS pass_rate FROM (SELECT standard, "check", {_TALLY} FROM checks GROUP BY ALL))
          SELECT 'average_score_by_standard' AS section, standard AS key, NULL AS other, CAST(round(avg(score), 2) AS DOUBLE) AS value FROM scores WHERE standard IS NOT NULL GROUP BY standard
          UNION ALL SELECT 'check_passed', "check", standard, passed FROM c UNION ALL SELECT 'check_failed', "check", standard, failed FROM c UNION ALL SELECT 'check_skipped', "check", standard, skipped FROM c
          UNION ALL SELECT 'check_pass_rate', "check", standard, pass_rate FROM c WHERE pass_rate IS NOT NULL UNION ALL SELECT 'per_document', CAST(id AS VARCHAR), standard, score FROM scores""",
    ),
}
