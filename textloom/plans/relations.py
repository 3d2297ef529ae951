"""References, reviewed rows and composed results of relations."""

from pyspark.sql import functions as F

from textloom.operators import combinations as co
from textloom.operators import payloads as y
from textloom.operators import references as r
from textloom.operators import relation_fields as rf
from textloom.operators import validation as v
from textloom.plans.bindings import EDGES, Tables, items, links

_SOURCES = [r.Source("bips", "BIP", most=400), r.Source("slips", "SLIP"), r.Source("nips", "NIP", hexadecimal=True)]
_NOTE = """'see BIPs ' || o_orderkey % 40 || '/' || o_custkey % 9 || ' and 09; bip-' || o_orderkey || '/file.md, NIP ' || upper(hex(o_custkey % 200)) || ' or 0' || o_orderkey % 10 || ' (SLIP-00' || o_custkey % 50 || ')'"""
_HEXED = "CASE WHEN length({0}) = 1 THEN '0' || {0} ELSE {0} END"
_FOUND = f"""hits AS (SELECT o_orderkey AS id, unnest([
    struct_pack(slug := 'bips', target := CAST(o_orderkey % 40 AS VARCHAR)), struct_pack(slug := 'bips', target := CAST(o_custkey % 9 AS VARCHAR)), struct_pack(slug := 'bips', target := '9'),
    struct_pack(slug := 'bips', target := CASE WHEN o_orderkey <= 400 THEN CAST(o_orderkey AS VARCHAR) END), struct_pack(slug := 'slips', target := CAST(o_custkey % 50 AS VARCHAR)),
    struct_pack(slug := 'nips', target := {_HEXED.format("printf('%X', o_custkey % 200)")}), struct_pack(slug := 'nips', target := '0' || o_orderkey % 10)]) AS h FROM orders)"""
_TARGET = "CASE o_orderkey % 6 WHEN 0 THEN 'nips:' || hex(o_orderkey % 300) WHEN 1 THEN 'BIP-00' || o_orderkey % 500 WHEN 2 THEN ' slip ' || o_orderkey % 90 || ' ' WHEN 3 THEN CAST(o_orderkey % 500 AS VARCHAR(20)) WHEN 4 THEN 'other:7' ELSE 'no id' END"

_SCORES = """found AS (SELECT DISTINCT method, source, target FROM links), scores AS (
  SELECT m.method, m.metric, i.item, coalesce(n, 0) AS score FROM items i CROSS JOIN (SELECT DISTINCT method, metric FROM found, (VALUES ('in'), ('out')) x(metric)) m
  LEFT JOIN (SELECT method, 'in' AS metric, target AS item, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT method, 'out', source, count(*) FROM found GROUP BY ALL) d USING (method, metric, item))"""
_TYPED = """typed AS (SELECT method, 'bips:' || source AS source, CASE WHEN length(target) % 2 = 0 THEN 'bips:' ELSE 'bips:x' END || target AS target, CASE rel WHEN 'F' THEN 'depends_on' ELSE CASE WHEN length(source) % 2 = 0 THEN 'supersedes' ELSE 'superseded_by' END END AS rel FROM links)"""


def _scores(t: Tables):
    from textloom.plans.agreement import _grid

    return _grid(t)


def _typed(t: Tables):
    rel = F.when(F.col("rel") == "F", "depends_on").when(F.length("source") % 2 == 0, "supersedes").otherwise("superseded_by")
    target = F.concat(F.when(F.length("target") % 2 == 0, "bips:").otherwise("bips:x"), "target")
    return links(t).select("method", F.concat(F.lit("bips:"), "source").alias("source"), target.alias("target"), rel.alias("rel"))


def _nodes(t: Tables):
    return items(t).select(F.concat(F.lit("bips:"), "item").alias("key"))


def _reviewed(t: Tables):
    """Customers as reviewed rows."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("line"), F.concat(F.when(k % 5 == 0, "zips:").otherwise("bips:"), F.floor(k / 2)).alias("ip"), F.when(k % 7 > 0, F.col("c_name")).otherwise(" ").alias("reviewer"),
        F.when(k % 11 == 0, "2024-13-01").when(k % 3 == 0, "").otherwise("2024-03-01").alias("reviewed_at"), F.when(k % 13 == 0, "-4").otherwise(k.cast("string")).alias("extracted_target_count"),
        F.when(k % 17 == 0, "guess").otherwise("random").alias("sampling_strategy"), F.when(k % 4 == 0, "-").otherwise("low").alias("density_bucket"), F.lit("body").alias("density_basis"), F.lit("").alias("created"),
        F.col("c_mktsegment").alias("type"),
    )


def _curated(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("line"), F.concat(F.lit("bips:"), "o_custkey").alias("source"), F.concat(F.lit("bips:"), F.col("o_orderkey") % 100).alias("target"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reviewed_at"))


def _source_rows(t: Tables):
    return t.customer.select(F.concat(F.lit("bips:"), "c_custkey").alias("ip"), F.when(F.col("c_custkey") % 2 == 0, "1998-01-01").otherwise("1996-01-01").alias("reviewed_at"), F.when(F.col("c_custkey") % 3 == 0, "1997-06-01").otherwise("").alias("created")).filter("ip not like '%9'")


def _metadata(t: Tables):
    return t.supplier.select(F.concat(F.lit("bips:"), "s_suppkey").alias("key"), F.lit("1999-01-01").alias("created"), F.lit("1998-02-01").alias("last_commit"))


_W = """k AS (SELECT *, rank() OVER (PARTITION BY method, metric, scope ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, metric, scope, score) - 1) / 2 AS ar FROM scoped),
  s AS (SELECT scope, metric, item, sum(ar) AS r FROM k GROUP BY ALL), q AS (SELECT scope, metric, sum(r * r) - sum(r) * sum(r) / count(*) AS s, count(*) AS n FROM s GROUP BY ALL),
  g AS (SELECT scope, method, metric, score, count(*) AS t FROM scoped GROUP BY ALL), tie AS (SELECT scope, metric, sum(t * t * t - t) AS ties, count(DISTINCT method) AS m FROM g GROUP BY ALL)"""

_KEY = f"""CASE o_orderkey % 6 WHEN 0 THEN 'nips:' || {_HEXED.format("printf('%X', o_orderkey % 300)")} WHEN 2 THEN 'slips:' || o_orderkey % 90 WHEN 4 THEN 'bips:7'
  WHEN 5 THEN NULL ELSE CASE WHEN o_orderkey % 500 <= 400 THEN 'bips:' || o_orderkey % 500 END END"""


def _findings(t: Tables):
    """A customer's orders as what a model found in one document, in order of their keys."""
    k = F.col("o_orderkey")
    return t.orders.select(
        (F.col("o_custkey") % 500).alias("id"), F.struct("o_custkey", "o_orderkey").alias("pos"), F.expr(_TARGET).alias("target"), F.when(k % 3 == 0, " Requires").when(k % 3 == 1, "odd").alias("type"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("evidence"), F.lit(None).cast("string").alias("reason"), F.when(k % 4 == 0, "HIGH ").when(k % 4 == 1, "medium").when(k % 4 == 2, "sure").alias("confidence"),
    )


QUERIES = {
    "txt05_header_targets": (
        lambda t: rf.header_targets(
            t.customer.select(F.col("c_custkey").alias("id"), F.lit("requires").alias("type"), F.concat(F.lit(" slip "), F.col("c_custkey") % 90, F.lit(", BIP-00"), F.col("c_custkey") % 500, F.lit(",7 , junk,, 7,nips:0"), F.col("c_custkey") % 10).alias("value")), _SOURCES, _SOURCES[0]
        ),
        """WITH k AS (SELECT c_custkey AS id, 1 AS s, CAST(c_custkey % 500 AS BIGINT) AS n, 'bips:' || c_custkey % 500 AS target FROM customer WHERE c_custkey % 500 <= 400 UNION SELECT c_custkey, 1, 7, 'bips:7' FROM customer
            UNION SELECT c_custkey, 2, c_custkey % 90, 'slips:' || c_custkey % 90 FROM customer UNION SELECT c_custkey, 3, c_custkey % 10, 'nips:0' || c_custkey % 10 FROM customer)
          SELECT id, 'requires' AS type, CAST(row_number() OVER (PARTITION BY id ORDER BY s, n) AS INT) AS position, target FROM k""",
    ),
    "txt06_model_findings": (
        lambda t: rf.model_findings(_findings(t), _SOURCES, _SOURCES[0], ["requires", "references"]),
        f"""WITH k AS (SELECT o_custkey % 500 AS id, o_custkey, o_orderkey, {_KEY} AS target, o_orderpriority FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY o_custkey, o_orderkey) AS nth FROM k WHERE target IS NOT NULL AND (id > 400 OR target <> 'bips:' || id))
          SELECT id, target, CASE WHEN o_orderkey % 3 = 0 THEN 'requires' ELSE 'references' END AS type, o_orderpriority AS evidence, '' AS reason, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM n WHERE nth = 1""",
    ),
    "txt01_references": (
        lambda t: r.find_references(t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_NOTE).alias("text")), _SOURCES),
        f"WITH {_FOUND} SELECT id, h.slug AS slug, h.target AS target, count(*) AS n FROM hits WHERE h.target IS NOT NULL GROUP BY ALL",
    ),
    "txt03_matched_items": (
        lambda t: t.orders.select("o_orderkey", r.match_item(F.expr(_TARGET), _SOURCES[0], True).alias("bare"), r.match_item(F.expr(_TARGET), _SOURCES[0], False).alias("labelled")),
        """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 3) AND o_orderkey % 500 <= 400 THEN CAST(o_orderkey % 500 AS VARCHAR) END AS bare, CASE WHEN o_orderkey % 6 = 1 AND o_orderkey % 500 <= 400 THEN CAST(o_orderkey % 500 AS VARCHAR) END AS labelled FROM orders""",
    ),
    "txt04_resolved_targets": (
        lambda t: t.orders.select("o_orderkey", r.resolve_target(F.expr(_TARGET), _SOURCES, _SOURCES[0]).alias("key")),
        f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'nips:' || {_HEXED.format("printf('%X', o_orderkey % 300)")} WHEN 2 THEN 'slips:' || o_orderkey % 90 WHEN 4 THEN 'bips:7'
          WHEN 5 THEN NULL ELSE CASE WHEN o_orderkey % 500 <= 400 THEN 'bips:' || o_orderkey % 500 END END AS key FROM orders""",
    ),
    "prj11_id_lists": (
        lambda t: t.orders.select("o_orderkey", F.array_join(r.id_list(F.concat_ws(", ", F.concat(F.lit("BIP-00"), "o_orderkey"), F.lit("none at all"), F.concat(F.lit("bip "), "o_custkey"), F.lit("0")), "BIP"), "|").alias("ids")),
        "SELECT o_orderkey, o_orderkey || '|' || o_custkey || '|0' AS ids FROM orders",
    ),
    "prj27_key_order": (
        lambda t: t.part.select(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(":"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))).alias("key")).select("key", r.key_order(F.col("key"))["number"].alias("number")).groupBy("key", "number").count(),
        "SELECT split_part(p_name, ' ', 1) || ':' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS key, CAST(CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS BIGINT) AS number, count(*) AS count FROM part GROUP BY ALL",
    ),
    "grf02_node_keys": (
        lambda t: t.customer.select("c_custkey", r.node_key(F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_custkey")).alias("key")),
        "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer",
    ),
    "val02_reviewed_violations": (
        lambda t: v.reviewed_violations(_reviewed(t), ["bips", "slips"], ["random", "stratified"], ["low", "high"], ["body"]),
        """WITH r AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 5 = 0 THEN 'zips:' ELSE 'bips:' END || c_custkey // 2 AS ip, c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 AS bad FROM customer),
          f AS (SELECT ip, min(line) AS first FROM r WHERE NOT bad GROUP BY ip)
          SELECT line, ip, 'bad key' AS rule FROM r WHERE line % 5 = 0 UNION ALL SELECT line, ip, 'no reviewer' FROM r WHERE line % 7 = 0 UNION ALL SELECT line, ip, 'bad review day' FROM r WHERE line % 11 = 0
          UNION ALL SELECT line, ip, 'bad target count' FROM r WHERE line % 13 = 0 UNION ALL SELECT line, ip, 'unknown strategy' FROM r WHERE line % 17 = 0
          UNION ALL SELECT r.line, r.ip, 'duplicate' FROM r JOIN f USING (ip) WHERE NOT r.bad AND r.line > f.first""",
    ),
    "val03_policy_warnings": (
        lambda t: v.policy_warnings(_reviewed(t), {"bips": "BUILDING"}),
        """WITH r AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 5 = 0 THEN 'zips:' ELSE 'bips:' END || c_custkey // 2 AS ip, c_mktsegment AS type FROM customer),
          p AS (SELECT line, CASE WHEN line % 5 = 0 THEN 'source' ELSE 'type' END AS kind, CASE WHEN line % 5 = 0 THEN '' ELSE 'bips' END AS slug, CASE WHEN line % 5 = 0 THEN ip ELSE ip || ' (' || type || ')' END AS shown FROM r WHERE line % 5 = 0 OR type <> 'BUILDING'),
          n AS (SELECT *, row_number() OVER (PARTITION BY kind, slug ORDER BY line) AS k FROM p)
          SELECT kind, slug, count(*) AS n, string_agg(shown, ', ' ORDER BY line) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) || ' more' ELSE '' END AS examples FROM n GROUP BY kind, slug""",
    ),
    "jon13_consistency_errors": (
        lambda t: v.consistency_errors(_curated(t), _source_rows(t), _metadata(t)),
        """WITH e AS (SELECT o_orderkey AS line, o_custkey AS s, o_orderkey % 100 AS x, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' ELSE DATE '1996-01-01' END AS day,
            CASE WHEN c_custkey % 3 = 0 THEN DATE '1997-06-01' END AS created FROM customer WHERE c_custkey % 10 <> 9),
          j AS (SELECT e.*, r.k AS known, r.day AS own, coalesce(t.created, CASE WHEN u.s_suppkey IS NOT NULL THEN DATE '1999-01-01' END) AS born, CASE WHEN w.s_suppkey IS NOT NULL THEN DATE '1998-02-01' END AS last
            FROM e LEFT JOIN r ON r.k = e.s LEFT JOIN r t ON t.k = e.x LEFT JOIN supplier u ON u.s_suppkey = e.x LEFT JOIN supplier w ON w.s_suppkey = e.s)
          SELECT line, 'source not reviewed' AS rule FROM j WHERE known IS NULL UNION ALL SELECT line, 'reviewed before its edge' FROM j WHERE known IS NOT NULL AND own < day UNION ALL SELECT line, 'target newer than source' FROM j WHERE known IS NOT NULL AND born > last""",
    ),
    "val04_history_violations": (
        lambda t: v.history_violations(
            t.events.groupBy(F.col("user_id").alias("id")).agg(
                F.collect_list(F.array(F.col("event_id").cast("string"), F.col("event_type"), F.lit("x"))).alias("history"),
                F.collect_list(F.struct(F.col("event_type").alias("commit"), F.when(F.col("value") > 5, "p").otherwise("").alias("path"), F.date_format("ts", "yyyy-MM-dd").alias("date"))).alias("events"),
            )
        ),
        "SELECT user_id AS id, 'event without path' AS rule FROM events GROUP BY user_id HAVING bool_or(coalesce(value, 0) <= 5 OR value IS NULL)",
    ),
    "val05_stale_rows": (
        lambda t: v.stale_payload(t.orders.groupBy("o_orderstatus", "o_orderpriority").count(), t.orders.groupBy("o_orderstatus", "o_orderpriority").agg((F.count("*") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("count"))),
        "WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, c AS count, 'stored' AS side FROM n UNION ALL SELECT o_orderstatus, o_orderpriority, c + 1, 'computed' FROM n",
    ),
    "sup06_error_stats": (
        lambda t: v.error_stats(_reviewed(t), v.reviewed_violations(_reviewed(t), ["bips", "slips"], ["random"], ["low"], ["body"]).filter("rule <> 'duplicate'")),
        """SELECT count(*) AS rows, count(*) FILTER (n > 0) AS rows_with_errors, CAST(sum(n) AS BIGINT) AS errors FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END
          + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS n FROM customer)""",
    ),
    "set02_source_combinations": (
        lambda t: co.combinations(t.documents, "lang").select("combination"),
        """WITH s AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
          SELECT string_agg(lang, '+' ORDER BY lang) AS combination FROM range(1, CAST(1 << (SELECT count(*) FROM s) AS BIGINT)) r(mask), s WHERE (mask >> i) & 1 = 1 GROUP BY mask HAVING count(*) > 1""",
    ),
    "stat06_centrality_comparison": (
        lambda t: y.centrality_comparison(_scores(t), 10).select("scope", "metric", "items", "judges", F.round("w", 9).alias("w")),
        f"""WITH {EDGES}, {_SCORES}, top AS (SELECT DISTINCT item FROM (SELECT *, row_number() OVER (PARTITION BY method, metric ORDER BY score DESC, item) AS n FROM scores) WHERE n <= 10),
          scoped AS (SELECT *, 'all' AS scope FROM scores UNION ALL SELECT *, 'top' FROM scores WHERE item IN (FROM top)), {_W}
          SELECT scope, metric, n AS items, m AS judges, round(12 * s / (m * m * (n * n * n - n) - m * ties), 9) AS w FROM q JOIN tie USING (scope, metric)""",
    ),
    "stat06_pairwise_tau": (
        lambda t: y.pairwise_tau(_scores(t)).select("metric", "left", "right", F.round("tau", 9).alias("tau")),
        f"""WITH {EDGES}, {_SCORES}, s AS (SELECT a.metric, a.method AS l, b.method AS r, a.item, a.score AS x, b.score AS y FROM scores a JOIN scores b ON a.metric = b.metric AND a.item = b.item AND a.method < b.method),
          p AS (SELECT a.metric, a.l, a.r, sign(a.x - b.x) * sign(a.y - b.y) AS z, a.x <> b.x AS dx, a.y <> b.y AS dy FROM s a JOIN s b ON a.metric = b.metric AND a.l = b.l AND a.r = b.r AND a.item < b.item)
          SELECT metric, l AS "left", r AS "right", round(sum(z) / (sqrt(count(*) FILTER (dx)) * sqrt(count(*) FILTER (dy))), 9) AS tau FROM p GROUP BY ALL""",
    ),
    "stat07_relation_checks": (
        lambda t: y.relation_checks(_typed(t), _nodes(t)),
        f"""WITH {EDGES}, {_TYPED}, d AS (SELECT DISTINCT method, CASE rel WHEN 'depends_on' THEN 'dependency' ELSE 'supersession' END AS kind, source, target, rel FROM typed)
          SELECT method, kind, count(*) FILTER (source = target) AS self_relations, count(*) FILTER (target NOT IN (SELECT 'bips:' || item FROM items)) AS unresolved FROM d GROUP BY ALL""",
    ),
    "stat07_supersession": (
        lambda t: y.supersession_summary(_typed(t)),
        f"""WITH {EDGES}, {_TYPED}, f AS (SELECT method, CASE rel WHEN 'supersedes' THEN source ELSE target END AS a, CASE rel WHEN 'supersedes' THEN target ELSE source END AS b, count(DISTINCT rel) = 2 AS mutual FROM typed WHERE rel <> 'depends_on' GROUP BY ALL)
          SELECT method, count(*) AS facts, count(*) FILTER (mutual) AS reciprocal, round(100 * count(*) FILTER (mutual) / count(*), 1) AS percentage FROM f GROUP BY method""",
    ),
    "agg30_run_statistics": (
        lambda t: y.run_statistics(t.events.select(F.col("event_type").alias("model"), F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("timestamp"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("success").alias("status"))),
        """WITH l AS (SELECT event_type AS model, user_id, count(*) AS n, max_by(event_id, (ts, event_id)) AS last FROM events GROUP BY ALL) SELECT model, CAST(sum(n) AS BIGINT) AS runs, count(*) AS documents, count(*) FILTER (last % 4 = 0) AS failed FROM l GROUP BY model""",
    ),
    "agg36_review_counts": (
        lambda t: y.review_counts(t.part.select(F.concat_ws(":", "p_brand", "p_partkey").alias("key")), t.part.join(t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.concat_ws(":", "p_brand", "p_partkey").alias("key"))),
        "SELECT p_brand AS slug, count(*) AS nodes, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS reviewed FROM part GROUP BY p_brand",
    ),
    "agg36_edges_by_slugs": (
        lambda t: y.edges_by_slugs(links(t).select(F.concat_ws(":", F.right("source", F.lit(1)), "source").alias("source"), F.concat_ws(":", F.right("target", F.lit(1)), "target").alias("target"))),
        f"""WITH {EDGES} SELECT right(source, 1) AS "from", right(target, 1) AS "to", count(*) AS edges FROM links GROUP BY ALL""",
    ),
    "top09_prefilled_sample": (
        lambda t: y.prefilled_sample(t.customer.select("c_nationkey", F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")).distinct().join(t.customer.select("c_nationkey", F.col("c_custkey").alias("key")), "key"), "key", ["c_nationkey"]).groupBy("c_nationkey", "status").count(),
        "SELECT c_nationkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'begun' ELSE 'pending' END AS status, count(*) AS count FROM customer GROUP BY ALL",
    ),
    "jon16_latest_metadata": (
        lambda t: y.latest_metadata(t.orders.select(F.col("o_orderstatus").alias("slug"), F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("created"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_commit"))),
        """WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS snapshot FROM orders) SELECT o_orderstatus || ':' || o_orderkey AS key, o_orderpriority AS title, '' AS created, strftime(o_orderdate, '%Y-%m-%d') AS last_commit FROM o
          WHERE (o_orderstatus, snapshot) IN (SELECT o_orderstatus, max(snapshot) FROM o GROUP BY o_orderstatus)""",
    ),
    "cmp09_backfilled": (
        lambda t: y.backfilled(
            t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("author"), F.lit(None).cast("string").alias("created")),
            t.orders.select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("name")),
        ),
        """WITH c AS (SELECT o_custkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS name FROM orders), f AS (SELECT id, min(day) AS day FROM c GROUP BY id),
          n AS (SELECT id, day, string_agg(DISTINCT name, chr(10) ORDER BY name) AS names FROM c JOIN f USING (id, day) GROUP BY id, day)
          SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE names END AS author, day AS created FROM customer LEFT JOIN n ON id = c_custkey""",
    ),
    "dat06_normal_events": (
        lambda t: y.normal_events(t.events.select(F.col("event_id").alias("id"), F.concat(F.lit(" "), "event_type").alias("commit"), F.lit(None).cast("string").alias("path"), F.lit("a ").alias("author"), F.col("event_type").alias("status"), F.lit("").alias("standard"), F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise("soon").alias("date"))),
        "SELECT event_id AS id, event_type AS commit, '' AS path, 'a' AS author, event_type AS status, '' AS standard, CASE WHEN event_id % 5 > 0 THEN CAST(ts AS DATE) END AS date FROM events",
    ),
    "sup10_labelled_cases": (
        lambda t: y.labelled_cases(t.orders.select(F.col("o_custkey").alias("newer"), F.col("o_orderkey").alias("older")), t.customer.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))),
        """SELECT o_custkey || CASE WHEN o_custkey % 2 = 0 AND a.c_name IS NOT NULL THEN ' (' || a.c_name || ')' ELSE '' END AS newer, o_orderkey || CASE WHEN o_orderkey % 2 = 0 AND b.c_name IS NOT NULL THEN ' (' || b.c_name || ')' ELSE '' END AS older
          FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_orderkey""",
    ),
}
