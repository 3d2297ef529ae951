"""Network and review queries."""

from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.operators import centrality as ce
from textloom.operators import graph as gr
from textloom.operators import ranking
from textloom.operators import review as rv
from textloom.operators.components import connected_components
from textloom.plans.bindings import EDGES, FLOWS, NODES, Tables, flows, items, links, nodes

_G = "g AS (SELECT DISTINCT source, target FROM flows WHERE method = 'A')"
_ALL = "g AS (SELECT DISTINCT source, target FROM flows)"
_U = "u AS (SELECT source, target FROM g UNION SELECT target, source FROM g)"


def _dense(t: Tables, method: str | None = "A"):
    found = flows(t)
    return (found if method is None else found.filter(F.col("method") == method)).select("source", "target").distinct()


def _parts(t: Tables, method: str | None = "R"):
    """The network of parts by one method, or by all."""
    found = links(t)
    return (found if method is None else found.filter(F.col("method") == method)).select("source", "target").distinct()


def _part_names(t: Tables):
    return items(t).select(F.col("item").alias("node"))


_PG = "g AS MATERIALIZED (SELECT DISTINCT source, target FROM links WHERE method = 'R')"


def _names(t: Tables):
    return t.nation.select(F.col("n_name").alias("node"))


def _rank_sql(rounds: int, edges: str = "SELECT source, target, 1 AS w FROM g") -> str:
    out = f"WITH {FLOWS}, {_G}, e AS ({edges}), n AS (SELECT n_name AS node, sum(w) AS o FROM nation LEFT JOIN e ON source = n_name GROUP BY n_name), r0 AS (SELECT node, o, 1.0::DOUBLE / 25 AS s FROM n)"
    for k in range(rounds):
        out += f""", r{k + 1} AS MATERIALIZED (SELECT r.node, r.o, 0.85::DOUBLE * (coalesce(f.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{k} WHERE o IS NULL) / 25) + 0.15::DOUBLE / 25 AS s FROM r{k} r
          LEFT JOIN (SELECT target, sum(x.s * e.w / x.o) AS s FROM e JOIN r{k} x ON x.node = e.source GROUP BY target) f ON f.target = r.node)"""
    return out + f" SELECT node, round(s, 9) AS score FROM r{rounds}"


#: Both directions of each pair of nations, with what one has shipped more.
_PAIRED = "SELECT source, target, sum(surplus) AS w FROM (SELECT source, target, surplus FROM flows UNION ALL SELECT target, source, surplus FROM flows) GROUP BY ALL"


def _paired(t: Tables):
    return gr.both_ways(flows(t), "surplus").groupBy("source", "target").agg(F.sum("surplus").alias("surplus"))


def _power_sql(rounds: int) -> str:
    """Power iteration, scaled to length 1 at the end only."""
    out = f"WITH {FLOWS}, {_ALL}, {_U}, r0 AS (SELECT n_name AS node, 0.2::DOUBLE AS s FROM nation)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT r.node, r.s + coalesce(f.s, 0) AS s FROM r{k} r LEFT JOIN (SELECT target, sum(x.s) AS s FROM u JOIN r{k} x ON x.node = u.source GROUP BY target) f ON f.target = r.node)"
    return out + f" SELECT node, round(s / (SELECT sqrt(sum(s * s)) FROM r{rounds}), 6) AS score FROM r{rounds}"


def _paths_sql(edges: str) -> str:
    return f"""walk AS (SELECT n_name AS origin, n_name AS node, 0 AS d FROM nation UNION SELECT w.origin, e.target, w.d + 1 FROM walk w JOIN {edges} e ON e.source = w.node WHERE w.d < 12),
      dist AS (SELECT origin, node, min(d) AS d FROM walk GROUP BY ALL),
      steps AS (SELECT origin, node, 0 AS d, 1::BIGINT AS paths FROM dist WHERE d = 0 UNION ALL
        SELECT s.origin, e.target, s.d + 1, sum(s.paths)::BIGINT FROM steps s JOIN {edges} e ON e.source = s.node JOIN dist x ON x.origin = s.origin AND x.node = e.target AND x.d = s.d + 1 GROUP BY s.origin, e.target, s.d)"""



def _graphs(t: Tables):
    """The network of parts by method, relation type and model: the relation types of method R are its models."""
    found = links(t).withColumn("model", F.when(F.col("method") == "R", F.concat(F.lit("m"), "rel")))
    return ce.method_graphs(found, "method", "R", published="mF")


_METHOD_GRAPHS = f"""WITH {EDGES}, e AS MATERIALIZED (SELECT DISTINCT graph, source, target FROM (
  SELECT method AS graph, source, target FROM links WHERE method <> 'R' OR rel = 'F' UNION ALL SELECT method || '/' || rel, source, target FROM links WHERE method <> 'R' UNION ALL SELECT 'R@m' || rel, source, target FROM links WHERE method = 'R')),
  gn AS MATERIALIZED (SELECT graph, item AS node, (SELECT count(*) FROM items) AS n FROM items, (SELECT DISTINCT graph FROM e))"""


def _ranks_sql(rounds: int = 40) -> str:
    """PageRank of each graph, round by round; a graph that has converged keeps its scores."""
    out = _METHOD_GRAPHS + ", o AS (SELECT graph, source AS node, count(*) AS o FROM e GROUP BY ALL), r0 AS MATERIALIZED (SELECT graph, node, n, o, 1.0::DOUBLE / n AS s, false AS done, 0 AS k, 0.0::DOUBLE AS change FROM gn LEFT JOIN o USING (graph, node))"
    for k in range(rounds):
        out += f""", f{k} AS (SELECT x.graph, e.target AS node, sum(x.s / x.o) AS f FROM e JOIN r{k} x ON x.graph = e.graph AND x.node = e.source WHERE NOT x.done GROUP BY ALL),
          l{k} AS (SELECT graph, sum(CASE WHEN o IS NULL THEN s ELSE 0 END) AS lost FROM r{k} GROUP BY graph),
          v{k} AS (SELECT r.*, 0.85::DOUBLE * (coalesce(f, 0) + lost / n) + 0.15::DOUBLE / n AS new FROM r{k} r JOIN l{k} USING (graph) LEFT JOIN f{k} f ON f.graph = r.graph AND f.node = r.node),
          r{k + 1} AS MATERIALIZED (SELECT graph, node, n, o, CASE WHEN done THEN s ELSE new END AS s, done OR sum(abs(new - s)) OVER (PARTITION BY graph) < n * 1e-6 AS done, CASE WHEN done THEN k ELSE {k + 1} END AS k,
            CASE WHEN done THEN change ELSE sum(abs(new - s)) OVER (PARTITION BY graph) END AS change FROM v{k})"""
    return out


def _values_sql(rounds: int) -> str:
    """Eigenvector scores of each graph, round by round."""
    out = _METHOD_GRAPHS + ", r0 AS MATERIALIZED (SELECT graph, node, n, 1 / sqrt(n) AS s, false AS done, 0 AS k FROM gn)"
    for k in range(rounds):
        out += f""", f{k} AS (SELECT x.graph, e.target AS node, sum(x.s) AS f FROM e JOIN r{k} x ON x.graph = e.graph AND x.node = e.source WHERE NOT x.done GROUP BY ALL),
          w{k} AS (SELECT r.*, coalesce(f, 0) AS raw, sqrt(sum(coalesce(f, 0) * coalesce(f, 0)) OVER (PARTITION BY r.graph)) AS norm FROM r{k} r LEFT JOIN f{k} f ON f.graph = r.graph AND f.node = r.node),
          v{k} AS (SELECT *, CASE WHEN norm > 0 THEN raw / norm ELSE 0 END AS new FROM w{k}),
          r{k + 1} AS MATERIALIZED (SELECT graph, node, n, CASE WHEN done THEN s ELSE new END AS s, done OR NOT norm > 0 OR sum(abs(new - s)) OVER (PARTITION BY graph) < n * 1e-6 AS done, CASE WHEN done THEN k ELSE {k + 1} END AS k FROM v{k})"""
    return out


def _scored(t: Tables, operator, **settings):
    """Scores of the graphs' nodes; the graphs are made once."""
    edges = written(_graphs(t))
    return operator(edges, _grid(t, edges), **settings)


def _grid(t: Tables, edges):
    return ranking.in_every_group(_part_names(t), edges.select("graph").distinct(), "node")


QUERIES = {
    "cmp02_graph_ranks": (
        lambda t: _scored(t, ce.page_ranks).scores.select("graph", "node", F.round("score", 9).alias("score")),
        _ranks_sql() + " SELECT graph, node, round(s, 9) AS score FROM r40",
    ),
    "grf04_outcomes": (
        lambda t: _scored(t, ce.page_ranks).outcomes.select("graph", "nodes", "rounds", F.round("change", 9).alias("change"), "outcome"),
        _ranks_sql() + " SELECT graph, n AS nodes, CAST(k AS INT) AS rounds, round(change, 9) AS change, 'converged' AS outcome FROM r40 GROUP BY ALL",
    ),
    "cmp02_graph_values": (
        lambda t: _scored(t, ce.eigenvectors).scores.select("graph", "node", F.round("score", 6).alias("score")),
        _values_sql(60) + " SELECT graph, node, round(s, 6) AS score FROM r60",
    ),
    "grf08_zeros_on_failure": (
        lambda t: (lambda found: found.outcomes.join(found.scores.groupBy("graph").agg(F.count_if(F.col("score") != 0).alias("scored")), "graph").select("graph", "rounds", "outcome", "scored"))(
            _scored(t, ce.eigenvectors, rounds=3, zero_on_failure=True)
        ),
        _METHOD_GRAPHS + " SELECT graph, CAST(3 AS INT) AS rounds, 'exhausted' AS outcome, CAST(0 AS BIGINT) AS scored FROM e GROUP BY graph",
    ),
    "cmp02_summaries": (
        lambda t: ce.summaries(ce.degrees(_graphs(t), _grid(t, _graphs(t)))).select("graph", "nodes", "edges", "isolated", F.round("density", 12).alias("density")),
        _METHOD_GRAPHS + """, x AS (SELECT graph, node, (SELECT count(*) FROM e WHERE e.graph = gn.graph AND e.source = gn.node) AS o, (SELECT count(*) FROM e WHERE e.graph = gn.graph AND e.target = gn.node) AS i FROM gn)
          SELECT graph, count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (o = 0 AND i = 0) AS isolated, round(sum(o) / (count(*) * (count(*) - 1)), 12) AS density FROM x GROUP BY graph""",
    ),
    "grf03_degrees": (
        lambda t: gr.degrees(_parts(t), _part_names(t)),
        f"""WITH {EDGES}, {_PG}, o AS (SELECT source AS node, count(*) AS n FROM g GROUP BY source), i AS (SELECT target AS node, count(*) AS n FROM g GROUP BY target)
          SELECT item AS node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM items LEFT JOIN o ON o.node = item LEFT JOIN i ON i.node = item""",
    ),
    "grf03_summary": (
        lambda t: gr.summary(links(t).select("source", "target").distinct(), items(t), "item"),
        f"""WITH {EDGES}, e AS (SELECT DISTINCT source, target FROM links) SELECT (SELECT count(*) FROM items) AS nodes, (SELECT count(*) FROM e) AS edges,
          (SELECT count(*) FROM items WHERE item NOT IN (SELECT source FROM e UNION SELECT target FROM e)) AS isolated,
          (SELECT count(*) FROM e) / ((SELECT count(*) FROM items) * ((SELECT count(*) FROM items) - 1)) AS density""",
    ),
    "grf04_page_rank_5_rounds": (
        lambda t: gr.page_rank(_dense(t), _names(t), rounds=5, tolerance=0).select("node", F.round("score", 9).alias("score")),
        _rank_sql(5),
    ),
    "grf05_weighted_page_rank": (
        lambda t: gr.page_rank(_paired(t), _names(t), weight="surplus", scaled=False, rounds=12, tolerance=0).select("node", F.round("score", 9).alias("score")),
        _rank_sql(12, _PAIRED),
    ),
    "grf07_eigenvector": (
        lambda t: gr.eigenvector(gr.both_ways(_dense(t, None)).distinct(), _names(t), shifted=True, rounds=12, tolerance=0).select("node", F.round("score", 6).alias("score")),
        _power_sql(12),
    ),
    "grf09_betweenness": (
        lambda t: gr.betweenness(_dense(t), _names(t)).select("node", F.round("score", 9).alias("score")),
        f"""WITH RECURSIVE {FLOWS}, {_G}, {_paths_sql("g")}, b AS (SELECT v.node, sum(v.paths * w.paths / st.paths) AS s FROM steps st JOIN steps v ON v.origin = st.origin JOIN steps w ON w.origin = v.node AND w.node = st.node
          WHERE st.d > 1 AND v.d > 0 AND w.d > 0 AND v.d + w.d = st.d GROUP BY v.node)
          SELECT n_name AS node, round(coalesce(s, 0) / (24 * 23), 9) AS score FROM nation LEFT JOIN b ON node = n_name""",
    ),
    "grf11_closeness": (
        lambda t: gr.closeness(gr.shortest_paths(_dense(t), _names(t)), _names(t)).select("node", F.round("score", 9).alias("score")),
        f"""WITH RECURSIVE {FLOWS}, {_G}, {_paths_sql("g")} SELECT origin AS node, round(coalesce(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * ((count(*) - 1) / 24) END, 0), 9) AS score FROM dist GROUP BY origin""",
    ),
    "grf12_components": (
        lambda t: connected_components(_parts(t), "source", "target"),
        f"""WITH RECURSIVE {EDGES}, {_PG}, {_U},
          reach AS (SELECT source AS node, source AS other FROM u UNION SELECT r.node, u.target FROM reach r JOIN u ON u.source = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node""",
    ),
    "grf13_strong_components": (
        lambda t: gr.strong_components(_parts(t)),
        f"""WITH RECURSIVE {EDGES}, {_PG}, reach AS (SELECT source, target FROM g UNION SELECT r.source, g.target FROM reach r JOIN g ON g.source = r.target)
          SELECT a.source AS node, least(min(a.target), a.source) AS component FROM reach a JOIN reach b ON b.source = a.target AND b.target = a.source WHERE a.source <> a.target GROUP BY a.source""",
    ),
    "grf14_simple_cycles": (
        lambda t: gr.simple_cycles(_dense(t, None), 3),
        f"""WITH {FLOWS}, {_ALL} SELECT CAST(2 AS INT) AS length, count(*) AS cycles FROM g a JOIN g b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target
          UNION ALL SELECT 3, count(*) FROM g a JOIN g b ON a.target = b.source JOIN g c ON b.target = c.source AND c.target = a.source WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target""",
    ),
    "grf15_depth": (
        lambda t: gr.depth(_dense(t, "R"), _names(t)),
        f"""WITH RECURSIVE {FLOWS}, g AS (SELECT DISTINCT source, target FROM flows WHERE method = 'R'), {_paths_sql("g")}
          SELECT CAST(coalesce(max(d), 0) AS INT) AS depth FROM dist WHERE origin NOT IN (SELECT target FROM g)""",
    ),
    "flt13_neighbourhood": (
        lambda t: gr.neighbourhood(_parts(t, None), _part_names(t).filter("node < 'PART_12'")),
        f"WITH {EDGES}, g AS (SELECT DISTINCT source, target FROM links) SELECT * FROM g WHERE source < 'PART_12' OR target < 'PART_12'",
    ),
    "flt14_least_degree": (
        lambda t: gr.least_degree(_parts(t), 9),
        f"WITH {EDGES}, {_PG}, d AS (SELECT n FROM (SELECT source AS n FROM g UNION ALL SELECT target FROM g) GROUP BY n HAVING count(*) >= 9) SELECT * FROM g WHERE source IN (FROM d) AND target IN (FROM d)",
    ),
    "sup17_induced": (lambda t: gr.induced(_parts(t, None), _part_names(t).filter("node > 'PART_2'")), f"WITH {EDGES}, g AS (SELECT DISTINCT source, target FROM links) SELECT * FROM g WHERE source > 'PART_2' AND target > 'PART_2'"),
    "val01_edge_violations": (
        lambda t: rv.edge_violations(_curated(t), ["bips", "slips"], ["F", "O"]),
        f"""WITH {EDGES}, {{curated}}, k AS (SELECT *, count(*) OVER (PARTITION BY source, target, rel) AS same, min(rel) OVER (PARTITION BY source, target) <> max(rel) OVER (PARTITION BY source, target) AS clash FROM c)
          SELECT source, target, 'unknown catalogue' AS rule FROM k WHERE source LIKE 'nips%' OR target LIKE 'nips%' UNION ALL SELECT source, target, 'no reviewer' FROM k WHERE reviewer = ''
          UNION ALL SELECT source, target, 'bad day' FROM k WHERE reviewed_at = '2024-02-30' UNION ALL SELECT source, target, 'duplicate' FROM k WHERE same > 1
          UNION ALL SELECT source, target, 'conflicting types' FROM k WHERE clash""",
    ),
    "win11_era_buckets": (
        lambda t: rv.era_buckets(nodes(t).select("id", F.when(F.col("id") % 13 > 0, F.col("created")).alias("created")), 7),
        f"""WITH {NODES}, d AS (SELECT id, CASE WHEN id % 13 > 0 THEN created END AS created FROM nodes) SELECT id, created, CASE WHEN created IS NOT NULL THEN
          CAST(least(((row_number() OVER (PARTITION BY created IS NULL ORDER BY created, id) - 1) * 7) // count(*) OVER (PARTITION BY created IS NULL), 6) AS INT) END AS bucket FROM d""",
    ),
    "top07_sample_by_stratum": (
        lambda t: rv.stratified_sample(nodes(t), ["status", "layer"], 100, 11).groupBy("status", "layer").count(),
        f"""WITH {NODES}, s AS (SELECT DISTINCT status, layer FROM nodes), r AS (SELECT *, row_number() OVER (ORDER BY status, layer) AS k FROM s)
          SELECT status, layer, CAST(6 + CASE WHEN k <= 10 THEN 1 ELSE 0 END AS BIGINT) AS count FROM r""",
    ),
    "top08_density_buckets": (
        lambda t: gr.degrees(_parts(t), _part_names(t)).select("node", rv.density_bucket(F.col("out_degree"), 3).alias("bucket")),
        f"WITH {EDGES}, {_PG} SELECT item AS node, CASE WHEN count(target) = 0 THEN 'none' WHEN count(target) < 3 THEN 'low' ELSE 'high' END AS bucket FROM items LEFT JOIN g ON source = item GROUP BY item",
    ),
    "flt01_focus": (lambda t: rv.in_focus(t.part.select(F.col("p_partkey").alias("id")), "1-9,30-44,85,a0"), "SELECT p_partkey AS id FROM part WHERE p_partkey BETWEEN 1 AND 9 OR p_partkey BETWEEN 30 AND 44 OR p_partkey = 85"),
    "flt02_filter_expression": (
        lambda t: rv.matching(t.documents.select("source", F.col("doc_id").cast("string").alias("id")), rv.filter_ranges(t.spark, "src3 10-400, src5, 0123, 17-19", [f"src{i}" for i in range(20)])),
        """SELECT source, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE (source = 'src3' AND doc_id BETWEEN 10 AND 400) OR source = 'src5' OR doc_id = 123 OR doc_id BETWEEN 17 AND 19""",
    ),
    "flt03_merged_ranges": (
        lambda t: rv.merged_ranges(t.part.select("p_brand", F.col("p_partkey").alias("low"), (F.col("p_partkey") + F.col("p_size")).alias("high")), ["p_brand"]),
        """WITH r AS (SELECT p_brand, p_partkey AS low, p_partkey + p_size AS high FROM part),
          m AS (SELECT *, max(high) OVER (PARTITION BY p_brand ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
          i AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY low, high) AS island FROM m)
          SELECT p_brand, min(low) AS low, max(high) AS high FROM i GROUP BY p_brand, island""",
    ),
    "flt10_review_window": (
        lambda t: rv.in_review_window(nodes(t).select("id", F.date_format("created", "yyyy-MM-dd").alias("day")), "day", "1998-03-01", "1997-02-01"),
        f"WITH {NODES} SELECT id, strftime(created, '%Y-%m-%d') AS day FROM nodes WHERE created BETWEEN DATE '1997-02-01' AND DATE '1998-03-01'",
    ),
    "win03_latest_runs": (
        lambda t: rv.latest_runs(t.events.select("user_id", "event_type", F.col("event_id").alias("run_id"), F.col("ts").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success").alias("status")), ["user_id", "event_type"]).drop("timestamp"),
        "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS run_id, 'success' AS status FROM events WHERE event_id % 3 <> 0 GROUP BY ALL",
    ),
}


def _curated(t: Tables):
    """Relations as curated edges, some of them wrong."""
    number = F.length("source") * 31 + F.length("target")
    slug = F.when(F.col("source") < "PART_10", "nips").when(F.col("source") < "PART_2", "bips").otherwise("slips")
    return links(t).filter("method = 'A'").select(
        F.concat_ws(":", slug, "source").alias("source"), F.concat(F.lit("bips:"), "target").alias("target"), "rel",
        F.when(number % 4 > 0, "R").otherwise("").alias("reviewer"), F.when(number % 3 > 0, "2024-02-29").otherwise("2024-02-30").alias("reviewed_at"),
    )


_CURATED = """c AS (SELECT CASE WHEN source < 'PART_10' THEN 'nips' WHEN source < 'PART_2' THEN 'bips' ELSE 'slips' END || ':' || source AS source, 'bips:' || target AS target, rel,
  CASE WHEN (length(source) * 31 + length(target)) % 4 > 0 THEN 'R' ELSE '' END AS reviewer, CASE WHEN (length(source) * 31 + length(target)) % 3 > 0 THEN '2024-02-29' ELSE '2024-02-30' END AS reviewed_at FROM links WHERE method = 'A')"""
QUERIES["val01_edge_violations"] = (QUERIES["val01_edge_violations"][0], QUERIES["val01_edge_violations"][1].replace("{curated}", _CURATED))
