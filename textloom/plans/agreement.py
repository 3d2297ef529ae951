"""Agreement, evaluation, ranking and concordance queries."""

from pyspark.sql import functions as F

from textloom.functions.shared import dealt
from textloom.operators import agreement as g
from textloom.operators import ranking as r
from textloom.plans.bindings import EDGES, Tables, items, links

_A = "a AS (SELECT DISTINCT source, target FROM links WHERE method = 'A')"
_N = "n AS (SELECT DISTINCT source, target FROM links WHERE method = 'N')"
_DEGREES = """found AS (SELECT DISTINCT method, source, target FROM links), degrees AS (
  SELECT method, 'in' AS metric, target AS item, count(*) AS score FROM found GROUP BY method, target UNION ALL SELECT method, 'out', source, count(*) FROM found GROUP BY method, source)"""
_GRID = """grid AS (SELECT m.method, m.metric, i.item, coalesce(score, 0) AS score FROM items i CROSS JOIN (SELECT DISTINCT method, metric FROM degrees) m
  LEFT JOIN degrees d ON d.method = m.method AND d.metric = m.metric AND d.item = i.item)"""


def _degrees(t: Tables):
    found = dealt(links(t).select("method", "source", "target"), t.n_lines(), "method", "source", "target").distinct()
    ends = found.select("method", F.inline(F.array(F.struct(F.lit("in").alias("metric"), F.col("target").alias("item")), F.struct(F.lit("out").alias("metric"), F.col("source").alias("item")))))
    return ends.groupBy("method", "metric", "item").agg(F.count("*").alias("score"))


def _grid(t: Tables):
    return r.score_grid(items(t).select("item"), _degrees(t), ["method", "metric"])


def _agreement_sql(by: str, types: int) -> str:
    on = " AND ".join(f"x.{c} = y.{c}" for c in by.split(", "))
    return f"""WITH {EDGES}, s AS (SELECT DISTINCT method, {by} FROM links), z AS (SELECT method, count(*) AS size FROM s GROUP BY method),
      o AS (SELECT x.method AS approach, y.method AS baseline, count(*) AS k FROM s x JOIN s y ON {on} GROUP BY ALL),
      f AS (SELECT p.method AS approach, q.method AS baseline, coalesce(k, 0) AS overlap, p.size AS pa, q.size AS pb, (SELECT count(*) * (count(*) - 1) * {types} FROM items)::DOUBLE AS u
        FROM z p CROSS JOIN z q LEFT JOIN o ON o.approach = p.method AND o.baseline = q.method),
      k AS (SELECT *, (u - pa - pb + 2 * overlap) / u AS po, pa / u * (pb / u) + (u - pa) / u * ((u - pb) / u) AS pe FROM f)
      SELECT approach, baseline, overlap, pa - overlap AS approach_only, pb - overlap AS baseline_only, pa + pb - overlap AS "union", overlap / pb AS hit_rate, (po - pe) / (1 - pe) AS kappa FROM k"""


QUERIES = {
    "jon04_overlap_classes": (
        lambda t: g.overlap_classes(g.edges_of(links(t), "A"), g.edges_of(links(t), "N")),
        f"""WITH {EDGES}, {_A}, {_N} SELECT coalesce(a.source, n.source) AS source, coalesce(a.target, n.target) AS target,
          CASE WHEN a.source IS NULL THEN 'baseline_only' WHEN n.source IS NULL THEN 'approach_only' ELSE 'overlap' END AS kind FROM a FULL JOIN n ON a.source = n.source AND a.target = n.target""",
    ),
    "jon05_wildcard_types": (
        lambda t: g.typed_with_wildcards(g.edges_of(links(t), "A"), links(t).filter("method = 'N'"), ["F", "O"]),
        f"""WITH {EDGES}, {_A}, typed AS (SELECT DISTINCT source, target, rel FROM links WHERE method = 'N')
          SELECT a.source, a.target, rel FROM a JOIN typed USING (source, target) UNION ALL
          SELECT source, target, rel FROM (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM typed t WHERE t.source = a.source AND t.target = a.target)) CROSS JOIN (VALUES ('F'), ('O')) v(rel)""",
    ),
    "agg33_pairwise_agreement": (lambda t: g.pairwise_agreement(links(t), items(t)), _agreement_sql("source, target", 1)),
    "agg33_typed_agreement": (lambda t: g.pairwise_agreement(links(t), items(t), ["source", "target", "rel"], 2), _agreement_sql("source, target, rel", 2)),
    "set01_first_wins_union": (
        lambda t: g.first_wins_union([t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))], "key"),
        "SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    ),
    "set03_edge_difference": (
        lambda t: g.edges_of(links(t), "A").subtract(g.edges_of(links(t), "N")),
        f"WITH {EDGES}, {_A}, {_N} SELECT * FROM a EXCEPT SELECT * FROM n",
    ),
    "set03_edge_intersection": (
        lambda t: g.edges_of(links(t), "A").intersect(g.edges_of(links(t), "N")),
        f"WITH {EDGES}, {_A}, {_N} SELECT * FROM a INTERSECT SELECT * FROM n",
    ),
    "set04_replace_slice": (
        lambda t: g.replace_slice(links(t), "R", links(t).filter("method = 'A' and rel = 'F'")).groupBy("method", "rel").count(),
        f"WITH {EDGES} SELECT method, rel, count(*) AS count FROM (SELECT method, rel FROM links WHERE method <> 'R' UNION ALL SELECT 'R', rel FROM links WHERE method = 'A' AND rel = 'F') GROUP BY ALL",
    ),
    "set05_flat_edges": (
        lambda t: links(t).groupBy("source", "target", "method", "rel").agg(F.count("*").alias("value")),
        f"WITH {EDGES} SELECT source, target, method, rel, count(*) AS value FROM links GROUP BY ALL",
    ),
    "flt04_referential_edges": (
        lambda t: g.referential(
            links(t).select(F.right("source", F.lit(2)).alias("slug"), "source", F.right("target", F.lit(2)).alias("target_slug"), "target").distinct(),
            items(t).filter("size > 25").select(F.right("item", F.lit(2)).alias("slug"), F.col("item").alias("id")),
        ),
        f"""WITH {EDGES}, e AS (SELECT DISTINCT right(source, 2) AS slug, source, right(target, 2) AS target_slug, target FROM links), k AS (SELECT right(item, 2) AS slug, item AS id FROM items WHERE size > 25)
          SELECT * FROM e WHERE NOT (slug = target_slug AND source = target) AND (target IN (SELECT id FROM k) OR target_slug NOT IN (SELECT slug FROM k))""",
    ),
    "flt05_catalogue_edges": (
        lambda t: g.in_catalogue(links(t), items(t).filter("size <> 2"), "item").groupBy("method").count(),
        f"WITH {EDGES}, k AS (SELECT item FROM items WHERE size <> 2) SELECT method, count(*) AS count FROM links WHERE source IN (FROM k) AND target IN (FROM k) GROUP BY method",
    ),
    "flt06_edges_by_type": (lambda t: g.edges_of(links(t), "A", "F"), f"WITH {EDGES} SELECT DISTINCT source, target FROM links WHERE method = 'A' AND rel = 'F'"),
    "flt07_null_key_filter": (
        lambda t: g.without_null_keys(links(t).withColumn("target", F.nullif("target", F.lit("PART_7")))).groupBy("method").count(),
        f"WITH {EDGES} SELECT method, count(*) AS count FROM links WHERE target <> 'PART_7' GROUP BY method",
    ),
    "jon12_reciprocal_facts": (
        lambda t: g.reciprocal_facts(links(t).select("source", "target", F.when(F.col("rel") == "F", "supersedes").otherwise("superseded_by").alias("rel"))),
        f"""WITH {EDGES}, f AS (SELECT CASE rel WHEN 'F' THEN source ELSE target END AS newer, CASE rel WHEN 'F' THEN target ELSE source END AS older, rel FROM links)
          SELECT newer, older, count(DISTINCT rel) = 2 AS reciprocal FROM f GROUP BY ALL""",
    ),
    "stat04_edge_evaluation": (
        lambda t: g.evaluate(g.edges_of(links(t), "A"), g.edges_of(links(t), "N"), ["source", "target"]),
        f"""WITH {EDGES}, {_A}, {_N}, x AS (SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM n)) AS tp, (SELECT count(*) FROM (FROM a EXCEPT FROM n)) AS fp, (SELECT count(*) FROM (FROM n EXCEPT FROM a)) AS fn)
          SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM x""",
    ),
    "stat04_typed_evaluation": (
        lambda t: g.evaluate(
            g.typed_with_wildcards(g.edges_of(links(t), "A"), links(t).filter("method = 'N'"), ["F", "O"]), links(t).filter("method = 'N'"), ["source", "target", "rel"]
        ),
        f"""WITH {EDGES}, {_A}, gold AS (SELECT DISTINCT source, target, rel FROM links WHERE method = 'N'), p AS (
            SELECT a.source, a.target, rel FROM a JOIN gold USING (source, target) UNION ALL
            SELECT source, target, rel FROM (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM gold t WHERE t.source = a.source AND t.target = a.target)) CROSS JOIN (VALUES ('F'), ('O')) v(rel)),
          x AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM gold)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM gold)) AS fp, (SELECT count(*) FROM (FROM gold EXCEPT FROM p)) AS fn)
          SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM x""",
    ),
    "agg34_gold_composition": (
        lambda t: g.composition(links(t).filter("method = 'N'"), ["rel", "source"]),
        f"""WITH {EDGES}, x AS (SELECT 'rel' AS dimension, rel AS value FROM links WHERE method = 'N' UNION ALL SELECT 'source', source FROM links WHERE method = 'N'),
          c AS (SELECT dimension, value, count(*) AS n FROM x GROUP BY ALL) SELECT dimension, value, n, n / sum(n) OVER (PARTITION BY dimension) AS share FROM c""",
    ),
    "agg35_type_mapping_counts": (
        lambda t: links(t).rollup("method", "rel").agg(F.countDistinct("source", "target").alias("pairs")),
        f"WITH {EDGES} SELECT method, rel, count(DISTINCT (source, target)) AS pairs FROM links GROUP BY ROLLUP (method, rel)",
    ),
    "flt09_reviewed_scope": (
        lambda t: links(t).join(items(t).filter("size = 1").select(F.col("item").alias("source")), "source", "left_semi").groupBy("method", "source").count(),
        f"WITH {EDGES} SELECT method, source, count(*) AS count FROM links WHERE source IN (SELECT item FROM items WHERE size = 1) GROUP BY ALL",
    ),
    "win01_competition_rank": (
        lambda t: r.competition_rank(_degrees(t), ["method", "metric"]),
        f"WITH {EDGES}, {_DEGREES} SELECT method, metric, item, score, CAST(rank() OVER (PARTITION BY method, metric ORDER BY score DESC) AS INT) AS rank FROM degrees",
    ),
    "win02_average_rank": (
        lambda t: r.average_rank(_grid(t), ["method", "metric"]),
        f"""WITH {EDGES}, {_DEGREES}, {_GRID} SELECT *, rank() OVER (PARTITION BY method, metric ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, metric, score) - 1) / 2 AS average_rank FROM grid""",
    ),
    "jon11_score_grid": (_grid, f"WITH {EDGES}, {_DEGREES}, {_GRID} SELECT * FROM grid"),
    "stat02_kendall_w": (
        lambda t: r.kendall_w(_grid(t).withColumnRenamed("method", "judge"), ["metric"]),
        f"""WITH {EDGES}, {_DEGREES}, {_GRID}, k AS (SELECT *, rank() OVER (PARTITION BY method, metric ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, metric, score) - 1) / 2 AS ar FROM grid),
          s AS (SELECT metric, item, sum(ar) AS r FROM k GROUP BY ALL), v AS (SELECT metric, sum(r * r) - sum(r) * sum(r) / count(*) AS s, count(*) AS n FROM s GROUP BY metric),
          g AS (SELECT method, metric, score, count(*) AS t FROM grid GROUP BY ALL), tie AS (SELECT metric, sum(t * t * t - t) AS ties, count(DISTINCT method) AS m FROM g GROUP BY metric)
          SELECT metric, 12 * s / (m * m * (n * n * n - n) - m * ties) AS w FROM v JOIN tie USING (metric)""",
    ),
    "stat03_kendall_tau_b": (
        lambda t: r.kendall_tau_b(
            _grid(t).filter("method = 'A'").select("metric", "item", F.col("score").alias("x")).join(_grid(t).filter("method = 'N'").select("metric", "item", F.col("score").alias("y")), ["metric", "item"]), ["metric"]
        ),
        f"""WITH {EDGES}, {_DEGREES}, {_GRID}, s AS (SELECT a.metric, a.item, a.score AS x, b.score AS y FROM grid a JOIN grid b ON a.metric = b.metric AND a.item = b.item WHERE a.method = 'A' AND b.method = 'N'),
          p AS (SELECT a.metric, sign(a.x - b.x) * sign(a.y - b.y) AS z, a.x <> b.x AS dx, a.y <> b.y AS dy FROM s a JOIN s b ON a.metric = b.metric AND a.item < b.item)
          SELECT metric, sum(z) / (sqrt(count(*) FILTER (dx)) * sqrt(count(*) FILTER (dy))) AS tau FROM p GROUP BY metric""",
    ),
    "top03_top_nodes": (
        lambda t: r.top_n(_degrees(t), ["method", "metric"], 5),
        f"WITH {EDGES}, {_DEGREES} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY method, metric ORDER BY score DESC, item) AS INT) AS position FROM degrees) WHERE position <= 5",
    ),
    "win16_highlights": (
        lambda t: r.highlights(r.top_n(_degrees(t), ["method", "metric"], 5).withColumn("seq", F.concat_ws(":", "method", "metric", "position"))),
        f"""WITH {EDGES}, {_DEGREES}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, metric ORDER BY score DESC, item) AS position FROM degrees) WHERE position <= 5),
          h AS (SELECT item, count(*) AS cells, min(method || ':' || metric || ':' || position) AS first FROM top GROUP BY item HAVING count(*) > 1)
          SELECT item, cells, first, CAST(row_number() OVER (ORDER BY cells DESC, first, item) - 1 AS INT) AS index FROM h""",
    ),
}
