"""Classification queries."""

from textloom.operators import classification as c
from textloom.plans.bindings import NODES, Tables, nodes

_ALIAS = {"1-URGENT": "urgent", "5-LOW": "low"}

QUERIES = {
    "agg04_status_over_time": (
        lambda t: c.count_over_time(nodes(t), "status"),
        f"WITH {NODES} SELECT year, coalesce(nullif(trim(status), ''), 'Unknown') AS status, count(*) AS count FROM nodes GROUP BY ALL",
    ),
    "agg05_type_over_time": (
        lambda t: c.count_over_time(nodes(t), "type", "Unknown Type"),
        f"WITH {NODES} SELECT year, coalesce(nullif(trim(type), ''), 'Unknown Type') AS type, count(*) AS count FROM nodes GROUP BY ALL",
    ),
    "snk03_status_pivot": (
        lambda t: c.pivot_over_time(nodes(t), "status", ["F", "O", "P"]),
        f"""WITH {NODES} SELECT year, count(*) FILTER (status = 'F') AS "F", count(*) FILTER (status = 'O') AS "O", count(*) FILTER (status = 'P') AS "P" FROM nodes GROUP BY year""",
    ),
    "agg06_sankey_grouped": (
        lambda t: c.sankey_links(nodes(t)),
        f"""WITH {NODES} SELECT source, target, count(*) AS count FROM (
          SELECT layer AS source, status AS target FROM nodes UNION ALL SELECT status, type FROM nodes) GROUP BY ALL""",
    ),
    "agg06_sankey_full": (
        lambda t: c.sankey_links(nodes(t).replace("4-NOT SPECIFIED", " ", "type"), grouped=False),
        f"""WITH {NODES} SELECT source, target, count(*) AS count FROM (
          SELECT layer AS source, status AS target FROM nodes WHERE type <> '4-NOT SPECIFIED'
          UNION ALL SELECT status, type FROM nodes WHERE type <> '4-NOT SPECIFIED') GROUP BY ALL""",
    ),
    "agg07_facet_distribution": (
        lambda t: c.facet_distribution(nodes(t), ["layer", "status", "type"]),
        f"""WITH {NODES} SELECT 'layer' AS facet, layer AS category, count(*) AS count FROM nodes GROUP BY layer
          UNION ALL SELECT 'status', status, count(*) FROM nodes GROUP BY status UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type""",
    ),
    "agg08_facet_timeline": (
        lambda t: c.facet_timeline(nodes(t), "layer"),
        f"""WITH {NODES}, docs AS (SELECT * FROM nodes),
          years AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM docs), layers AS (SELECT DISTINCT layer FROM docs)
          SELECT years.year, layers.layer, count(docs.id) AS count FROM years CROSS JOIN layers LEFT JOIN docs ON docs.year = years.year AND docs.layer = layers.layer GROUP BY ALL""",
    ),
    "agg09_chord_matrix": (
        lambda t: c.chord_matrix(nodes(t), ["layer", "status", "type"]),
        f"""WITH {NODES}, pairs AS (
          SELECT 'layer:' || layer AS a, 'status:' || status AS b FROM nodes UNION ALL SELECT 'layer:' || layer, 'type:' || type FROM nodes
          UNION ALL SELECT 'status:' || status, 'type:' || type FROM nodes)
          SELECT a AS source, b AS target, count(*) AS count FROM pairs GROUP BY ALL UNION ALL SELECT b, a, count(*) FROM pairs GROUP BY ALL""",
    ),
    "agg10_relation_rows": (
        lambda t: c.relation_rows(nodes(t), "layer", "status", "type"),
        f"WITH {NODES} SELECT layer, status, type, count(*) AS count FROM nodes GROUP BY GROUPING SETS ((layer, status), (layer, status, type))",
    ),
    "agg11_status_type_crosstab": (
        lambda t: c.crosstab(nodes(t), "status", "type"),
        f"""WITH {NODES}, counts AS (SELECT status, type, count(*) AS n FROM nodes GROUP BY ALL)
          SELECT status, type, n, n / sum(n) OVER (PARTITION BY type) AS share, n = max(n) OVER (PARTITION BY type) AS is_mode FROM counts""",
    ),
    "agg12_all_groupings": (
        lambda t: c.all_groupings(nodes(t), ["layer", "status", "type"]),
        f"WITH {NODES} SELECT layer, status, type, count(*) AS count FROM nodes GROUP BY CUBE (layer, status, type)",
    ),
    "agg37_top_layers": (
        lambda t: c.top_categories(nodes(t), "layer", 3),
        f"WITH {NODES} SELECT layer, count(*) AS count, (SELECT count(*) FROM nodes) AS total FROM nodes GROUP BY layer ORDER BY count DESC, layer LIMIT 3",
    ),
    "top10_preferred_order": (
        lambda t: c.in_preferred_order(nodes(t).groupBy("type").count(), "type", ["3-MEDIUM", "2-HIGH"]),
        f"""WITH {NODES} SELECT type, count(*) AS count, CAST(row_number() OVER (ORDER BY CASE type WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, type) AS INT) AS position
          FROM nodes GROUP BY type""",
    ),
    "prj07_alias_mapping": (
        lambda t: c.apply_alias(nodes(t), "type", _ALIAS).groupBy("type").count(),
        f"WITH {NODES} SELECT CASE type WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE type END AS type, count(*) AS count FROM nodes GROUP BY ALL",
    ),
}
