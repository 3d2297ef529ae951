"""Authorship and collaboration queries."""

from pyspark.sql import functions as F

from textloom.operators import authorship as a
from textloom.plans.bindings import AUTHORED, NODES, Tables, authored, nodes

_PAIRS = "pairs AS (SELECT x.author AS a, y.author AS b, count(*) AS weight FROM authored x JOIN authored y ON x.id = y.id AND x.author < y.author GROUP BY ALL)"
_COUNTS = "counts AS (SELECT author, count(DISTINCT id) AS documents FROM authored GROUP BY author)"
_DEGREES = "ends AS (SELECT a AS author, weight FROM pairs UNION ALL SELECT b, weight FROM pairs), degrees AS (SELECT author, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM ends GROUP BY author)"
_DECLARED = "declared AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS author FROM lineitem WHERE l_linenumber <= 2)"


def _declared(t: Tables):
    return t.lineitem.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("author")).distinct()


def _per_document(t: Tables):
    return authored(t).groupBy("id").agg(F.count("*").alias("authors"))


QUERIES = {
    "agg13_author_counts": (lambda t: a.author_counts(authored(t)), f"WITH {AUTHORED} SELECT author, count(DISTINCT id) AS documents FROM authored GROUP BY author"),
    "top01_top_authors": (
        lambda t: a.top_authors(authored(t)),
        f"WITH {AUTHORED}, {_COUNTS} SELECT author, documents FROM counts ORDER BY documents DESC, CAST(author AS VARCHAR) LIMIT 15",
    ),
    "agg14_documents_per_year": (
        lambda t: nodes(t).groupBy("year").agg(F.count("*").alias("documents")),
        f"WITH {NODES} SELECT year, count(*) AS documents FROM nodes GROUP BY year",
    ),
    "agg15_histogram_of_counts": (
        lambda t: a.histogram(a.author_counts(authored(t)), "documents"),
        f"WITH {AUTHORED}, {_COUNTS} SELECT documents, count(*) AS n FROM counts GROUP BY documents",
    ),
    "agg16_authors_per_document": (
        lambda t: a.histogram(_per_document(t), "authors"),
        f"WITH {AUTHORED}, per AS (SELECT id, count(*) AS authors FROM authored GROUP BY id) SELECT authors, count(*) AS n FROM per GROUP BY authors",
    ),
    "agg17_top_share": (
        lambda t: a.top_share(authored(t)),
        f"""WITH {AUTHORED}, {_COUNTS}, top AS (SELECT CAST(sum(documents) AS BIGINT) AS top FROM (SELECT documents FROM counts ORDER BY documents DESC, CAST(author AS VARCHAR) LIMIT 10))
          SELECT top, (SELECT count(DISTINCT id) FROM authored) AS documents, top * 100.0::DOUBLE / (SELECT count(DISTINCT id) FROM authored) AS percent FROM top""",
    ),
    "agg18_collaboration_edges": (lambda t: a.collaboration_edges(authored(t)), f"WITH {AUTHORED}, {_PAIRS} SELECT a, b, weight FROM pairs"),
    "agg19_degrees": (lambda t: a.degrees(a.collaboration_edges(authored(t))), f"WITH {AUTHORED}, {_PAIRS}, {_DEGREES} SELECT author, degree, weighted_degree FROM degrees"),
    "agg19_degree_distribution": (
        lambda t: a.histogram(a.degrees(a.collaboration_edges(authored(t))), "degree"),
        f"WITH {AUTHORED}, {_PAIRS}, {_DEGREES} SELECT degree, count(*) AS n FROM degrees GROUP BY degree",
    ),
    "agg19_network_summary": (
        lambda t: a.network_summary(authored(t), a.collaboration_edges(authored(t))),
        f"""WITH {AUTHORED}, pairs AS (SELECT x.author AS a, y.author AS b, count(*) AS weight FROM authored x JOIN authored y ON x.id = y.id AND x.author < y.author GROUP BY ALL),
          n AS (SELECT count(DISTINCT author) AS authors FROM authored), m AS (SELECT count(*) AS pairs, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM pairs),
          alone AS (SELECT count(*) AS isolated FROM (SELECT DISTINCT author FROM authored) WHERE author NOT IN (SELECT a FROM pairs UNION SELECT b FROM pairs))
          SELECT authors, pairs, weight, isolated, 2 * pairs / (authors * (authors - 1)) AS density, 2 * pairs / authors AS mean_degree FROM n, m, alone""",
    ),
    "agg20_contributor_coverage": (
        lambda t: a.contributor_coverage(_declared(t), authored(t)),
        f"""WITH {AUTHORED}, {_DECLARED}, d AS (SELECT * FROM declared), c AS (SELECT * FROM authored),
          p AS (SELECT x.author AS d, y.author AS c FROM (SELECT DISTINCT author FROM d) x FULL JOIN (SELECT DISTINCT author FROM c) y ON x.author = y.author),
          good AS (SELECT DISTINCT d.id FROM d JOIN c ON d.id = c.id AND d.author = c.author)
          SELECT count(c) AS contributors, count(d) AS declared, count(*) FILTER (c IS NOT NULL AND d IS NOT NULL) AS both, count(*) FILTER (d IS NULL) AS never_declared,
            (SELECT count(DISTINCT id) FROM c) AS with_contributors, (SELECT count(DISTINCT id) FROM c WHERE id NOT IN (SELECT id FROM good)) AS uncredited FROM p""",
    ),
    "agg21_overlap_breakdown": (
        lambda t: a.overlap_breakdown(_declared(t), authored(t)),
        f"""WITH {AUTHORED}, {_DECLARED}, per AS (SELECT x.id, count(*) AS editors, count(y.author) AS own FROM authored x LEFT JOIN declared y ON x.id = y.id AND x.author = y.author GROUP BY x.id)
          SELECT CASE WHEN own = editors THEN 'only authors' WHEN own > 0 THEN 'some authors' ELSE 'no author' END AS kind, count(*) AS documents FROM per GROUP BY ALL""",
    ),
    "agg38_log2_bins": (
        lambda t: a.log2_bins(a.histogram(a.author_counts(authored(t)), "documents"), "documents", "n"),
        f"""WITH {AUTHORED}, {_COUNTS}, bins AS (SELECT CAST(length(bin(documents)) - 1 AS INT) AS bin, count(*) AS n FROM counts GROUP BY ALL)
          SELECT CAST(s.bin AS INT) AS bin, CAST(1 AS BIGINT) << s.bin AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(bin) + 1 FROM bins))) AS bin) s LEFT JOIN bins ON bins.bin = s.bin""",
    ),
    "agg39_author_documents": (lambda t: authored(t), f"WITH {AUTHORED} SELECT id, author FROM authored"),
    "win09_cumulative_documents": (
        lambda t: a.cumulative(nodes(t).groupBy("year").agg(F.count("*").alias("documents")), "year", "documents"),
        f"WITH {NODES}, y AS (SELECT year, count(*) AS documents FROM nodes GROUP BY year) SELECT year, documents, CAST(sum(documents) OVER (ORDER BY year) AS BIGINT) AS running FROM y",
    ),
    "win10_weighted_ecdf": (
        lambda t: a.weighted_ecdf(a.histogram(_per_document(t), "authors"), "authors", "n"),
        f"""WITH {AUTHORED}, per AS (SELECT id, count(*) AS authors FROM authored GROUP BY id), h AS (SELECT authors, count(*) AS n FROM per GROUP BY authors)
          SELECT authors, sum(n) OVER (ORDER BY authors) / sum(n) OVER () AS share FROM h""",
    ),
    "win12_dense_histogram": (
        lambda t: a.densify(a.histogram(a.author_counts(authored(t)), "documents"), "documents").select("documents", "n", F.col("skipped").cast("long").alias("skipped")),
        f"""WITH {AUTHORED}, {_COUNTS}, h AS (SELECT documents, count(*) AS n FROM counts GROUP BY documents),
          gaps AS (SELECT documents, n, lead(documents) OVER (ORDER BY documents) - documents - 1 AS gap FROM h)
          SELECT documents, n, 0::BIGINT AS skipped FROM gaps UNION ALL SELECT documents + 1, 0, gap FROM gaps WHERE gap >= 3
          UNION ALL SELECT unnest(range(documents + 1, documents + gap + 1)), 0, 0 FROM gaps WHERE gap BETWEEN 1 AND 2""",
    ),
    "prj13_clean_names": (
        lambda t: t.customer.select("c_custkey", F.concat(F.col("c_name"), F.lit(" <x@y>")).alias("c_name")).select("c_custkey", a.clean_name("c_name").alias("name")),
        "SELECT c_custkey, c_name AS name FROM customer",
    ),
    "grf10_degree_centrality": (
        lambda t: a.degrees(a.collaboration_edges(authored(t))).crossJoin(F.broadcast(authored(t).agg(F.countDistinct("author").alias("n")))).select("author", (F.col("degree") / (F.col("n") - 1)).alias("centrality")),
        f"WITH {AUTHORED}, {_PAIRS}, {_DEGREES} SELECT author, degree / (SELECT count(DISTINCT author) - 1 FROM authored) AS centrality FROM degrees",
    ),
}
