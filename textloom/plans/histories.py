"""Path histories: each customer's orders as the commits of a repository with one file, renamed by finished orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.plans.bindings import Tables
from textloom.sources import git_logs as g

def changes(t: Tables):
    """A customer's first order adds a file, finished orders rename it, the others change it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nth = F.row_number().over(order)
    size = F.count("*").over(Window.partitionBy("o_custkey"))
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", nth.alias("nth"), (size - nth).alias("seq"), ((F.col("o_orderstatus") == "F") & (nth > 1)).cast("int").alias("renames"))
    rows = rows.withColumn("version", F.sum("renames").over(Window.partitionBy("o_custkey").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    name = lambda v: F.format_string("docs/d%d.md", v)
    change = F.when(F.col("nth") == 1, "A").when(F.col("renames") == 1, "R").otherwise("M")
    return rows.select(
        F.col("o_custkey").cast("string").alias("repo"), "seq", F.col("o_orderkey").cast("string").alias("commit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.lit("a").alias("author"), F.lit("").alias("mail"),
        change.alias("change"), F.when(change == "R", name(F.col("version") - 1)).alias("old_path"), name(F.col("version")).alias("path"),
    )


_NTH = """o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)"""

QUERIES = {
    "src09_path_history": (
        lambda t: g.path_history(changes(t)),
        # each file is followed from its first commit, one rename after the other
        f"""WITH RECURSIVE {_NTH}, walk AS (
            SELECT o_custkey, o_orderkey, day, nth, size, 0 AS version FROM o WHERE nth = 1
            UNION ALL SELECT o.o_custkey, o.o_orderkey, o.day, o.nth, o.size, w.version + CASE WHEN o.done THEN 1 ELSE 0 END FROM walk w JOIN o ON o.o_custkey = w.o_custkey AND o.nth = w.nth + 1)
          SELECT CAST(o_custkey AS VARCHAR) AS repo, 'docs/d' || max(version) OVER (PARTITION BY o_custkey) || '.md' AS file, size - nth AS seq, CAST(o_orderkey AS VARCHAR) AS "commit", day AS timestamp, 'a' AS author, 'docs/d' || version || '.md' AS path FROM walk""",
    ),
    "src08_file_history": (
        lambda t: g.file_history(changes(t)).groupBy("repo", "file").agg(F.count("*").alias("commits"), F.min("day").alias("first_day"), F.max_by("commit", -F.col("seq")).alias("newest")),
        f"""WITH {_NTH} SELECT CAST(o_custkey AS VARCHAR) AS repo, 'docs/d' || count(*) FILTER (done AND nth > 1) || '.md' AS file, count(*) AS commits, CAST(min(day) AS DATE) AS first_day, CAST(max_by(o_orderkey, nth) AS VARCHAR) AS newest FROM o GROUP BY o_custkey""",
    ),
}
