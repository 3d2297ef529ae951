"""The operators' inputs, bound to the driver's tables, and the same as SQL.

An order is a document: its status and priority are status and type, its customer's region
the layer, the suppliers of its lines the authors.  A part and the part after it in an order
are a relation, its line's return flag the method that found it, the line status its type:
a network as sparse as the table is long.  Nations with a surplus in their shipments to
another are a small dense network.  A customer's orders are the status events of one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.shared import dealt


class Tables:
    """Tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self, *keys: str) -> DataFrame:
        """The table lineitem, dealt by keys to tasks of bounded rows."""
        return dealt(self.lineitem, self.n_lines(), *keys)

    def n_lines(self) -> int:
        """Rows of lineitem, from the files' footers; counted once."""
        if "_n_lines" not in vars(self):
            self._n_lines = self.lineitem.count()
        return self._n_lines


NODES = """nodes AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS type, r_name AS layer,
    CAST(o_orderdate AS DATE) AS created, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def nodes(t: Tables) -> DataFrame:
    """id, status, type, layer, created and year of each document."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("layer"))
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("type"),
            "layer",
            F.to_date("o_orderdate").alias("created"),
            F.year("o_orderdate").cast("long").alias("year"),
        )
    )


AUTHORED = "authored AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS author FROM lineitem)"


def authored(t: Tables) -> DataFrame:
    """id and author, one row for each author of a document."""
    return t.lines("l_orderkey").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("author")).distinct()


EDGES = """links AS (
  SELECT 'PART_' || l_partkey AS source, 'PART_' || next AS target, l_returnflag AS method, l_linestatus AS rel FROM (
    SELECT l_partkey, l_returnflag, l_linestatus, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS next FROM lineitem)
  WHERE next <> l_partkey),
  items AS (SELECT 'PART_' || p_partkey AS item, p_size AS size FROM part)"""


def links(t: Tables) -> DataFrame:
    """source, target, method and rel of each relation between parts, repeats included."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = t.lines("l_orderkey").withColumn("next", F.lead("l_partkey").over(order)).filter("next <> l_partkey")
    named = [F.concat(F.lit("PART_"), c).alias(n) for c, n in (("l_partkey", "source"), ("next", "target"))]
    return lines.select(*named, F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("rel"))


def items(t: Tables) -> DataFrame:
    """item and size: the parts that relations are between."""
    return t.part.select(F.concat(F.lit("PART_"), "p_partkey").alias("item"), F.col("p_size").alias("size"))


FLOWS = """sold AS (
  SELECT s.n_name AS source, c.n_name AS target, l_returnflag AS method, sum(l_quantity) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey
  WHERE s.n_name <> c.n_name GROUP BY ALL),
  flows AS (SELECT x.source, x.target, x.method, x.quantity - coalesce(y.quantity, 0) AS surplus FROM sold x LEFT JOIN sold y ON y.source = x.target AND y.target = x.source AND y.method = x.method
    WHERE x.quantity > coalesce(y.quantity, 0))"""


def flows(t: Tables) -> DataFrame:
    """source, target, method and surplus: nations that ship more to another than they get from it."""
    seller = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"))
    buyer = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target"))
    shipped = (
        t.lineitem.join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyer, F.col("o_custkey") == F.col("c_custkey"))
        .filter("source <> target")
    )
    # both directions of a pair meet in one group
    one, other = F.least("source", "target"), F.greatest("source", "target")
    signed = F.when(F.col("source") == one, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    net = shipped.groupBy(one.alias("one"), other.alias("other"), F.col("l_returnflag").alias("method")).agg(F.sum(signed).alias("net")).filter("net <> 0")
    ahead = F.col("net") > 0
    return net.select(F.when(ahead, F.col("one")).otherwise(F.col("other")).alias("source"), F.when(ahead, F.col("other")).otherwise(F.col("one")).alias("target"), "method", F.abs("net").alias("surplus"))


EVENTS = "timeline AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, o_orderstatus AS status FROM orders)"


def timeline(t: Tables) -> DataFrame:
    """entity, date, seq and status: the status events of each entity."""
    return t.orders.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
