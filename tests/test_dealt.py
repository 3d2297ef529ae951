import contextlib
import io

import pytest
from pyspark.sql import functions as F

from textloom.functions import shared
from textloom.operators import authorship
from textloom.plans import bindings, library_queries


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def tables(spark, tmp_path):
    lines = spark.range(400).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") * 7 % 30).alias("l_partkey"), (F.col("id") * 5 % 11).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"))
    lines = lines.selectExpr("*", "1.0D as l_quantity", "2.0D as l_extendedprice", "substr('ANR', 1 + cast(l_partkey % 3 as int), 1) as l_returnflag", "'O' as l_linestatus")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["win01_competition_rank", "top03_top_nodes", "win16_highlights", "agg18_collaboration_edges", "agg19_degrees", "agg19_degree_distribution", "agg19_network_summary"])
def test_many_rows_are_dealt_to_tasks_of_bounded_rows(spark, tables, monkeypatch, name):
    query = library_queries()[name]
    whole = query(spark, tables)
    assert "REPARTITION_BY_NUM" not in plan_of(whole)
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    dealt = query(spark, tables)
    assert "REPARTITION_BY_NUM" in plan_of(dealt) and rows_of(dealt) == rows_of(whole)


def test_tasks_grow_with_rows_and_pairs(spark, tables, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    t = bindings.Tables(spark, tables)
    assert "hashpartitioning(l_orderkey" in (plan := plan_of(bindings.links(t))) and ", 8), REPARTITION_BY_NUM" in plan
    # 100 documents of 4 authors have 600 pairs
    assert ", 12), REPARTITION_BY_NUM" in plan_of(authorship.collaboration_edges(bindings.authored(t)))
