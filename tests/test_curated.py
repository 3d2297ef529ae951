"""Curated tables: which file counts, which rows, and what strict loading raises."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import relation_fields as rf
from textloom.operators.references import Source
from textloom.sources import curated as cu
from textloom.sources import sheets as sh


def no_reviewer(rows):
    return rows.filter("coalesce(reviewer, '') = ''").select("line", F.lit("no reviewer").alias("rule"))


def test_workbook_before_text(spark, tmp_path):
    columns = ["ip", "reviewer"]
    book, text = f"file://{tmp_path}/book.xlsx", f"file://{tmp_path}/rows.csv"
    load = lambda **more: cu.load_curated(spark, book, text, "ips", columns, ["ip"], no_reviewer, **more)
    assert load().count() == 0 and cu.appended_rows(spark, book, "ips", columns).count() == 0
    (tmp_path / "rows.csv").write_text("ip,reviewer\na:1,R\n ,S\na:2,\na:3,\n")
    assert [(r.ip, r.reviewer or "") for r in load(strict=False).orderBy("line").collect()] == [("a:1", "R"), ("a:2", ""), ("a:3", "")]
    with pytest.raises(ValueError, match="2 errors: 2: no reviewer; 3: no reviewer"):
        load()
    sh.write_sheets(spark.createDataFrame([("b:1", "R"), ("", "T"), (" ", " ")], "ip string, reviewer string").coalesce(1), str(tmp_path / "out"), "xlsx", "ips")
    next((tmp_path / "out").glob("*.xlsx")).rename(tmp_path / "book.xlsx")
    assert [(r.ip, r.reviewer) for r in load().collect()] == [("b:1", "R")]
    assert cu.appended_rows(spark, book, "ips", columns).count() == 2


def test_findings_and_headers(spark):
    sources = [Source("bips", "BIP", most=400), Source("nips", "NIP", hexadecimal=True)]
    rows = [("5", 0, "BIP 5", "requires", "e", "r", "high"), ("5", 1, "nips:a", None, None, None, None), ("5", 2, "NIP 0A", "requires", "x", "y", "high"), ("5", 3, None, "requires", "", "", ""), ("5", 4, "junk", "requires", "", "", "")]
    got = rf.model_findings(spark.createDataFrame(rows, "id string, pos int, target string, type string, evidence string, reason string, confidence string"), sources, sources[0], ["requires"]).collect()
    assert [tuple(r) for r in got] == [("5", "nips:0A", "references", "", "", "low")]
    fields = spark.createDataFrame([(1, "requires", "NIP 10, 30, bip-4,,30 , x"), (2, "requires", None), (3, "replaces", "")], "id int, type string, value string")
    assert [tuple(r) for r in rf.header_targets(fields, sources, sources[0]).collect()] == [(1, "requires", 1, "bips:4"), (1, "requires", 2, "bips:30"), (1, "requires", 3, "nips:10")]
