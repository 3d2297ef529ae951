"""Stored results found by names, sheets committed together."""

import csv
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import artifacts as ar
from textloom.sources import documents as ds
from textloom.sources import sheets as sh
from textloom.sources import sinks


def stored(spark, root, snapshots):
    for snapshot, names in snapshots.items():
        for name in names:
            spark.createDataFrame([(snapshot, name)], "snapshot string, name string").coalesce(1).write.mode("overwrite").json(f"{root}/{snapshot}/{name}")


def test_artifacts_fall_back(spark, tmp_path):
    root = f"file://{tmp_path}/04"
    stored(spark, root, {"2024-01-01": ["network", "evolution"], "2024-03-01": ["network"], "latest": ["authorship"]})
    (tmp_path / "04" / "2024-01-01" / "plain.json").write_text('{"snapshot": "2024-01-01"}\n')
    listed = ar.listing(spark, root)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    from_ = lambda name, wanted=None: ar.load_payload(spark, root, name, wanted).first().snapshot
    assert from_("network", "2024-01-01") == "2024-01-01" and from_("network", "2023-01-01") == from_("network") == "2024-03-01"
    assert from_("authorship", "2024-01-01") == "latest" and from_("evolution", "2024-01-01") == "2024-01-01" and from_("plain.json", "2024-01-01") == "2024-01-01"
    with pytest.raises(FileNotFoundError, match="no evolution in latest, 2024-03-01"):
        from_("evolution")
    assert {tuple(r) for r in ar.resolved(listed.filter("artifact <> 'plain.json'")).collect()} == {("network", "2024-03-01"), ("authorship", "latest")}


def test_removal(spark, tmp_path):
    roots = {"b": [f"file://{tmp_path}/b4"], "a": [f"file://{tmp_path}/a4", f"file://{tmp_path}/a3", f"file://{tmp_path}/none"]}
    for folder in ("a3", "a4", "b4"):
        stored(spark, f"file://{tmp_path}/{folder}", {"s1": ["network"], "s2": ["network"]})
    planned = ar.remove_snapshot(spark, roots, "s1")
    assert [(s, f.rsplit("/", 2)[1]) for s, f, _, _ in planned] == [("a", "a3"), ("a", "a4"), ("b", "b4")] and all(n > 0 and size > 0 for _, _, n, size in planned)
    assert (tmp_path / "a3" / "s1").exists()
    assert len(ar.remove_snapshot(spark, roots, "s1", source="a", dry_run=False)) == 2
    assert not (tmp_path / "a3" / "s1").exists() and not (tmp_path / "a4" / "s1").exists() and (tmp_path / "b4" / "s1").exists() and (tmp_path / "a3" / "s2").exists()
    for bad in ("", "..", "x/y"):
        with pytest.raises(ValueError):
            ar.remove_snapshot(spark, roots, bad, dry_run=False)


def test_branches_and_links(spark):
    o = "refs/remotes/origin/"
    refs = [("a", f"{o}HEAD", f"{o}trunk"), ("a", f"{o}master", ""), ("b", f"{o}main", ""), ("b", f"{o}master", ""), ("c", f"{o}main", ""), ("d", f"{o}dev", "")]
    assert dict(ar.default_branches(spark.createDataFrame(refs, "repo string, ref string, target string")).collect()) == {"a": "origin/trunk", "b": "origin/master", "c": "origin/main", "d": None}
    manifests = [("x", "1", "c1", "7", "f7"), ("x", "2", "c2", "7", "g7"), ("y", "1", "d1", "1", "h1"), ("y", "2", " ", "1", "h2"), ("z", "1", "e1", "3", "i3")]
    links = ar.link_index(spark.createDataFrame(manifests, "source string, snapshot string, commit string, id string, file string"), spark.createDataFrame([("x", "7", "now7")], "source string, id string, file string"))
    assert {tuple(r) for r in links.collect()} == {("x", "1", "7", "f7", "c1"), ("x", "2", "7", "g7", "c2"), ("y", "1", "1", "h1", "d1"), ("z", "1", "3", "i3", "e1"), ("x", None, "7", "now7", None), ("z", None, "3", "i3", None)}


ROWS = [("a:1", 'tab\tand "quotes"', 3), (" b<&>", None, None), ("é\U0001f600\x01", "line\nbreak", 0)]


@pytest.mark.parametrize("kind", ["tsv", "xlsx"])
def test_sheets_come_back(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    table = spark.createDataFrame(ROWS * 2, "key string, note string, n int")
    sh.write_sheets(table.repartition(3), path, kind, 'of "ips"')
    sh.write_sheets(table.coalesce(1).limit(3), path, kind)
    files = [f for f in os.listdir(path) if f.endswith(kind)]
    assert len(files) == 1 and sorted(os.listdir(path)) == sorted([*files, "_SUCCESS"])  # the first writing is gone
    want = [tuple("" if v is None else str(v) for v in r) for r in ROWS]
    if kind == "tsv":
        with open(f"{path}/{files[0]}", newline="", encoding="utf-8") as f:
            head, *rows = list(csv.reader(f, delimiter="\t"))
        assert head == ["key", "note", "n"] and sorted(map(tuple, rows)) == sorted(want)
    else:
        got = ds.read_sheet(spark, f"file://{path}/{files[0]}", ["key", "note", "n"]).collect()
        assert sorted(tuple(r) for r in got) == sorted(tuple(v.strip().replace("\x01", "") for v in r) for r in want)
        with zipfile.ZipFile(f"{path}/{files[0]}") as z:
            assert z.testzip() is None and "[Content_Types].xml" in z.namelist()


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sh.write_sheets(spark.range(3).coalesce(1), path)
    before = sorted(os.listdir(path))
    broken = spark.range(40).repartition(4).withColumn("x", F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        sh.write_sheets(broken, path)
    assert sorted(os.listdir(path)) == before


def test_long_tables_have_several_workbooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sh, "MOST_ROWS", 4)
    writer = sh.SheetWriter(str(tmp_path), "xlsx", "s", ["id"], True)
    writer.prepare()
    message = writer.write(iter(spark.range(7).toArrow().to_batches()))
    writer.commit([message, None])
    assert len(message.files) == 3 and sorted(int(r.id) for r in ds.read_sheet(spark, f"file://{tmp_path}/*.xlsx", ["id"]).collect()) == list(range(7))
    assert [sh.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_plain_csv_is_one_file(spark, tmp_path):
    sinks.write_csv(spark.range(2), str(tmp_path / "c"))
    assert len([f for f in os.listdir(tmp_path / "c") if f.endswith(".csv")]) == 1
