import io
import json
import zipfile

from pyspark.sql import functions as F

from textloom.operators import network as nw
from textloom.sources import documents as ds
from textloom.sources import sinks
from textloom.streaming import status


def doc(i, title, relations=(), regex=(), runs=(), score=50.0):
    inter = {"preamble_extracted": list(relations), "body_extracted_regex": list(regex), "body_extracted_llm": list(runs)}
    return {"raw": {"preamble": {"bip": str(i), "title": title, "author": ["A <a@x>", "B <b@x>"], "status": "Draft"}}, "insights": {"formal_compliance": {"score": score}, "word_list": {"x": 3}, "interrelations": inter}}


def test_documents_to_network(spark, tmp_path):
    runs = [
        {"run_id": "1", "model": "m", "timestamp": "2024-01-01", "status": "success", "findings": [{"target": "3", "type": None}]},
        {"run_id": "2", "model": "m", "timestamp": "2024-02-01", "status": "success", "findings": [{"target": "2", "type": "depends_on"}]},
    ]
    for name, d in {"a": doc(1, "One", [{"target": "2", "type": "requires"}], [{"target": "slips:7", "count": 4}], runs), "b": doc(2, "Two", regex=[{"target": "2", "count": 1}]), "c": doc(1, "Again")}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "bad.json").write_text("{not json")
    docs = ds.read_documents(spark, str(tmp_path)).withColumn("id", nw.field("bip"))
    nodes = nw.build_nodes(docs, "bips").orderBy("id").collect()
    assert [(n.id, n.graph_key, n.title, n.author) for n in nodes] == [("1", "bips:1", "One", ["A <a@x>", "B <b@x>"]), ("2", "bips:2", "Two", ["A <a@x>", "B <b@x>"])]
    edges = {tuple(e) for e in nw.build_edges(docs, "bips").collect()}
    assert edges == {
        ("bips:1", "bips:2", "preamble_extracted", "requires", 1),
        ("bips:1", "slips:7", "body_extracted_regex", "reference", 4),
        ("bips:1", "bips:2", "body_extracted_llm", "depends_on", 1),
    }
    out = f"file://{tmp_path}/out"
    sinks.write_network_csv(nw.build_nodes(docs, "bips"), nw.build_edges(docs, "bips"), out)
    assert spark.read.option("header", True).csv(f"{out}/nodes").select("author").distinct().collect()[0][0] == "A <a@x> | B <b@x>"


def test_curated_stop_words_and_texts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# note\nsource\ttarget\trel\n\n a:1 \tb:2\tx\n# gone\nc:3\td:4\ty\n")
    got = ds.read_curated(spark, str(tmp_path / "c.csv"), ["source", "rel", "note"]).collect()
    assert [tuple(r) for r in got] == [("a:1", "x", None), ("c:3", "y", None)]
    (tmp_path / "stop.txt").write_text("# list\nThe\n\nof \n")
    assert {r.word for r in ds.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "of"}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "BIP-0001.md").write_text("one\ntwo")
    (tmp_path / "texts" / "readme.md").write_text("no")
    assert [tuple(r) for r in ds.read_texts(spark, str(tmp_path / "texts"), r"bip-\d+").collect()] == [("BIP-0001.md", "one\ntwo")]
    config = ds.load_registry({"b.yml": "slug: z\nauthorship: {identities: [{name: N, aliases: [n1, n2]}]}", "a.yml": "x: 1"})
    assert list(config) == ["a", "z"] and ds.identity_aliases(config["z"]) == {"n1": "N", "n2": "N"}


def test_sheets(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="ips" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>ip</t></si><si><t>bips:1</t></si></sst>")
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>note</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row><c r="A3"><v> </v></c></row>'
        z.writestr("xl/worksheets/s.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    got = ds.read_sheet(spark, str(tmp_path / "b.xlsx"), ["ip", "note", "other"]).collect()
    assert [tuple(r) for r in got] == [("bips:1", "5", None)]


def test_snapshots_and_merges(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, v string, w string")
    sinks.write_snapshot(one, root, "2024-01-01")
    sinks.write_snapshot(one, root, "2024-02-01")
    sinks.write_snapshot(one.filter("id = 2"), root, "2024-02-01")
    assert spark.read.parquet(root).groupBy("snapshot").count().count() == 2 and spark.read.parquet(root).count() == 3
    assert [r.snapshot for r in ds.snapshots(spark, root).collect()] == ["2024-01-01", "2024-02-01"]
    new = spark.createDataFrame([(2, None), (3, "n")], "id int, v string")
    assert sorted(tuple(r) for r in sinks.merged_snapshot(new, one, "id").collect()) == [(2, "b", "k"), (3, "n", None)]
    assert [r.id for r in sinks.stale_rows(one, new, "id").collect()] == [1]
    listed = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "source string, snapshot string")
    assert [r.snapshot for r in ds.common_snapshots(listed).collect()] == ["1"]
    log = spark.createDataFrame([("abcdef12|2024-01-02T00:00:00+02:00|Ann|a@x",), ("abcdef13|2024-01-02T09:00:00Z|Bob|b@x",), ("abcdef14|2024-05-02T00:00:00Z|Cy|c@x",), ("junk",)], "value string")
    history = ds.git_log(log).withColumn("id", F.lit(1))
    assert {r.author for r in nw.first_day_authors(history, ("Bob",)).collect()} == {"Ann"} and nw.contributors(history).count() == 3


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 05:00:00", "a", 2.0), (3, "2024-01-02 05:00:00", "b", 4.0)]
    spark.createDataFrame(rows, "event_id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    events = status.without_repeats(status.read_events(spark, f"{tmp_path}/in", "event_id long, ts timestamp, kind string, value double"))
    query = status.counts_by_window(events, "kind").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.kind, r.n, r.total) for r in spark.table("counted").collect()] == [("a", 2, 3.0)]
