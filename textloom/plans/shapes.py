"""Shapes of stored documents: orders as JSON documents, some of them broken in each way."""

from pyspark.sql import functions as F

from textloom.operators import schema_rules as sr
from textloom.operators.references import Source
from textloom.plans.bindings import Tables

_SOURCES = [Source("bips", "BIP", most=5000), Source("nips", "NIP", hexadecimal=True)]

#: A document of an order, the same expression in Spark and DuckDB; each fault is a residue of its key.
_DOC = """CASE WHEN o_orderkey % 101 = 0 THEN '{broken' WHEN o_orderkey % 103 = 0 THEN '[1]' ELSE
  '{' || CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN '"meta": null, ' WHEN 2 THEN '"meta": {"git_history": {}}, ' WHEN 3 THEN '"meta": {"git_history": [["c", "d", " ", "m"], ["c", "d", "n"]]}, ' WHEN 4 THEN '"meta": {"git_history": [["c"], 5]}, '
    ELSE '"meta": {"git_history": [["' || o_orderkey || '", "2024", "n", "m"]]}, ' END
  || '"insights": {"interrelations": ' || CASE o_orderkey % 17 WHEN 0 THEN '"none"' WHEN 1 THEN '{}' ELSE '{"preamble_extracted": [{"target": ' ||
    CASE o_orderkey % 11 WHEN 0 THEN 'null' WHEN 1 THEN '7' WHEN 2 THEN '"x"' WHEN 3 THEN '"zips:1"' WHEN 4 THEN '"nips:XY"' ELSE '"bips:' || o_orderkey % 9000 || '"' END || ', "type": "' || CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'odd' ELSE 'requires' END || '"}],
    "body_extracted_regex": [{"target": "nips:0A", "count": ' || CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '1.5' WHEN 2 THEN '"2"' ELSE '2' END || '}],
    "body_extracted_llm": [{"run_id": "r", "model": "m", "timestamp": "t", ' || CASE o_orderkey % 19 WHEN 0 THEN '"status": "failed", "findings": []' WHEN 1 THEN '"status": "failed", "error_message": "e", "findings": [{"target": "bips:1", "type": "requires"}]'
      WHEN 2 THEN '"status": "odd", "error_message": "e", "findings": []' WHEN 3 THEN '"status": "success"' WHEN 4 THEN '"status": "success", "findings": [3, {"type": "requires"}]' ELSE '"status": "success", "findings": []' END || '}]}' END || '}}' END"""


def _files(t: Tables):
    return t.orders.select(F.col("o_orderkey").cast("string").alias("file"), F.expr(_DOC.replace("\n", " ")).alias("text"))


def _found(t: Tables):
    return sr.document_violations(_files(t), _SOURCES, ["requires"], ["requires"])


#: What each residue must give: condition, path, problem.
_FAULTS = [
    ("k % 13 = 0", "$.meta", "must be an object, is missing"), ("k % 13 = 1", "$.meta", "must be an object, is null"), ("k % 13 = 2", "$.meta.git_history", "must be a list, is object"),
    ("k % 13 = 3", "$.meta.git_history[0][2]", "empty author_name"), ("k % 13 = 3", "$.meta.git_history[1]", "without author_email"),
    ("k % 13 = 4", "$.meta.git_history[0]", "must hold commit, author_date, author_name and author_email"), ("k % 13 = 4", "$.meta.git_history[1]", "must hold commit, author_date, author_name and author_email"),
    ("k % 17 = 0", "$.insights.interrelations", "must be an object, is text"),
    *[("k % 17 = 1", f"$.insights.interrelations.{m}", "must be a list, is missing") for m in ("preamble_extracted", "body_extracted_regex", "body_extracted_llm")],
    *[
        (f"k % 17 > 1 AND {where}", f"$.insights.interrelations.{path}", problem)
        for where, path, problem in (
            ("k % 11 = 0", "preamble_extracted[0].target", "must be text, is null"), ("k % 11 = 1", "preamble_extracted[0].target", "must be text, is number"), ("k % 11 = 2", "preamble_extracted[0].target", "not of the form source:id"),
            ("k % 11 = 3", "preamble_extracted[0].target", "unknown source"), ("(k % 11 = 4 OR (k % 11 > 4 AND k % 9000 > 5000))", "preamble_extracted[0].target", "no id of its source"),
            ("k % 7 = 0", "preamble_extracted[0].type", "must be text, is empty"), ("k % 7 = 1", "preamble_extracted[0].type", "unknown type"), ("k % 5 < 3", "body_extracted_regex[0].count", "must be a positive whole number"),
            ("k % 19 = 0", "body_extracted_llm[0].error_message", "failed run without a message"), ("k % 19 = 1", "body_extracted_llm[0].findings", "findings of a failed run"), ("k % 19 = 2", "body_extracted_llm[0].status", "unknown status"),
            ("k % 19 = 3", "body_extracted_llm[0].findings", "must be a list, is missing"), ("k % 19 = 4", "body_extracted_llm[0].findings[0]", "must be an object, is number"), ("k % 19 = 4", "body_extracted_llm[0].findings[1].target", "missing"),
        )
    ],
]
_EXPECTED = "v AS (SELECT CAST(k AS VARCHAR) AS file, x.path AS path, x.problem AS problem, CASE WHEN x.problem = 'without author_email' THEN 'warning' ELSE 'error' END AS level FROM (SELECT o_orderkey AS k, unnest([" + ", ".join(
    [
        "CASE WHEN o_orderkey % 101 = 0 THEN struct_pack(path := '$', problem := 'no JSON') WHEN o_orderkey % 103 = 0 THEN struct_pack(path := '$', problem := 'must be an object, is list') END",
        *[f"CASE WHEN o_orderkey % 101 > 0 AND o_orderkey % 103 > 0 AND {where.replace('k %', 'o_orderkey %')} THEN struct_pack(path := '{path}', problem := '{problem}') END" for where, path, problem in _FAULTS],
    ]
) + "]) AS x FROM orders) WHERE x IS NOT NULL)"

QUERIES = {
    "val04_document_shapes": (_found, f"WITH {_EXPECTED} SELECT * FROM v"),
    "val06_report": (
        lambda t: sr.report(_files(t), _found(t)).select("file", "status", "errors", "warnings"),
        f"""WITH {_EXPECTED}, n AS (SELECT o_orderkey, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM orders LEFT JOIN v ON file = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey)
          SELECT CAST(o_orderkey AS VARCHAR) AS file, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warned' ELSE 'ok' END AS status, errors, warnings FROM n""",
    ),
}
