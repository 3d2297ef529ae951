"""Document standards, other headers and identities: headers made from the columns of documents, around their texts."""

from pyspark.sql import functions as F

from textloom.operators import conformity as c
from textloom.operators import parsers as p
from textloom.operators import standards as s
from textloom.plans.bindings import Tables

#: The header of a document and its sections, the same expression in Spark and DuckDB.
_HEADER = """'BIP: ' || doc_id || '\n' || CASE WHEN doc_id % 7 > 0 THEN 'Title: ' || coalesce(source, '') || repeat('x', CAST(doc_id % 80 AS INT)) || '\n' ELSE '' END
  || 'Authors: A B <a@x.org>\n    C <' || CASE WHEN doc_id % 3 > 0 THEN 'c@x' ELSE 'c' END || '>\n'
  || 'Status: ' || CASE doc_id % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Complete' WHEN 2 THEN 'Deployed' WHEN 3 THEN 'Closed' ELSE 'Final' END || '\n'
  || 'Type: ' || CASE doc_id % 4 WHEN 0 THEN 'Specification' WHEN 1 THEN 'Informational' WHEN 2 THEN 'Process' ELSE 'Standard' END || '\n'
  || 'Assigned: ' || CASE doc_id % 6 WHEN 0 THEN '?' WHEN 1 THEN '2024-02-30' ELSE '2024-02-29' END || '\n'
  || CASE WHEN doc_id % 8 > 0 THEN 'License: MIT\n' ELSE '' END
  || CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Discussion: 2024-01-02: http://x y\n' ELSE 'Discussion: 2024-01-02: http://x\n' END
  || CASE WHEN doc_id % 2 = 0 THEN 'Version: 1.2.' || doc_id % 4 * 5 || '\n' WHEN doc_id % 10 = 1 THEN 'Version: one\n' ELSE '' END
  || CASE doc_id % 3 WHEN 1 THEN 'Requires: 1, 22\n' WHEN 2 THEN 'Requires: 1,22\n' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN 'Layer: x\n' ELSE '' END"""
_TEXT = f"""CASE WHEN doc_id % 11 = 0 THEN '<pre>\n' || {_HEADER} || 'no header\n</pre>\n' ELSE {_HEADER} || '\n' END || '== Abstract ==\n' || coalesce(text, '')
  || CASE WHEN doc_id % 3 > 0 THEN '\n==Motivation==\nwhy' ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN '\n=== Copyright ===\nnone' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '\n== Specification ==\nall' ELSE '' END
  || CASE WHEN doc_id % 6 < 4 THEN '\n==  Change  Log ==\n1.2.0 first, never 1.2.77x or x1.3.0, then 1.2.' || doc_id % 3 * 5 ELSE '' END"""

_DONE = "doc_id % 5 IN (1, 2)"
_VERSIONED = "(doc_id % 2 = 0 OR doc_id % 10 = 1)"
_EXPECTED = {
    "preamble.top_rfc822": "doc_id % 11 > 0",
    **{f"required_header.{h}": "true" for h in ("bip", "authors", "status", "type", "assigned")},
    "required_header.title": "doc_id % 7 > 0 AND coalesce(source, '') || repeat('x', CAST(doc_id % 80 AS INT)) <> ''",
    "required_header.license": "doc_id % 8 > 0",
    "header_order": "doc_id % 11 > 0 AND doc_id % 13 > 0",
    "header_value.bip": "true",
    "header_value.title": "CASE WHEN doc_id % 7 > 0 THEN length(coalesce(source, '')) + doc_id % 80 <= 50 END",
    "header_value.authors": "doc_id % 3 > 0",
    "header_value.deputies": "NULL",
    "header_value.status": "doc_id % 5 < 4",
    "header_value.type": "doc_id % 4 < 3",
    "header_value.assigned": "doc_id % 6 <> 1",
    "header_value.license": "CASE WHEN doc_id % 8 > 0 THEN true END",
    "header_value.discussion": "CASE WHEN doc_id % 9 > 0 THEN doc_id % 9 > 1 END",
    "header_value.version": f"CASE WHEN {_VERSIONED} THEN doc_id % 2 = 0 END",
    "header_value.requires": "CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END",
    "header_value.replaces": "NULL",
    "header_value.proposed_replacement": "NULL",
    "required_section.abstract": "true",
    "required_section.motivation": "doc_id % 3 > 0",
    "required_section.copyright": "doc_id % 4 > 0",
    "type_specific.specification_section": "CASE WHEN doc_id % 4 = 0 THEN true END",
    "changelog.changelog_section": f"CASE WHEN {_DONE} THEN doc_id % 6 < 4 END",
    "changelog.version_header": f"CASE WHEN {_DONE} THEN {_VERSIONED} END",
    "changelog.version_matches": f"CASE WHEN {_DONE} AND {_VERSIONED} THEN doc_id % 2 = 0 AND doc_id % 6 < 4 AND doc_id % 3 = doc_id % 4 END",
}
_LIST = "[" + ", ".join(f"struct_pack(check_id := 'bip3.{k}', ok := CAST({v} AS BOOLEAN))" for k, v in _EXPECTED.items()) + "]"
_CHECKS = f"checks AS (SELECT id, x.check_id AS \"check\", x.ok AS passed FROM (SELECT doc_id AS id, unnest({_LIST}) AS x FROM documents))"


def _parsed(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.expr(_TEXT).alias("text"))
    return docs.select("id", *s.parsed_columns(F.col("text")))


def _checks(t: Tables):
    return c.assess(_parsed(t), s.new_standard(s.parsed()))


def _older(t: Tables, standard: str, tag: bool):
    q = s.parsed()
    fields = {h: q.value(h) for h in ("title", "version", "license")}
    return c.assess(_parsed(t), s.field_standard(fields, q, {"Abstract": 2, "Copyright": 2, "Change Log": 2}, standard, q.value("layer") if tag else None)).select("id", "check", "passed")


def _older_sql(standard: str, tag: bool) -> str:
    expected = {
        "required_field.title": _EXPECTED["required_header.title"], "required_field.version": _VERSIONED, "required_field.license": "doc_id % 8 > 0",
        "heading.abstract": "true", "heading.copyright": "false", "heading.changelog": "doc_id % 6 < 4",
    }
    if tag:
        expected["field_present.type"] = "doc_id % 13 = 0"
    listed = ", ".join(f"struct_pack(check_id := '{standard}.{k}', ok := CAST({v} AS BOOLEAN))" for k, v in expected.items())
    return f'SELECT id, x.check_id AS "check", x.ok AS passed FROM (SELECT doc_id AS id, unnest([{listed}]) AS x FROM documents)'


_TAGGED = """'NIP-' || doc_id || '\n======\n\n' || coalesce(nullif(source, ''), 'No title') || '\n-------\n\n' || CASE doc_id % 3 WHEN 0 THEN '`draft` `relay`  `Optional` `extra` `final`' WHEN 1 THEN '**Status:** Final ' ELSE 'No `tags` here' END || '\n' || coalesce(text, '')"""
_ALIASES = {"status": {"draft": "Draft", "final": "Final"}, "type": {"optional": "optional"}, "layer": {"relay": "relay"}}


def _identities(t: Tables):
    """Each conversation turn and the first turn of its conversation as two versions of a document."""
    turns = t.conversations.select("conv_id", "turn", "role", F.regexp_extract("text", "^[^.]*", 0).alias("title"))
    first = turns.filter("turn = 0").select("conv_id", *[F.col(x).alias(f"first_{x}") for x in ("role", "title")])
    both = turns.join(first, "conv_id")

    def version(number, title, role, path):
        return p.identity(number, F.col(title), F.lit("2024-01-05T10:00"), F.col(role), path, "bip")

    # a number, a placeholder, a draft with a number, and letters that are no placeholder
    conv = F.col("conv_id")
    candidate = (
        F.when(F.col("turn") % 2 == 0, F.format_string("docs/bip-%04d.md", conv))
        .when(F.col("turn") % 4 == 1, "docs/bip-XXXX.md")
        .when(conv % 3 == 0, F.format_string("docs/bip-%04d-draft.md", conv))
        .when(conv % 3 == 1, F.format_string("docs/bip-template-%04d.md", conv))
        .otherwise(F.format_string("docs/bip-exx%d.md", conv))
    )
    mine = version(F.lit(None).cast("string"), "title", "role", candidate)
    other = version(F.concat(F.lit("00"), "conv_id"), "first_title", "first_role", F.lit("bip.md"))
    return both.select("conv_id", "turn", mine["number"].alias("number"), p.same_document(mine, other, candidate).alias("same"))


QUERIES = {
    "chk02_new_standard": (lambda t: _checks(t).select("id", "check", "passed"), f"WITH {_CHECKS} SELECT * FROM checks"),
    "chk02_scores": (
        lambda t: c.document_scores(_checks(t)).filter("standard is null").drop("standard"),
        f"""WITH {_CHECKS}, n AS (SELECT id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS skipped FROM checks GROUP BY id)
          SELECT id, passed, failed, skipped, round_even(passed / (passed + failed) * 100, 2) AS score FROM n""",
    ),
    "chk01_legacy_standard": (lambda t: _older(t, "bip2", False), _older_sql("bip2", False)),
    "chk04_tag_standard": (lambda t: _older(t, "nip", True), _older_sql("nip", True)),
    "chk05_issues": (
        lambda t: _parsed(t).select(
            "id",
            F.array_join(s.header_issues({h: s.parsed().value(h) for h in ("title", "license")}), ",").alias("missing"),
            F.array_join(s.heading_issues(s.parsed(), {"Abstract": 2, "Copyright": 2, "Change Log": 2}), "; ").alias("headings"),
        ),
        f"""SELECT doc_id AS id, concat_ws(',', CASE WHEN NOT ({_EXPECTED["required_header.title"]}) THEN 'title' END, CASE WHEN doc_id % 8 = 0 THEN 'license' END) AS missing,
          concat_ws('; ', CASE WHEN doc_id % 4 > 0 THEN 'Wrong level for Copyright: expected 2, found 3' ELSE 'Missing: Copyright' END, CASE WHEN doc_id % 6 >= 4 THEN 'Missing: Change Log' END) AS headings FROM documents""",
    ),
    "prj18_top_headers": (
        lambda t: _parsed(t).select("id", F.col("top.valid").alias("valid"), F.inline("top.headers")).groupBy("id", "valid").agg(F.count("*").alias("headers"), F.max_by("value", F.col("name") == "authors").alias("authors")),
        """SELECT doc_id AS id, doc_id % 11 > 0 AS valid, 5 + CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 8 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 9 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 OR doc_id % 10 = 1 THEN 1 ELSE 0 END
          + CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS headers, 'A B <a@x.org>' || chr(10) || 'C <' || CASE WHEN doc_id % 3 > 0 THEN 'c@x' ELSE 'c' END || '>' AS authors FROM documents""",
    ),
    "prj06_tag_lines": (
        lambda t: p.tag_line_headers(t.documents.select(F.col("doc_id").alias("id"), F.expr(_TAGGED).alias("text")), _ALIASES),
        """SELECT doc_id AS id, trim(coalesce(nullif(source, ''), 'No title')) AS title, CASE doc_id % 3 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Final' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'optional' END AS type,
          CASE WHEN doc_id % 3 = 0 THEN 'relay' END AS layer, CASE WHEN doc_id % 3 = 0 THEN 'extra, final' END AS kind FROM documents""",
    ),
    "flt18_same_document": (
        _identities,
        r"""WITH f AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(trim(regexp_replace(regexp_extract(text, '^[^.]*'), '\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS title FROM conversations)
          SELECT a.conv_id, a.turn, CASE WHEN a.turn % 4 = 1 THEN '' WHEN a.turn % 4 = 3 AND a.conv_id % 3 = 2 THEN 'exx' || a.conv_id ELSE CAST(a.conv_id AS VARCHAR) END AS number,
            CASE a.turn % 4 WHEN 1 THEN (a.title <> '' AND a.title = b.title) OR (lower(trim(a.role)) = lower(trim(b.role)) AND trim(a.role) <> '') WHEN 3 THEN a.conv_id % 3 < 2 ELSE true END AS same FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.turn = 0""",
    ),
}
