"""Rules on the shape of stored documents and payloads, held against VARIANT values within each row.

A member may be missing, null, or of another kind than it should be; the three are told apart,
as a typed read would make all of them null.  Problems are rows with the path of the member,
so a report is a grouping.  Nothing is shuffled before the report.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import once
from textloom.operators.references import Source
from textloom.operators.text import reference_id

#: What a model run's status may be; other than success needs a message and no findings.
STATUSES = ("failed", "success")
_NO_PROBLEMS = "array<struct<path:string,problem:string,level:string>>"


def kind(value: Column, path: str = "$") -> Column:
    """missing, null, object, list, text, flag or number: what a variant holds at a path."""

    def named(shape: Column) -> Column:
        found = F.when(shape.isNull(), "missing").when(shape == "VOID", "null")
        for start, name in (("OBJECT", "object"), ("ARRAY", "list"), ("STRING", "text"), ("BOOLEAN", "flag")):
            found = found.when(F.startswith(shape, F.lit(start)), name)
        return found.otherwise("number")

    return once(F.schema_of_variant(F.try_variant_get(value, path, "variant")), named)


def text_at(value: Column, path: str) -> Column:
    """A member as trimmed text; empty if it is missing or null."""
    return F.coalesce(F.trim(F.try_variant_get(value, path, "string")), F.lit(""))


def _problem(path: Column, what: Column | str, broken: Column, level: str = "error") -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), what.alias("problem"), F.lit(level).alias("level")))


def _of(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(name))


Rules = Callable[[Column, Column], list[Column]]


def list_problems(value: Column, member: str, path: Column, rules: Rules) -> Column:
    """Problems of a member that must be a list, and of its entries by ``rules(entry, path)``, which may give problems or lists of them."""
    entries = F.try_variant_get(value, f"$.{member}", "array<variant>")
    at = _of(path, f".{member}")

    def entry(e: Column, i: Column) -> Column:
        own = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
        return _all(rules(e, own))

    def checked(what: Column) -> Column:
        wrong = F.array(_problem(at, F.concat(F.lit("must be a list, is "), what), F.lit(True)))
        return F.when(what == "list", F.flatten(F.transform(entries, entry))).otherwise(wrong)

    return once(kind(value, f"$.{member}"), checked)


class _Many(list):
    """A list of problems as one column."""


def _all(problems: list[Column | _Many]) -> Column:
    """Problems and lists of them as one list."""
    single, many = [p for p in problems if not isinstance(p, _Many)], [p[0] for p in problems if isinstance(p, _Many)]
    return F.concat(*([F.array_compact(F.array(*single)).cast(_NO_PROBLEMS)] if single else []), *many)


def _with(facts: dict[str, Column], problems: Callable[[Column], list[Column | _Many]]) -> list[_Many]:
    """Problems that follow from facts, each fact found once."""
    return [_Many([once(F.struct(*[c.alias(n) for n, c in facts.items()]), lambda f: _all(problems(f)))])]


def target_rules(sources: list[Source]) -> Rules:
    """A relation's target: text of the form slug:id, of a known source, with an id that the source can have."""

    def rules(e: Column, path: Column) -> list[_Many]:
        def problems(f: Column) -> list[Column]:
            what, target = f["what"], f["target"]
            slug, rest = F.substring_index(target, ":", 1), F.substring(target, F.instr(target, ":") + 1, 1 << 20)
            shaped = F.contains(target, F.lit(":")) & (slug != "") & (rest != "")
            valid = reduce(lambda other, s: F.when(slug == s.slug, reference_id(rest, s.most, s.hexadecimal).isNotNull()).otherwise(other), sources, F.lit(False))
            known = slug.isin([s.slug for s in sources])
            text, right = (what == "text") & (target != ""), f["own"] == "object"
            return [
                _problem(path, F.concat(F.lit("must be an object, is "), f["own"]), ~right),
                _problem(_of(path, ".target"), "missing", right & (what == "missing")),
                _problem(_of(path, ".target"), F.concat(F.lit("must be text, is "), F.when(what == "text", "empty").otherwise(what)), right & (what != "missing") & ~text),
                _problem(_of(path, ".target"), "not of the form source:id", text & ~shaped),
                _problem(_of(path, ".target"), "unknown source", text & shaped & ~known),
                _problem(_of(path, ".target"), "no id of its source", text & shaped & known & ~valid),
            ]

        return _with({"own": kind(e), "what": kind(e, "$.target"), "target": text_at(e, "$.target")}, problems)

    return rules


def type_rule(e: Column, path: Column, allowed: list[str]) -> list[_Many]:
    def problems(f: Column) -> list[Column]:
        absent = (f["what"] != "text") | (f["given"] == "")
        right, at = f["own"] == "object", _of(path, ".type")
        return [_problem(at, F.concat(F.lit("must be text, is "), F.when(f["what"] == "text", "empty").otherwise(f["what"])), right & absent), _problem(at, "unknown type", right & ~absent & ~f["whole"].isin(allowed))]

    return _with({"own": kind(e), "what": kind(e, "$.type"), "given": text_at(e, "$.type"), "whole": F.try_variant_get(e, "$.type", "string")}, problems)


def document_problems(doc: Column, sources: list[Source], header_types: list[str], relation_types: list[str]) -> Column:
    """All problems of a stored document: history, and relations from headers, text and models."""
    root, target = F.lit("$"), target_rules(sources)

    def history(e: Column, path: Column) -> list[Column]:
        fields = F.try_variant_get(e, "$", "array<variant>")
        names = ("commit", "author_date", "author_name")

        def problems(f: Column) -> list[Column]:
            empty = lambda i: f["right"] & (F.coalesce(F.trim(F.try_variant_get(e, f"$[{i}]", "string")), F.lit("")) == "")
            return [
                _problem(path, "must hold commit, author_date, author_name and author_email", ~f["right"]),
                *[_problem(_of(path, f"[{i}]"), f"empty {name}", empty(i)) for i, name in enumerate(names)],
                _problem(path, "without author_email", empty(3), "warning"),
            ]

        return _with({"right": (kind(e) == "list") & F.size(fields).isin(3, 4)}, problems)

    def counted(e: Column, path: Column) -> list[Column]:
        n = F.try_variant_get(e, "$.count", "long")
        whole = F.startswith(F.schema_of_variant(F.try_variant_get(e, "$.count", "variant")), F.lit("BIGINT"))
        return [*target(e, path), _problem(_of(path, ".count"), "must be a positive whole number", (kind(e) == "object") & ~F.coalesce(whole & (n >= 1), F.lit(False)))]

    def run(e: Column, path: Column) -> list[Column]:
        findings = F.coalesce(F.size(F.try_variant_get(e, "$.findings", "array<variant>")), F.lit(0))
        return _with({"own": kind(e), "status": F.lower(text_at(e, "$.status")), "findings": findings}, lambda f: run_problems(e, path, f))

    def run_problems(e: Column, path: Column, f: Column) -> list[Column | _Many]:
        status, findings = f["status"], f["findings"]
        right, bad = f["own"] == "object", ~status.isin("success", "")
        return [
            _problem(path, F.concat(F.lit("must be an object, is "), f["own"]), ~right),
            *[_problem(_of(path, f".{m}"), "missing or empty", right & (text_at(e, f"$.{m}") == "")) for m in ("run_id", "model", "timestamp", "status")],
            _problem(_of(path, ".status"), "unknown status", right & (status != "") & ~status.isin(*STATUSES)),
            _problem(_of(path, ".findings"), "findings of a failed run", right & bad & (findings > 0)),
            _problem(_of(path, ".error_message"), "failed run without a message", right & bad & (text_at(e, "$.error_message") == "")),
            _Many([F.when(right, list_problems(e, "findings", path, lambda f, at: [*target(f, at), *type_rule(f, at, relation_types)])).otherwise(F.array().cast(_NO_PROBLEMS))]),
        ]

    inner = "$.insights.interrelations"
    at = F.lit(inner)

    def no_object(where: Column, what: Column) -> Column:
        return F.array(_problem(where, F.concat(F.lit("must be an object, is "), what), F.lit(True)))

    def lists(relations: Column) -> Column:
        return F.concat(
            list_problems(relations, "preamble_extracted", at, lambda e, p: [*target(e, p), *type_rule(e, p, header_types)]),
            list_problems(relations, "body_extracted_regex", at, counted),
            list_problems(relations, "body_extracted_llm", at, run),
        )

    meta = F.lit("$.meta")
    metas = once(kind(doc, "$.meta"), lambda what: F.when(what == "object", list_problems(F.try_variant_get(doc, "$.meta", "variant"), "git_history", meta, history)).otherwise(no_object(meta, what)))
    inside = once(kind(doc, inner), lambda what: F.when(what == "object", once(F.try_variant_get(doc, inner, "variant"), lists)).otherwise(no_object(at, what)))
    held = once(kind(doc), lambda what: F.when(what != "object", no_object(root, what)).otherwise(F.concat(metas, inside)))
    return F.when(doc.isNull(), F.array(_problem(root, "no JSON", F.lit(True)))).otherwise(held)


def document_violations(files: DataFrame, sources: list[Source], header_types: list[str], relation_types: list[str]) -> DataFrame:
    """file, path, problem and level of stored documents (file, text): a row for each problem."""
    parsed = files.select("file", F.try_parse_json("text").alias("doc"))
    return parsed.select("file", F.inline(document_problems(F.col("doc"), sources, header_types, relation_types)))


def payload_violations(files: DataFrame, shapes: dict[str, dict[str, str]]) -> DataFrame:
    """The same of payloads (file, text): members (paths) and their kinds by file name; files without a shape need to be JSON only, and files of a shape must be there."""
    parsed = files.select("file", F.try_parse_json("text").alias("doc"))
    rules = []
    for file, members in shapes.items():
        for path, wanted in members.items():
            what = kind(F.col("doc"), path)
            rules.append(_problem(F.lit(path), F.concat(F.lit(f"must be {wanted}, is "), what), (F.col("file") == file) & F.col("doc").isNotNull() & (what != wanted)))
    found = F.array_compact(F.array(_problem(F.lit("$"), "no JSON", F.col("doc").isNull()), *rules))
    absent = files.sparkSession.createDataFrame([(f,) for f in sorted(shapes)], "file string").join(files.select("file"), "file", "left_anti")
    return parsed.select("file", F.inline(found)).unionByName(absent.select("file", F.lit("$").alias("path"), F.lit("file is missing").alias("problem"), F.lit("error").alias("level")))


def index_violations(files: DataFrame, index: str = "dataset_index.json") -> DataFrame:
    """Problems of an index that lists files by name: absent, without a files object, or naming files that are not there (file, text)."""
    doc = F.try_parse_json("text")
    own = files.filter(F.col("file") == index).select("file", doc.alias("doc"))
    members = F.try_variant_get("doc", "$.files", "map<string,string>")
    shaped = F.coalesce((kind(F.col("doc"), "$.files") == "object") & (F.size(members) > 0), F.lit(False))
    level = F.lit("error").alias("level")
    wrong = own.filter(~shaped).select("file", F.lit("$.files").alias("path"), F.lit("must be an object with files").alias("problem"), level)
    listed = own.filter(shaped).select("file", F.explode(F.map_values(members)).alias("named"))
    lost = listed.join(files.select(F.col("file").alias("named")), "named", "left_anti").select("file", F.lit("$.files").alias("path"), F.concat(F.lit("missing file "), "named").alias("problem"), level)
    absent = files.sparkSession.createDataFrame([(index,)], "file string").join(files.select("file"), "file", "left_anti").select("file", F.lit("$").alias("path"), F.lit("file is missing").alias("problem"), level)
    return wrong.unionByName(lost).unionByName(absent)


def report(files: DataFrame, problems: DataFrame, shown: int = 5) -> DataFrame:
    """file, status (ok, warned, failed), errors, warnings, distinct problems with their numbers, and the first paths of each file (file), absent ones included."""
    # problems are found once: each file also is a row without one
    none = [F.lit(None).cast("string").alias(c) for c in ("level", "problem", "path")]
    every = problems.select("file", "level", "problem", "path").unionByName(files.select("file", *none)).repartition("file")
    counted = every.groupBy("file", "level", "problem").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    shown_of = F.when(F.col("level").isNotNull(), F.struct(F.col("level"), F.col("problem"), F.col("n"), F.col("path")))
    full = counted.groupBy("file").agg(
        F.sum(F.when(F.col("level") == "error", F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("level") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
        F.slice(F.sort_array(F.collect_list(shown_of)), 1, shown).alias("found"),
    )
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warned").otherwise("ok")
    lines = F.transform("found", lambda x: F.format_string("%s (%d, first at %s)", x["problem"], x["n"], x["path"]))
    return full.select("file", status.alias("status"), "errors", "warnings", F.coalesce(F.array_join(lines, "; "), F.lit("")).alias("problems"))


def validation_summary(reported: DataFrame) -> DataFrame:
    """status, files, errors and warnings of a report."""
    return reported.groupBy("status").agg(F.count("*").alias("files"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
