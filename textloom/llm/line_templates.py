"""Line dedup by a log-template tree, in DataFrame functions only.

Each line walks a tree of fixed depth: its token count, then its first ``DEPTH`` tokens.
Tokens with digits are variable fields and stand as ``<*>``.  At the leaf, the rest of the
tokens is cut into ``SEGMENTS`` runs; a line belongs to its exact template and, from
``LONG`` tokens on, to the templates that leave one run open (``<*>``), so lines at one leaf
that differ within one run only share a template.  A long line of several sentences has its
sentences as runs instead: each that has ``LEAST_SENTENCE`` fixed tokens is a template of
its own, the same as a line of those tokens, so a passage is found inside other words and
when some of its sentences differ.  A template that recurs across documents stays in its
first document (the smallest doc_id) and is dropped from the others: its lines, or its
sentences from lines that stay.

Lines with fewer than ``LEAST`` fixed tokens say little: their exact templates are dropped
only if ``SHORT_DOCS`` documents have them.  Lines without a fixed token always stay.

Cases: a null or empty text stays as it is, with 0 and 1 lines; rows of one doc_id are one
document; a row without an id is a document of its own, after all others (ids below 2^62); repeats inside one document stay; a line
that loses sentences gets single spaces; columns of docs named like those of the result
are replaced, others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written

DEPTH = 3
SEGMENTS = 6
LONG = 10
LEAST = 5
LEAST_SENTENCE = 8
SHORT_DOCS = 5
_LAST = (1 << 63) - 1
_ENDS = ".!?"


def _tidy(line: Column) -> Column:
    """The line's tokens with one space between them."""
    untidy = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(untidy, F.trim(F.regexp_replace(line, "[ \t\r]+", " "))).otherwise(line)


def _sentences(tidy: Column) -> Column:
    """Sentences of a tidy line."""
    marked = tidy
    for end in _ENDS:
        marked = F.replace(marked, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.split(marked, "\n")


def _tokens(sentence: Column) -> Column:
    """Tokens of a tidy sentence, variable fields as <*>."""
    shown = F.when(sentence.rlike("[0-9]"), F.regexp_replace(sentence, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(sentence)
    # a split at one plain character needs no regular expression
    return F.when(sentence == "", F.array().cast("array<string>")).otherwise(F.split(shown, " "))


def _start(toks: Column, i: int) -> Column:
    return F.floor((F.size(toks) - DEPTH) * i / SEGMENTS).cast("int")


def _runs(toks: Column) -> list[Column]:
    """Hashes of the runs behind the leading tokens."""
    starts = [_start(toks, i) for i in range(SEGMENTS + 1)]
    return [F.xxhash64(F.slice(toks, a + (DEPTH + 1), F.greatest(b - a, F.lit(0)))) for a, b in zip(starts, starts[1:])]


def _lead(toks: Column) -> Column:
    return F.xxhash64(F.size(toks), F.slice(toks, 1, DEPTH))


def _exact(toks: Column) -> Column:
    return F.xxhash64(F.size(toks), toks)


def _fixed(toks: Column) -> Column:
    """Number of fixed tokens."""
    fields = F.when(F.array_contains(toks, "<*>"), F.size(F.filter(toks, lambda t: t == "<*>"))).otherwise(0)
    return F.size(toks) - fields


def _sentence_key(toks: Column) -> Column:
    return F.when(_fixed(toks) >= LEAST_SENTENCE, _exact(toks))


def _owned(docs: DataFrame) -> DataFrame:
    """row (all columns) and own (the document's number) of docs; rows without an id are numbered where they are written, if there are any."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own"))
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return rows
    numbered = written(nameless.select(F.struct(*docs.columns).alias("row"), (F.lit(_LAST) - F.monotonically_increasing_id()).alias("own")))
    return rows.filter("own is not null").unionByName(numbered)


def _templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates (doc, unit, template) of long lines and sentences, and (doc, template) of short lines, of documents (doc, text)."""
    lines = docs.select("doc", F.explode(F.split("text", "\n")).alias("line")).select("doc", _tidy(F.col("line")).alias("tidy"))
    split = lines.select("doc", F.transform(_sentences(F.col("tidy")), _tokens).alias("parts")).select("doc", "parts", F.flatten("parts").alias("toks"))
    toks, fixed = F.col("toks"), F.col("fixed")
    several = (F.size("parts") > 1) & (F.size(toks) >= LONG)
    # what the tree needs of a line: its exact template, then the lead and runs, or the sentences
    runs = F.when((fixed >= LEAST) & ~several & (F.size(toks) >= LONG), F.array(_lead(toks), *_runs(toks)))
    inner = F.when(several, F.filter(F.transform("parts", _sentence_key), lambda k: k.isNotNull()))
    rated = split.withColumn("fixed", _fixed(toks))
    # lines without a fixed token go after they are written: a filter before would be pushed below the tokens and make them again
    exact_key = F.when(fixed > 0, _exact(toks)).alias("exact")
    parsed = written(rated.select("doc", (fixed < LEAST).alias("short"), exact_key, runs.alias("runs"), inner.alias("inner"))).filter("exact is not null")
    part = [F.get("runs", F.lit(i)) for i in range(SEGMENTS + 1)]
    opened = [F.xxhash64(part[0], *[F.lit(j) if j == i else part[j + 1] for j in range(SEGMENTS)]) for i in range(SEGMENTS)]
    pair = lambda unit, template: F.struct(unit.alias("unit"), template.alias("template"))
    exact = F.array(pair(F.col("exact"), F.col("exact")))
    open_runs = F.when(F.col("runs").isNotNull(), F.array(*[pair(F.col("exact"), t) for t in opened]))
    sentences = F.transform("inner", lambda k: pair(k, k))
    listed = F.coalesce(F.concat(exact, open_runs), F.concat(exact, sentences), exact)
    return parsed.filter("not short").select("doc", F.inline(listed)), parsed.filter("short").select("doc", F.col("exact").alias("template"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with recurring lines and sentences taken out of ``text``, and the columns n_lines, n_dropped and n_cut (sentences taken out of lines that stay)."""
    rows = _owned(docs)
    members, short = _templates(rows.select(F.col("own").alias("doc"), F.col("row.text").alias("text")))
    first = members.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    dropped = members.join(first.drop("last"), "template").filter("doc > first").select("doc", "unit")
    short = short.distinct()
    many = short.groupBy("template").agg(F.min("doc").alias("first"), F.count("*").alias("docs")).filter(F.col("docs") >= SHORT_DOCS)
    dropped = dropped.unionByName(short.join(many, "template").filter("doc > first").select("doc", F.col("template").alias("unit")))
    gone = dropped.groupBy("doc").agg(F.collect_set("unit").alias("gone")).select(F.struct("doc", "gone").alias("found"))
    # docs as one column, so that no name of theirs can clash; lines bound as lambda variables are taken apart once
    joined = rows.join(gone, F.col("own") == F.col("found.doc"), "left")
    text, listed = F.col("row.text"), F.col("found.gone")
    # one pass over a document's lines: each step binds what the next one reads
    shown = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), _sentences(_tidy(line)).alias("shown")))
    parted = F.transform(shown, lambda x: F.struct(x["line"].alias("line"), x["shown"].alias("shown"), F.transform(x["shown"], _tokens).alias("toks")))
    flat = F.transform(parted, lambda x: F.struct(*(x[c].alias(c) for c in ("line", "shown", "toks")), F.flatten(x["toks"]).alias("all")))

    def sentences_left(x: Column) -> Column:
        several = (F.size(x["toks"]) > 1) & (F.size(x["all"]) >= LONG)
        left = F.filter(x["shown"], lambda s, i: ~F.coalesce(F.array_contains(listed, _sentence_key(F.get(x["toks"], i))), F.lit(False)))
        return F.when(~(F.array_contains(listed, _exact(x["all"])) & (_fixed(x["all"]) > 0)), F.when(several, left).otherwise(x["shown"]))

    kept = F.transform(flat, lambda x: F.struct(x["line"].alias("line"), x["shown"].alias("shown"), F.coalesce(sentences_left(x), F.array().cast("array<string>")).alias("left")))
    # a line without a sentence left is dropped; one with all of them stays as it was
    whole = F.transform(
        kept,
        lambda x: F.when(
            F.size(x["left"]) > 0,
            F.struct(F.when(F.size(x["left"]) == F.size(x["shown"]), x["line"]).otherwise(F.array_join(x["left"], " ")).alias("text"), (F.size(x["shown"]) - F.size(x["left"])).alias("cut")),
        ),
    )
    stay = F.when(listed.isNotNull(), F.filter(whole, lambda line: line.isNotNull()))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long")
    result = {
        "text": F.when(F.col("stay").isNull(), text).otherwise(F.array_join(F.col("stay.text"), "\n")),
        "n_lines": n_lines,
        "n_dropped": F.when(F.col("stay").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("stay")),
        "n_cut": F.coalesce(F.aggregate("stay", F.lit(0).cast("long"), lambda n, line: n + line["cut"]), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped", "n_cut") if c not in docs.columns)]
    return joined.select("row", stay.alias("stay")).select(*[(result[c] if c in result else F.col("row")[c]).alias(c) for c in names])


_SPLIT = "string_split(" + "replace(" * 3 + "tidy" + "".join(f", '{e} ', '{e}' || chr(10))" for e in _ENDS) + ", chr(10))"
_MASKED = "CASE WHEN s = '' THEN [] ELSE string_split(regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') END"
_FIXED = "len(list_filter({}, lambda t: t <> '<*>'))"
_KEY = "'x ' || array_to_string({}, ' ')"
_RUNS = [f"list_slice(toks, {DEPTH} + 1 + floor((len(toks) - {DEPTH}) * {i} / {SEGMENTS})::INT, {DEPTH} + floor((len(toks) - {DEPTH}) * {i + 1} / {SEGMENTS})::INT)" for i in range(SEGMENTS)]
_OPEN = [
    f"(len(toks)::VARCHAR || ' {i} ' || array_to_string(list_slice(toks, 1, {DEPTH}), ' ') || '|' || " + " || '|' || ".join(f"array_to_string({_RUNS[j]}, ' ')" for j in range(SEGMENTS) if j != i) + ")"
    for i in range(SEGMENTS)
]
#: The same in DuckDB, with strings in place of hashes.
ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM {{docs}}
), tidied AS (
  SELECT *, trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'), ' ') AS tidy FROM split
), parted AS (
  SELECT *, {_SPLIT} AS shown FROM tidied
), tokens AS (
  SELECT *, list_transform(shown, lambda s: {_MASKED}) AS parts FROM parted
), flat AS (
  SELECT *, flatten(parts) AS toks FROM tokens
), rated AS (
  SELECT *, {_FIXED.format("toks")} AS fixed, {_KEY.format("toks")} AS exact, len(shown) > 1 AND len(toks) >= {LONG} AS several,
    list_transform(parts, lambda p: CASE WHEN {_FIXED.format("p")} >= {LEAST_SENTENCE} THEN {_KEY.format("p")} END) AS keys
  FROM flat
), members AS (
  SELECT doc_id, exact AS unit, unnest(CASE WHEN NOT several AND len(toks) >= {LONG} THEN [exact, {", ".join(_OPEN)}] ELSE [exact] END) AS template FROM rated WHERE fixed >= {LEAST}
  UNION ALL SELECT doc_id, k, k FROM (SELECT doc_id, unnest(keys) AS k FROM rated WHERE several AND fixed >= {LEAST}) WHERE k IS NOT NULL
), firsts AS (
  SELECT template, min(doc_id) AS first FROM members GROUP BY template HAVING min(doc_id) < max(doc_id)
), short AS (
  SELECT DISTINCT doc_id, exact FROM rated WHERE fixed BETWEEN 1 AND {LEAST - 1}
), many AS (
  SELECT exact, min(doc_id) AS first FROM short GROUP BY exact HAVING count(*) >= {SHORT_DOCS}
), gone AS (
  SELECT DISTINCT doc_id, unit FROM members JOIN firsts USING (template) WHERE doc_id > first
  UNION SELECT doc_id, exact FROM short JOIN many USING (exact) WHERE doc_id > first
), sets AS (
  SELECT doc_id, list(unit) AS units FROM gone GROUP BY doc_id
), marked AS (
  SELECT doc_id, pos, line, shown, CASE WHEN fixed > 0 AND list_contains(units, exact) THEN [] WHEN several THEN list_filter(shown, lambda s, i: NOT coalesce(list_contains(units, keys[i]), false)) ELSE shown END AS stays
  FROM rated LEFT JOIN sets USING (doc_id)
)
SELECT doc_id, coalesce(string_agg(CASE WHEN len(stays) = len(shown) THEN line ELSE array_to_string(stays, ' ') END, chr(10) ORDER BY pos) FILTER (len(stays) > 0), '') AS text,
  count(*)::BIGINT AS n_lines, count(*) FILTER (len(stays) = 0)::BIGINT AS n_dropped, coalesce(sum(len(shown) - len(stays)) FILTER (len(stays) > 0), 0)::BIGINT AS n_cut
FROM marked GROUP BY doc_id
"""
