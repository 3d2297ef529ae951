"""Headers of documents in other layouts, and the identity of a document over its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.operators.standards import top_headers
from textloom.operators.text import header_block, header_fields


def tag_line_headers(docs: DataFrame, aliases: dict[str, dict[str, str]], dimensions: tuple[str, ...] = ("status", "type", "layer")) -> DataFrame:
    """id, title, a column for each dimension, and kind, of documents (id, text) that name their properties in a line of tokens.

    The first heading (underlined with =, or one that starts with "# NIP-") names the document, the next
    (underlined with -, or "## ") is its title, and the first line after that has the tokens: nothing but words
    in backticks, or one bold status.  Tokens go to the first dimension that knows them and has none yet; the
    rest, in order, is the kind.
    aliases: by dimension, the value of each token in lower case.
    """
    own = Window.partitionBy("id")
    line, after, pos = F.col("line"), F.col("after"), F.col("pos")
    first = lambda test: F.min(F.when(test, pos)).over(own)
    at = lambda place, value: F.max(F.when(pos == F.col(place), value)).over(own)
    under = lambda mark: F.trim(after).rlike(f"^{mark}$")
    rows = docs.select("id", F.posexplode_outer(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    rows = rows.withColumn("after", F.coalesce(F.lead("line").over(own.orderBy("pos")), F.lit("")))
    rows = rows.withColumn("top", first(under("=+") | line.rlike(r"^#\s+NIP-")))
    rows = rows.withColumn("body", at("top", pos + F.when(under("=+"), 2).otherwise(1)))
    rows = rows.withColumn("title_at", first((pos >= F.col("body")) & (F.trim(line) != "") & (under("-{2,}") | line.rlike(r"^##\s+"))))
    rows = rows.withColumn("below", at("title_at", pos + F.when(under("-{2,}"), 2).otherwise(1)))
    rows = rows.withColumn("line_at", first((pos >= F.col("below")) & (F.trim(line) != "")))
    title = F.trim(F.when(under("-{2,}"), line).otherwise(F.regexp_replace(line, r"^##\s+", "")))
    out = rows.groupBy("id").agg(F.max(F.when(pos == F.col("title_at"), title)).alias("title"), F.max(F.when(pos == F.col("line_at"), F.trim(line))).alias("line"))
    ticked = F.regexp_extract_all("line", F.lit("`([^`]+)`"), F.lit(1))
    only_ticked = F.trim(F.regexp_replace("line", "`[^`]+`", "")) == ""
    bold = F.trim(F.regexp_extract("line", r"(?i)^\*\*status:\*\*\s*(\S.*)$", 1))
    none = F.array().cast("array<string>")
    out = out.withColumn("tokens", F.coalesce(F.when(only_ticked & (F.size(ticked) > 0), ticked).when(bold != "", F.array(bold)), none))
    # each token's dimension and value: the first that knows it
    known = F.create_map(*[F.lit(x) for d in reversed(dimensions) for token, value in aliases.get(d, {}).items() for x in (token, f"{d}\n{value}")]) if any(aliases.get(d) for d in dimensions) else None
    read = F.try_element_at(known, F.lower("token")) if known is not None else F.lit(None).cast("string")
    rows = out.select("id", F.posexplode("tokens").alias("pos", "token")).select("id", "pos", "token", F.substring_index(read, "\n", 1).alias("dimension"), F.substring_index(read, "\n", -1).alias("value"))
    earliest = F.row_number().over(Window.partitionBy("id", "dimension").orderBy("pos")) == 1
    taken = rows.withColumn("taken", F.col("dimension").isNotNull() & earliest)
    rest = F.sort_array(F.collect_list(F.when(~F.col("taken"), F.struct("pos", "token"))))
    sums = taken.groupBy("id").agg(
        *[F.max(F.when(F.col("taken") & (F.col("dimension") == d), F.col("value"))).alias(d) for d in dimensions],
        F.nullif(F.array_join(F.transform(rest, lambda x: x["token"]), ", "), F.lit("")).alias("kind"),
    )
    return out.select("id", F.coalesce("title", F.lit("")).alias("title")).join(sums, "id", "left")


def historic_fields(docs: DataFrame, aliases: dict[str, dict[str, str]], dimensions: tuple[str, ...] = ("status", "type", "layer")) -> DataFrame:
    """id, layout and fields of documents (id, text) from any time: a fenced or <pre> block with fields, else header lines at the top, else a line of tokens.

    Each layout is read only where the ones before gave no field; layout is block, headers, tags, or empty.
    """
    of_block = header_fields(docs.select("id", header_block(F.col("text")).alias("block")).filter("block is not null"))
    blocks = of_block.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("block"))
    found = docs.select("id", "text").join(blocks, "id", "left")
    headers = F.when(F.col("block").isNull(), top_headers(F.col("text"))["headers"])
    names = F.array_distinct(F.transform(headers, lambda h: h["name"]))
    last = lambda n: F.element_at(F.filter(headers, lambda h: h["name"] == n), -1)["value"]
    found = written(found.withColumn("top", F.when(F.size(headers) > 0, F.map_from_arrays(names, F.transform(names, last)))))
    rest = found.filter("block is null and top is null")
    tags = tag_line_headers(rest.select("id", "text"), aliases, dimensions)
    members = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("title", *dimensions, "kind")])
    tags = tags.select("id", F.map_from_entries(F.filter(members, lambda m: F.coalesce(m["value"], F.lit("")) != "")).alias("tags"))
    full = found.join(tags, "id", "left")
    layout = F.when(F.col("block").isNotNull(), "block").when(F.col("top").isNotNull(), "headers").when(F.size("tags") > 0, "tags").otherwise("")
    return full.select("id", layout.alias("layout"), F.coalesce("block", "top", "tags", F.create_map().cast("map<string,string>")).alias("fields"))


def with_aliases(fields: Column, aliases: dict[str, str], drop: bool = True) -> Column:
    """A map of fields in which each alias's value stands under its canonical name too, unless that key exists; aliases go where asked."""
    for alias, name in aliases.items():
        if alias != name:
            add = F.map_contains_key(fields, alias) & ~F.map_contains_key(fields, name)
            fields = F.when(add, F.map_concat(fields, F.create_map(F.lit(name), F.element_at(fields, alias)))).otherwise(fields)
    gone = [a for a, n in aliases.items() if a != n]
    return F.map_filter(fields, lambda k, _: ~k.isin(gone)) if drop and gone else fields


def flat_text(value: Column) -> Column:
    """Lower case, white space made one space, trimmed; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")), F.lit(""))


def document_number(value: Column) -> Column:
    """An id in one spelling: digits without leading zeros, other letters and digits in lower case, else empty; x's stand for none."""
    text = flat_text(value)
    return F.when(text.rlike(r"^\d+$"), text.cast("decimal(38,0)").cast("string")).when(text.rlike("^[0-9a-z]+$") & ~text.rlike("^x+$"), text).otherwise(F.lit(""))


def is_placeholder(path: Column) -> Column:
    """Whether a file name stands for a document without a number yet: a part after a hyphen, its ending aside, is nothing but three or more x's or question marks."""
    parts = F.split(F.lower(F.substring_index(path, "/", -1)), "-")
    later = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.substring_index(p, ".", 1))
    return F.exists(later, lambda p: (F.length(p) >= 3) & ((F.translate(p, "x", "") == "") | (F.translate(p, "?", "") == "")))


def path_number(path: Column, prefix: str) -> Column:
    """The id in a file name: the stem after the prefix if it is one, else its first number; empty for placeholders."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    named = document_number(F.regexp_replace(stem, f"(?i)^{prefix}-", ""))
    digits = F.regexp_extract(stem, r"(\d+)", 1)
    found = F.when(named != "", named).when(digits != "", digits.cast("decimal(38,0)").cast("string")).otherwise(F.lit(""))
    return F.when(is_placeholder(path), F.lit("")).otherwise(found)


def identity(declared: Column, title: Column, created: Column, authors: Column, path: Column, prefix: str) -> Column:
    """number, title, created and authors that tell whether two versions are of one document; the path's number counts only where none is declared."""
    given = document_number(declared)
    number = F.when(given != "", given).when(flat_text(declared) == "", path_number(path, prefix)).otherwise(F.lit(""))
    day = F.substring(flat_text(created), 1, 10)
    people = F.filter(F.array_distinct(F.transform(F.split(authors, "\n"), flat_text)), lambda a: a != "")
    return F.struct(
        number.alias("number"),
        F.trim(F.regexp_replace(flat_text(title), "[^a-z0-9]+", " ")).alias("title"),
        F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), day).otherwise(F.lit("")).alias("created"),
        F.coalesce(people, F.array().cast("array<string>")).alias("authors"),
    )


def same_document(candidate: Column, target: Column, candidate_path: Column) -> Column:
    """Whether two identities are one document: by equal numbers if both have one; else at once unless the candidate's path is a placeholder, which needs two of day, title and author to agree (author and title, or the day and either)."""
    both = (candidate["number"] != "") & (target["number"] != "")
    day = (target["created"] != "") & (candidate["created"] == target["created"])
    title = (target["title"] != "") & (candidate["title"] == target["title"])
    author = F.coalesce(F.arrays_overlap(candidate["authors"], target["authors"]), F.lit(False))
    votes = day.cast("int") + title.cast("int") + author.cast("int")
    return F.when(both, candidate["number"] == target["number"]).otherwise(~is_placeholder(candidate_path) | (votes >= 2))
