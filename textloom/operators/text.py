"""Words, references, headers and sections of document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unicode word characters, as Python's.
WORD = r"(?U)\b\w+\b"


def word_counts(docs: DataFrame, stop_words: DataFrame | None = None, least: int = 2) -> DataFrame:
    """id, word and n of each document's words that occur at least so often."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("word"))
    counts = words.groupBy("id", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts if stop_words is None else counts.join(stop_words, "word", "left_anti")


def corpus_words(counts: DataFrame, n: int = 200) -> DataFrame:
    """The corpus's most frequent words, ties by word."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def vocabulary_sizes(counts: DataFrame) -> DataFrame:
    """Distinct and all counted words of each document."""
    return counts.groupBy("id").agg(F.count("*").alias("unique_terms"), F.sum("n").alias("total_terms"))


def reference_id(value: Column, most: int, hexadecimal: bool = False) -> Column:
    """The canonical id: decimal without leading zeros, or upper-case hex of two digits at least; null if no id or over ``most``."""
    text = F.trim(value)
    if hexadecimal:
        number = F.when(text.rlike(r"^[0-9A-Fa-f]{1,6}$"), F.conv(text, 16, 10).cast("long"))
        shown = F.upper(F.when(F.length(text) == 1, F.concat(F.lit("0"), text)).otherwise(text))
    else:
        number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
        shown = number.cast("string")
    return F.when(number <= most, shown)


def prefixed_number(value: Column, prefix: str) -> Column:
    """The number of an id like PREFIX-007, else the value itself."""
    digits = F.regexp_extract(value, rf"(?i)^(?:{prefix}[-\s]*)?0*(\d+)$", 1)
    return F.when(digits != "", digits).otherwise(value)


def without_self(references_: DataFrame) -> DataFrame:
    """References of documents to others."""
    return references_.filter(F.col("id").cast("string") != F.col("target"))


def header_block(text: Column) -> Column:
    """The first <pre> block or fenced block, whichever comes first, else null."""
    pre, fence = r"(?is)<pre>(.*?)</pre>", r"(?s)```[^\n]*\n(.*?)```"
    at_pre, at_fence = F.regexp_instr(text, F.lit(pre)), F.regexp_instr(text, F.lit(fence))
    first_pre = (at_pre > 0) & ((at_fence == 0) | (at_pre < at_fence))
    return F.when(first_pre, F.regexp_extract(text, pre, 1)).when(at_fence > 0, F.regexp_extract(text, fence, 1))


def header_fields(docs: DataFrame, block: str = "block") -> DataFrame:
    """id, key and value of header lines; indented lines continue a value, a later key replaces an earlier one.

    A key is words joined by hyphens before the first colon, indented by two characters at most.
    """
    lines = docs.select("id", F.posexplode(F.split(block, "\n")).alias("pos", "line"))
    before = F.substring_index("line", ":", 1)
    name = F.ltrim(before)
    worded = F.contains("line", F.lit(":")) & F.forall(F.split(name, "-"), lambda w: w.rlike(r"^\w+$"))
    indented = F.startswith("line", F.lit("    ")) | F.startswith("line", F.lit("\t"))
    split = lines.select("id", "pos", "line", name.alias("name"), (worded & ~indented & (F.length(before) - F.length(name) <= 2)).alias("is_key"), indented.alias("indented"))
    order = Window.partitionBy("id").orderBy("pos")
    grouped = split.withColumn("field", F.count_if("is_key").over(order)).filter((F.col("field") > 0) & (F.col("is_key") | (F.col("indented") & (F.regexp_replace("line", r"\s", "") != ""))))
    value = F.substring("line", F.instr("line", ":") + 1, F.length("line"))
    part = F.when(F.col("is_key"), value).otherwise(F.col("line"))
    fields = grouped.groupBy("id", "field").agg(
        F.lower(F.regexp_replace(F.max(F.when(F.col("is_key"), F.col("name"))), "-", "_")).alias("key"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim(F.regexp_replace(part, "\t", " ")).alias("part")))), lambda x: x["part"]), "\n").alias("value"),
    )
    return fields.groupBy("id", "key").agg(F.max_by("value", "field").alias("value"))


def list_field(value: Column) -> Column:
    """Lines of a value, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(value, "\n"), lambda v: F.trim(v)), lambda v: v != "")


def heading_level(line: Column) -> Column:
    """The level of a heading, a line of text between two marks at least on either side: the smaller number of marks, six at most; 0 for other lines."""
    text = F.rtrim(F.regexp_replace(line, r"\s+$", ""))
    marks = [F.length(F.regexp_extract(text, end, 0)) for end in ("^=*", "=*$")]
    level = F.least(*marks, F.lit(6))
    # most lines are none: they are told apart by their first marks
    return F.when(F.startswith(line, F.lit("==")), F.when((level >= 2) & (heading_name(text) != ""), level).otherwise(0)).otherwise(0)


def heading_name(line: Column) -> Column:
    """The text between the marks of a heading: lower case, white space made one space."""
    bare = F.btrim(F.btrim(F.regexp_replace(line, r"\s+", " ")), F.lit("="))
    return F.lower(F.trim(bare))


def sections(docs: DataFrame) -> DataFrame:
    """id, name and level of each section, by headings with marks on both sides; the first of a name stays."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.select("id", "pos", heading_name(F.col("line")).alias("name"), heading_level(F.col("line")).alias("level")).filter("level > 0")
    return found.groupBy("id", "name").agg(F.min_by("level", "pos").alias("level"))


def html_headings(pages: DataFrame) -> DataFrame:
    """id and count of headings of each level of HTML."""
    return pages.select("id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<h([1-6])[ >]"), 1)).alias("level")).groupBy("id", F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


def body_text(text: Column) -> Column:
    """The text without its leading <pre> or fenced block, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?is)^\s*(?:<pre>.*?</pre>|```.*?```)", "")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def git_day(text: Column) -> Column:
    """The day of an ISO or a verbose git date, as written."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    verbose = F.regexp_replace(F.regexp_extract(text, r"^\w{3} (\w{3} +\d{1,2} [\d:]+ \d{4})", 1), r"^(\w{3}) +(\d{1,2}) \S+ (\d{4})$", "$1 $2 $3")
    return F.coalesce(F.nullif(iso, F.lit("")), F.date_format(F.try_to_date(F.nullif(verbose, F.lit("")), "MMM d yyyy"), "yyyy-MM-dd"))


def short_title(title: Column, most: int = 9, upper_most: int = 7, share: float = 0.6) -> Column:
    """The title cut to 9 characters, to 7 where more than 60 % of them are upper case."""
    head = F.substring(title, 1, most)
    capitals = F.length(F.regexp_replace(head, r"(?U)[^\p{Lu}]", ""))
    return F.when(capitals > share * F.length(head), F.substring(title, 1, upper_most)).otherwise(head)


def evidence_found(evidence: Column, text: Column) -> Column:
    """Whether a quote stands in the text, white space and case aside."""

    def flat(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    return F.contains(flat(text), flat(evidence))
