"""Vocabulary, reference, header and section queries."""

from pyspark.sql import functions as F

from textloom.operators import references as r
from textloom.operators import text as x
from textloom.plans.bindings import Tables

#: A stop list for the driver's texts.
_STOP = ["the", "of", "and", "is", "de", "le", "la", "und", "der", "que", "en"]

_WORDS = r"""words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS word FROM documents),
  counts AS (SELECT id, word, count(*) AS n FROM words GROUP BY ALL HAVING count(*) >= 2)"""


def _docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text", "source")


def _stop(t: Tables):
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, _STOP))).alias("word"))


def _noted(t: Tables):
    """Order priorities and keys as texts with references."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("see BIP-"), F.col("o_orderkey") % 40, F.lit(" and bips "), F.col("o_custkey") % 7, F.lit(", 09 and "), F.col("o_orderkey") % 5, F.lit("; SLIP 3")).alias("text"),
    )


#: A document with a header made from its columns before its text, the same expression in Spark and DuckDB.
_HEADED = """'<pre>\n  BIP: ' || doc_id || '\n  Title: One ' || coalesce(source, '') || '\n  Author: A <a@x>\n    B <b@x>\n  Status: ' || coalesce(lang, '') || '\n  Status: Final\n</pre>\n' || coalesce(text, '') || '\n==Abstract==\ntext\n=== Sub  part ===\n==Abstract==\nmore'"""


def _headed(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.expr(_HEADED.replace("\n", "\\n")).alias("text"))


QUERIES = {
    "agg01_word_counts": (
        lambda t: x.word_counts(_docs(t), _stop(t)),
        f"WITH {_WORDS} SELECT id, word, n FROM counts WHERE word NOT IN ({', '.join(repr(w) for w in _STOP)})",
    ),
    "agg02_corpus_words": (
        lambda t: x.corpus_words(x.word_counts(_docs(t))),
        f"WITH {_WORDS} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY word ORDER BY n DESC, word LIMIT 200",
    ),
    "agg02_vocabulary_sizes": (
        lambda t: x.vocabulary_sizes(x.word_counts(_docs(t))),
        f"WITH {_WORDS} SELECT id, count(*) AS unique_terms, CAST(sum(n) AS BIGINT) AS total_terms FROM counts GROUP BY id",
    ),
    "agg03_word_cloud": (
        lambda t: x.corpus_words(x.word_counts(_docs(t), _stop(t)), 100),
        f"""WITH {_WORDS} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE word NOT IN ({', '.join(repr(w) for w in _STOP)}) GROUP BY word ORDER BY n DESC, word LIMIT 100""",
    ),
    "agg24_reference_counts": (
        lambda t: x.without_self(r.find_references(_noted(t), [r.Source("bips", "BIP")]).drop("slug")),
        """WITH hits AS (SELECT o_orderkey AS id, unnest([o_orderkey % 40, o_custkey % 7, 9, o_orderkey % 5]) AS target FROM orders)
          SELECT id, CAST(target AS VARCHAR) AS target, count(*) AS n FROM hits WHERE id <> target GROUP BY ALL""",
    ),
    "prj01_header_blocks": (
        lambda t: _headed(t).select("id", F.length(x.header_block(F.col("text"))).alias("length")),
        f"WITH d AS (SELECT doc_id AS id, {_HEADED} AS text FROM documents) SELECT id, CAST(strpos(text, '</pre>') - 6 AS INT) AS length FROM d",
    ),
    "prj02_header_fields": (
        lambda t: x.header_fields(_headed(t).select("id", x.header_block(F.col("text")).alias("block"))),
        """WITH o AS (SELECT * FROM documents) SELECT doc_id AS id, 'bip' AS key, CAST(doc_id AS VARCHAR) AS value FROM o
          UNION ALL SELECT doc_id, 'title', trim('One ' || coalesce(source, '')) FROM o UNION ALL SELECT doc_id, 'author', 'A <a@x>' || chr(10) || 'B <b@x>' FROM o UNION ALL SELECT doc_id, 'status', 'Final' FROM o""",
    ),
    "prj03_list_fields": (
        lambda t: x.header_fields(_headed(t).select("id", x.header_block(F.col("text")).alias("block"))).filter("key = 'author'").select("id", F.posexplode(x.list_field(F.col("value"))).alias("pos", "author")),
        "SELECT doc_id AS id, CAST(unnest([0, 1]) AS INT) AS pos, unnest(['A <a@x>', 'B <b@x>']) AS author FROM documents",
    ),
    "prj05_prefixed_ids": (
        lambda t: t.part.select("p_partkey", x.prefixed_number(F.concat(F.lit("PART-000"), "p_partkey"), "part").alias("number"), x.prefixed_number(F.col("p_brand"), "part").alias("same")),
        "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS number, p_brand AS same FROM part",
    ),
    "prj10_reference_ids": (
        lambda t: t.orders.select("o_orderkey", x.reference_id(F.concat(F.lit("00"), "o_orderkey"), 9000).alias("decimal"), x.reference_id(F.lower(F.hex("o_orderkey")), 4000, True).alias("hex")),
        "SELECT o_orderkey, CASE WHEN o_orderkey <= 9000 THEN CAST(o_orderkey AS VARCHAR) END AS decimal, CASE WHEN o_orderkey <= 4000 THEN lpad(printf('%X', o_orderkey), CAST(greatest(2, length(printf('%X', o_orderkey))) AS INT), '0') END AS hex FROM orders",
    ),
    "prj12_git_days": (
        lambda t: t.orders.select(
            "o_orderkey",
            x.git_day(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+02:00"))).alias("iso"),
            x.git_day(F.concat(F.lit("Mon "), F.date_format("o_orderdate", "MMM d"), F.lit(" 23:00:01 "), F.year("o_orderdate"), F.lit(" -0700"))).alias("verbose"),
        ),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS verbose FROM orders",
    ),
    "prj16_body_text": (
        lambda t: _headed(t).select("id", x.body_text(F.col("text")).alias("body")),
        f"WITH d AS (SELECT doc_id AS id, {_HEADED} AS text FROM documents) SELECT id, regexp_replace(regexp_replace(substr(text, strpos(text, '</pre>') + 6), '\\r\\n?', chr(10), 'g'), '^\\s+', '') AS body FROM d",
    ),
    "prj17_sections": (
        lambda t: x.sections(_headed(t)),
        "WITH o AS (SELECT doc_id AS id FROM documents) SELECT id, 'abstract' AS name, CAST(2 AS INT) AS level FROM o UNION ALL SELECT id, 'sub part', 3 FROM o",
    ),
    "prj17_html_headings": (
        lambda t: x.html_headings(t.pages.select(F.col("page_id").alias("id"), "html")),
        "WITH h AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '(?i)<h([1-6])[ >]', 1)) AS level FROM pages) SELECT id, CAST(level AS INT) AS level, count(*) AS n FROM h GROUP BY ALL",
    ),
    "prj26_short_titles": (
        lambda t: t.customer.select("c_custkey", x.short_title(F.col("c_name")).alias("a"), x.short_title(F.col("c_mktsegment")).alias("b")),
        "SELECT c_custkey, left(c_name, 9) AS a, left(c_mktsegment, 7) AS b FROM customer",
    ),
    "jon17_evidence": (
        lambda t: t.conversations.select("conv_id", "turn", x.evidence_found(F.lit("THE  of"), F.col("text")).alias("found")),
        r"SELECT conv_id, turn, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'the of') AS found FROM conversations",
    ),
}
