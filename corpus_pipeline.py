"""The corpus pipeline: toxic documents go, recurring lines go, one document of each
near-duplicate group stays, and what is left is packed into sequences.

Each stage works on all rows and whole texts that the one before kept.  Cases: an empty
table gives an empty result, and without labels nothing is toxic; a null text counts as
empty for toxicity, near copies (null and empty texts are copies of each other) and packing
(one piece of the end id), and stays null until then; rows of one doc_id are one document
for lines, and one of them stays where near copies go; rows without an id stay; texts of
any length are whole; columns besides those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.llm import line_templates, near_copies, packing, simhash, toxicity
from textloom.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; the chain learns from ``labels``."""
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs.select(*COLUMNS), chain).filter(~F.col("is_toxic")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences whose templates an earlier document has; n_chars follows where a text changes."""
    cleaned = line_templates.drop_recurring_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when((F.col("n_dropped") > 0) | (F.col("n_cut") > 0), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: candidates by SimHash fingerprints and MinHash bands of five-word shingles, exact similarity of 0.8 or more."""
    return simhash.first_of_each_group(docs.select(*COLUMNS), near_copies.group_documents)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash", drop_near_copies), ("packing", pack)]

#: The classifier and the tokenizer have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
