"""Thin queries of the numbered operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, divergence, embeddings, filter_audit, fingerprints, licenses, line_templates, ngrams, packing, pages, simhash, stable_search, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of each text and of its edit with the next one, and their likeness."""
    return fingerprints.fingerprint_with_next(_table(spark, sf_dir, "documents"))


def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text, learnt from the ids outside the held-out seventh."""
    return ngrams.score_documents(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and of the text decoded from them."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the smallest id reachable over links of two bits at most."""
    groups = simhash.group_documents(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return pages.extract_pages(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, and the labels of all phrases and notices."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories and its verdict, without the texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, chain).drop("text")


def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links and components of all vectors at a cosine of 0.9."""
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without recurring lines and sentences, with counts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of all 120 orders, by source."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that set each apart."""
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each vector whose id is divisible by 100."""
    return stable_search.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_fingerprints,
        op2_ngram_scores,
        op3_best_fit_packing,
        op4_bpe,
        op5_simhash,
        op6_page_text,
        op7_license_scan,
        op8_toxicity,
        op9_embedding_groups,
        op10_line_templates,
        op11_filter_audit,
        op12_source_divergence,
        op13_nearest_vectors,
    )
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_license_scan": licenses.ORACLE_SQL,
        "op9_embedding_groups": embeddings.ORACLE_SQL,
        "op10_line_templates": line_templates.ORACLE_SQL.format(docs="documents"),
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_nearest_vectors": stable_search.ORACLE_SQL,
    }
