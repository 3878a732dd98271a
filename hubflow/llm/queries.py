"""Registered queries of the operators: each over its whole table, full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import (conversation, decontaminate, embed_dedup, exactdup, linededup, lm_score, ngram_join, packing,
                         pii, quality, ranked, secrets, sql, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: each doc_id is a path with one version."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_history(docs, secrets.new_ledger_path(spark), ["doc_id"])
    return secrets.secret_digest(found)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with the item contained."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"),
                                      _table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels outside the held-out third."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return ngram_join.link_components(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the corpus's trigram counts."""
    out = lm_score.stupid_backoff(_table(spark, sf_dir, "documents"))
    return out.withColumns({"log_score": F.round("log_score", 4) + F.lit(0.0),
                            "mean_log_score": F.round("mean_log_score", 6) + F.lit(0.0)})


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of every page without its host's boilerplate."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", linededup.url_host(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    return (linededup.drop_boilerplate(pages, "page_id", F.col("host"), F.col("text"))
            .select("page_id", "text", "n_lines", "n_dropped"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every embedding."""
    return embed_dedup.vector_components(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label quality of every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after planted damage."""
    return conversation.repair_digest(conversation.damage(_table(spark, sf_dir, "conversations")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document and the row that stays."""
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_decontamination, op3_packing, op4_toxicity, op5_ngram_join,
    op6_lm_score, op7_line_dedup, op8_pii, op9_embedding_dedup, op10_quality,
    op11_ranked_search, op12_conversation_repair, op13_exact_dedup)}
ORACLE_SQL = {
    "op1_secret_scan": sql.SECRETS,
    "op2_decontamination": sql.DECONTAMINATION,
    "op3_packing": sql.PACKING,
    "op5_ngram_join": sql.NGRAM_JOIN,
    "op6_lm_score": sql.LM_SCORE,
    "op7_line_dedup": sql.LINE_DEDUP,
    "op8_pii": sql.PII,
    "op9_embedding_dedup": sql.EMBEDDINGS,
    "op11_ranked_search": sql.RANKED_SEARCH,
    "op12_conversation_repair": sql.CONVERSATION,
    "op13_exact_dedup": sql.EXACT_DEDUP,
}
