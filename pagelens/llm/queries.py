"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lang_id, mixing, near_dups, quality, secrets, sharding, spans, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the source is the owner, a source's texts of one language are a repository."""
    docs = _table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", "source", "lang"))
    return secrets.find_secrets(docs, owner_col="source", repo_col="repo")


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 8)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and of every document, by a trigram model of the documents' languages."""
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.fit_trigrams(docs)
    of_docs = lang_id.identify_documents(docs, model).select("doc_id", F.lit(None).cast("long").alias("page_id"), "lang", "confidence", "text_lang", "declared", "host")
    of_pages = lang_id.identify_pages(_table(spark, sf_dir, "pages"), model).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "lang", "confidence", "text_lang", "declared", "host")
    return of_docs.unionByName(of_pages)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op8_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_rows(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated runs of sentences that go, with the document that keeps the first copy."""
    return spans.repeated_spans(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_cube_mix, op3_jump_shards, op4_language_id, op5_order_minhash, op6_decontamination, op7_url_templates, op8_quality_mcd, op9_toxicity, op10_sentence_spans)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other queries are tested against brute force."""
    return {"op7_url_templates": url_filter.ORACLE_SQL}
