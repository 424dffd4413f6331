"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, decontaminate, html_text, imatch, importance, langid, mixing, pu_quality, quality_rules, ranked_search, sentencepiece_codec, sharding, sql, suffix_dedup
from .common import table


def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dartminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("key").alias("doc_id"), "class_id", F.col("keep").alias("kept"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2
    scorer = pu_quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = pu_quality.score(docs.withColumn("held_out", held_out), scorer)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5) == 0
    langs, prob = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), langs, prob)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, sharding.shard_names()).select("doc_id", "slot", "shard")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", imatch.as_text(F.col("print")).alias("fingerprint"), imatch.as_text(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.described(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), texts=False)
    out = mixing.probabilities(docs, budget=mixing.BUDGET)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "drawn")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resampled(docs, table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.marks(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", *decontaminate.MADE)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
