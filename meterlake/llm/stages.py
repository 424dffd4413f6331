"""The operators as steps of a corpus pipeline: each takes documents and returns documents, with the columns they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, mixing, pu_quality, sentencepiece_codec, suffix_dedup
from .common import quoted, table, whole_row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Labels of the held-out quarter are not learned from."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    scorer = pu_quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold != 2)
    scored = pu_quality.score(docs.select(whole_row(docs).alias("doc"), "text"), scorer)
    return scored.where(F.col("score") >= pu_quality.THRESHOLD).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return dartminhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that the corpus holds more than once; documents of which nothing but space is left go."""
    # texts travel once: the row without its text goes along
    out = suffix_dedup.remove_repeats(docs.select(F.struct(whole_row(docs, "text").alias("of"), F.col("text").isNull().alias("no text")).alias("doc"), "doc_id", "text"))
    out = out.where(~((F.col("n_removed") > 0) & F.col("kept_text").rlike(r"^\s*$")))
    new = {"text": F.when(~F.col("doc.`no text`"), F.col("kept_text"))} | ({} if "n_chars" not in docs.columns else {"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("doc.of.n_chars"))})
    return out.select(*[(new[c] if c in new else F.col(f"doc.of.{quoted(c)}")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the calibrated probabilities."""
    rows = mixing.described(docs.select(whole_row(docs).alias("doc"), "doc_id", "text", "source", "lang"), texts=False)
    return mixing.probabilities(rows, budget=mixing.BUDGET).where("drawn").select("doc.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the proof that they decode to its text."""
    return sentencepiece_codec.encode_documents(docs)
