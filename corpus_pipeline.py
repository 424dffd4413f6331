"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import stages
from meterlake.llm.common import table, written

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("repeats", stages.repeats),
    ("mixing", stages.mix),
    ("pieces", stages.pieces),
]

#: The trained classifier, sketches and tokenisation are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
