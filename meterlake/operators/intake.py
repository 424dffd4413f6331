"""Validity, repeats and calendar keys of usage messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import timekeys


def with_keys(usage: DataFrame) -> DataFrame:
    """usage with kst, yyyymm, yyyymmdd and slot."""
    local = timekeys.kst(F.col("occurred_at"))
    return usage.withColumn("kst", local).withColumns({"yyyymm": timekeys.month_key(F.col("kst")), "yyyymmdd": timekeys.day_key(F.col("kst")), "slot": timekeys.slot_key(F.col("kst"))})


def with_status(raw: DataFrame) -> DataFrame:
    """raw with status: no_event_id, invalid_bytes for amounts that are null or not positive, dup for ids seen before among valid ones, else ok.

    Validity comes first: an invalid message doesn't use up its id. The earliest arrival of an id counts. Rows without an id are no repeats of
    each other, and no group either.
    """
    valid = F.coalesce(F.col("bytes"), F.lit(0)) > 0
    alone = F.when(F.col("event_id").isNull(), F.col("arrival_seq"))
    first = F.row_number().over(Window.partitionBy("event_id", valid, alone).orderBy("arrival_seq")) == 1
    return raw.withColumn("status", F.when(F.col("event_id").isNull(), F.lit("no_event_id")).when(~valid, F.lit("invalid_bytes")).when(~first, F.lit("dup")).otherwise(F.lit("ok")))


def accepted(raw: DataFrame) -> DataFrame:
    """Valid messages, each id once, by a partial aggregate: the earliest arrival as one struct."""
    valid = raw.where("bytes > 0 and event_id is not null and occurred_at is not null")
    rest = [c for c in raw.columns if c not in ("event_id", "arrival_seq")]
    lead = valid.groupBy("event_id").agg(F.min_by(F.struct("arrival_seq", *rest), "arrival_seq").alias("row"))
    return lead.select("event_id", "row.*")


def reason() -> Column:
    """Why no state may see a message, or null."""
    return F.when(F.col("event_id").isNull(), F.lit("NO_EVENT_ID")).when(F.col("occurred_at").isNull(), F.lit("NO_TIME")).when(F.coalesce(F.col("bytes"), F.lit(0)) <= 0, F.lit("INVALID_BYTES"))


def quarantined(raw: DataFrame) -> DataFrame:
    """Messages that no state may see, with the reason."""
    return raw.withColumn("reason", reason()).where("reason is not null")
