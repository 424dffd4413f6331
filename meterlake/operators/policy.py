"""Block policies: flags for each usage event at a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import policy_text, timekeys


def now_parts(as_of: str) -> dict[str, Column]:
    return timekeys.time_parts(F.lit(as_of).cast("timestamp_ntz"))


def immediate(events: DataFrame, locked: DataFrame) -> DataFrame:
    """Events of subscribers that are locked."""
    return events.join(locked.select("sub_id").distinct(), "sub_id", "left_semi")


def timed(events: DataFrame, block_time: DataFrame, as_of: str) -> DataFrame:
    """Events of subscribers with a block whose end is after as_of."""
    return events.join(block_time.where(F.col("expire_epoch") > now_parts(as_of)["epoch"]).select("sub_id").distinct(), "sub_id", "left_semi")


def by_app(events: DataFrame, block_app: DataFrame) -> DataFrame:
    return events.join(block_app.select("sub_id", "app_id").distinct(), ["sub_id", "app_id"], "left_semi")


def active_repeats(block_repeat: DataFrame, as_of: str) -> DataFrame:
    """Subscribers with a repeated block that holds at as_of; both ends belong to it, and a start after the end spans midnight."""
    now = now_parts(as_of)
    rule = policy_text.decode_repeat(F.col("encoded"))
    rows = block_repeat.withColumn("rule", rule).where("rule is not null")
    start, end, hhmm = F.col("rule.start"), F.col("rule.end"), now["hhmm"]
    inside = F.when(start <= end, (hhmm >= start) & (hhmm <= end)).otherwise((hhmm >= start) | (hhmm <= end))
    return rows.where(F.array_contains(F.split("rule.days", ","), now["iso_day"].cast("string")) & inside).select("sub_id").distinct()


def repeated(events: DataFrame, block_repeat: DataFrame, as_of: str) -> DataFrame:
    return events.join(active_repeats(block_repeat, as_of), "sub_id", "left_semi")


def passing(events: DataFrame, locked: DataFrame, block_time: DataFrame, block_app: DataFrame, block_repeat: DataFrame, as_of: str) -> DataFrame:
    """Events that no policy blocks."""
    ended = block_time.where(F.col("expire_epoch") > now_parts(as_of)["epoch"])
    # the blocks of a subscriber as a whole are one anti join
    whole = locked.select("sub_id").unionByName(ended.select("sub_id")).unionByName(active_repeats(block_repeat, as_of)).distinct()
    return events.join(whole, "sub_id", "left_anti").join(block_app.select("sub_id", "app_id").distinct(), ["sub_id", "app_id"], "left_anti")


def pruned(block_time: DataFrame, as_of: str) -> DataFrame:
    """Blocks that still run."""
    return block_time.where(F.col("expire_epoch") > now_parts(as_of)["epoch"])
