"""Totals over applied usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.quota import GIFT_APP


def _sum(column: str, name: str):
    return F.sum(column).cast("bigint").alias(name)


def by_subscriber(allocated: DataFrame, period: str) -> DataFrame:
    """Per subscriber and month or day: total, plan, family, gift and overflow."""
    sums = [_sum("bytes", "total_used"), _sum("plan_take", "plan_used"), _sum("family_take", "member_family_used"), _sum("gift_take", "gift_used"), _sum("overflow", "overflow_used")]
    return allocated.groupBy("sub_id", period).agg(*sums)


def by_family(allocated: DataFrame, period: str) -> DataFrame:
    """Families that took nothing have no row."""
    return allocated.where("family_take > 0").groupBy("family_id", period).agg(_sum("family_take", "family_used"))


def by_app(events: DataFrame, period: str) -> DataFrame:
    """Amounts by app, a missing app as a group of its own."""
    return events.groupBy("sub_id", "app_id", period).agg(_sum("bytes", "used"))


def by_slot(events: DataFrame) -> DataFrame:
    return events.groupBy("sub_id", "yyyymmdd", "slot").agg(_sum("bytes", "used"))


def by_slot_wide(events: DataFrame) -> DataFrame:
    slots = [f"{h:02d}_used" for h in range(0, 24, 3)]
    wide = events.groupBy("sub_id", "yyyymmdd").pivot("slot", slots).agg(F.sum("bytes").cast("bigint"))
    return wide.select("sub_id", "yyyymmdd", *[F.coalesce(F.col(f"`{s}`"), F.lit(0).cast("bigint")).alias(f"h{s}") for s in slots])


def by_gift(split: DataFrame) -> DataFrame:
    return split.groupBy("sub_id", "gift_id", "yyyymm").agg(_sum("take", "gift_used"))


def top_apps(events: DataFrame, period: str, k: int) -> DataFrame:
    """The k apps of each subscriber and period with the most usage; of equal amounts the smaller id first."""
    w = Window.partitionBy("sub_id", period).orderBy(F.desc("used"), F.asc_nulls_last("app_id"))
    return by_app(events, period).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rebuild(log: DataFrame) -> DataFrame:
    """Monthly totals from the applied log; overflow is what the parts leave."""
    over = F.col("usage_amount") - F.col("gift_used") - F.col("plan_used") - F.col("family_used")
    sums = [_sum("usage_amount", "total_used"), _sum("p", "plan_used"), _sum("f", "member_family_used"), _sum("g", "gift_used"), _sum("o", "overflow_used")]
    return log.select("sub_id", "yyyymm", "usage_amount", F.col("plan_used").alias("p"), F.col("family_used").alias("f"), F.col("gift_used").alias("g"), over.alias("o")).groupBy("sub_id", "yyyymm").agg(*sums)


def rebuild_family(log: DataFrame) -> DataFrame:
    return log.where("family_used > 0").groupBy("family_id", "yyyymm").agg(F.sum("family_used").cast("bigint").alias("family_total")).withColumnRenamed("family_total", "family_used")


def donor_movements(gifts_given: DataFrame, app_id: Column | None = None, slots: bool = False) -> DataFrame:
    """What giving costs the giver: plan usage of month and day, and app usage; with slots, that of the three-hour slot too.

    gifts_given: giver_sub_id, amount, yyyymm, yyyymmdd, slot. app_id: the app that giving is booked under, the gift app where null. Long form: (sub_id, kind, period, item, used).
    """
    app = F.coalesce(*([] if app_id is None else [app_id]), F.lit(GIFT_APP)).cast("string")
    row = lambda kind, period, item: F.struct(F.lit(kind).alias("kind"), F.col(period).alias("period"), item.alias("item"))
    none = F.lit(None).cast("string")
    rows = [row("plan_month", "yyyymm", none), row("plan_day", "yyyymmdd", none), row("app_month", "yyyymm", app), row("app_day", "yyyymmdd", app)]
    if slots:
        rows.append(row("slot", "yyyymmdd", F.col("slot")))
    long = gifts_given.select(F.col("giver_sub_id").alias("sub_id"), "amount", F.explode(F.array(*rows)).alias("m"))
    return long.groupBy("sub_id", "m.kind", "m.period", "m.item").agg(_sum("amount", "used")).select("sub_id", "kind", "period", "item", "used")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
