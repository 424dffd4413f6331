"""One-shot threshold alerts, the applied log and the notification outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.quota import remaining_percent, used_percent


def plan_alerts(allocated: DataFrame) -> DataFrame:
    """The events that bring a plan to a lower level for the first time in a month, with threshold and remaining_pct."""
    return _fired(allocated.where("plan_alert is not null"), "plan_alert", "plan_limit", "plan_used")


def family_alerts(allocated: DataFrame) -> DataFrame:
    return _fired(allocated.where("family_alert is not null"), "family_alert", "family_limit", "family_used")


def gift_alerts(split: DataFrame) -> DataFrame:
    return _fired(split.where("threshold is not null"), "threshold", "gift_limit", "gift_used")


def _fired(rows: DataFrame, level: str, quota: str, used: str) -> DataFrame:
    return rows.withColumns({"threshold": F.col(level), "remaining_pct": remaining_percent(F.col(quota), F.col(used))})


def _metrics(provided: Column, used: Column) -> tuple[Column, Column]:
    """Provided and used amounts as text: not below 0, used not above what was provided."""
    zero = F.lit(0).cast("bigint")
    p, u = F.greatest(zero, provided), F.greatest(zero, used)
    return p.cast("string"), F.when(p > 0, F.least(u, p)).otherwise(u).cast("string")


def outbox(allocated: DataFrame) -> DataFrame:
    """Alerts of the three kinds, in one pass over the applied events; ids are digests of what they say, so a replay writes the same rows."""
    none = F.lit(None)

    def alert(kind: str, sub: Column, family: Column, gift: Column, owner: Column, level: Column, quota: Column, used: Column) -> Column:
        provided, spent = _metrics(quota, used)
        return F.struct(
            F.lit(kind).alias("alert_type"), owner.alias("aggregateid"), sub.cast("bigint").alias("sub_id"), family.cast("bigint").alias("family_id"), level.cast("string").alias("threshold"),
            gift.cast("string").alias("gift_id"), provided.alias("provided_amount"), used_percent(remaining_percent(quota, used)).cast("string").alias("used_percent"), spent.alias("used_amount"),
        )

    sub, family = F.col("sub_id"), F.col("family_id")
    plan = F.when(F.col("plan_alert").isNotNull(), alert("PLAN_REMAINING", sub, none, none, F.concat(F.lit("sub:"), sub.cast("string")), F.col("plan_alert"), F.col("plan_limit"), F.col("plan_used")))
    pool = F.when(F.col("family_alert").isNotNull(), alert("FAMILY_POOL_REMAINING", none, family, none, F.concat(F.lit("family:"), family.cast("string")), F.col("family_alert"), F.col("family_limit"), F.col("family_used")))
    paid = F.filter(F.coalesce("gift_parts", F.array()), lambda g: g["threshold"].isNotNull())
    gifts = F.transform(paid, lambda g: alert("GIFT_REMAINING", F.col("sub_id"), none, g["gift_id"], F.concat(F.lit("gift:"), g["gift_id"]), g["threshold"], g["gift_limit"], g["gift_used"]))
    some = allocated.where("plan_alert is not null or family_alert is not null or exists(gift_parts, g -> g.threshold is not null)")
    each = some.select("event_id", "kst", F.explode(F.array_compact(F.concat(F.array(plan, pool), gifts))).alias("a"))
    alert_id = F.sha2(F.concat_ws("|", "a.alert_type", "event_id", "a.aggregateid", "a.threshold"), 256)
    return each.select(
        alert_id.alias("alert_id"), F.lit("user-alert").alias("aggregatetype"), "a.aggregateid", F.lit("USAGE_THRESHOLD").alias("event_type"), "a.alert_type", "event_id", "a.sub_id", "a.family_id",
        "a.threshold", "a.gift_id", "a.provided_amount", "a.used_percent", "a.used_amount", F.col("kst").alias("created_time"),
    )


def with_payload(rows: DataFrame) -> DataFrame:
    """Outbox rows with `payload`, the message as JSON text."""
    names = {
        "alert_id": "alertId", "event_type": "eventType", "alert_type": "alertType", "sub_id": "subId", "family_id": "familyId", "threshold": "threshold", "gift_id": "giftId",
        "provided_amount": "providedAmount", "used_percent": "usedPercent", "used_amount": "usedAmount", "created_time": "createdTime",
    }
    return rows.withColumn("payload", F.to_json(F.struct(*[F.col(a).alias(b) for a, b in names.items()])))


def payload(rows: DataFrame) -> DataFrame:
    """The part of outbox rows that a publisher sends."""
    return with_payload(rows).select("alert_id", "aggregatetype", "aggregateid", F.col("event_type").alias("type"), "payload")


def applied_log(allocated: DataFrame) -> DataFrame:
    """One row for each applied event; gift details as JSON text in order of use, [] without gifts."""
    detail = F.to_json(F.transform("gift_parts", lambda g: F.struct(g["gift_id"].alias("giftId"), g["take"].alias("usedAmount"))))
    return allocated.select(
        "event_id", "sub_id", "family_id", "app_id", F.col("kst").alias("occurred_at"), "yyyymm", "yyyymmdd", F.col("bytes").alias("usage_amount"), F.col("gift_take").alias("gift_used"),
        F.col("plan_take").alias("plan_used"), F.col("family_take").alias("family_used"), F.coalesce(detail, F.lit("[]")).alias("gift_detail_json"),
    )
