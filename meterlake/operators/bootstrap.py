"""The first load of limits, members, gifts and policies from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import policy_text, timekeys


def plan_limits(subscription: DataFrame, plan: DataFrame) -> DataFrame:
    live = subscription.where("not is_deleted").join(plan.where("not is_deleted").select("plan_id", "plan_data_amount"), "plan_id")
    return live.select("sub_id", F.col("plan_data_amount").alias("plan_limit"))


def family_limits(family_sub: DataFrame, family: DataFrame) -> DataFrame:
    live = family.where("not is_deleted").select("family_id", "family_data_amount")
    return family_sub.join(live, "family_id").select("family_id", F.col("family_data_amount").alias("family_limit")).distinct()


def members(family_sub: DataFrame) -> DataFrame:
    """Missing limits count as 0."""
    return family_sub.select("family_id", "sub_id", F.coalesce("data_limit", F.lit(0)).cast("bigint").alias("member_limit"))


def priorities(family_sub: DataFrame) -> DataFrame:
    """Only families with priorities of 0 and above are in priority mode."""
    return family_sub.select("family_id", "sub_id", F.coalesce("priority", F.lit(0)).cast("bigint").alias("score")).where("score >= 0")


def gifts(present_data: DataFrame) -> DataFrame:
    """Gift buckets by receiver and month of creation, in order of creation."""
    made = present_data.select("present_data_id", "target_sub_id", "data_amount", "created_time")
    return made.select(
        F.col("target_sub_id").alias("sub_id"), F.col("present_data_id").cast("string").alias("gift_id"), timekeys.month_key(F.col("created_time")).alias("yyyymm"), F.col("data_amount").alias("gift_limit"),
        (timekeys.epoch_seconds(F.col("created_time")) - 9 * 3600).alias("score"),
    )


def given(present_data: DataFrame) -> DataFrame:
    """The givers' side, as movements to sum up; the creation time is Korean local time."""
    t = F.col("created_time")
    return present_data.select(F.col("provide_sub_id").alias("giver_sub_id"), F.col("data_amount").alias("amount"), timekeys.month_key(t).alias("yyyymm"), timekeys.day_key(t).alias("yyyymmdd"), timekeys.slot_key(t).alias("slot"))


def gift_app(app_blocked_service: DataFrame) -> DataFrame:
    """The smallest live app id: the first load books gifts under it."""
    return app_blocked_service.where("not is_deleted").orderBy("app_blocked_service_id").limit(1).select(F.col("app_blocked_service_id").alias("app_id"))


def locked(subscription: DataFrame) -> DataFrame:
    return subscription.where("not is_deleted and is_locked").select("sub_id")


def blocked_apps(blocked_service_sub: DataFrame, app_blocked_service: DataFrame) -> DataFrame:
    live = app_blocked_service.where("not is_deleted").select(F.col("app_blocked_service_id").alias("blocked_service_id"))
    return blocked_service_sub.where("is_active").join(live, "blocked_service_id").select("sub_id", F.col("blocked_service_id").alias("app_id"))


def _live_policies(policy_sub: DataFrame, block_policy: DataFrame) -> DataFrame:
    snapshot = F.coalesce("policy_snapshot", F.lit("{}"))
    live = block_policy.where("is_active and not is_deleted").withColumn("snapshot", snapshot).withColumn("kind", policy_text.policy_type(F.col("policy_type"), F.col("snapshot")))
    return policy_sub.where("is_active").select("sub_id", "block_policy_id").join(live, "block_policy_id")


def repeat_policies(policy_sub: DataFrame, block_policy: DataFrame) -> DataFrame:
    """(sub_id, policy_id, encoded) of scheduled policies."""
    rows = _live_policies(policy_sub, block_policy).where("kind = 'SCHEDULED'")
    s = F.col("snapshot")
    days = policy_text.days_csv(policy_text.snapshot_days(s))
    start = policy_text.snapshot_field(s, "$.start_hhmm", "$.data.startTime", "$.startTime")
    end = policy_text.snapshot_field(s, "$.end_hhmm", "$.data.endTime", "$.endTime")
    return rows.select("sub_id", F.col("block_policy_id").alias("policy_id"), policy_text.encode_repeat(days, start, end).alias("encoded"))


def once_policies(policy_sub: DataFrame, block_policy: DataFrame) -> DataFrame:
    """(sub_id, policy_id, expire_epoch) of one-time policies with an end that can be read."""
    rows = _live_policies(policy_sub, block_policy).where("kind = 'ONCE'")
    end = policy_text.once_end_epoch(policy_text.snapshot_field(F.col("snapshot"), "$.expire_epoch", "$.data.endTime", "$.endTime"))
    return rows.select("sub_id", F.col("block_policy_id").alias("policy_id"), end.alias("expire_epoch")).where("expire_epoch > 0")


def stored_policies(policy_sub: DataFrame, block_policy: DataFrame) -> DataFrame:
    """(sub_id, policy_id, type, encoded, expire_epoch): all policies of the first load, as `control.policies` takes them for its base."""
    repeats = repeat_policies(policy_sub, block_policy).select("sub_id", "policy_id", F.lit("SCHEDULED").alias("type"), "encoded", F.lit(None).cast("bigint").alias("expire_epoch"))
    ends = once_policies(policy_sub, block_policy).select("sub_id", "policy_id", F.lit("ONCE").alias("type"), F.lit(None).cast("string").alias("encoded"), "expire_epoch")
    return repeats.unionByName(ends)


def first_by_subscriber(rows: DataFrame, order: str) -> DataFrame:
    """Of several rows of a subscriber the first, by a partial aggregate."""
    rest = [c for c in rows.columns if c != "sub_id"]
    return rows.groupBy("sub_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("sub_id", "r.*")
