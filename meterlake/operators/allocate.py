"""The waterfall: each event's amount over gifts, the plan and the family pool, the rest as overflow, by clipped running sums.

With limits that hold for the month the sequential rule is closed-form: what an event takes from a cap is the growth of
least(running sum, cap). Gifts, plans and the caps of members belong to a subscriber, whatever families its events name: those windows lie
in one exchange by subscriber, with all limits of a subscriber in one row beside it. What is left goes on, in a second exchange, to the
pool of the family that the event names. Events without a family form a group for each subscriber, so they are no skewed group.

A cap of a member counts what was taken in that family; it starts anew in another one within the month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.quota import DAILY_PLAN_LIMIT, NO_ALERT, clip, remaining, threshold

ORDER = ("kst", "event_id")
OPENINGS = {"plan": {"sub_id": "sub_id", "period": "plan_period"}, "member": {"family_id": "family_id", "sub_id": "sub_id", "yyyymm": "yyyymm"}, "family": {"family_id": "family_id", "yyyymm": "yyyymm"}}


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def subscriber_limits(plans: DataFrame, members: DataFrame, gifts: DataFrame, gift_open: DataFrame | None = None) -> list[DataFrame]:
    """Tables by sub_id alone, so that events meet all of them where they lie: plan_limit; caps, the member limits by family; buckets, the
    gifts by month in order of use, each with the stretch (lo, hi) that it covers of the month's running sum. The last two are arrays, as
    long as a subscriber has families and gifts."""
    if gift_open is None:
        left = gifts.withColumn("gift_open", _zero())
    else:
        left = gifts.join(gift_open, ["sub_id", "gift_id", "yyyymm"], "left").withColumn("gift_open", F.coalesce("gift_open", _zero()))
    left = left.withColumn("left", F.greatest(_zero(), F.col("gift_limit") - F.col("gift_open")))
    w = Window.partitionBy("sub_id", "yyyymm").orderBy("score", "gift_id").rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("hi", F.sum("left").over(w).cast("bigint")).withColumn("lo", F.col("hi") - F.col("left"))
    bucket = F.struct("yyyymm", "lo", "hi", "score", "gift_id", "gift_limit", "gift_open")
    buckets = left.groupBy("sub_id").agg(F.sort_array(F.collect_list(bucket)).alias("buckets"))
    caps = members.groupBy("sub_id").agg(F.collect_list(F.struct("family_id", "member_limit")).alias("caps"))
    return [plans.select("sub_id", "plan_limit"), caps, buckets]


def _parts(buckets: Column, start: Column, end: Column) -> Column:
    """What each gift pays of the stretch from start to end, with its use before and after."""
    met = F.filter(buckets, lambda g: (g["lo"] < end) & (g["hi"] > start))

    def part(g: Column) -> Column:
        used = g["gift_open"] + F.least(end, g["hi"]) - g["lo"]
        take = F.least(end, g["hi"]) - F.greatest(start, g["lo"])
        now, before = threshold(g["gift_limit"], used), threshold(g["gift_limit"], used - take)
        fires = F.when((now != NO_ALERT) & (now < before), now).cast("int")
        return F.struct(g["gift_id"].alias("gift_id"), g["gift_limit"].alias("gift_limit"), take.cast("bigint").alias("take"), used.cast("bigint").alias("gift_used"), fires.alias("threshold"))

    return F.transform(met, part)


def allocate(events: DataFrame, plans: DataFrame, families: DataFrame, members: DataFrame, gifts: DataFrame, opening: dict[str, DataFrame] | None = None) -> DataFrame:
    """events (with calendar keys) with takes, overflow, the usage after them, the gifts that pay, and the alert levels they reach.

    plans (sub_id, plan_limit): below 0 is without limit, the daily plan counts by day. families (family_id, family_limit): below 0 acts as
    0. members (family_id, sub_id, member_limit): only above 0 it is a cap. gifts (sub_id, gift_id, yyyymm, gift_limit, score).
    opening: usage before the events, by name: plan (sub_id, period, plan_open), member (family_id, sub_id, yyyymm, member_open), family
    (family_id, yyyymm, family_open), gift (sub_id, gift_id, yyyymm, gift_open). Levels that it had reached are not alerted again.

    plan_alert and family_alert are the levels that an event is the first of its month to reach, else null; gift_parts has the same for each
    gift as threshold.
    """
    opening = opening or {}
    rows = events
    for limits in subscriber_limits(plans, members, gifts, opening.get("gift")):
        rows = rows.join(limits, "sub_id", "left")
    rows = rows.withColumn("plan_limit", F.coalesce("plan_limit", _zero()))
    rows = rows.withColumn("plan_period", F.when(F.col("plan_limit") == DAILY_PLAN_LIMIT, F.col("yyyymmdd")).otherwise(F.col("yyyymm")))
    of_family = F.get(F.filter("caps", lambda c: c["family_id"] == F.col("family_id")), F.lit(0))["member_limit"]
    rows = rows.withColumns({"member_limit": F.coalesce(of_family, _zero()), "buckets": F.filter("buckets", lambda g: g["yyyymm"] == F.col("yyyymm"))})
    rows = rows.withColumn("gift_cap", F.coalesce(F.array_max(F.transform("buckets", lambda g: g["hi"])), _zero()))
    for name in ("plan", "member"):
        rows = _opened(rows, name, opening)

    # a period is a prefix of the time, so ordering by it first changes nothing, and one sort serves windows by month and by period
    def own(column: str, *keys: str, until: int = 0, f=F.sum) -> Column:
        order = ORDER if keys else ("plan_period", *ORDER)
        return f(column).over(Window.partitionBy("sub_id", "yyyymm", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, until))

    rows = rows.withColumn("cum_bytes", own("bytes").cast("bigint"))
    rows = rows.withColumn("gift_take", clip(F.col("bytes"), F.col("cum_bytes"), F.col("gift_cap")))
    start = F.col("cum_bytes") - F.col("bytes")
    rows = rows.withColumn("gift_parts", F.when(F.col("gift_take") > 0, _parts(F.col("buckets"), start, start + F.col("gift_take"))))
    rows = rows.withColumn("rest", F.col("bytes") - F.col("gift_take"))
    rows = rows.withColumn("plan_take", clip(F.col("rest"), own("rest", "plan_period").cast("bigint"), remaining(F.col("plan_limit"), F.col("plan_open"))))
    rows = rows.withColumn("plan_used", F.col("plan_open") + own("plan_take", "plan_period").cast("bigint"))
    # a daily plan starts anew each day but alerts once a level and month
    reached = F.when(F.col("plan_take") > 0, threshold(F.col("plan_limit"), F.col("plan_used")))
    rows = rows.withColumn("level", reached.cast("int"))
    before = F.least(F.coalesce(own("level", until=-1, f=F.min), F.lit(NO_ALERT)), threshold(F.col("plan_limit"), F.col("plan_open")))
    rows = rows.withColumn("plan_alert", F.when((F.col("level") != NO_ALERT) & (F.col("level") < before), F.col("level")))
    rows = rows.withColumn("rest", F.col("rest") - F.col("plan_take"))
    member_cap = F.when(F.col("member_limit") > 0, F.greatest(_zero(), F.col("member_limit") - F.col("member_open")))
    rows = rows.withColumn("asked", clip(F.col("rest"), own("rest", "family_id").cast("bigint"), member_cap))

    rows = rows.withColumn("grp", F.when(F.col("family_id") > 0, F.col("family_id")).otherwise(-F.col("sub_id")))
    pools = families.where("family_id > 0").select(F.col("family_id").alias("grp"), "family_limit")
    rows = _opened(rows.join(pools, "grp", "left").withColumn("family_limit", F.coalesce("family_limit", _zero())), "family", opening)
    shared = Window.partitionBy("grp", "yyyymm").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    pool = F.greatest(_zero(), F.col("family_limit") - F.col("family_open"))
    rows = rows.withColumn("family_take", clip(F.col("asked"), F.sum("asked").over(shared).cast("bigint"), pool))
    rows = rows.withColumn("overflow", F.col("rest") - F.col("family_take"))
    rows = rows.withColumn("family_used", F.col("family_open") + F.sum("family_take").over(shared).cast("bigint"))
    now, was = (threshold(F.col("family_limit"), u).cast("int") for u in (F.col("family_used"), F.col("family_used") - F.col("family_take")))
    rows = rows.withColumn("family_alert", F.when((F.col("family_take") > 0) & (now != NO_ALERT) & (now < was), now))
    return rows.drop("rest", "asked", "grp", "level", "plan_open", "member_open", "family_open", "gift_cap", "caps", "buckets")


def _opened(rows: DataFrame, name: str, opening: dict[str, DataFrame]) -> DataFrame:
    """rows with the usage before them, 0 where none is given."""
    column = f"{name}_open"
    if name in opening:
        keys = OPENINGS[name]
        rows = rows.join(opening[name].withColumnsRenamed(keys), list(keys.values()), "left")
        return rows.withColumn(column, F.coalesce(column, _zero()))
    return rows.withColumn(column, _zero())


def split_gifts(allocated: DataFrame) -> DataFrame:
    """Which gift pays what: (event_id, sub_id, yyyymm, kst, gift_id, gift_limit, take, gift_used, threshold)."""
    return allocated.where("gift_take > 0").select("event_id", "sub_id", "yyyymm", "kst", F.inline("gift_parts"))
