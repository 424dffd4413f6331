"""Generated usage: a fixed pattern, random events, and a plausible history by plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterlake.functions.draws import between, jittered, split, splits, uniform, uniforms
from meterlake.functions.quota import GIFT_APP

# fixed values: shares of apps by rank and of the day's slots, and bounds of daily use
APP_WEIGHTS = (24.0, 16.0, 8.0, 8.0, 8.0)
APP_REST = 3.0
SLOT_WEIGHTS = (7.0, 3.0, 6.0, 14.0, 16.0, 17.0, 23.0, 14.0)
UNLIMITED_PLAN, DAILY_PLAN = 1, 5
APPS = 19
#: Parts of days that are worked out at once.
CELLS = 1 << 17


def fixed(spark: SparkSession, family_index: DataFrame, subs: tuple[int, ...] = (1, 2, 3), amount: int = 1000) -> DataFrame:
    """One event of a fixed amount for each subscriber that has a family in the index (sub_id, family_id)."""
    rows = spark.createDataFrame([(s, amount) for s in subs], "sub_id bigint, bytes bigint")
    return rows.join(family_index.where("family_id > 0").select("sub_id", "family_id"), "sub_id").select("sub_id", "family_id", "bytes")


def random_app(u: Column) -> Column:
    """Any app but the one that gifts are booked under."""
    return (F.floor(u * APPS) + 1).cast("bigint")


def random(subscribers: DataFrame, per_subscriber: int, seed: str, low: int = 50, high: int = 500) -> DataFrame:
    """Events of random amounts and apps for subscribers (sub_id, family_id)."""
    rows = subscribers.select("sub_id", "family_id", F.explode(F.sequence(F.lit(1), F.lit(per_subscriber))).alias("n"))
    key = (seed, F.col("sub_id"), F.col("n"))
    return rows.select("sub_id", "family_id", "n", between(uniform("bytes", *key), F.lit(low), F.lit(high)).alias("bytes"), random_app(uniform("app", *key)).alias("app_id"))


def stream(spark: SparkSession, per_second: int, subscribers: int) -> DataFrame:
    """An endless stream of random events."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    sub = F.pmod(F.xxhash64("value"), F.lit(subscribers)) + 1
    return rows.select(F.concat(F.lit("gen-"), F.col("value").cast("string")).alias("event_id"), sub.alias("sub_id"), (F.floor((sub - 1) / 5) + 1).cast("bigint").alias("family_id"), between(uniform("bytes", F.col("value")), F.lit(50), F.lit(500)).alias("bytes"), random_app(uniform("app", F.col("value"))).alias("app_id"), F.col("timestamp").cast("timestamp_ntz").alias("occurred_at"))


def checked_plans(plans: DataFrame) -> DataFrame:
    """plans (sub_id, plan_id, plan_limit), or an error: the unlimited plan must be -1 and every other one above 0."""
    good = F.when(F.col("plan_id") == UNLIMITED_PLAN, F.col("plan_limit") == -1).otherwise(F.col("plan_limit") > 0)
    return plans.withColumn("plan_limit", F.when(good, F.col("plan_limit")).otherwise(F.raise_error(F.concat(F.lit("invalid plan limit of subscriber "), F.col("sub_id").cast("string")))))


def dealt(plans: DataFrame) -> DataFrame:
    """plans over as many tasks as a shuffle has. They are few bytes, which adaptive execution would leave to one or two tasks, but each
    becomes thousands of rows. In turn, not by key: a shuffle by a key that a join has used before is left out of the plan."""
    return plans.repartition(int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def history_days(plans: DataFrame, as_of: str, months: int = 5) -> DataFrame:
    """(sub_id, day, yyyymm, used) of each day from the first of the month `months` ago to the day before as_of."""
    start, end = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -months), F.date_sub(F.lit(as_of).cast("date"), 1)
    plans, flat = checked_plans(dealt(plans)), F.col("plan_id").isin(UNLIMITED_PLAN, DAILY_PLAN)
    limit, sub, month = F.col("plan_limit"), F.col("sub_id"), F.col("yyyymm")
    days = plans.where(flat).withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day")))).withColumn("yyyymm", F.date_format("day", "yyyyMM"))
    u_base, u_day = uniform("base", sub, month), uniform("day", sub, F.col("day"))
    free = F.greatest(F.lit(50_000), jittered(between(u_base, F.lit(400_000), F.lit(2_000_000)), 0.2, u_day))
    share = lambda x: F.greatest(F.lit(1), F.round(limit * F.lit(x)).cast("bigint"))
    daily = F.greatest(share(0.5), F.least(limit, jittered(between(u_base, share(0.65), share(0.85)), 0.1, u_day)))
    by_day = days.select("sub_id", "day", "yyyymm", F.when(F.col("plan_id") == UNLIMITED_PLAN, free).otherwise(daily).cast("bigint").alias("used"))
    first, last = F.col("first"), F.last_day("first")
    groups = plans.where(~flat).withColumn("first", F.explode(F.sequence(start, end, F.expr("interval 1 month")))).withColumn("yyyymm", F.date_format(first, "yyyyMM"))
    groups = groups.withColumn("days", F.sequence(first, F.least(last, end), F.expr("interval 1 day")))
    prorated = F.greatest(F.lit(1), F.round(limit.cast("double") * F.size("days") / F.dayofmonth(last)).cast("bigint"))
    target = between(uniform("base", sub, month), F.greatest(F.lit(1), F.round(prorated * 0.5).cast("bigint")), prorated)
    weights = F.transform("days", lambda d: F.lit(0.9) + uniform("day", sub, d) * F.lit(0.2))
    spread = groups.select("sub_id", "yyyymm", F.explode(F.arrays_zip(F.col("days").alias("day"), split(target, weights, 0).alias("used"))).alias("x"))
    return by_day.unionByName(spread.select("sub_id", "x.day", "yyyymm", "x.used"))


def parted(days: DataFrame, item: str, kind: str, weigh: Callable) -> DataFrame:
    """(sub_id, day, item, used): a day's usage in parts of at least 1, if it is enough for that. weigh(labels, batch) gives, of some rows
    of days, what the parts can go to, and tables of which of these and of weights, a row a day."""
    fields = StructType([days.schema["sub_id"], days.schema["day"]]).add(item, kind).add("used", "long")
    # a label is what draws of a day have in common
    labelled = days.withColumn("_label", F.concat_ws("|", F.col("sub_id").cast("string"), F.col("day").cast("string")))

    def run(batches):
        for batch in batches:
            begin, rows = 0, 1  # the first row tells how many parts there are
            while begin < batch.num_rows:
                some = batch.slice(begin, rows)
                items, which, weights = weigh(some["_label"].to_pylist(), some)
                if not len(items):
                    break
                used = splits(some["used"].to_numpy(), weights, 1).ravel()
                at = pa.array(np.repeat(np.arange(some.num_rows), len(items)))
                yield pa.RecordBatch.from_arrays([some["sub_id"].take(at), some["day"].take(at), items.take(pa.array(which.ravel())), pa.array(used)], names=fields.names)
                begin, rows = begin + rows, max(1, CELLS // len(items))

    return labelled.mapInArrow(run, fields)


def history_apps(days: DataFrame, apps: DataFrame) -> DataFrame:
    """(sub_id, day, app_id, used): a day's usage over the live apps in a drawn order; the app of gifts has none."""
    ids = apps.where(F.col("app_id") != GIFT_APP).agg(F.array_sort(F.collect_list(F.col("app_id").cast("bigint"))).alias("_apps"))
    days = days.select("sub_id", "day", "used").crossJoin(F.broadcast(ids))  # one row

    def weigh(labels: list[str], batch: pa.RecordBatch):
        ids = batch["_apps"][0].values
        names = ids.to_pylist()
        order = np.argsort(uniforms([f"app|{x}" for x in labels], names), axis=1, kind="stable")
        rank = np.array([*APP_WEIGHTS, *[APP_REST] * len(ids)])[: len(ids)]
        return ids, order, rank * (0.8 + np.take_along_axis(uniforms([f"weight|{x}" for x in labels], names), order, axis=1) * 0.5)

    return parted(days, "app_id", "long", weigh)


def history_slots(days: DataFrame) -> DataFrame:
    """(sub_id, day, slot, used): a day's usage over its three-hour slots, low at night and high in the evening."""
    hours = [f"{h:02d}" for h in range(0, 24, 3)]

    def weigh(labels: list[str], batch: pa.RecordBatch):
        drawn = uniforms([f"slot|{x}" for x in labels], hours)
        return pa.array([f"{h}_used" for h in hours]), np.tile(np.arange(len(hours)), (len(labels), 1)), np.array(SLOT_WEIGHTS) * (0.85 + drawn * 0.3)

    return parted(days.select("sub_id", "day", "used"), "slot", "string", weigh)
