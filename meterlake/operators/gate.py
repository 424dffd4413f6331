"""The gate before publishing: which pending events the remaining quotas approve.

Greedy with skips: an event needs its whole amount from one place, and a later, smaller one may pass where a larger one failed. No window
says that, so each subscriber's events, then each family's, run in order past what is left. Rows are sorted and folded as they come, with a
constant amount of work an event, so a group may be as long as it likes.

Gifts are the one leak: an event that all gifts together can't cover drains them all and is still judged by the plan in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import timekeys
from meterlake.functions.quota import DAILY_PLAN_LIMIT, remaining
from meterlake.session import cut

from .machines import folded


def _big(x: int = 0) -> Column:
    return F.lit(x).cast("bigint")


def left_at(moment: str, log: DataFrame, plans: DataFrame, families: DataFrame, members: DataFrame, gifts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What quotas leave at a moment of Korean time: (gift_left, plan_left, pool_left, member_left), as `approved` takes them.

    log: the applied log. What it holds of the moment's month before the moment is used up; of daily plans, what it holds of the day.
    Gifts count one by one, so that what one has over doesn't make up for another.
    """
    at = F.lit(moment).cast("timestamp_ntz")
    month, day = timekeys.month_key(at), timekeys.day_key(at)
    detail = F.from_json("gift_detail_json", "array<struct<giftId:string,usedAmount:bigint>>")
    so_far = log.where((F.col("yyyymm") == month) & (F.col("occurred_at") < at))
    so_far = so_far.select("sub_id", "family_id", "plan_used", F.when(F.col("yyyymmdd") == day, F.col("plan_used")).alias("of_day"), "family_used", F.posexplode_outer(detail).alias("i", "gift"))
    one = F.coalesce("i", F.lit(0)) == 0  # an event comes once for each gift it draws on
    total = lambda c: F.sum(F.when(one, F.col(c))).alias(c)
    spent = so_far.groupBy("sub_id", "family_id", F.col("gift.giftId").alias("gift_id")).agg(total("plan_used"), total("of_day"), total("family_used"), F.sum("gift.usedAmount").alias("used"))
    spent = cut(spent)  # of the size of the state, not of the log; the four tables go on from it
    left = F.greatest(_big(), F.col("gift_limit") - F.coalesce("used", _big()))
    of_gifts = spent.where("gift_id is not null").groupBy("sub_id", "gift_id").agg(F.sum("used").alias("used"))
    gift_left = gifts.where(F.col("yyyymm") == month).join(of_gifts, ["sub_id", "gift_id"], "left").groupBy("sub_id").agg(F.sum(left).cast("bigint").alias("gift_left"))
    own = spent.groupBy("sub_id").agg(F.sum("plan_used").alias("of_month"), F.sum("of_day").alias("of_day"))
    used = F.when(F.col("plan_limit") == DAILY_PLAN_LIMIT, F.col("of_day")).otherwise(F.col("of_month"))
    plan_left = plans.join(own, "sub_id", "left").select("sub_id", remaining(F.col("plan_limit"), used).alias("plan_left"))
    shared = spent.where("family_id > 0").groupBy("family_id", "sub_id").agg(F.sum("family_used").alias("used"))
    rest = lambda limit: F.greatest(_big(), F.coalesce(limit, _big()) - F.coalesce("used", _big())).cast("bigint")
    pool_left = families.join(shared.groupBy("family_id").agg(F.sum("used").alias("used")), "family_id", "left").select("family_id", rest("family_limit").alias("pool_left"))
    member_left = members.join(shared, ["family_id", "sub_id"], "left").select("family_id", "sub_id", rest("member_limit").alias("member_left"))
    return gift_left, plan_left, pool_left, member_left


OWN = "sub_id bigint, seq bigint, event_id string, family_id bigint, bytes bigint, gift_left bigint, plan_left bigint, unlimited boolean, pending boolean"


def _own_step(left: dict, row: dict):
    if not row["pending"]:
        left.update({k: row[k] for k in ("gift_left", "plan_left", "unlimited") if row[k] is not None})
        return
    amount, gift, plan = row["bytes"], left.get("gift_left", 0), left.get("plan_left", 0)
    path = "gift" if gift >= amount else "plan" if left.get("unlimited") or plan >= amount else None
    left["gift_left"] = gift - amount if path == "gift" else 0
    if path == "plan" and not left.get("unlimited"):
        left["plan_left"] = plan - amount
    yield {k: row[k] for k in ("seq", "event_id", "sub_id", "family_id", "bytes")} | {"path": path}


def personal(batch: DataFrame, gift_left: DataFrame, plan_left: DataFrame) -> DataFrame:
    """batch (seq, event_id, sub_id, family_id, bytes) with path: gift, plan, or null for what is left to the family.

    gift_left (sub_id, gift_left): summed over gifts, as only the sum decides. plan_left (sub_id, plan_left): null is without limit.
    """
    none = lambda kind: F.lit(None).cast(kind)
    event = [none("bigint").alias("seq"), none("string").alias("event_id"), none("bigint").alias("family_id"), none("bigint").alias("bytes")]
    rows = batch.select("sub_id", "seq", "event_id", "family_id", "bytes", none("bigint").alias("gift_left"), none("bigint").alias("plan_left"), none("boolean").alias("unlimited"), F.lit(True).alias("pending"))
    stored = [
        gift_left.select("sub_id", *event, "gift_left", none("bigint").alias("plan_left"), none("boolean").alias("unlimited"), F.lit(False).alias("pending")),
        plan_left.select("sub_id", *event, none("bigint").alias("gift_left"), "plan_left", F.col("plan_left").isNull().alias("unlimited"), F.lit(False).alias("pending")),
    ]
    for part in stored:
        rows = rows.unionByName(part)
    return folded(rows, "sub_id", ["pending", "seq", "event_id"], _own_step, dict, lambda key, left: (), "seq bigint, event_id string, sub_id bigint, family_id bigint, bytes bigint, path string")


def _family_step(left: dict, row: dict):
    out = {k: row[k] for k in ("family_id", "event_id", "mode", "path")}
    if row["path"] is not None:
        yield out
        return
    sub, amount = row["sub_id"], row["bytes"]
    if row["mode"] is None or (row["mode"] == "PRIORITY" and row["place"] is None):
        return
    pool, own = left.setdefault("pool", max(0, row["pool_left"] or 0)), left.setdefault(sub, row["member_left"] or 0)
    if pool >= amount and own >= amount:
        left["pool"], left[sub] = pool - amount, own - amount
        yield out | {"path": "family"}


def judged_by_families(judged: DataFrame, pool_left: DataFrame, member_left: DataFrame, priorities: DataFrame) -> DataFrame:
    """Approved ones of judged (seq, event_id, sub_id, family_id, bytes, path): those that have a path, and of the others what their family
    pays: (family_id, event_id, mode, path). One pass, so that what judged comes from is computed once.

    pool_left (family_id, pool_left); member_left (family_id, sub_id, member_left), missing members have nothing; priorities (family_id,
    sub_id, score): a family with rows goes member by member in order of score, then of the id as text, and unlisted members get nothing;
    other families go by arrival.
    """
    rows = judged.join(member_left, ["family_id", "sub_id"], "left").join(priorities.select("family_id", "sub_id", "score"), ["family_id", "sub_id"], "left")
    listed = priorities.select("family_id").distinct().withColumn("listed", F.lit(True))
    rows = rows.join(listed, "family_id", "left").join(pool_left, "family_id", "left")
    rows = rows.withColumn("mode", F.when(F.coalesce("family_id", F.lit(0)) != 0, F.when(F.col("listed"), F.lit("PRIORITY")).otherwise(F.lit("FIFO"))))
    ordered = F.col("mode") == "PRIORITY"
    key = F.when(F.col("mode").isNull(), -F.col("sub_id")).otherwise(F.col("family_id"))  # no crowd of events without a family
    rows = rows.withColumns({"key": key, "place": F.when(ordered, F.col("score")).cast("bigint"), "text": F.when(ordered, F.col("sub_id").cast("string"))})
    return folded(rows, "key", ["place", "text", "seq", "event_id"], _family_step, dict, lambda key, left: (), "family_id bigint, mode string, event_id string, path string")


def family(pending: DataFrame, pool_left: DataFrame, member_left: DataFrame, priorities: DataFrame) -> DataFrame:
    """Approved ones of pending (seq, event_id, sub_id, family_id, bytes): (family_id, event_id, mode)."""
    return judged_by_families(pending.withColumn("path", F.lit(None).cast("string")), pool_left, member_left, priorities).select("family_id", "mode", "event_id")


def approved(batch: DataFrame, gift_left: DataFrame, plan_left: DataFrame, pool_left: DataFrame, member_left: DataFrame, priorities: DataFrame) -> DataFrame:
    """(event_id, path) of the events of a batch that gifts, the plan or the family pool approve, each id once."""
    return judged_by_families(personal(batch, gift_left, plan_left), pool_left, member_left, priorities).select("event_id", "path")


def keep_approved(batch: DataFrame, approved_ids: DataFrame) -> DataFrame:
    return batch.join(approved_ids.select("event_id").distinct(), "event_id", "left_semi")
