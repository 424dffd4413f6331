"""The waterfall where limits change between events: each event sees the limits of its moment.

Limits and their changes become rows beside the usage, in the order of time; at one moment changes come first. Two folds over sorted rows
follow, gifts and plan by subscriber, then members and pool by family: an exchange and a sort each, as in the closed form of `allocate`,
which serves where limits hold for the month. The result has the columns of `allocate`, so that alerts and logs are made of it alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import machines
from .machines import CHANGE, FAMILY_KINDS, SUBSCRIBER_KINDS, USAGE, Family, Store, Subscriber, folded

EVENT = "event_id string, family_id bigint, app_id bigint, kst timestamp_ntz, yyyymmdd string, bytes bigint"
#: What a machine takes, usage or a change, with the key that it belongs to and where it comes among rows of one moment.
ROW = f"key bigint, seq bigint, {CHANGE}, {EVENT}"
ORDER = ["kst", "last", "seq", "event_id"]


def fitted(rows: DataFrame, ddl: str = ROW) -> DataFrame:
    """rows with exactly these columns; those it lacks are null."""
    kind = rows.sparkSession.createDataFrame([], ddl).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def usage_rows(events: DataFrame) -> DataFrame:
    return fitted(events.withColumns({"key": F.col("sub_id"), "kind": F.lit(USAGE)}))


def subscriber_changes(changes: DataFrame) -> DataFrame:
    """Change events that set what a subscriber draws on."""
    gift = F.col("kind") == "GIFT_RECEIVED"
    rows = changes.where(F.col("kind").isin(*SUBSCRIBER_KINDS))
    sub = F.when(gift, F.col("receiverSubId")).otherwise(F.col("subId"))
    return fitted(rows.withColumns({"key": sub, "sub_id": sub, "amount": F.when(gift, F.col("giftLimitBytes")).otherwise(F.col("planLimit")), "name": F.col("giftId"), "yyyymm": F.col("yyyyMM")}))


def family_changes(changes: DataFrame) -> DataFrame:
    rows = changes.where(F.col("kind").isin(*FAMILY_KINDS))
    return fitted(rows.withColumns({"key": F.col("familyId"), "sub_id": F.col("subId"), "amount": F.col("newLimit")}))


def stored_subscribers(plans: DataFrame, gifts: DataFrame, plan_used: DataFrame | None = None, gift_used: DataFrame | None = None) -> DataFrame:
    """What is known of subscribers at the start. plan_used (sub_id, period, amount): by month, and by day for daily plans. gift_used
    (sub_id, gift_id, yyyymm, amount)."""
    parts = [
        plans.select(F.col("sub_id").alias("key"), F.lit(0).alias("seq"), F.lit(machines.STORED_PLAN).alias("kind"), F.col("plan_limit").alias("amount")),
        gifts.select(F.col("sub_id").alias("key"), F.lit(0).alias("seq"), F.lit(machines.STORED_GIFT).alias("kind"), F.col("gift_limit").alias("amount"), F.col("gift_id").alias("name"), "yyyymm", "score"),
    ]
    if plan_used is not None:
        parts.append(plan_used.select(F.col("sub_id").alias("key"), F.lit(1).alias("seq"), F.lit(machines.STORED_USE).alias("kind"), "amount", F.col("period").alias("yyyymm")))
    if gift_used is not None:
        parts.append(gift_used.select(F.col("sub_id").alias("key"), F.lit(1).alias("seq"), F.lit(machines.STORED_USE).alias("kind"), "amount", F.col("gift_id").alias("name"), "yyyymm"))
    return _all(parts)


def stored_families(families: DataFrame, members: DataFrame, scores: DataFrame | None = None, pool_used: DataFrame | None = None, member_used: DataFrame | None = None) -> DataFrame:
    """What is known of families at the start. pool_used (family_id, yyyymm, amount), member_used (family_id, sub_id, yyyymm, amount)."""
    listed = members if scores is None else members.join(scores.select("family_id", "sub_id", "score"), ["family_id", "sub_id"], "left")
    parts = [
        families.select(F.col("family_id").alias("key"), F.lit(0).alias("seq"), F.lit(machines.STORED_POOL).alias("kind"), F.col("family_limit").alias("amount")),
        listed.select(F.col("family_id").alias("key"), F.lit(0).alias("seq"), F.lit(machines.STORED_MEMBER).alias("kind"), "sub_id", F.col("member_limit").alias("amount"), *([] if scores is None else ["score"])),
    ]
    if pool_used is not None:
        parts.append(pool_used.select(F.col("family_id").alias("key"), F.lit(1).alias("seq"), F.lit(machines.STORED_USE).alias("kind"), "amount", "yyyymm"))
    if member_used is not None:
        parts.append(member_used.select(F.col("family_id").alias("key"), F.lit(1).alias("seq"), F.lit(machines.STORED_USE).alias("kind"), "sub_id", "amount", "yyyymm"))
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = fitted(parts[0])
    for part in parts[1:]:
        out = out.unionByName(fitted(part))
    return out


def own_step(machine: Subscriber, row: dict):
    """A row past a subscriber's machine: usage comes out with what gifts and the plan pay, for the family that it names."""
    if row["kind"] != USAGE:
        machine.change(row["kind"], row)
    else:
        key = row["family_id"] if row["family_id"] > 0 else -row["sub_id"]
        yield row | {"key": key} | machine.usage(row["bytes"], row["yyyymm"], row["yyyymmdd"])


def shared_step(machine: Family, row: dict):
    if row["kind"] != USAGE:
        machine.change(row["kind"], row)
    else:
        yield row | machine.usage(row["sub_id"], row["rest"], row["yyyymm"])


OWN = f"{ROW}, {Subscriber.RESULT}"
SHARED = f"{OWN}, {Family.RESULT}"


def finished(rows: DataFrame) -> DataFrame:
    """The columns of `allocate`, of what the second machine yields."""
    gift = F.from_json("gift_detail", "array<struct<giftId:string,limit:bigint,usedAmount:bigint,giftUsed:bigint,fired:int>>")
    parts = F.transform(gift, lambda g: F.struct(g["giftId"].alias("gift_id"), g["limit"].alias("gift_limit"), g["usedAmount"].alias("take"), g["giftUsed"].alias("gift_used"), g["fired"].alias("threshold")))
    return rows.select(
        "event_id", "sub_id", "family_id", "app_id", "kst", "yyyymm", "yyyymmdd", "bytes", "gift_take", F.when(F.col("gift_take") > 0, parts).alias("gift_parts"), "plan_take", "plan_limit", "plan_used",
        F.col("plan_fired").alias("plan_alert"), "family_take", "overflow", "family_limit", "family_used", F.col("family_fired").alias("family_alert"),
    )


def allocate(events: DataFrame, changes: DataFrame, subscribers: DataFrame, families: DataFrame) -> DataFrame:
    """events (with calendar keys) with takes, alerts and the limits of their moment, in the columns of the closed form.

    changes: change events as they are parsed, accepted once each, with `kst`, the moment from which they hold, and `seq`. subscribers,
    families: what is stored at the start. An event without a family pays alone; a limit that nothing sets is 0.
    """
    last = (F.col("kind") == USAGE).alias("last")
    rows = usage_rows(events).unionByName(subscriber_changes(changes)).unionByName(subscribers)
    own = folded(rows.select("*", last), "key", ORDER, own_step, lambda: Subscriber(Store()), lambda key, machine: (), OWN)
    rows = own.unionByName(fitted(family_changes(changes).unionByName(families), OWN))
    shared = folded(rows.select("*", last), "key", ORDER, shared_step, lambda: Family(Store()), lambda key, machine: (), SHARED)
    return finished(shared)


def family_final(changes: DataFrame, families: DataFrame) -> DataFrame:
    """(family_id, sub_id, member_limit, family_limit, score) after all changes of all kinds, in order: one fold of a family's creation,
    additions, removals, limits and modes together, as each bears on the others. score is null where there is no order of priority."""
    rows = family_changes(changes).unionByName(families)
    schema = "family_id bigint, sub_id bigint, member_limit bigint, family_limit bigint, score bigint"
    return folded(rows.select("*", (F.col("seq") > 0).alias("last")), "key", ["seq", "event_id"], shared_step, lambda: Family(Store()), lambda key, machine: [{"family_id": key} | m for m in machine.members()], schema)
