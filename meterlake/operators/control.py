"""State after change events, as joins and windows over the events instead of mutation.

Each kind is one of: the last value of a key, the last snapshot of a key taken apart, or a running count over effective changes. Events
that come again under an id are dropped first; ids of family, subscription and policy events are spaces of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.quota import GIFT_APP, MEMBER_LIMIT
from meterlake.sources import decode

POLICY_KINDS = ("POLICY_CHANGED", "POLICY_DEACTIVATE", "POLICY_DELETED")


def id_space(kind: Column) -> Column:
    return F.when(kind.isin(*POLICY_KINDS), F.lit("policy")).when(kind.startswith("FAMILY"), F.lit("family")).otherwise(F.lit("sub"))


def once(events: DataFrame, applicable: Column | None = None) -> DataFrame:
    """The first event of each id and id space, of those that are applicable."""
    rest = [c for c in events.columns if c not in ("event_id", "seq")]
    order = F.col("seq") if applicable is None else F.when(applicable, F.col("seq"))
    lead = events.withColumn("space", id_space(F.col("kind"))).groupBy("space", "event_id").agg(F.min_by(F.struct("seq", *rest), order).alias("r"))
    return lead.where("r is not null").select("event_id", "r.*")


def accepted(events: DataFrame) -> DataFrame:
    """The first of each change that can be applied; one that lacks a field of its kind changes nothing and takes no id.

    The reason is judged in the aggregate: as a filter it would be pushed below the parsing of messages and copy that for each field.
    """
    return once(events, decode.refused(events).isNull())


def _last(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The values of the latest row of each key, by a partial aggregate."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("v"))
    return top.select(*keys, "v.*")


def plan_limits(events: DataFrame, base: DataFrame) -> DataFrame:
    """(sub_id, plan_limit) with changed plans."""
    new = _last(events.where("kind = 'PLAN_CHANGED'").select(F.col("subId").alias("sub_id"), F.col("planLimit").alias("new"), "seq"), ["sub_id"], "new")
    return base.join(new, "sub_id", "full").select("sub_id", F.coalesce("new", "plan_limit").alias("plan_limit"))


def locks(events: DataFrame, base: DataFrame) -> DataFrame:
    """(sub_id) locked at the end."""
    rows = events.where("kind in ('SUBSCRIPTION_LOCKED', 'SUBSCRIPTION_UNLOCKED')").select(F.col("subId").alias("sub_id"), (F.col("kind") == "SUBSCRIPTION_LOCKED").alias("on"), "seq")
    state = base.select("sub_id", F.lit(True).alias("was")).join(_last(rows, ["sub_id"], "on"), "sub_id", "full")
    return state.where("coalesce(on, was)").select("sub_id")


def app_blocks(events: DataFrame, base: DataFrame) -> DataFrame:
    """(sub_id, app_id): the last list of each subscriber replaces what was; a missing list is empty."""
    rows = events.where("kind = 'APP_BLOCK_LIST_UPDATED'").select(F.col("subId").alias("sub_id"), F.coalesce("appIds", F.array().cast("array<bigint>")).alias("apps"), "seq")
    new = _last(rows, ["sub_id"], "apps")
    kept = base.select("sub_id", "app_id").join(new, "sub_id", "left_anti")
    return kept.unionByName(new.select("sub_id", F.explode(F.array_distinct("apps")).alias("app_id")))


def member_limits_set(events: DataFrame, base: DataFrame) -> DataFrame:
    """(family_id, sub_id, member_limit) with limits set by hand."""
    rows = events.where("kind = 'FAMILY_SUB_LIMIT_CHANGED'").select(F.col("familyId").alias("family_id"), F.col("subId").alias("sub_id"), F.col("newLimit").alias("new"), "seq")
    return base.join(_last(rows, ["family_id", "sub_id"], "new"), ["family_id", "sub_id"], "full").select("family_id", "sub_id", F.coalesce("new", "member_limit").alias("member_limit"))


def policies(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(sub_id, policy_id, store, encoded, expire_epoch) at the end: store is repeat for scheduled policies, time for others.

    base (sub_id, policy_id, type, encoded, expire_epoch): policies at the start, none by default.

    A change puts a policy in one store and out of the other, a deactivation or deletion out of both (entries without subscribers do
    nothing), and a snapshot replaces all of a subscriber's policies: of what came before it nothing counts.
    """
    one = lambda p: [F.col(f"{p}.policyId").alias("policy_id"), F.col(f"{p}.policyType").alias("type"), F.col(f"{p}.encoded").alias("encoded"), F.col(f"{p}.expireEpoch").alias("expire_epoch")]
    changed = events.where("kind = 'POLICY_CHANGED'").select("seq", F.explode("subIds").alias("sub_id"), *one("policy"), F.lit(True).alias("on"))
    if base is not None:
        changed = changed.unionByName(base.select(F.lit(-1).cast("bigint").alias("seq"), "sub_id", "policy_id", "type", "encoded", "expire_epoch", F.lit(True).alias("on")))
    gone = events.where("kind in ('POLICY_DEACTIVATE', 'POLICY_DELETED')").select("seq", F.explode("policies").alias("p")).select("seq", F.explode("p.subIds").alias("sub_id"), *one("p"), F.lit(False).alias("on"))
    snapshots = events.where("kind = 'POLICY_SNAPSHOT'").select("seq", F.col("subId").alias("sub_id"), "policies")
    last = snapshots.groupBy("sub_id").agg(F.max("seq").alias("since"))
    from_snapshot = snapshots.join(last, "sub_id").where("seq = since").select("seq", "sub_id", F.explode("policies").alias("p")).select("seq", "sub_id", *one("p"), F.lit(True).alias("on"))
    later = changed.unionByName(gone).join(last, "sub_id", "left").where("since is null or seq > since").drop("since")
    state = _last(later.unionByName(from_snapshot), ["sub_id", "policy_id"], "type", "encoded", "expire_epoch", "on")
    repeat = F.col("type") == "SCHEDULED"
    return state.where("on").select("sub_id", "policy_id", F.when(repeat, F.lit("repeat")).otherwise(F.lit("time")).alias("store"), F.when(repeat, F.col("encoded")).alias("encoded"), F.when(~repeat, F.col("expire_epoch")).alias("expire_epoch"))


def created_families(events: DataFrame) -> DataFrame:
    """(family_id, sub_id, member_limit, family_limit) of new families: each member has five GiB, and may use the whole."""
    rows = _last(events.where("kind = 'FAMILY_CREATE'").select(F.col("familyId").alias("family_id"), "members", "seq"), ["family_id"], "members")
    limit = (F.size("members") * MEMBER_LIMIT).cast("bigint")
    return rows.select("family_id", F.explode("members").alias("sub_id"), limit.alias("member_limit"), limit.alias("family_limit"))


def membership_changes(events: DataFrame, base: DataFrame) -> DataFrame:
    """Additions of absent members and removals of present ones, with the family's size after each: (family_id, sub_id, seq, added, size).

    base (family_id, sub_id): members at the start.
    """
    start = base.select("family_id", "sub_id", F.lit(-1).cast("bigint").alias("seq"), F.lit(True).alias("added"))
    rows = events.where("kind in ('FAMILY_MEMBER_ADDED', 'FAMILY_MEMBER_REMOVED')").select(F.col("familyId").alias("family_id"), F.col("subId").alias("sub_id"), "seq", (F.col("kind") == "FAMILY_MEMBER_ADDED").alias("added"))
    before = F.coalesce(F.lag("added").over(Window.partitionBy("family_id", "sub_id").orderBy("seq")), F.lit(False))
    real = start.unionByName(rows).withColumn("before", before).where("added <> `before`").drop("before")
    step = F.when(F.col("added"), 1).otherwise(-1)
    return real.withColumn("size", F.sum(step).over(Window.partitionBy("family_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def family_state(events: DataFrame, base: DataFrame, families: DataFrame) -> DataFrame:
    """(family_id, sub_id, member_limit, family_limit) after additions and removals.

    base (family_id, sub_id, member_limit), families (family_id, family_limit): as stored at the start; a family that is not there has 0.
    An addition raises the stored limit by five GiB, a removal lowers it by as much but not below 0: running sums less the lowest sum that
    a removal has reached, if that is below 0. Who joins may use all of the limit as it is then, while the others' limits stay.
    """
    so_far = Window.partitionBy("family_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("seq") < 0, 0).when(F.col("added"), MEMBER_LIMIT).otherwise(-MEMBER_LIMIT)
    rows = membership_changes(events, base).join(families.select("family_id", "family_limit"), "family_id", "left")
    rows = rows.withColumn("total", F.coalesce("family_limit", F.lit(0)) + F.sum(step).over(so_far))
    lowest = F.min(F.when((F.col("seq") >= 0) & ~F.col("added"), F.col("total"))).over(so_far)
    rows = rows.withColumn("now", (F.col("total") - F.least(F.lit(0), F.coalesce(lowest, F.lit(0)))).cast("bigint"))
    latest = rows.groupBy("family_id", "sub_id").agg(F.max_by(F.struct("seq", "added", "now"), "seq").alias("v")).where("v.added")
    ends = rows.groupBy("family_id").agg(F.max_by("now", "seq").alias("family_limit"))
    joined = latest.join(base, ["family_id", "sub_id"], "left").join(ends, "family_id")
    limit = F.when(F.col("v.seq") >= 0, F.col("v.now")).otherwise(F.col("member_limit"))
    return joined.select("family_id", "sub_id", limit.cast("bigint").alias("member_limit"), "family_limit")


def modes(events: DataFrame, base: DataFrame) -> DataFrame:
    """(family_id, sub_id, score): the last mode event of a family replaces its priorities; any mode but PRIORITY leaves none."""
    rows = events.where("kind = 'FAMILY_MODE_CHANGED'").select(F.col("familyId").alias("family_id"), F.when(F.col("mode") == "PRIORITY", F.col("priorities")).alias("p"), "seq")
    new = _last(rows, ["family_id"], "p")
    kept = base.select("family_id", "sub_id", "score").join(new, "family_id", "left_anti")
    return kept.unionByName(new.select("family_id", F.explode("p").alias("x")).select("family_id", F.col("x.subId").alias("sub_id"), F.col("x.priority").alias("score")))


def priorities_after(events: DataFrame, base: DataFrame, members: DataFrame) -> DataFrame:
    """(family_id, sub_id, score) of families in priority mode after additions and removals.

    Who joins goes behind the highest score; the removal of a listed member moves those with higher scores up by one, so that equal scores
    stay equal, and the removal of one who was never listed moves nobody. A list that has become empty is gone. Each step needs the scores
    that the one before left: an ordered fold over a family's changes.
    """
    listed = base.groupBy("family_id").agg(F.collect_list(F.struct(F.col("sub_id").cast("bigint").alias("sub_id"), F.col("score").cast("bigint").alias("score"))).alias("start"))
    changes = membership_changes(events, members).where("seq >= 0").join(listed.select("family_id"), "family_id", "left_semi")
    steps = changes.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("seq", "sub_id", "added"))).alias("steps"))

    def step(rows: Column, e: Column) -> Column:
        others = F.filter(rows, lambda x: x["sub_id"] != e["sub_id"])
        behind = F.struct(e["sub_id"].alias("sub_id"), (F.array_max(F.transform(rows, lambda x: x["score"])) + 1).alias("score"))
        left = F.array_max(F.transform(F.filter(rows, lambda x: x["sub_id"] == e["sub_id"]), lambda x: x["score"]))
        closed = F.transform(others, lambda x: F.struct(x["sub_id"].alias("sub_id"), F.when(x["score"] > left, x["score"] - 1).otherwise(x["score"]).alias("score")))
        return F.when(F.size(rows) == 0, rows).when(e["added"], F.concat(others, F.array(behind))).otherwise(closed)

    none = F.array().cast("array<struct<seq:bigint,sub_id:bigint,added:boolean>>")
    rows = listed.join(steps, "family_id", "left").select("family_id", F.aggregate(F.coalesce("steps", none), F.col("start"), step).alias("list"))
    return rows.select("family_id", F.explode("list").alias("x")).select("family_id", "x.sub_id", "x.score")


def received_gifts(events: DataFrame, base: DataFrame) -> DataFrame:
    """(sub_id, gift_id, yyyymm, gift_limit, score): gifts there were, then new ones behind them in order of arrival."""
    rows = events.where("kind = 'GIFT_RECEIVED'").select("seq", F.col("receiverSubId").alias("sub_id"), F.col("giftId").alias("gift_id"), F.col("yyyyMM").alias("yyyymm"), F.col("giftLimitBytes").alias("gift_limit"))
    top = base.groupBy("sub_id", "yyyymm").agg(F.max("score").cast("bigint").alias("top"))
    place = F.row_number().over(Window.partitionBy("sub_id", "yyyymm").orderBy("seq"))
    new = rows.join(top, ["sub_id", "yyyymm"], "left").withColumn("score", (F.coalesce("top", F.lit(-1)) + place).cast("bigint"))
    old = base.select("sub_id", "gift_id", "yyyymm", "gift_limit", F.col("score").cast("bigint").alias("score"))
    return old.unionByName(new.select("sub_id", "gift_id", "yyyymm", "gift_limit", "score"))


def gifts_given(events: DataFrame) -> DataFrame:
    """The givers' movements; they are booked under the gift app, without a slot."""
    rows = events.where("kind = 'GIFT_RECEIVED'")
    return rows.select(F.col("giverSubId").alias("giver_sub_id"), F.col("giftAmountBytes").alias("amount"), F.col("yyyyMM").alias("yyyymm"), F.col("yyyyMMDD").alias("yyyymmdd"), F.lit(None).cast("string").alias("slot"), F.lit(GIFT_APP).alias("app_id"))
