"""Registered queries of the metering engine: operators applied to the derived domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import alerts, allocate, bootstrap, control, gate, intake, policy, rollups, versioned
from meterlake.sources import decode, fixtures, generator

from . import oracle, oracle_versioned



class Domain:
    """The domain tables of one directory, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    raw = property(lambda s: fixtures.raw_usage(s.spark, s.dir))
    events = property(lambda s: intake.with_keys(intake.accepted(s.raw)))
    subscription = property(lambda s: fixtures.subscription(s.spark, s.dir))
    family_sub = property(lambda s: fixtures.family_sub(s.spark, s.dir))
    plans = property(lambda s: bootstrap.plan_limits(s.subscription, fixtures.plan(s.spark)))
    families = property(lambda s: bootstrap.family_limits(s.family_sub, fixtures.family(s.spark, s.dir)))
    members = property(lambda s: bootstrap.members(s.family_sub))
    priorities = property(lambda s: bootstrap.priorities(s.family_sub))
    gifts = property(lambda s: fixtures.gift(s.spark, s.dir))
    locked = property(lambda s: bootstrap.locked(s.subscription))
    block_time = property(lambda s: fixtures.block_time(s.spark, s.dir))
    block_app = property(lambda s: fixtures.block_app(s.spark, s.dir))
    block_repeat = property(lambda s: fixtures.block_repeat(s.spark, s.dir))
    allocated = property(lambda s: allocate.allocate(s.events, s.plans, s.families, s.members, s.gifts))
    split = property(lambda s: allocate.split_gifts(s.allocated))
    log = property(lambda s: alerts.applied_log(s.allocated))
    passing = property(lambda s: policy.passing(s.events, s.locked, s.block_time, s.block_app, s.block_repeat, fixtures.AS_OF))
    control = property(lambda s: control.accepted(decode.control(fixtures.control_messages(s.spark, s.dir))))
    limit_changes = property(lambda s: control.accepted(decode.control(fixtures.limit_messages(s.spark, s.dir))))
    odd_families = property(lambda s: versioned.stored_families(fixtures.odd_families(s.spark, s.dir), s.members, s.priorities))
    policy_sub = property(lambda s: fixtures.policy_sub(s.spark, s.dir))
    policies = property(lambda s: fixtures.policies(s.spark))
    policies_now = property(lambda s: control.policies(s.control, bootstrap.stored_policies(s.policy_sub, s.policies)))
    presents = property(lambda s: fixtures.present_data(s.spark, s.dir))
    services = property(lambda s: fixtures.app_blocked_service(s.spark, s.dir))

    @property
    def history(self) -> DataFrame:
        return generator.history_days(self.plans.join(self.subscription.select("sub_id", "plan_id"), "sub_id"), fixtures.AS_OF[:10])

    @property
    def batch(self) -> DataFrame:
        """The gate judges every event that the policies pass, whatever its own month, by what quotas leave at the moment of asking."""
        return self.passing.select(F.col("arrival_seq").alias("seq"), "event_id", "sub_id", "family_id", "bytes")

    @property
    def gate_state(self) -> tuple[DataFrame, ...]:
        return (*gate.left_at(fixtures.AS_OF, self.log, self.plans, self.families, self.members, self.gifts), self.priorities)


def _gate_left(d: Domain) -> DataFrame:
    """What each quota leaves at the moment of asking, as one table."""
    gifts, plans, pools, members, _ = d.gate_state
    none = F.lit(None).cast("bigint")
    parts = [
        gifts.select(F.lit("gift").alias("kind"), "sub_id", none.alias("family_id"), F.col("gift_left").alias("amount_left")),
        plans.select(F.lit("plan").alias("kind"), "sub_id", none.alias("family_id"), F.col("plan_left").alias("amount_left")),
        pools.select(F.lit("pool").alias("kind"), none.alias("sub_id"), "family_id", F.col("pool_left").alias("amount_left")),
        members.select(F.lit("member").alias("kind"), "sub_id", "family_id", F.col("member_left").alias("amount_left")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _allocate_versioned(d: Domain) -> DataFrame:
    rows = versioned.allocate(d.events, d.limit_changes, versioned.stored_subscribers(d.plans, d.gifts), d.odd_families)
    return rows.select(
        "event_id", "sub_id", "family_id", "yyyymm", "bytes", "gift_take", "plan_take", "family_take", "overflow", "plan_limit", "plan_used", "plan_alert", "family_limit", "family_used", "family_alert",
    )


def _policy_pass_latest(d: Domain) -> DataFrame:
    """Events that pass the policies of the first load with all changes on top."""
    rules = d.policies_now
    repeats, ends = rules.where("store = 'repeat'"), rules.where("store = 'time'")
    return policy.passing(d.events, control.locks(d.control, d.locked), ends, control.app_blocks(d.control, d.block_app), repeats, fixtures.FRIDAY).select("event_id")


def _gate_family(d: Domain) -> DataFrame:
    gift_left, plan_left, *rest = d.gate_state
    return gate.family(gate.personal(d.batch, gift_left, plan_left).where("path is null").drop("path"), *rest).select("event_id", "family_id", "mode")


QUERIES = {
    "usage_total_month": lambda d: d.events.groupBy("sub_id", "yyyymm").agg(F.sum("bytes").cast("bigint").alias("total_used")),
    "usage_app_month": lambda d: rollups.by_app(d.events, "yyyymm"),
    "usage_app_day": lambda d: rollups.by_app(d.events, "yyyymmdd"),
    "usage_3hourly": lambda d: rollups.by_slot(d.events),
    "usage_3hourly_wide": lambda d: rollups.by_slot_wide(d.events),
    "valid_events": lambda d: d.raw.where("bytes > 0").select("event_id", "arrival_seq", "bytes"),
    "quarantined_events": lambda d: intake.quarantined(d.raw).select("event_id", "arrival_seq", "reason"),
    "dedup_events": lambda d: d.events.select("event_id", "sub_id", "family_id", "bytes", "app_id", "kst", "arrival_seq"),
    "status_counts": lambda d: rollups.status_counts(intake.with_status(d.raw)),
    "block_immediate": lambda d: policy.immediate(d.events, d.locked).select("event_id"),
    "block_time": lambda d: policy.timed(d.events, d.block_time, fixtures.AS_OF).select("event_id"),
    "block_app": lambda d: policy.by_app(d.events, d.block_app).select("event_id"),
    "block_repeat": lambda d: policy.repeated(d.events, d.block_repeat, fixtures.AS_OF).select("event_id"),
    "policy_pass": lambda d: d.passing.select("event_id"),
    "policy_pass_morning": lambda d: policy.passing(d.events, d.locked, d.block_time, d.block_app, d.block_repeat, fixtures.NEXT_MORNING).select("event_id"),
    "block_repeat_morning": lambda d: policy.repeated(d.events, d.block_repeat, fixtures.NEXT_MORNING).select("event_id"),
    "allocate_waterfall": lambda d: d.allocated.select("event_id", "sub_id", "family_id", "yyyymm", "bytes", "gift_take", "plan_take", "family_take", "overflow", "plan_used", "family_used"),
    "gift_split": lambda d: d.split.select("event_id", "gift_id", "take", "gift_used"),
    "usage_sub_month": lambda d: rollups.by_subscriber(d.allocated, "yyyymm"),
    "usage_sub_day": lambda d: rollups.by_subscriber(d.allocated, "yyyymmdd"),
    "usage_family_month": lambda d: rollups.by_family(d.allocated, "yyyymm"),
    "usage_family_day": lambda d: rollups.by_family(d.allocated, "yyyymmdd"),
    "usage_gift": lambda d: rollups.by_gift(d.split),
    "plan_alerts": lambda d: alerts.plan_alerts(d.allocated).select("event_id", "sub_id", "yyyymm", "threshold", "remaining_pct", "plan_used"),
    "family_alerts": lambda d: alerts.family_alerts(d.allocated).select("event_id", "family_id", "yyyymm", "threshold", "remaining_pct", "family_used"),
    "gift_alerts": lambda d: alerts.gift_alerts(d.split).select("event_id", "gift_id", "yyyymm", "threshold", "remaining_pct", "gift_used"),
    "outbox_rows": lambda d: alerts.outbox(d.allocated),
    "applied_log": lambda d: d.log,
    "rebuild_from_log": lambda d: rollups.rebuild(d.log),
    "rebuild_family": lambda d: rollups.rebuild_family(d.log),
    "topk_apps": lambda d: rollups.top_apps(d.events, "yyyymm", 3).select("sub_id", "app_id", "yyyymm", "used", F.col("place").cast("bigint").alias("place")),
    "plan_limits": lambda d: d.plans,
    "family_limits": lambda d: d.families,
    "members": lambda d: d.members,
    "priorities": lambda d: d.priorities,
    "locked_subs": lambda d: d.locked,
    "blocked_apps": lambda d: bootstrap.blocked_apps(fixtures.blocked_service_sub(d.spark, d.dir), d.services),
    "gift_app": lambda d: bootstrap.gift_app(d.services),
    "policy_repeat_parse": lambda d: bootstrap.repeat_policies(d.policy_sub, d.policies),
    "policy_once_parse": lambda d: bootstrap.once_policies(d.policy_sub, d.policies),
    "seed_gifts": lambda d: bootstrap.gifts(d.presents),
    "seed_donor_usage": lambda d: rollups.donor_movements(bootstrap.given(d.presents), app_id=bootstrap.gift_app(d.services).scalar(), slots=True),
    "gate_left": _gate_left,
    "gate_personal": lambda d: gate.personal(d.batch, *d.gate_state[:2]).select("event_id", "sub_id", "path"),
    "gate_family": _gate_family,
    "approved_events": lambda d: gate.approved(d.batch, *d.gate_state),
    "published_events": lambda d: gate.keep_approved(d.batch, gate.approved(d.batch, *d.gate_state)).select("event_id", "sub_id", "bytes"),
    "block_time_pruned": lambda d: policy.pruned(d.block_time, fixtures.AS_OF),
    "first_gift": lambda d: bootstrap.first_by_subscriber(d.presents.select(F.col("target_sub_id").alias("sub_id"), "present_data_id", "data_amount"), "present_data_id"),
    "control_parsed": lambda d: d.control.select("event_id", "kind", "seq"),
    "plan_latest": lambda d: control.plan_limits(d.control, d.plans),
    "lock_latest": lambda d: control.locks(d.control, d.locked),
    "app_block_latest": lambda d: control.app_blocks(d.control, d.block_app),
    "policy_latest": lambda d: control.policies(d.control),
    "policy_stored": lambda d: bootstrap.stored_policies(d.policy_sub, d.policies),
    "policy_now": lambda d: d.policies_now,
    "policy_pass_latest": _policy_pass_latest,
    "member_limit_latest": lambda d: control.member_limits_set(d.control, d.members),
    "family_created": lambda d: control.created_families(d.control),
    "family_state": lambda d: control.family_state(d.control, d.members, d.families),
    "priority_state": lambda d: control.priorities_after(d.control, d.priorities, d.members),
    "family_final": lambda d: versioned.family_final(d.limit_changes, d.odd_families),
    "allocate_versioned": _allocate_versioned,
    "mode_latest": lambda d: control.modes(d.control, d.priorities),
    "gift_append": lambda d: control.received_gifts(d.control, d.gifts),
    "generator_fixed": lambda d: generator.fixed(d.spark, fixtures.subscribers(d.spark, d.dir)),
    "generator_random": lambda d: generator.random(fixtures.subscribers(d.spark, d.dir), 20, "7"),
    "history_days": lambda d: d.history,
    "history_apps": lambda d: generator.history_apps(d.history, d.services.where("not is_deleted").select(F.col("app_blocked_service_id").alias("app_id"))),
    "history_slots": lambda d: generator.history_slots(d.history),
    "donor_usage": lambda d: rollups.donor_movements(control.gifts_given(d.control)),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each applied event with its takes and the plan alert it fires."""
    d = Domain(spark, sf_dir)
    return d.allocated.select("event_id", "sub_id", "family_id", "kst", "bytes", "gift_take", "plan_take", "family_take", "overflow", F.col("plan_alert").alias("plan_threshold"))


def _bound(make):
    return lambda spark, sf_dir: make(Domain(spark, sf_dir))


def queries() -> dict:
    return {name: _bound(make) for name, make in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.ORACLES | oracle_versioned.ORACLES
