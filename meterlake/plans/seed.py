"""The first load: state tables made from the relational ones, each written as a whole, so that a second load replaces the first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterlake.operators import bootstrap, rollups

TABLES = ("subscription", "plan", "family", "family_sub", "present_data", "app_blocked_service", "blocked_service_sub", "policy_sub", "block_policy")


def state(source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """State tables by name, from the tables named in TABLES."""
    s = source
    return {
        "plan_limit": bootstrap.plan_limits(s["subscription"], s["plan"]),
        "family_limit": bootstrap.family_limits(s["family_sub"], s["family"]),
        "family_member": bootstrap.members(s["family_sub"]),
        "family_priority": bootstrap.priorities(s["family_sub"]),
        "gift": bootstrap.gifts(s["present_data"]),
        "donor_usage": rollups.donor_movements(bootstrap.given(s["present_data"]), app_id=bootstrap.gift_app(s["app_blocked_service"]).scalar(), slots=True),
        "block_immediate": bootstrap.locked(s["subscription"]),
        "block_app": bootstrap.blocked_apps(s["blocked_service_sub"], s["app_blocked_service"]),
        "block_repeat": bootstrap.repeat_policies(s["policy_sub"], s["block_policy"]),
        "block_time": bootstrap.once_policies(s["policy_sub"], s["block_policy"]),
    }


def load(source: dict[str, DataFrame], target: str) -> list[str]:
    """Writes the state tables below target; what was there goes."""
    made = state(source)
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    return sorted(made)
