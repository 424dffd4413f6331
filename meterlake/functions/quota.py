"""Arithmetic of quotas, thresholds and clipped running sums. Amounts are whole KB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the metering rules
DAILY_PLAN_LIMIT = 1048576
MEMBER_LIMIT = 5 * 1024 * 1024
NO_ALERT = 101
GIFT_APP = 20


def remaining(limit: Column, used: Column) -> Column:
    """What a plan quota leaves; null is without limit, as a negative limit asks for."""
    return F.when(limit < 0, F.lit(None).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), F.coalesce(limit, F.lit(0)) - F.coalesce(used, F.lit(0))))


def remaining_percent(quota: Column, used: Column) -> Column:
    left = F.greatest(F.lit(0).cast("bigint"), quota - used)
    return F.when(quota > 0, (left * 100 - F.pmod(left * 100, quota)) / quota).otherwise(F.lit(0)).cast("int")


def threshold(quota: Column, used: Column) -> Column:
    """The alert level that usage has reached: 0, 10, 30 or 50 percent left, 101 for none or without a quota."""
    left = F.greatest(F.lit(0).cast("bigint"), quota - used)
    percent = remaining_percent(quota, used)
    return (
        F.when(F.coalesce(quota, F.lit(0)) <= 0, F.lit(NO_ALERT))
        .when(left == 0, F.lit(0))
        .when(percent <= 10, F.lit(10))
        .when(percent <= 30, F.lit(30))
        .when(percent <= 50, F.lit(50))
        .otherwise(F.lit(NO_ALERT))
    )


def used_percent(remaining_pct: Column) -> Column:
    return F.lit(100) - F.least(F.lit(100), F.greatest(F.lit(0), remaining_pct))


def clip(amount: Column, cumulative: Column, cap: Column) -> Column:
    """What a running sum takes from a cap with this amount; a null cap is without limit."""
    return F.when(cap.isNull(), amount).otherwise(F.least(cumulative, cap) - F.least(cumulative - amount, cap))
