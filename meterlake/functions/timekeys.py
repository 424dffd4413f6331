"""Calendar keys in Korean time. Inputs are UTC instants without a zone (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def kst(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def utc(instant: Column) -> Column:
    """The UTC time, without a zone, of an instant; the session's zone has no part in it."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def epoch_seconds(local: Column) -> Column:
    """Seconds from 1970 of a time without a zone, read as UTC, whatever the session's zone."""
    return F.unix_date(F.to_date(local)).cast("bigint") * 86400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def month_key(local: Column) -> Column:
    return F.date_format(local, "yyyyMM")


def day_key(local: Column) -> Column:
    return F.date_format(local, "yyyyMMdd")


def slot_key(local: Column) -> Column:
    """The three-hour slot of a local time: 00_used, 03_used, ... 21_used."""
    return F.format_string("%02d_used", F.floor(F.hour(local) / 3).cast("int") * 3)


def time_parts(local: Column) -> dict[str, Column]:
    """Epoch seconds (of the UTC instant), ISO day of week, HH:mm, month and day of a local time."""
    return {
        "epoch": epoch_seconds(local) - 9 * 3600,
        "iso_day": (F.weekday(local) + 1).cast("int"),
        "hhmm": F.date_format(local, "HH:mm"),
        "yyyymm": month_key(local),
        "yyyymmdd": day_key(local),
    }
