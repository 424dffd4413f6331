"""Text forms of block policies: day lists, encoded repeats, end times, snapshot fields and wrapped JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = {"MON": "1", "TUE": "2", "WED": "3", "THU": "4", "FRI": "5", "SAT": "6", "SUN": "7"}


def days_csv(raw: Column) -> Column:
    """A comma list with day names as ISO numbers; blanks around and empty entries go, other entries stay."""
    names = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    tokens = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, F.upper(t)), t)), ",")


def encode_repeat(days: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", F.coalesce(days, F.lit("")), F.coalesce(start, F.lit("")), F.coalesce(end, F.lit("")))


def decode_repeat(encoded: Column) -> Column:
    """struct(days, start, end); null unless there are three parts with text."""
    part = lambda i: F.regexp_extract(encoded, r"^([^|]+)\|([^|]+)\|([^|]+)", i)
    return F.when(part(1) != "", F.struct(part(1).alias("days"), part(2).alias("start"), part(3).alias("end")))


def once_end_epoch(raw: Column) -> Column:
    """Epoch seconds of the end of a one-time policy: digits, or a local time in one of two spellings; 0 if it is neither."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    seconds = F.when(F.length(F.regexp_replace(text, "[^:]", "")) == 1, F.concat(text, F.lit(":00"))).otherwise(text)
    local = lambda pattern: F.unix_timestamp(F.try_to_timestamp(F.concat(seconds, F.lit("+09:00")), F.lit(pattern + "XXX")))
    digits = F.when(text.rlike("^[0-9]+$"), F.try_cast(text, "bigint") if hasattr(F, "try_cast") else text.try_cast("bigint"))
    return F.coalesce(digits, local("yyyy.MM.dd'T'HH:mm:ss"), local("yyyy-MM-dd'T'HH:mm:ss"), F.lit(0).cast("bigint"))


def snapshot_field(snapshot: Column, *paths: str) -> Column:
    """The first of several JSON paths with text."""
    return F.coalesce(*[F.nullif(F.get_json_object(snapshot, p), F.lit("")) for p in paths])


def snapshot_days(snapshot: Column) -> Column:
    """days_csv as it is, or an array of days joined."""
    arrays = [F.nullif(F.array_join(F.from_json(F.get_json_object(snapshot, p), "array<string>"), ","), F.lit("")) for p in ("$.data.days", "$.days")]
    return F.coalesce(F.nullif(F.get_json_object(snapshot, "$.days_csv"), F.lit("")), *arrays)


def policy_type(column: Column, snapshot: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(column, F.lit("")), snapshot_field(snapshot, "$.policyType", "$.policy_type"), F.lit("")))


def unwrapped(message: Column, levels: int) -> Column:
    """A JSON message that was encoded as a JSON string up to `levels` times."""
    once = lambda m: F.when(F.ltrim(m).startswith('"'), F.get_json_object(F.concat(F.lit("["), m, F.lit("]")), "$[0]")).otherwise(m)
    # most messages are not wrapped: those take no step
    return F.when(F.ltrim(message).startswith('"'), F.aggregate(F.sequence(F.lit(1), F.lit(levels)), message, lambda m, _: once(m))).otherwise(message)
