"""Sinks for micro-batches that may come again: each writes a batch under its number and leaves out rows it has."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Signs in an error's chain that a retry can't help: data faults by SQL state class, and broken JSON.
PERMANENT_STATES = ("22", "23", "42")
PERMANENT_NAMES = ("DataIntegrityViolation", "JSONDecodeError", "JsonProcessingException", "MALFORMED_RECORD")
MESSAGE = 1000


def is_permanent(error: BaseException | None) -> bool:
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        state = getattr(error, "getSqlState", lambda: None)() or getattr(error, "sqlstate", None) or ""
        if str(state)[:2] in PERMANENT_STATES or any(n in type(error).__name__ or n in str(error) for n in PERMANENT_NAMES):
            return True
        error = error.__cause__ or error.__context__
    return False


def _existing(df: DataFrame, path: str, columns: list[str]) -> DataFrame | None:
    kept = [df.schema[c] for c in columns]
    try:
        return df.sparkSession.read.schema(StructType([*kept, StructField("batch_id", LongType())])).parquet(path)
    except AnalysisException:
        return None


def append_once(df: DataFrame, path: str, key: str, batch_id: int, day: str | None = None) -> None:
    """Rows whose key no other batch has written, under batch_id; the same batch again replaces its own rows.

    day: a column by which the target is partitioned, the same for a key whenever it comes; then only the days of this batch are looked at and
    written, however much there is of others. Rows without a day are kept in a partition of their own.
    """
    rows = df.dropDuplicates([key])
    old = _existing(df, path, [key] if day is None else [key, day])
    if day is None:
        if old is not None:
            rows = rows.join(old.where(F.col("batch_id") != batch_id).select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    if old is not None:
        days = [r[0] for r in rows.select(day).distinct().collect()]  # as many as a batch has days
        rows = rows.join(of_days(old, day, days).where(F.col("batch_id") != batch_id).select(key), key, "left_anti")
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch_id").parquet(path)


def of_days(df: DataFrame, day: str, days: list) -> DataFrame:
    """The partitions of these days."""
    some = F.col(day).isin([d for d in days if d is not None])
    return df.where(some | F.col(day).isNull() if None in days else some)


def failed_rows(df: DataFrame, error: BaseException) -> DataFrame:
    """Rows for the failure table: the row as JSON, and the error's type and message, cut to length."""
    body = F.to_json(F.struct("*"))
    return df.select("event_id", body.alias("payload"), F.lit(type(error).__name__).alias("exception_type"), F.substring(F.lit(str(error)), 1, MESSAGE).alias("exception_message"), F.current_timestamp().alias("failed_at"))


def guarded(write: Callable[[DataFrame, int], None], failures: str, retries: int = 2, pause: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: transient errors are tried again and then fail the query, which its checkpoint restarts; batches with a
    permanent fault go to the failure table as a whole."""

    def run(df: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                return write(df, batch_id)
            except Exception as error:
                if is_permanent(error):
                    return append_once(failed_rows(df, error), failures, "event_id", batch_id)
                if attempt == retries:
                    raise
                time.sleep(pause)

    return run


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], failures: str, trigger: dict | None = None, retries: int = 2, pause: float = 1.0):
    return df.writeStream.foreachBatch(guarded(write, failures, retries, pause)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
