"""From messages to the applied log and the outbox, as one streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import alerts, intake
from meterlake.sources import database, decode

from . import metrics, sinks, waterfall

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 day"


def parsed(messages: DataFrame) -> DataFrame:
    """Usage messages with `arrived`, when the source or the batch took them, `message`, their text, and the reason of refused ones."""
    arrived = F.col("timestamp") if "timestamp" in messages.columns else F.current_timestamp()
    rows = messages.select(F.col("value").cast("string").alias("value"), F.col("value").cast("string").alias("message"), arrived.alias("arrived"))
    rows = decode.usage(rows).withColumn("refused", intake.reason())
    late = F.col("occurred_at").cast("timestamp") < F.col("arrived") - F.expr(f"interval {LATE}")
    return metrics.tallied(rows, "usage_intake", ok=F.col("refused").isNull(), refused=F.col("refused").isNotNull(), late=F.col("refused").isNull() & late)


def parsed_changes(messages: DataFrame) -> DataFrame:
    """Change messages with the reason of refused ones. Those of a batch go in order of `seq`: the source's offset where it has one, else the
    order of their event ids."""
    rows = messages.select(F.col("value").cast("string").alias("value"), F.col("value").cast("string").alias("message"), (F.col("offset") if "offset" in messages.columns else F.lit(0)).cast("bigint").alias("seq"))
    rows = decode.control(rows)
    return rows.withColumn("refused", decode.refused(rows))


def applied(messages: DataFrame, subscribers: DataFrame, families: DataFrame, changes: DataFrame | None = None, **seconds: int) -> DataFrame:
    """messages (value: JSON; timestamp, offset where the source has them) -> applied rows, and refused messages of both streams as rows with
    `refused`, the reason, and `message`. changes: messages of changes. subscribers, families: see versioned.stored_*."""
    conf = messages.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # state that may expire by the clock asks for one batch more after each, without end; it is cleared with the next data just as well
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    usage = parsed(messages)
    good = waterfall.once_by_arrival(usage.where("refused is null").drop("refused", "message"))
    control = None if changes is None else parsed_changes(changes)
    rows = waterfall.apply(intake.with_keys(good), subscribers, families, None if control is None else control.where("refused is null"), **seconds)
    bad = usage.where("refused is not null").select("event_id", "refused", "message")
    if control is not None:
        bad = bad.unionByName(control.where("refused is not null").select("event_id", "refused", "message"))
    return rows.unionByName(bad, allowMissingColumns=True)


def write_to(target: str):
    """A foreachBatch function: applied rows and whole outbox rows by day, refused messages with their reason, each once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.where("refused is null").drop("refused", "message")
            sinks.append_once(rows, f"{target}/applied", "event_id", batch_id, day="yyyymmdd")
            box = alerts.with_payload(alerts.outbox(rows)).withColumn("day", F.date_format("created_time", "yyyyMMdd"))
            sinks.append_once(box, f"{target}/outbox", "alert_id", batch_id, day="day")
            refused = batch.where("refused is not null").select(F.sha2("message", 256).alias("message_id"), "event_id", "refused", "message", F.date_format(F.current_timestamp(), "yyyyMMdd").alias("day"))
            sinks.append_once(refused, f"{target}/refused", "message_id", batch_id, day="day")
        finally:
            batch.unpersist()

    return write


def _database_rows(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = batch.where("refused is null").drop("refused", "message")
    return alerts.applied_log(rows), alerts.with_payload(alerts.outbox(rows))


def define_databases(batch: DataFrame, connect: str, usage: str, alert: str) -> None:
    """Makes the tables that `write_databases` needs and that are not there."""
    log, box = _database_rows(batch)
    database.defined(batch.sparkSession, log, connect, usage, "applied_log", "event_id")
    database.defined(batch.sparkSession, box, connect, alert, "outbox", "alert_id")


def write_databases(connect: str, usage: str, alert: str):
    """A foreachBatch function: the applied log into one database, the outbox into another, each in one transaction a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            log, box = _database_rows(batch)
            database.append(log, connect, usage, "applied_log", "event_id", batch_id)
            database.append(box, connect, alert, "outbox", "alert_id", batch_id)
        finally:
            batch.unpersist()

    return write


def run(messages: DataFrame, target: str, subscribers: DataFrame, families: DataFrame, changes: DataFrame | None = None, trigger: dict | None = None, write=None, **seconds: int):
    """Starts the query over any streams of messages, Kafka topics or files. write: where batches go, folders below target by default."""
    return sinks.start(applied(messages, subscribers, families, changes, **seconds), f"{target}/checkpoint", write or write_to(target), f"{target}/failed", trigger)


def run_files(spark: SparkSession, source: str, target: str, subscribers: DataFrame, families: DataFrame, changes: str | None = None, trigger: dict | None = None, files: int = 1000, **seconds: int):
    """Reads JSON lines files as they come, at most `files` a batch, and keeps target/applied, outbox, refused and failed; a replay changes
    nothing. changes: a folder of change messages."""
    lines = lambda path: spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(path)
    return run(lines(source), target, subscribers, families, lines(changes) if changes else None, trigger, **seconds)


def run_topics(spark: SparkSession, servers: str, usage: str, changes: list[str], target: str, subscribers: DataFrame, families: DataFrame, trigger: dict | None = None, **options: str):
    """Reads topics: usage and, together, those of family and subscription changes."""
    control = decode.kafka(spark, servers, ",".join(changes), **options) if changes else None
    return run(decode.kafka(spark, servers, usage, **options), target, subscribers, families, control, trigger)
