"""The outbox as messages: a stream of its rows, sent by key in order, rows that can't be sent parked one by one.

Rows of a key go through one task, in the order of their time. A fault of a row (see sinks.is_permanent) parks that row with its reason and
the others go on; any other error fails the batch, and `supervised` starts the query again after a pause. What was sent is kept by batch, so a
batch that comes again after a restart sends only what it had not sent for good: at least once, as a broker without transactions allows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

Send = Callable[[str, str], None]
RESULT = "alert_id string, aggregateid string, payload string, day string, fault string"
# fixed values: pauses between restarts, in seconds
FIRST_PAUSE, FACTOR, LONGEST_PAUSE, ALL_PAUSES = 0.5, 2.0, 10.0, 60.0


def _sent(connect: Callable[[], Send]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = None
        for batch in batches:
            send = send or connect()
            faults = []
            for key, value in zip(batch.column("aggregateid").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                try:
                    send(key, value)
                    faults.append(None)
                except Exception as error:
                    if not sinks.is_permanent(error):
                        raise
                    faults.append(f"{type(error).__name__}: {error}"[: sinks.MESSAGE])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(faults, pa.string())], [*batch.schema.names, "fault"])

    return run


def publish(rows: DataFrame, connect: Callable[[], Send], target: str, batch_id: int) -> None:
    """Sends the outbox rows of a batch, in order of time within each key, and keeps target/sent and target/parked.

    connect is called once a task and gives the function that sends a key and a payload.
    """
    spark = rows.sparkSession
    kept = spark.read.schema(RESULT + ", batch_id bigint")
    todo = rows.dropDuplicates(["alert_id"])
    try:
        done = kept.parquet(f"{target}/sent").where(F.col("fault").isNull())
        days = [r[0] for r in todo.select("day").distinct().collect()]  # as many as a batch has days
        todo = todo.join(sinks.of_days(done, "day", days).select("alert_id"), "alert_id", "left_anti")
    except AnalysisException:  # nothing has been sent yet
        pass
    ordered = todo.repartition("aggregateid").sortWithinPartitions("aggregateid", "created_time", "alert_id")
    sent = ordered.select("alert_id", "aggregateid", "payload", "day").mapInArrow(_sent(connect), RESULT)
    # written by this one action, so that each row is sent once an attempt; rows of an attempt that failed halfway may be sent again
    sent.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{target}/sent")
    faults = kept.parquet(f"{target}/sent").where((F.col("batch_id") == batch_id) & F.col("fault").isNotNull()).drop("batch_id")
    sinks.append_once(faults, f"{target}/parked", "alert_id", batch_id, day="day")


def run_outbox(spark: SparkSession, outbox: str, target: str, connect: Callable[[], Send], trigger: dict | None = None, files: int = 1000):
    """A query over the outbox that `job` keeps, as it grows."""
    schema = "alert_id string, aggregateid string, created_time timestamp_ntz, payload string, day string, batch_id bigint"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(outbox).drop("batch_id")
    writer = rows.writeStream.foreachBatch(lambda batch, batch_id: publish(batch, connect, target, batch_id))
    return writer.option("checkpointLocation", f"{target}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def supervised(start: Callable[[], object], first: float = FIRST_PAUSE, factor: float = FACTOR, longest: float = LONGEST_PAUSE, total: float = ALL_PAUSES, sleep: Callable[[float], None] = time.sleep) -> int:
    """Starts a query and waits for its end; after a failure that may pass, starts it again, after pauses that grow. Pauses begin anew once a
    batch has got through. Gives how often it was started; raises the last failure if it is permanent or the pauses are used up."""
    starts, pause, paused = 0, first, 0.0
    while True:
        query = start()
        starts += 1
        try:
            query.awaitTermination()
            return starts
        except Exception as error:
            if query.lastProgress is not None and query.lastProgress.numInputRows:
                pause, paused = first, 0.0
            if sinks.is_permanent(error) or paused + pause > total:
                raise
            sleep(pause)
            paused, pause = paused + pause, min(longest, pause * factor)
