import sqlite3

import pytest
from pyspark.sql import functions as F

from meterlake.operators import alerts as outbox
from meterlake.plans.catalog import Domain
from meterlake.sources import database
from meterlake.streaming import job, sinks

CONNECT = "sqlite3:connect"


def rows(spark, *ids, parts=3):
    df = spark.createDataFrame([(f"e{i}", i, None if i % 2 else i * 10, i % 3 == 0) for i in ids], "event_id string, n int, amount bigint, ok boolean")
    return df.withColumn("at", F.lit("2024-01-02 03:04:05.000006").cast("timestamp_ntz")).repartition(parts, "event_id")


def content(path, what="event_id, n, amount"):
    return sorted(sqlite3.connect(path).execute(f"SELECT {what} FROM applied").fetchall())


def append(df, path, batch):
    database.append(df, CONNECT, path, "applied", "event_id", batch)


@pytest.fixture
def paths(spark, tmp_path):
    out = [str(tmp_path / f"{n}.db") for n in ("usage", "alerts")]
    for path in out:
        database.defined(spark, rows(spark, 1), CONNECT, path, "applied", "event_id")
        database.defined(spark, rows(spark, 1), CONNECT, path, "applied", "event_id")
    return out


def test_a_batch_is_there_once_and_keys_too(spark, paths):
    path = paths[0]
    append(rows(spark, 1, 2, 2, 3), path, 0)
    append(rows(spark, 1, 2, 3), path, 0)  # the batch again
    append(rows(spark, 3, 4), path, 1)  # a key again
    append(rows(spark), path, 2)
    assert content(path) == [("e1", 1, None), ("e2", 2, 20), ("e3", 3, None), ("e4", 4, 40)]
    assert content(path, "ok, at")[0] == (0, "2024-01-02 03:04:05.000006")
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*) FROM applied_stage").fetchone() == (0,) and db.execute("SELECT batch FROM batches ORDER BY 1").fetchall() == [(0,), (1,), (2,)]


def test_a_crash_between_two_databases_leaves_no_double_and_no_gap(spark, paths, tmp_path):
    """The second database fails for good at first; the batch comes again as a whole."""
    usage, alerts = paths
    fails = [True]

    def write(batch, batch_id):
        append(batch, usage, batch_id)
        if fails.pop() if fails else False:
            raise RuntimeError("the driver dies between the two commits")
        append(batch, alerts, batch_id)

    source = str(tmp_path / "in")
    rows(spark, *range(50)).write.parquet(source)
    stream = lambda: sinks.start(spark.readStream.schema(rows(spark, 1).schema).parquet(source), str(tmp_path / "c"), write, str(tmp_path / "failed"), retries=0)
    with pytest.raises(Exception, match="dies between"):
        stream().awaitTermination()
    assert len(content(usage)) == 50 and content(alerts) == []
    stream().awaitTermination()
    assert content(usage) == content(alerts) and len(content(usage)) == 50


def test_a_task_that_fails_leaves_nothing(spark, paths):
    path = paths[0]
    broken = rows(spark, 1, 2, 3).withColumn("n", F.when(F.col("event_id") == "e2", F.raise_error(F.lit("broken"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        append(broken, path, 0)
    assert content(path) == []
    append(rows(spark, 1, 2, 3), path, 0)
    assert len(content(path)) == 3


def test_applied_rows_and_alerts_go_to_their_databases(spark, tmp_path):
    d = Domain(spark, "/root/testdata/sf0.001")
    usage, alert = (str(tmp_path / f"{n}.db") for n in ("usage", "alert"))
    batch = d.allocated.withColumns({"refused": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    job.define_databases(batch, CONNECT, usage, alert)
    write = job.write_databases(CONNECT, usage, alert)
    write(batch, 0)
    write(batch, 0)
    read = lambda path, what: sorted(sqlite3.connect(path).execute(what).fetchall())
    assert read(usage, "SELECT event_id, plan_used, gift_detail_json FROM applied_log") == sorted(map(tuple, d.log.select("event_id", "plan_used", "gift_detail_json").collect()))
    want = outbox.with_payload(outbox.outbox(d.allocated)).select("alert_id", "aggregateid", "payload").collect()
    assert read(alert, "SELECT alert_id, aggregateid, payload FROM outbox") == sorted(map(tuple, want))
