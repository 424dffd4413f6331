import json
import os

import pytest
from pyspark.sql import functions as F

from meterlake.operators import rollups
from meterlake.plans.catalog import Domain
from meterlake.streaming import projection, publisher, sinks

SMALL = "/root/testdata/sf0.001"
BOX = "alert_id string, aggregateid string, created_time timestamp_ntz, payload string, day string"


def outbox(spark, *rows):
    df = spark.createDataFrame([(a, k, f"2024-01-01 00:00:{t:02d}", json.dumps({"n": a})) for a, k, t in rows], "alert_id string, aggregateid string, at string, payload string")
    return df.select("alert_id", "aggregateid", F.col("at").cast("timestamp_ntz").alias("created_time"), "payload", F.lit("20240101").alias("day"))


class DataIntegrityViolation(Exception):
    pass


def recorder(path, poison=(), broken=None):
    """A broker that is a file: refuses some rows for good, and, as long as a file named `broken` is there, fails on its rows."""

    def connect():
        def send(key, value):
            n = json.loads(value)["n"]
            if n in poison:
                raise DataIntegrityViolation(f"{n} is too odd")
            if broken and n == "e" and os.path.exists(broken):
                raise ConnectionError("lost")
            with open(path, "a") as f:
                f.write(f"{key} {n}\n")

        return send

    return connect


def test_rows_go_by_key_in_order_and_poison_is_parked_alone(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "t")
    rows = outbox(spark, ("c", "k1", 3), ("a", "k1", 1), ("b", "k1", 2), ("x", "k2", 1), ("y", "k2", 2), ("a", "k1", 1))
    for _ in range(2):  # a batch that comes again sends nothing twice but what was refused
        publisher.publish(rows, recorder(log, poison=("b",)), target, 0)
    sent = open(log).read().split("\n")[:-1]
    assert [s for s in sent if s.startswith("k1")] == ["k1 a", "k1 c"] and [s for s in sent if s.startswith("k2")] == ["k2 x", "k2 y"]
    parked = spark.read.parquet(f"{target}/parked").collect()
    assert [(r.alert_id, r.fault) for r in parked] == [("b", "DataIntegrityViolation: b is too odd")]


def test_a_broker_that_is_away_is_tried_again_after_growing_pauses(spark, tmp_path):
    box, log, target, broken = (str(tmp_path / n) for n in ("box", "log", "t", "broken"))
    sinks.append_once(outbox(spark, ("a", "k1", 1), ("e", "k1", 2), ("f", "k1", 3)), box, "alert_id", 0, day="day")
    open(broken, "w").close()
    pauses = []

    def sleep(seconds):
        pauses.append(seconds)
        if len(pauses) == 3:
            os.remove(broken)

    starts = publisher.supervised(lambda: publisher.run_outbox(spark, box, target, recorder(log, broken=broken)), sleep=sleep)
    assert starts == 4 and pauses == [0.5, 1.0, 2.0]
    sent = [s.split()[1] for s in open(log).read().split("\n")[:-1]]
    assert sorted(set(sent)) == ["a", "e", "f"] and sent.index("a") < sent.index("e") < sent.index("f") and sent[-2:] == ["e", "f"]


def test_pauses_are_bounded():
    class Query:
        lastProgress = None

        def awaitTermination(self):
            raise RuntimeError("still away")

    pauses = []
    with pytest.raises(RuntimeError):
        publisher.supervised(Query, sleep=pauses.append)
    assert pauses == [0.5, 1.0, 2.0, 4.0, 8.0, 10.0, 10.0, 10.0, 10.0] and sum(pauses) <= 60


@pytest.mark.parametrize("parts", [1, 4])
def test_totals_equal_a_rebuild_after_any_split(spark, tmp_path, parts):
    """Batches by hash, so that each has late rows of all months."""
    d = Domain(spark, SMALL)
    log, target = str(tmp_path / "log"), str(tmp_path / "t")
    rows = d.allocated.drop("gift_parts").withColumn("gift_parts", F.expr("cast(array() as array<struct<gift_id:string,take:bigint>>)")).persist()
    listed = lambda df: sorted(map(tuple, df.select("sub_id", "yyyymm", *projection.SUMS).collect()))
    assert projection.totals(spark, target).count() == 0
    for b in range(parts):
        sinks.append_once(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == b), log, "event_id", b, day="yyyymmdd")
        assert projection.advance(spark, log, target) == b
    assert listed(projection.totals(spark, target)) == listed(rollups.rebuild(d.log))
    assert projection.advance(spark, log, target) == parts - 1  # nothing new
    assert listed(projection.totals(spark, target)) == listed(rollups.rebuild(d.log))
    rows.unpersist()


def test_a_crash_before_the_marks_changes_nothing(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "t")
    row = ("e{}", 1, 2, 3, "2024-01-0{} 00:00:00", "202401", "2024010{}", 10, 0, 4, 3, 3)
    schema = "event_id string, sub_id bigint, family_id bigint, app_id bigint, at string, yyyymm string, yyyymmdd string, bytes bigint, gift_take bigint, plan_take bigint, family_take bigint, overflow bigint"
    for b in range(3):
        df = spark.createDataFrame([tuple(x.format(b + 1) if isinstance(x, str) else x for x in row)], schema)
        df = df.withColumn("kst", F.col("at").cast("timestamp_ntz")).withColumn("gift_parts", F.expr("cast(null as array<struct<gift_id:string,take:bigint>>)"))
        sinks.append_once(df, log, "event_id", b, day="yyyymmdd")
    total = lambda: [(r.total_used, r.plan_used) for r in projection.totals(spark, target).collect()]
    assert projection.advance(spark, log, target, most=0) == 0 and total() == [(10, 4)]
    projection.advance(spark, log, target)
    assert total() == [(30, 12)]
    import shutil

    shutil.rmtree(f"{target}/marks/upto=2")  # as if the marks had not been written
    assert total() == [(10, 4)]
    assert projection.advance(spark, log, target) == 2 and total() == [(30, 12)]
