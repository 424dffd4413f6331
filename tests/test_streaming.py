import json
import os
import time

import pytest
from pyspark.sql import functions as F

from meterlake.functions import policy_text, timekeys
from meterlake.operators import alerts, allocate, versioned
from meterlake.plans.catalog import Domain
from meterlake.sources import decode
from meterlake.streaming import job, metrics, sinks

SMALL = "/root/testdata/sf0.001"


ROWS = [
    "event_id", "gift_take", "plan_take", "family_take", "overflow", "plan_limit", "plan_used", "plan_alert", "family_limit", "family_used", "family_alert",
]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def put(folder, number, texts):
    """A file of lines; files are read in the order of their times."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/part-{number}.txt"
    with open(path, "w") as f:
        f.write("".join(t + "\n" for t in texts))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def stored(d):
    return versioned.stored_subscribers(d.plans, d.gifts), versioned.stored_families(d.families, d.members)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    """Several batches, subscribers who move between families, repeats that come batches later, invalid messages."""
    d = Domain(spark, SMALL)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(r.arrival_seq, r.occurred_at, r.value) for r in d.raw.select("arrival_seq", "occurred_at", decode.encoded_usage().alias("value")).collect()]
    days = sorted(r[1] for r in rows)
    cuts = [days[len(days) // 3], days[2 * len(days) // 3]]
    for i in range(3):
        put(source, i, [v for seq, at, v in rows if seq < 10**9 and sum(at >= c for c in cuts) == i])
    put(source, 3, [v for seq, _, v in rows if seq >= 10**9])
    subscribers, families = stored(d)
    progress = metrics.Progress()
    spark.streams.addListener(progress)
    query = job.run_files(spark, source, target, subscribers, families, files=1)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    assert listed(spark.read.parquet(f"{target}/applied"), *ROWS) == listed(d.allocated, *ROWS)
    box, want = spark.read.parquet(f"{target}/outbox"), alerts.with_payload(alerts.outbox(d.allocated))
    assert listed(box, *want.columns) == listed(want, *want.columns)
    bad = {r.message for r in spark.read.parquet(f"{target}/refused").where("refused = 'INVALID_BYTES'").collect()}
    assert bad == {v for _, _, v in rows if json.loads(v)["bytes"] <= 0}
    tallies = [o.asDict() for p in query.recentProgress for name, o in p.observedMetrics.items() if name == "usage_intake"]
    assert sum(t["ok"] + t["refused"] for t in tallies) == len(rows)
    assert sum(t["refused"] for t in tallies) == sum(json.loads(v)["bytes"] <= 0 for _, _, v in rows)
    put(source, 9, [v for _, _, v in rows])  # everything again
    job.run_files(spark, source, target, subscribers, families, files=1).awaitTermination()
    assert spark.read.parquet(f"{target}/applied").count() == d.allocated.count() and spark.read.parquet(f"{target}/outbox").count() == want.count()
    spark.streams.removeListener(progress)


def test_stream_goes_on_from_what_a_batch_has_used(spark, tmp_path):
    d = Domain(spark, SMALL)
    done = d.allocated.where("yyyymmdd < '20240121'").persist()
    plan_used = done.groupBy("sub_id", F.col("yyyymm").alias("period")).agg(F.sum("plan_take").alias("amount"))
    plan_used = plan_used.unionByName(done.groupBy("sub_id", F.col("yyyymmdd").alias("period")).agg(F.sum("plan_take").alias("amount")))
    gift_used = allocate.split_gifts(done).groupBy("sub_id", "gift_id", "yyyymm").agg(F.sum("take").alias("amount"))
    own = done.where("family_id > 0")
    pool_used = own.groupBy("family_id", "yyyymm").agg(F.sum("family_take").alias("amount"))
    member_used = own.groupBy("family_id", "sub_id", "yyyymm").agg(F.sum("family_take").alias("amount"))
    subscribers = versioned.stored_subscribers(d.plans, d.gifts, plan_used, gift_used)
    families = versioned.stored_families(d.families, d.members, None, pool_used, member_used)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put(source, 0, [r.value for r in d.events.where("yyyymmdd >= '20240121'").select(decode.encoded_usage().alias("value")).collect()])
    job.run_files(spark, source, target, subscribers, families).awaitTermination()
    assert listed(spark.read.parquet(f"{target}/applied"), *ROWS) == listed(d.allocated.where("yyyymmdd >= '20240121'"), *ROWS)
    done.unpersist()


def usage(event, sub, family, amount, at):
    return json.dumps({"eventId": event, "subId": sub, "familyId": family, "bytes": amount, "appId": "1", "occurredAt": at + "Z"})


GIB5 = 5 * 1024 * 1024


def test_changes_act_on_later_events_and_once(spark, tmp_path):
    source, changes, target = (str(tmp_path / n) for n in ("in", "changes", "out"))
    plans = spark.createDataFrame([(1, 100), (2, 50)], "sub_id bigint, plan_limit bigint")
    gifts = spark.createDataFrame([], "sub_id bigint, gift_id string, yyyymm string, gift_limit bigint, score int")
    families = spark.createDataFrame([(7, 10)], "family_id bigint, family_limit bigint")
    members = spark.createDataFrame([(7, 1, 0), (7, 2, 8)], "family_id bigint, sub_id bigint, member_limit bigint")
    subscribers, pools = versioned.stored_subscribers(plans, gifts), versioned.stored_families(families, members)
    batches = [
        ([usage("a1", 1, 7, 104, "2024-01-10T00:00:00"), usage("a2", 2, 7, 70, "2024-01-10T00:00:01")], []),
        (
            [usage("b1", 1, 7, 100, "2024-01-11T00:00:00"), usage("b2", 2, 7, GIB5, "2024-01-11T00:00:01")],
            [
                {"type": "PLAN_CHANGED", "eventId": "p", "subId": 1, "planLimit": 150},
                {"type": "FAMILY_MEMBER_ADDED", "eventId": "m", "familyId": 7, "subId": 3},
                {"type": "FAMILY_SUB_LIMIT_CHANGED", "eventId": "l", "familyId": 7, "subId": 2, "newLimit": 1000},
                {"type": "GIFT_RECEIVED", "eventId": "g", "receiverSubId": 2, "giverSubId": 1, "giftId": "g1", "giftLimitBytes": 30, "giftAmountBytes": 30, "yyyyMM": "202401", "yyyyMMDD": "20240111"},
                {"type": "PLAN_CHANGED", "eventId": "bad", "subId": 1},
            ],
        ),
        # ids that have come before change nothing, though they say something else
        ([usage("c1", 1, 7, 10, "2024-01-12T00:00:00")], [{"type": "PLAN_CHANGED", "eventId": "p", "subId": 1, "planLimit": 9999}, {"type": "FAMILY_MEMBER_ADDED", "eventId": "m", "familyId": 7, "subId": 4}]),
    ]
    put(changes, 0, [])
    for i, (events, news) in enumerate(batches):
        put(source, i, events)
        put(changes, i + 1, [json.dumps(n) for n in news])
        job.run_files(spark, source, target, subscribers, pools, changes).awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(f"{target}/applied").collect()}
    short = {k: (r.gift_take, r.plan_take, r.family_take, r.overflow, r.plan_limit, r.family_limit) for k, r in got.items()}
    assert short == {
        "a1": (0, 100, 4, 0, 100, 10),
        "a2": (0, 50, 6, 14, 50, 10),  # the pool is out before the member's cap
        "b1": (0, 50, 50, 0, 150, 10 + GIB5),
        "b2": (30, 0, 994, GIB5 - 1024, 50, 10 + GIB5),  # 6 of 1000 were used
        "c1": (0, 0, 10, 0, 150, 10 + GIB5),
    }
    assert [(r.event_id, r.refused) for r in spark.read.parquet(f"{target}/refused").collect()] == [("bad", "MISSING_FIELD")]


def test_counters_expire_and_late_events_count_in_their_month(spark, tmp_path):
    source, target = (str(tmp_path / n) for n in ("in", "out"))
    plans = spark.createDataFrame([(1, 100)], "sub_id bigint, plan_limit bigint")
    none = spark.createDataFrame([], "sub_id bigint, gift_id string, yyyymm string, gift_limit bigint, score int")
    families = versioned.stored_families(spark.createDataFrame([], "family_id bigint, family_limit bigint"), spark.createDataFrame([], "family_id bigint, sub_id bigint, member_limit bigint"))
    put(source, 0, [usage("a", 1, 0, 60, "2024-03-10T00:00:00")])
    put(source, 1, [usage("late", 1, 0, 70, "2024-01-02T00:00:00"), usage("b", 1, 0, 60, "2024-03-11T00:00:00")])
    job.run_files(spark, source, target, versioned.stored_subscribers(plans, none), families, files=1).awaitTermination()
    took = lambda: {r.event_id: (r.yyyymm, r.plan_take) for r in spark.read.parquet(f"{target}/applied").collect()}
    assert took() == {"a": ("202403", 60), "late": ("202401", 70), "b": ("202403", 40)}
    source, target = (str(tmp_path / n) for n in ("in2", "out2"))
    for i in range(2):
        put(source, i, [usage(f"e{i}", 1, 0, 60, "2024-03-10T00:00:00")])
        job.run_files(spark, source, target, versioned.stored_subscribers(plans, none), families, used_seconds=1, level_seconds=1).awaitTermination()
        time.sleep(2)
    assert took() == {"e0": ("202403", 60), "e1": ("202403", 60)}


def test_days_bound_what_a_batch_looks_at(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, day string, n int")
    sinks.append_once(rows(("a", "20240101", 1), ("b", "20240102", 1), ("c", None, 1)), path, "k", 0, day="day")
    sinks.append_once(rows(("a", "20240101", 2), ("d", "20240101", 2), ("c", None, 2)), path, "k", 1, day="day")
    sinks.append_once(rows(("a", "20240101", 2), ("d", "20240101", 2), ("c", None, 2)), path, "k", 1, day="day")
    assert listed(spark.read.parquet(path), "k", "n") == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    plan = sinks.of_days(spark.read.parquet(path), "day", ["20240101"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "20240101" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_times_hold_in_any_session_zone(spark):
    text = '{"eventId": "e", "subId": 1, "bytes": 5, "appId": 3, "occurredAt": "%s"}'
    rows = spark.createDataFrame([(text % "2024-01-20T00:00:00Z",), (text % "2024-01-20T00:00:00",), (text % "2024-01-20T09:00:00.123456+09:00",)], "value string")
    ends = spark.createDataFrame([("2024-01-20T10:00:30",)], "end string")
    before, got = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "Asia/Seoul", "Europe/London"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            times = [str(r[0]) for r in decode.usage(rows).select("occurred_at").collect()]
            epoch = timekeys.time_parts(F.to_timestamp_ntz(F.lit("2024-07-20 09:00:30")))["epoch"]
            got.append((times, *ends.select(policy_text.once_end_epoch(F.col("end")), epoch).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(["2024-01-20 00:00:00", "2024-01-20 00:00:00", "2024-01-20 00:00:00.123456"], 1705712430, 1721433630)] * 3


def test_append_once_and_failures(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "event_id string, n int")
    sinks.append_once(a, path, "event_id", 0)
    sinks.append_once(a, path, "event_id", 0)
    sinks.append_once(spark.createDataFrame([("y", 9), ("z", 3)], "event_id string, n int"), path, "event_id", 1)
    assert sorted((r.event_id, r.n) for r in spark.read.parquet(path).collect()) == [("x", 1), ("y", 2), ("z", 3)]

    class DataIntegrityViolation(Exception):
        pass

    def broken(df, batch_id):
        raise DataIntegrityViolation("k" * 2000)

    sinks.guarded(broken, str(tmp_path / "failed"))(a, 5)
    rows = spark.read.parquet(str(tmp_path / "failed")).collect()
    assert {r.event_id for r in rows} == {"x", "y"} and all(len(r.exception_message) == 1000 for r in rows)
    assert json.loads(rows[0].payload)["event_id"] == rows[0].event_id

    tries = []

    def shaky(df, batch_id):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("connection lost")

    sinks.guarded(shaky, str(tmp_path / "none"), pause=0)(a, 6)
    assert len(tries) == 3
