import datetime
import decimal
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.operators import versioned
from meterlake.operators.machines import STORED_MEMBER, STORED_POOL, Family, Store, Subscriber, folded, values
from meterlake.plans.catalog import Domain

SMALL = "/root/testdata/sf0.001"
GIB5 = 5 * 1024 * 1024


def change(kind, **fields):
    return kind, {k: fields.get(k) for k in ("sub_id", "amount", "name", "yyyymm", "score", "mode", "members", "priorities")}


def state(*changes):
    machine = Family(Store())
    for kind, c in changes:
        machine.change(kind, c)
    rows = machine.members()
    return machine, {r["sub_id"]: (r["member_limit"], r["score"]) for r in rows}, {r["family_limit"] for r in rows}


def priority(*pairs):
    return change("FAMILY_MODE_CHANGED", mode="PRIORITY", priorities=[{"subId": s, "priority": p} for s, p in pairs])


def test_kinds_of_family_changes_bear_on_each_other():
    base = [change(STORED_POOL, amount=7), change(STORED_MEMBER, sub_id=1, amount=-1), change(STORED_MEMBER, sub_id=2, amount=3)]
    added, removed = (lambda s, k=k: change(k, sub_id=s) for k in ("FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED"))
    limit = lambda s, x: change("FAMILY_SUB_LIMIT_CHANGED", sub_id=s, amount=x)
    # who is there can't join, who isn't can't leave
    assert state(*base, added(1), removed(9))[1:] == ({1: (-1, None), 2: (3, None)}, {7})
    # a removal takes a share of the limit but not below 0, and the member's own limit; who comes back gets the limit of then
    assert state(*base, limit(1, 55), removed(1), added(1))[1:] == ({1: (GIB5, None), 2: (3, None)}, {GIB5})
    # places close up, equal ones stay equal, a newcomer goes behind
    assert state(*base, priority((1, 0), (2, 1), (3, 1)), removed(1), added(4))[1] == {2: (3, 0), 4: (GIB5, 1)}
    # when the last listed member leaves there is no order any more
    assert state(*base, priority((1, 0)), removed(1), added(4))[1] == {2: (3, None), 4: (GIB5, None)}
    assert state(*base, priority((1, 0)), priority())[1] == {1: (-1, None), 2: (3, None)}
    assert state(*base, priority((1, 0)), change("FAMILY_MODE_CHANGED", mode="FIFO"))[1] == {1: (-1, None), 2: (3, None)}
    # a creation between other changes sets the limit anew, and those it names, beside those there are
    created = change("FAMILY_CREATE", members=[2, 5])
    assert state(*base, limit(2, 9), created, removed(1))[1:] == ({2: (2 * GIB5, None), 5: (2 * GIB5, None)}, {GIB5})
    # a limit set for a stranger is kept, until the stranger joins
    machine, members, _ = state(*base, limit(8, 4))
    assert 8 not in members and machine.limits["member|8"] == "4"


def test_a_plan_changes_between_monthly_and_daily():
    s = Subscriber(Store())
    took = lambda amount, day: s.usage(amount, "202401", f"202401{day:02d}")["plan_take"]
    s.change(*change("PLAN_CHANGED", amount=100))
    assert took(60, 1) == 60
    s.change(*change("PLAN_CHANGED", amount=1048576))
    assert took(1048576, 1) == 1048576 - 60  # the day has used 60
    assert took(10, 2) == 10
    s.change(*change("PLAN_CHANGED", amount=1048580))
    assert took(10, 2) == 0  # the month has used 1048576 + 10
    s.change(*change("PLAN_CHANGED", amount=-1))
    assert took(5, 2) == 5


def test_gifts_go_behind_those_there_are():
    s = Subscriber(Store())
    s.change(*change("STORED_GIFT", name="b", yyyymm="202401", amount=10, score=4))
    s.change(*change("GIFT_RECEIVED", name="a", yyyymm="202401", amount=10))
    s.change(*change("GIFT_RECEIVED", name="c", yyyymm="202402", amount=10))
    out = s.usage(15, "202401", "20240101")
    assert [(g["giftId"], g["usedAmount"], g["fired"]) for g in json.loads(out["gift_detail"])] == [("b", 10, 0), ("a", 5, 50)]


def test_without_changes_it_is_the_closed_form(spark):
    d = Domain(spark, SMALL)
    rows = versioned.allocate(d.events, d.limit_changes.where("false"), versioned.stored_subscribers(d.plans, d.gifts), versioned.stored_families(d.families, d.members))
    columns = [c for c in rows.columns if c != "gift_parts"]
    listed = lambda df: sorted(map(str, df.select(*columns, F.to_json("gift_parts").alias("g")).collect()))
    assert listed(rows) == listed(d.allocated)


@pytest.mark.parametrize("events", [0, 1])
def test_empty_tables(spark, events):
    d = Domain(spark, SMALL)
    some = d.events.limit(events)
    none = versioned.allocate(some, d.limit_changes.limit(0), versioned.stored_subscribers(d.plans.limit(0), d.gifts.limit(0)), versioned.stored_families(d.families.limit(0), d.members.limit(0)))
    assert [(r.gift_take, r.plan_take, r.family_take, r.overflow == r.bytes) for r in none.collect()] == [(0, 0, 0, True)] * events
    assert versioned.family_final(d.limit_changes.limit(0), versioned.stored_families(d.families.limit(0), d.members.limit(0))).count() == 0


def test_a_key_is_folded_across_batches_after_one_exchange(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("key"), "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = folded(rows, "key", ["id"], lambda s, r: s.append(r["id"]) or (), list, lambda k, s: [{"key": k, "n": len(s), "ok": s == sorted(s)}], "key bigint, n bigint, ok boolean")
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(tuple, out.collect())) == [(0, 1667, True), (1, 1667, True), (2, 1666, True)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_fold_keeps_its_tasks(spark):
    """Adaptive execution would leave rows of so few bytes to one task."""
    rows = spark.range(5000).select((F.col("id") % 500).alias("key"), "id")
    out = folded(rows, "key", ["id"], lambda s, r: s.append(r["id"]) or (), list, lambda k, s: [{"key": k, "n": len(s)}], "key bigint, n bigint")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 500 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_columns_become_the_values_that_arrow_gives():
    moment = datetime.datetime(2024, 1, 1, 2, 3, 4, 567890)
    columns = [
        pa.array([1, None, 2**62 + 1]), pa.array([None, None, None], pa.int64()), pa.array([], pa.string()), pa.array(["a", None, "é"]), pa.array([True, None, False]), pa.array([0.1, None, 1e300]),
        pa.array([moment, None, moment], pa.timestamp("us")), pa.array([moment, None], pa.timestamp("us", "UTC")), pa.array([[1, None], None, []]), pa.array([[{"subId": 1, "priority": None}], None]),
        pa.array([decimal.Decimal("1.50"), None]), pa.array([moment.date(), None]), pa.array([b"x", None]), pa.array([1, None, 3])[1:],
    ]
    for column in columns:
        got = values(column)
        assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist())), column.type


def test_gifts_are_parsed_anew_when_one_comes():
    s = Subscriber(Store())
    for n in range(3):
        s.change(*change("GIFT_RECEIVED", name=f"g{n}", yyyymm="202401", amount=10))
        assert s.usage(10, "202401", "20240101")["gift_take"] == 10
    assert s.limits["gifts|202401"] == '[[0, "g0", 10], [1, "g1", 10], [2, "g2", 10]]'
