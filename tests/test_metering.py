import random

from pyspark.sql import functions as F

from meterlake.functions import policy_text, quota, timekeys
from meterlake.operators import alerts, allocate, control, gate, intake, policy
from meterlake.sources import decode

from .simulator import level, simulate

EVENT = "event_id string, sub_id bigint, family_id bigint, bytes bigint, app_id bigint, kst timestamp_ntz, yyyymm string, yyyymmdd string"


def world(seed, n=150):
    r = random.Random(seed)
    subs = list(range(1, 9))
    family = {s: 0 if s == 8 else (s - 1) // 3 + 1 for s in subs}
    plans = {s: r.choice([-1, 0, 500, 1500, 1048576]) for s in subs}
    families = {f: r.choice([-5, 0, 700, 3000]) for f in (1, 2, 3)}
    members = {(family[s], s): r.choice([-1, 0, 200, 900]) for s in subs if family[s]}
    gifts = {(s, m): [(f"{s}{m}{i}", r.choice([0, 50, 300]), r.randrange(3)) for i in range(r.randrange(3))] for s in subs for m in ("202401", "202402")}
    events = []
    for i in range(n):
        s, day = r.choice(subs), r.choice([1, 2, 15, 31, 32, 40])
        month, d = ("202401", day) if day <= 31 else ("202402", day - 31)
        big = plans[s] == 1048576
        home = family[s] % 3 + 1 if s in (2, 5) and day % 2 else family[s]  # two subscribers go to and fro between families
        events.append({"event_id": f"e{i:04d}", "sub_id": s, "family_id": home, "bytes": r.choice([1, 40, 333, 900]) * (500 if big else 1), "yyyymm": month, "yyyymmdd": f"{month}{d:02d}", "kst": f"{month[:4]}-{month[4:]}-{d:02d} {r.randrange(24):02d}:{r.randrange(3):02d}:00"})
    return events, plans, families, members, gifts


def frames(spark, events, plans, families, members, gifts):
    ev = spark.createDataFrame([(e["event_id"], e["sub_id"], e["family_id"], e["bytes"], e["kst"], e["yyyymm"], e["yyyymmdd"]) for e in events], "event_id string, sub_id bigint, family_id bigint, bytes bigint, kst string, yyyymm string, yyyymmdd string")
    ev = ev.withColumn("kst", F.col("kst").cast("timestamp_ntz")).withColumn("app_id", F.lit(None).cast("bigint"))
    return (
        ev,
        spark.createDataFrame(list(plans.items()), "sub_id bigint, plan_limit bigint"),
        spark.createDataFrame(list(families.items()), "family_id bigint, family_limit bigint"),
        spark.createDataFrame([(*k, v) for k, v in members.items()], "family_id bigint, sub_id bigint, member_limit bigint"),
        spark.createDataFrame([(s, g, m, limit, score) for (s, m), rows in gifts.items() for g, limit, score in rows], "sub_id bigint, gift_id string, yyyymm string, gift_limit bigint, score int"),
    )


def test_waterfall_equals_simulation(spark):
    for seed in range(5):
        w = world(seed)
        takes, fired = simulate(*w)
        ev, plans, families, members, gifts = frames(spark, *w)
        allocated = allocate.allocate(ev, plans, families, members, gifts).persist()
        got = {r.event_id: (r.gift_take, r.plan_take, r.family_take, r.overflow) for r in allocated.collect()}
        assert got == takes
        split = allocate.split_gifts(allocated).persist()
        sums = {r.event_id: r.s for r in split.groupBy("event_id").agg(F.sum("take").alias("s")).collect()}
        assert sums == {k: v[0] for k, v in takes.items() if v[0]}
        seen = {("plan", (r.sub_id, r.yyyymm), r.event_id, r.threshold) for r in alerts.plan_alerts(allocated).collect()}
        seen |= {("pool", (r.family_id, r.yyyymm), r.event_id, r.threshold) for r in alerts.family_alerts(allocated).collect()}
        seen |= {("gift", (r.sub_id, r.gift_id, r.yyyymm), r.event_id, r.threshold) for r in alerts.gift_alerts(split).collect()}
        assert seen == fired


def test_gifts_and_plan_are_used_up_once_though_the_family_changes(spark):
    ev, plans, families, members, gifts = frames(
        spark, [{"event_id": f"e{i}", "sub_id": 1, "family_id": f, "bytes": 80, "kst": f"2024-01-0{i} 00:00:00", "yyyymm": "202401", "yyyymmdd": f"2024010{i}"} for i, f in ((1, 1), (2, 2))],
        {1: 100}, {1: 500, 2: 30}, {(1, 1): -1}, {(1, "202401"): [("9", 10, 1), ("10", 15, 2)]},
    )
    out = allocate.allocate(ev, plans, families, members, gifts)
    assert sorted((r.event_id, r.gift_take, r.plan_take, r.family_take, r.overflow) for r in out.collect()) == [("e1", 25, 55, 0, 0), ("e2", 0, 45, 30, 5)]
    log = {r.event_id: r.gift_detail_json for r in alerts.applied_log(out).collect()}
    assert log == {"e1": '[{"giftId":"9","usedAmount":10},{"giftId":"10","usedAmount":15}]', "e2": "[]"}  # in order of use, not of the ids as text


def test_waterfall_with_opening_balances(spark):
    events, plans, families, members, gifts = world(77, 80)
    opening = {"plan": {(s, p): 100 for s in plans for p in ("202401", "202402")}, "member": {(f, s, m): 50 for f, s in members for m in ("202401", "202402")}, "pool": {(f, m): 130 for f in families for m in ("202401", "202402")}, "gift": {}}
    takes, _ = simulate(events, plans, families, members, gifts, opening)
    ev, p, f, m, g = frames(spark, events, plans, families, members, gifts)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = {
        "plan": frame([(*k, v) for k, v in opening["plan"].items()], "sub_id bigint, period string, plan_open bigint"),
        "member": frame([(*k, v) for k, v in opening["member"].items()], "family_id bigint, sub_id bigint, yyyymm string, member_open bigint"),
        "family": frame([(*k, v) for k, v in opening["pool"].items()], "family_id bigint, yyyymm string, family_open bigint"),
    }
    got = {r.event_id: (r.gift_take, r.plan_take, r.family_take, r.overflow) for r in allocate.allocate(ev, p, f, m, g, given).collect()}
    assert got == takes


def test_thresholds(spark):
    cases = [(100, u) for u in range(0, 131)] + [(0, 5), (-1, 5), (7, 3), (1000, 499), (1000, 500), (1000, 699), (1000, 700), (1000, 899), (1000, 900), (1000, 999), (1000, 1000)]
    df = spark.createDataFrame(cases, "q bigint, u bigint").select("q", "u", quota.threshold(F.col("q"), F.col("u")).alias("t"))
    assert all(r.t == level(r.q, r.u) for r in df.collect())


def test_calendar_keys(spark):
    rows = [("2024-01-31 15:00:00",), ("2024-01-31 14:59:59",), ("2024-01-01 17:30:00",), ("2024-01-01 14:30:00",), ("2024-01-01 15:00:00",)]
    local = timekeys.kst(F.col("t").cast("timestamp_ntz"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(timekeys.month_key(local), timekeys.day_key(local), timekeys.slot_key(local)).collect()]
    assert got == [("202402", "20240201", "00_used"), ("202401", "20240131", "21_used"), ("202401", "20240102", "00_used"), ("202401", "20240101", "21_used"), ("202401", "20240102", "00_used")]


def test_intake_counts_invalid_before_repeats(spark):
    rows = [("a", 0, 1), ("a", 5, 2), ("a", 6, 3), ("b", None, 4), ("c", -1, 5), (None, 4, 6)]
    raw = spark.createDataFrame(rows, "event_id string, bytes bigint, arrival_seq bigint").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {(r.arrival_seq, r.status) for r in intake.with_status(raw).where("event_id is not null").collect()} == {(1, "invalid_bytes"), (2, "ok"), (3, "dup"), (4, "invalid_bytes"), (5, "invalid_bytes")}
    assert [(r.event_id, r.bytes) for r in intake.accepted(raw).collect()] == [("a", 5)]
    assert {r.reason for r in intake.quarantined(raw).collect()} == {"NO_EVENT_ID", "INVALID_BYTES"}


def test_repeat_blocks(spark):
    rules = spark.createDataFrame([(1, "3|23:30|23:30"), (2, "3|22:00|07:00"), (3, "3|09:00|10:00"), (4, "|09:00|23:59"), (5, " 3|00:00|23:59"), (6, "4|22:00|07:00"), (7, "1,2,3|23:00|23:59")], "sub_id bigint, encoded string")
    assert sorted(r.sub_id for r in policy.active_repeats(rules, "2024-01-17 23:30:00").collect()) == [1, 2, 7]
    assert sorted(r.sub_id for r in policy.active_repeats(rules, "2024-01-18 06:30:00").collect()) == [6]


def test_policy_texts(spark):
    df = spark.createDataFrame([("MON, tue ,,5,Foo",), ("",), (None,)], "d string").select(policy_text.days_csv(F.col("d")).alias("x"))
    assert [r.x for r in df.collect()] == ["1,2,5,Foo", "", ""]
    ends = [("1705500000", 1705500000), (" 2024.01.20T10:00 ", 1705712400), ("2024-01-20T10:00:30", 1705712430), ("tomorrow", 0), ("", 0), (None, 0)]
    got = spark.createDataFrame([(e,) for e, _ in ends], "e string").select(policy_text.once_end_epoch(F.col("e")).alias("x")).collect()
    assert [r.x for r in got] == [x for _, x in ends]


def test_messages(spark):
    import json

    body = {"type": "PLAN_CHANGED", "eventId": "p1", "subId": 3, "planLimit": 7}
    once_, twice = json.dumps(json.dumps(body)), json.dumps(json.dumps(json.dumps(body)))
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, once_), (3, twice), (4, "{broken"), (5, json.dumps({"type": "PLAN_CHANGED", "eventId": "p2", "subId": "x"})), (6, json.dumps({"type": "NEW", "eventId": "p3"}))], "seq bigint, value string")
    events = decode.control(rows).withColumn("reason", decode.refused(rows))
    assert {r.seq: r.reason for r in events.collect()} == {1: None, 2: None, 3: None, 4: "NO_EVENT_ID", 5: "MISSING_FIELD", 6: "UNKNOWN_TYPE"}
    usage = spark.createDataFrame([('{"eventId":"u","subId":1,"bytes":5,"appId":"7","occurredAt":"2024-01-01T00:00:00Z"}',), ('{"eventId":"v","subId":1,"familyId":2,"bytes":5,"appId":null}',)], "value string")
    assert [(r.event_id, r.family_id, r.app_id) for r in decode.usage(usage).collect()] == [("u", 0, 7), ("v", 2, None)]


def test_gate_leak_skip_and_priority(spark):
    batch = spark.createDataFrame([(1, "a", 1, 1, 80), (2, "b", 1, 1, 10), (3, "c", 1, 1, 90), (4, "d", 1, 1, 30), (5, "e", 2, 1, 40), (6, "f", 3, 0, 1)], "seq bigint, event_id string, sub_id bigint, family_id bigint, bytes bigint")
    gifts = spark.createDataFrame([(1, 50)], "sub_id bigint, gift_left bigint")
    plans = spark.createDataFrame([(1, 85), (2, 0)], "sub_id bigint, plan_left bigint")
    path = {r.event_id: r.path for r in gate.personal(batch, gifts, plans).collect()}
    # a drains the gift without use and takes the plan; b finds no gift but what the plan has left is too little
    assert path == {"a": "plan", "b": None, "c": None, "d": None, "e": None, "f": None}
    pool = spark.createDataFrame([(1, 100)], "family_id bigint, pool_left bigint")
    member = spark.createDataFrame([(1, 1, 95), (1, 2, 60)], "family_id bigint, sub_id bigint, member_left bigint")
    none = spark.createDataFrame([], "family_id bigint, sub_id bigint, score bigint")
    first = spark.createDataFrame([(1, 2, 0)], "family_id bigint, sub_id bigint, score bigint")
    ids = lambda p: sorted(r.event_id for r in gate.approved(batch, gifts, plans, pool, member, p).collect())
    assert ids(none) == ["a", "b", "d", "e"]
    assert ids(first) == ["a", "e"]


def test_what_quotas_leave_at_a_moment(spark):
    log = spark.createDataFrame(
        [
            ("a", 1, 7, "2024-01-16 10:00:00", "202401", "20240116", 30, 6, '[{"giftId":"x","usedAmount":4},{"giftId":"y","usedAmount":1}]'),
            ("b", 1, 7, "2024-01-17 10:00:00", "202401", "20240117", 20, 0, "[]"),
            ("c", 2, 7, "2024-01-17 10:00:00", "202401", "20240117", 40, 9, '[{"giftId":"z","usedAmount":2}]'),
            ("d", 2, 7, "2024-01-17 23:30:00", "202401", "20240117", 500, 500, "[]"),  # at the moment, not before it
            ("e", 2, 7, "2023-12-31 23:59:59", "202312", "20231231", 700, 700, "[]"),
            ("f", 1, 8, "2024-01-02 00:00:00", "202401", "20240102", 0, 3, "[]"),
        ],
        "event_id string, sub_id bigint, family_id bigint, occurred_at string, yyyymm string, yyyymmdd string, plan_used bigint, family_used bigint, gift_detail_json string",
    )
    log = log.withColumns({"occurred_at": F.col("occurred_at").cast("timestamp_ntz"), "gift_used": F.when(F.col("gift_detail_json") == "[]", 0).otherwise(1)})
    plans = spark.createDataFrame([(1, quota.DAILY_PLAN_LIMIT), (2, 30), (3, -1), (4, 9)], "sub_id bigint, plan_limit bigint")
    families = spark.createDataFrame([(7, 20), (8, -5), (9, 4)], "family_id bigint, family_limit bigint")
    members = spark.createDataFrame([(7, 1, 10), (7, 2, 5), (8, 1, -1), (9, 4, None)], "family_id bigint, sub_id bigint, member_limit bigint")
    gifts = spark.createDataFrame([(1, "x", "202401", 3, 1), (1, "y", "202401", 10, 2), (2, "z", "202402", 8, 1), (5, "w", "202401", 6, 1)], "sub_id bigint, gift_id string, yyyymm string, gift_limit bigint, score int")
    left = [sorted(map(tuple, t.collect())) for t in gate.left_at("2024-01-17 23:30:00", log, plans, families, members, gifts)]
    assert left == [
        [(1, 9), (5, 6)],  # x has been overdrawn, y keeps its nine
        [(1, quota.DAILY_PLAN_LIMIT - 20), (2, 0), (3, None), (4, 9)],  # a daily plan has used what its day has
        [(7, 5), (8, 0), (9, 4)],
        [(7, 1, 4), (7, 2, 0), (8, 1, 0), (9, 4, 0)],
    ]
    empty = gate.left_at("2024-01-17 23:30:00", log.limit(0), plans, families, members, gifts.limit(0))
    assert [t.count() for t in empty] == [0, 4, 3, 4]


CONTROL = "seq bigint, kind string, event_id string, familyId bigint, subId bigint, members array<bigint>, mode string, priorities array<struct<subId:bigint,priority:bigint>>, newLimit bigint"


def test_family_changes(spark):
    ev = spark.createDataFrame([(1, "FAMILY_MEMBER_ADDED", "1", 1, 11, None, None, None, None), (2, "FAMILY_MEMBER_ADDED", "2", 1, 12, None, None, None, None), (3, "FAMILY_MEMBER_REMOVED", "3", 1, 10, None, None, None, None), (4, "FAMILY_MEMBER_REMOVED", "4", 1, 99, None, None, None, None), (5, "FAMILY_MEMBER_REMOVED", "5", 2, 20, None, None, None, None), (6, "FAMILY_MEMBER_ADDED", "6", 2, 21, None, None, None, None)], CONTROL)
    base = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 20, 7)], "family_id bigint, sub_id bigint, member_limit bigint")
    gib5 = quota.MEMBER_LIMIT
    state = lambda *limits: {(r.family_id, r.sub_id): (r.member_limit, r.family_limit) for r in control.family_state(ev, base, spark.createDataFrame(list(limits), "family_id bigint, family_limit bigint")).collect()}
    assert state((1, 2 * gib5), (2, gib5)) == {(1, 11): (6, 2 * gib5), (1, 12): (3 * gib5, 2 * gib5), (2, 21): (gib5, gib5)}
    assert state((1, 7), (2, 3)) == {(1, 11): (6, 7), (1, 12): (7 + gib5, 7), (2, 21): (gib5, gib5)}  # no limit falls below 0
    assert state((2, -4)) == {(1, 11): (6, 0), (1, 12): (gib5, 0), (2, 21): (gib5, gib5)}
    scores = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 0)], "family_id bigint, sub_id bigint, score bigint")
    got = {(r.family_id, r.sub_id): r.score for r in control.priorities_after(ev, scores, base).collect()}
    assert got == {(1, 11): 0, (1, 12): 1}  # family 2 lost its last listed member


def test_priorities_of_unlisted_members_and_ties(spark):
    def after(changes, scores, members):
        ev = spark.createDataFrame([(n, f"FAMILY_MEMBER_{kind}", str(n), 1, sub, None, None, None, None) for n, (kind, sub) in enumerate(changes)], CONTROL)
        base = spark.createDataFrame([(1, *x) for x in scores], "family_id bigint, sub_id bigint, score bigint")
        return {r.sub_id: r.score for r in control.priorities_after(ev, base, spark.createDataFrame([(1, m) for m in members], "family_id bigint, sub_id bigint")).collect()}

    assert after([("ADDED", 30)], [(10, 0), (11, 1)], [10, 11, 12]) == {10: 0, 11: 1, 30: 2}  # 12 was never listed
    assert after([("REMOVED", 10), ("REMOVED", 11), ("ADDED", 30)], [(10, 0), (11, 1)], [10, 11, 12]) == {}
    assert after([("REMOVED", 12)], [(10, 0), (11, 5)], [10, 11, 12]) == {10: 0, 11: 5}
    assert after([("REMOVED", 10), ("ADDED", 13)], [(10, 1), (11, 1), (12, 4)], [10, 11, 12]) == {11: 1, 12: 3, 13: 4}
    assert after([], [(10, 3)], [10]) == {10: 3}


def test_malformed_changes_are_left_out(spark):
    import json

    from meterlake.sources import decode

    texts = [{"type": "PLAN_CHANGED", "eventId": "a", "subId": 1, "planLimit": 70}, {"type": "PLAN_CHANGED", "eventId": "b", "subId": 1}, {"type": "PLAN_CHANGED", "subId": 1, "planLimit": 5}, {"type": "PLAN_CHANGED", "subId": 2, "planLimit": 6}, {"type": "PLAN_CHANGED", "eventId": "b", "subId": 2, "planLimit": 90}]
    events = decode.control(spark.createDataFrame([(n, json.dumps(t)) for n, t in enumerate(texts)], "seq bigint, value string"))
    base = spark.createDataFrame([(1, 100), (2, 100)], "sub_id bigint, plan_limit bigint")
    assert {r.sub_id: r.plan_limit for r in control.plan_limits(control.accepted(events), base).collect()} == {1: 70, 2: 90}


def test_policies_on_a_base(spark):
    import json

    from meterlake.sources import decode

    policy = lambda n: {"policyId": n, "policyType": "SCHEDULED", "encoded": "new"}
    texts = [{"type": "POLICY_CHANGED", "eventId": "a", "policy": policy(2), "subIds": [1]}, {"type": "POLICY_SNAPSHOT", "eventId": "b", "subId": 2, "policies": [policy(3)]}, {"type": "POLICY_DELETED", "eventId": "c", "policies": [policy(5) | {"subIds": [1]}]}]
    events = control.accepted(decode.control(spark.createDataFrame([(n, json.dumps(t)) for n, t in enumerate(texts)], "seq bigint, value string")))
    base = spark.createDataFrame([(1, 1, "SCHEDULED", "old", None), (1, 2, "SCHEDULED", "old", None), (1, 5, "SCHEDULED", "old", None), (2, 1, "SCHEDULED", "old", None)], "sub_id bigint, policy_id bigint, type string, encoded string, expire_epoch bigint")
    assert sorted((r.sub_id, r.policy_id, r.encoded) for r in control.policies(events, base).collect()) == [(1, 1, "old"), (1, 2, "new"), (2, 3, "new")]


def test_empty_tables(spark):
    events, plans, families, members, gifts = (spark.createDataFrame([], EVENT), *[spark.createDataFrame([], s) for s in ("sub_id bigint, plan_limit bigint", "family_id bigint, family_limit bigint", "family_id bigint, sub_id bigint, member_limit bigint", "sub_id bigint, gift_id string, yyyymm string, gift_limit bigint, score int")])
    allocated = allocate.allocate(events, plans, families, members, gifts)
    assert allocated.count() == 0 and allocate.split_gifts(allocated).count() == 0


def test_control_messages_wrapped_often(spark):
    import json

    from meterlake.sources import decode

    rows = []
    for n in range(8):
        text = json.dumps({"type": "PLAN_CHANGED", "eventId": f"e{n}", "subId": n, "planLimit": 7})
        for _ in range(n):
            text = json.dumps(text)
        rows.append((text,))
    got = decode.control(spark.createDataFrame([*rows, (None,), ("",)], "value string"))
    assert sorted((r.event_id, r.kind, r.subId, r.planLimit) for r in got.where("event_id is not null").collect()) == [(f"e{n}", "PLAN_CHANGED", n, 7) for n in range(8)]
    assert got.count() == 10
