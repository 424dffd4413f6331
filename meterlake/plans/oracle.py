"""The registered queries in plain SQL (DuckDB), written apart from the Spark code."""

from __future__ import annotations

BASE = """
WITH src AS (SELECT *, user_id + 1 AS sub FROM events),
one AS (
  SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, sub AS sub_id,
    CASE WHEN sub % 11 = 0 THEN 0 ELSE (sub - 1) // 5 + 1 + CASE WHEN sub % 7 = 3 AND ts >= TIMESTAMP '2024-01-09' THEN 1 ELSE 0 END END AS family_id,
    CASE WHEN event_id % 499 = 0 THEN 0 WHEN event_id % 997 = 1 THEN -5 ELSE CAST(floor(value * 16384) AS BIGINT) END AS bytes,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 19 + 1 END AS app_id,
    ts + INTERVAL 1 DAY * CAST(sub % 3 * 15 AS INTEGER) AS occurred_at, event_id AS arrival_seq
  FROM src),
raw AS (SELECT * FROM one UNION ALL SELECT event_id, sub_id, family_id, bytes, app_id, occurred_at, arrival_seq + 1000000000 FROM one WHERE arrival_seq % 53 = 0),
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) AS rn FROM raw WHERE bytes > 0) WHERE rn = 1),
ev AS (SELECT event_id, sub_id, family_id, bytes, app_id, occurred_at, arrival_seq, occurred_at + INTERVAL 9 HOUR AS kst, strftime(occurred_at + INTERVAL 9 HOUR, '%Y%m') AS yyyymm,
    strftime(occurred_at + INTERVAL 9 HOUR, '%Y%m%d') AS yyyymmdd, lpad(CAST(hour(occurred_at + INTERVAL 9 HOUR) // 3 * 3 AS VARCHAR), 2, '0') || '_used' AS slot FROM ok),
subs AS (SELECT DISTINCT sub AS sub_id, CASE WHEN sub % 11 = 0 THEN 0 ELSE (sub - 1) // 5 + 1 END AS family_id FROM src),
plan_limit AS (SELECT sub_id, CASE sub_id % 5 WHEN 0 THEN -1 WHEN 1 THEN 10000000 WHEN 2 THEN 20000000 WHEN 3 THEN 40000000 ELSE 1048576 END AS plan_limit FROM subs),
member AS (SELECT family_id, sub_id, CASE sub_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 3000000 ELSE 8000000 END AS member_limit, CASE WHEN family_id % 2 = 0 THEN sub_id * 7 % 5 ELSE -1 END AS priority FROM subs WHERE family_id > 0),
family_limit AS (SELECT family_id, count(*) * 5242880 AS family_limit FROM member GROUP BY family_id),
gift AS (SELECT sub_id, CAST(sub_id * 10 + 3 - n AS VARCHAR) AS gift_id, m AS yyyymm, 2000000 * n AS gift_limit, n AS score FROM subs, range(1, 3) AS r(n), (VALUES ('202401'), ('202402'), ('202403')) AS q(m) WHERE n <= sub_id % 3)
"""

ALLOCATED = """,
cap AS (SELECT sub_id, yyyymm, sum(gift_limit) AS gift_cap FROM gift GROUP BY ALL),
a0 AS (SELECT ev.*, coalesce(plan_limit, 0) AS plan_limit, coalesce(family_limit, 0) AS family_limit, coalesce(member_limit, 0) AS member_limit, coalesce(gift_cap, 0) AS gift_cap,
    CASE WHEN plan_limit = 1048576 THEN ev.yyyymmdd ELSE ev.yyyymm END AS period, CASE WHEN ev.family_id > 0 THEN ev.family_id ELSE -ev.sub_id END AS grp
  FROM ev LEFT JOIN plan_limit USING (sub_id) LEFT JOIN family_limit USING (family_id) LEFT JOIN member USING (family_id, sub_id) LEFT JOIN cap USING (sub_id, yyyymm)),
a1 AS (SELECT *, sum(bytes) OVER (PARTITION BY sub_id, yyyymm ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM a0),
a2 AS (SELECT *, least(cum, gift_cap) - least(cum - bytes, gift_cap) AS gift_take FROM a1),
a3 AS (SELECT *, bytes - gift_take AS r1, sum(bytes - gift_take) OVER (PARTITION BY sub_id, period ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS c1 FROM a2),
a4 AS (SELECT *, CASE WHEN plan_limit < 0 THEN r1 ELSE least(c1, plan_limit) - least(c1 - r1, plan_limit) END AS plan_take FROM a3),
a5 AS (SELECT *, r1 - plan_take AS r2, sum(r1 - plan_take) OVER (PARTITION BY family_id, sub_id, yyyymm ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS c2 FROM a4),
a6 AS (SELECT *, CASE WHEN member_limit > 0 THEN least(c2, member_limit) - least(c2 - r2, member_limit) ELSE r2 END AS asked FROM a5),
a7 AS (SELECT *, sum(asked) OVER (PARTITION BY grp, yyyymm ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS c3, greatest(0, family_limit) AS pool FROM a6),
a8 AS (SELECT *, least(c3, pool) - least(c3 - asked, pool) AS family_take FROM a7),
al AS (SELECT *, r2 - family_take AS overflow, sum(plan_take) OVER (PARTITION BY sub_id, period ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS plan_used,
    sum(family_take) OVER (PARTITION BY grp, yyyymm ORDER BY kst, event_id ROWS UNBOUNDED PRECEDING) AS family_used FROM a8),
gl AS (SELECT *, sum(gift_limit) OVER (PARTITION BY sub_id, yyyymm ORDER BY score, gift_id ROWS UNBOUNDED PRECEDING) AS hi FROM gift),
sp AS (SELECT al.event_id, al.sub_id, al.yyyymm, al.kst, gift_id, gift_limit, score, least(cum - bytes + gift_take, hi) - greatest(cum - bytes, hi - gift_limit) AS take, least(cum - bytes + gift_take, hi) - (hi - gift_limit) AS gift_used
  FROM al JOIN gl ON al.sub_id = gl.sub_id AND al.yyyymm = gl.yyyymm AND al.gift_take > 0 AND cum - bytes < hi AND hi - gift_limit < cum - bytes + gift_take)
"""


def level(quota: str, used: str) -> str:
    left = f"greatest(0, {quota} - {used})"
    return f"CASE WHEN {quota} <= 0 THEN 101 WHEN {left} = 0 THEN 0 WHEN {left} * 100 // {quota} <= 10 THEN 10 WHEN {left} * 100 // {quota} <= 30 THEN 30 WHEN {left} * 100 // {quota} <= 50 THEN 50 ELSE 101 END"


def _alert(name: str, source: str, quota: str, used: str, keys: str) -> str:
    pct = f"CASE WHEN {quota} <= 0 THEN 0 ELSE greatest(0, {quota} - {used}) * 100 // {quota} END"
    return f""",
{name}0 AS (SELECT *, {level(quota, used)} AS threshold, {pct} AS remaining_pct FROM {source}),
{name}1 AS (SELECT *, coalesce(min(threshold) OVER (PARTITION BY {keys} ORDER BY kst, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 101) AS was FROM {name}0),
{name} AS (SELECT * FROM {name}1 WHERE threshold <> 101 AND threshold < was)
"""


ALERTS = (
    _alert("pa", "(SELECT * FROM al WHERE plan_take > 0)", "plan_limit", "plan_used", "sub_id, yyyymm")
    + _alert("fa", "(SELECT * FROM al WHERE family_take > 0)", "family_limit", "family_used", "family_id, yyyymm")
    + _alert("ga", "sp", "gift_limit", "gift_used", "sub_id, gift_id, yyyymm")
)

def blocks(moment: str) -> str:
    """Blocked subscribers at a moment of Korean time, from days, times and ends: bt, ba, br, bi, and the events that pass."""
    return f""",
moment AS (SELECT epoch(TIMESTAMP '{moment}') - 32400 AS sec, CAST(isodow(TIMESTAMP '{moment}') AS VARCHAR) AS dow, strftime(TIMESTAMP '{moment}', '%H:%M') AS hm),
ends AS (SELECT sub_id, 1705501800 + d AS e FROM subs, (VALUES (-3600), (3600)) AS t(d) WHERE sub_id % 13 = 5 AND (d < 0 OR sub_id % 2 = 0)),
bt AS (SELECT DISTINCT sub_id FROM ends, moment WHERE e > sec),
ba AS (SELECT sub_id, 3 AS app_id FROM subs WHERE sub_id % 7 = 2),
rule AS (SELECT sub_id, string_split(['1,3,5|09:00|14:00', '2,4,6,7,3|23:00|07:00', '|09:00|10:00'][sub_id % 19], '|') AS p FROM subs WHERE sub_id % 19 IN (1, 2, 3)),
br AS (SELECT sub_id FROM rule, moment WHERE p[1] <> '' AND list_contains(string_split(p[1], ','), dow)
  AND CASE WHEN p[2] <= p[3] THEN hm >= p[2] AND hm <= p[3] ELSE hm >= p[2] OR hm <= p[3] END),
bi AS (SELECT sub_id FROM subs WHERE sub_id % 17 = 3),
pass AS (SELECT * FROM ev WHERE sub_id NOT IN (SELECT sub_id FROM bt) AND sub_id NOT IN (SELECT sub_id FROM br) AND sub_id NOT IN (SELECT sub_id FROM bi)
  AND NOT EXISTS (SELECT 1 FROM ba WHERE ba.sub_id = ev.sub_id AND ba.app_id = ev.app_id))
"""


BLOCKS, MORNING = blocks("2024-01-17 23:30:00"), blocks("2024-01-18 06:30:00")

#: What quotas leave on 2024-01-17 at 23:30: -1 stands for a plan without limit.
LEFT = """,
past AS (SELECT * FROM al WHERE yyyymm = '202401' AND kst < TIMESTAMP '2024-01-17 23:30:00'),
gsum AS (SELECT sub_id, sum(greatest(0, gift_limit - coalesce(used, 0))) AS g FROM gift LEFT JOIN (
    SELECT sub_id, gift_id, sum(take) AS used FROM sp WHERE event_id IN (SELECT event_id FROM past) GROUP BY ALL) USING (sub_id, gift_id)
  WHERE yyyymm = '202401' GROUP BY sub_id),
pleft AS (SELECT sub_id, CASE WHEN plan_limit < 0 THEN -1 WHEN plan_limit = 1048576 THEN greatest(0, plan_limit - coalesce(today, 0)) ELSE greatest(0, plan_limit - coalesce(used, 0)) END AS p
  FROM plan_limit LEFT JOIN (SELECT sub_id, sum(plan_take) AS used, sum(plan_take) FILTER (WHERE yyyymmdd = '20240117') AS today FROM past GROUP BY sub_id) USING (sub_id)),
fleft AS (SELECT family_id, greatest(0, family_limit - coalesce(used, 0)) AS f FROM family_limit LEFT JOIN (SELECT family_id, sum(family_take) AS used FROM past GROUP BY family_id) USING (family_id)),
mleft AS (SELECT family_id, sub_id, greatest(0, member_limit - coalesce(used, 0)) AS m
  FROM member LEFT JOIN (SELECT family_id, sub_id, sum(family_take) AS used FROM past GROUP BY ALL) USING (family_id, sub_id))
"""

GATE = ALLOCATED + BLOCKS + LEFT + """,
batch AS (SELECT arrival_seq AS seq, event_id, sub_id, family_id, bytes, row_number() OVER (PARTITION BY sub_id ORDER BY arrival_seq) AS n FROM pass),
walk AS MATERIALIZED (
  WITH RECURSIVE w AS (
    SELECT sub_id, CAST(0 AS BIGINT) AS n, CAST(coalesce(g, 0) AS BIGINT) AS g, CAST(p AS BIGINT) AS p, CAST('' AS VARCHAR) AS event_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS family_id, CAST(0 AS BIGINT) AS bytes, '' AS path
    FROM pleft LEFT JOIN gsum USING (sub_id)
    UNION ALL
    SELECT w.sub_id, w.n + 1, CASE WHEN w.g >= b.bytes THEN w.g - b.bytes ELSE 0 END, CASE WHEN w.g >= b.bytes OR w.p < 0 OR w.p < b.bytes THEN w.p ELSE w.p - b.bytes END, b.event_id, b.seq, b.family_id, b.bytes,
      CASE WHEN w.g >= b.bytes THEN 'gift' WHEN w.p < 0 OR w.p >= b.bytes THEN 'plan' ELSE '' END
    FROM w JOIN batch b ON b.sub_id = w.sub_id AND b.n = w.n + 1)
  SELECT * FROM w WHERE n > 0),
pend AS MATERIALIZED (SELECT walk.seq, walk.event_id, walk.sub_id, walk.family_id, walk.bytes, coalesce(m, 0) AS member_left, priority FROM walk LEFT JOIN mleft USING (family_id, sub_id) LEFT JOIN member USING (family_id, sub_id) WHERE path = '' AND family_id > 0),
listed AS (SELECT DISTINCT family_id FROM member WHERE priority >= 0),
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY CASE WHEN family_id IN (SELECT family_id FROM listed) THEN priority ELSE 0 END, CASE WHEN family_id IN (SELECT family_id FROM listed) THEN CAST(sub_id AS VARCHAR) ELSE '' END, seq) AS n FROM pend),
fam AS (
  WITH RECURSIVE f AS (
    SELECT family_id, CAST(0 AS BIGINT) AS n, CAST(f AS BIGINT) AS pool, MAP(CAST([] AS BIGINT[]), CAST([] AS BIGINT[])) AS spent, CAST('' AS VARCHAR) AS event_id, false AS ok FROM fleft
    UNION ALL
    SELECT family_id, n, CASE WHEN good THEN pool - bytes ELSE pool END, CASE WHEN good THEN map_concat(spent, MAP([CAST(sub_id AS BIGINT)], [CAST(s + bytes AS BIGINT)])) ELSE spent END, event_id, good
    FROM (SELECT f.family_id, f.n + 1 AS n, f.pool, f.spent, q.event_id, q.bytes, q.sub_id, coalesce(f.spent[CAST(q.sub_id AS BIGINT)], 0) AS s,
        f.pool >= q.bytes AND q.member_left - coalesce(f.spent[CAST(q.sub_id AS BIGINT)], 0) >= q.bytes AS good
      FROM f JOIN queue q ON q.family_id = f.family_id AND q.n = f.n + 1))
  SELECT * FROM f WHERE ok)
"""

CONTROL = """,
kinds AS (SELECT ['FAMILY_MEMBER_ADDED', 'FAMILY_MEMBER_REMOVED', 'FAMILY_MODE_CHANGED', 'FAMILY_SUB_LIMIT_CHANGED', 'POLICY_CHANGED', 'POLICY_DEACTIVATE', 'PLAN_CHANGED', 'SUBSCRIPTION_LOCKED', 'SUBSCRIPTION_UNLOCKED', 'APP_BLOCK_LIST_UPDATED', 'GIFT_RECEIVED', 'POLICY_SNAPSHOT', 'POLICY_DELETED', 'FAMILY_CREATE'] AS k),
ctl AS (SELECT event_id AS seq, event_id // 5 AS n, sub, (sub - 1) // 5 + 1 AS fam, CAST(floor(abs(value)) * 1000 AS BIGINT) AS amount, k[event_id // 5 % 14 + 1] AS kind, event_id // 5 % 4 + 1 AS policy, user_id, ts FROM src, kinds WHERE event_id % 5 = 0),
moves AS (SELECT family_id, sub_id, -1 AS seq, true AS added FROM member UNION ALL SELECT fam, sub, seq, kind = 'FAMILY_MEMBER_ADDED' FROM ctl WHERE kind IN ('FAMILY_MEMBER_ADDED', 'FAMILY_MEMBER_REMOVED')),
real AS (SELECT * FROM (SELECT *, coalesce(lag(added) OVER (PARTITION BY family_id, sub_id ORDER BY seq), false) AS was FROM moves) WHERE added <> was),
sized AS (SELECT *, sum(CASE WHEN added THEN 1 ELSE -1 END) OVER (PARTITION BY family_id ORDER BY seq RANGE UNBOUNDED PRECEDING) AS size FROM real)
"""

POLICY_ROWS = """(VALUES (1, 'SCHEDULED', '1,2,5|09:00|18:00'), (2, 'SCHEDULED', '6,7|22:00|06:00'), (3, 'SCHEDULED', '3,x|10:00|10:00'), (4, 'ONCE', '1705500000'), (5, 'ONCE', '1705712400'), (6, 'ONCE', '1705712430')) AS p(policy_id, kind, value)"""


#: Policies of the first load with changes on top (now_policy), as of one moment; who is locked, and which apps are blocked, by then.
POLICY_STATE = f""",
stored AS (SELECT sub_id, policy_id, kind, CASE WHEN kind = 'SCHEDULED' THEN value END AS encoded, CASE WHEN kind = 'ONCE' THEN CAST(value AS BIGINT) END AS expire_epoch
  FROM subs JOIN {POLICY_ROWS} ON policy_id = sub_id % 10 + 1 WHERE sub_id % 6 <> 0),
snap AS (SELECT sub, max(seq) AS since FROM ctl WHERE kind = 'POLICY_SNAPSHOT' GROUP BY sub),
told AS (SELECT seq, kind, sub, policy, n, CASE WHEN n % 3 <> 0 THEN '1,' || CAST(n % 5 + 2 AS VARCHAR) || '|09:00|10:00' END AS encoded, CASE WHEN n % 3 = 0 THEN 1700000000 + amount END AS expire_epoch FROM ctl),
step AS (SELECT -1 AS seq, sub_id, policy_id, encoded, expire_epoch, true AS live FROM stored
  UNION ALL SELECT seq, sub + d, policy, encoded, expire_epoch, true FROM told, range(2) AS t(d) WHERE kind = 'POLICY_CHANGED'
  UNION ALL SELECT seq, sub, policy, encoded, expire_epoch, true FROM told WHERE kind = 'POLICY_SNAPSHOT'
  UNION ALL SELECT seq, sub, policy, encoded, expire_epoch, false FROM told WHERE kind IN ('POLICY_DEACTIVATE', 'POLICY_DELETED') AND n % 7 <> 0),
valid AS (SELECT * FROM step LEFT JOIN snap ON snap.sub = step.sub_id WHERE since IS NULL OR seq >= since),
now_policy AS (SELECT sub_id, policy_id, CASE WHEN encoded IS NULL THEN 'time' ELSE 'repeat' END AS store, encoded, CAST(expire_epoch AS BIGINT) AS expire_epoch
  FROM valid a WHERE live AND NOT EXISTS (SELECT 1 FROM valid b WHERE b.sub_id = a.sub_id AND b.policy_id = a.policy_id AND b.seq > a.seq)),
lock_now AS (SELECT sub_id FROM subs LEFT JOIN (SELECT sub, arg_max(kind, seq) AS k FROM ctl WHERE kind LIKE 'SUBSCRIPTION%' GROUP BY sub) ON sub = sub_id WHERE coalesce(k = 'SUBSCRIPTION_LOCKED', sub_id % 17 = 3)
  UNION SELECT sub FROM (SELECT sub, arg_max(kind, seq) AS k FROM ctl WHERE kind LIKE 'SUBSCRIPTION%' GROUP BY sub) WHERE k = 'SUBSCRIPTION_LOCKED'),
listed_apps AS (SELECT sub, arg_max(n, seq) AS n FROM ctl WHERE kind = 'APP_BLOCK_LIST_UPDATED' GROUP BY sub),
app_now AS (SELECT sub_id, 3 AS app_id FROM subs WHERE sub_id % 7 = 2 AND sub_id NOT IN (SELECT sub FROM listed_apps) UNION ALL SELECT sub, n % 9 + d FROM listed_apps, range(2) AS t(d) WHERE n % 5 <> 0),
asked AS (SELECT TIMESTAMP '2024-01-19 09:30:00' AS t),
hours AS (SELECT sub_id, string_split(encoded, '|') AS p FROM now_policy WHERE store = 'repeat'),
shut AS (SELECT sub_id FROM lock_now UNION SELECT sub_id FROM now_policy, asked WHERE expire_epoch > epoch(t) - 32400
  UNION SELECT sub_id FROM hours, asked WHERE p[1] <> '' AND p[2] <> '' AND p[3] <> '' AND list_contains(string_split(p[1], ','), CAST(isodow(t) AS VARCHAR))
    AND CASE WHEN p[2] <= p[3] THEN strftime(t, '%H:%M') BETWEEN p[2] AND p[3] ELSE strftime(t, '%H:%M') >= p[2] OR strftime(t, '%H:%M') <= p[3] END)
"""


def _u(*label: str) -> str:
    parts = " || '|' || ".join(x if x.startswith("'") else f"CAST({x} AS VARCHAR)" for x in label)
    return f"(CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _between(u: str, low: str, high: str) -> str:
    return f"(CASE WHEN {high} <= {low} THEN {low} ELSE {low} + CAST(floor({u} * ({high} - {low} + 1)) AS BIGINT) END)"


def _split(name: str, source: str, keys: str, least: int) -> str:
    """Parts of a total by weight, walked in order; source has keys, i from 1, item, w and total."""
    on = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f""",
{name}_sum AS (SELECT {keys}, count(*) AS n, any_value(total) AS total, list_reduce(list(w ORDER BY i), lambda a, x: a + x, CAST(0 AS DOUBLE)) AS ws FROM {source} GROUP BY {keys}),
{name} AS (
  WITH RECURSIVE r AS (
    SELECT {keys}, CAST(0 AS BIGINT) AS i, n, CASE WHEN total >= n * {least} THEN {least} ELSE 0 END AS base, CAST(total - CASE WHEN total >= n * {least} THEN {least} ELSE 0 END * n AS BIGINT) AS left_, ws, CAST(0 AS BIGINT) AS used FROM {name}_sum
    UNION ALL
    SELECT {out}, s.i, r.n, r.base, CASE WHEN s.i = r.n THEN 0 ELSE r.left_ - least(r.left_, CAST(round(CAST(r.left_ AS DOUBLE) * s.w / r.ws) AS BIGINT)) END, r.ws - s.w,
      r.base + CASE WHEN s.i = r.n THEN r.left_ ELSE least(r.left_, CAST(round(CAST(r.left_ AS DOUBLE) * s.w / r.ws) AS BIGINT)) END
    FROM r JOIN {source} s ON {on} AND s.i = r.i + 1)
  SELECT {", ".join(f"r.{k.strip()}" for k in keys.split(","))}, item, r.used FROM r JOIN {source} s ON {on} AND s.i = r.i)
"""


_BASE_U, _DAY_U = _u("'base'", "sub_id", "m"), _u("'day'", "sub_id", "d")
_JIT = lambda base, a, b: f"CAST(round({base} * ({a}::DOUBLE + {_DAY_U} * {b}::DOUBLE)) AS BIGINT)"
HISTORY = (
    BASE
    + f""",
hd AS (SELECT sub_id, sub_id % 5 + 1 AS plan_id, plan_limit AS lim, CAST(d AS DATE) AS d, strftime(d, '%Y%m') AS m FROM plan_limit, range(DATE '2023-08-01', DATE '2024-01-17', INTERVAL 1 DAY) AS t(d)),
flat AS (SELECT sub_id, d, m, greatest(50000, {_JIT(_between(_BASE_U, "400000", "2000000"), "0.8", "0.4")}) AS used FROM hd WHERE plan_id = 1
  UNION ALL SELECT sub_id, d, m, greatest(CAST(round(lim * 0.5::DOUBLE) AS BIGINT), least(lim, {_JIT(_between(_BASE_U, "CAST(round(lim * 0.65::DOUBLE) AS BIGINT)", "CAST(round(lim * 0.85::DOUBLE) AS BIGINT)"), "0.9", "0.2")})) FROM hd WHERE plan_id = 5),
pm AS (SELECT *, row_number() OVER (PARTITION BY sub_id, m ORDER BY d) AS i, d AS item, 0.9::DOUBLE + {_DAY_U} * 0.2::DOUBLE AS w, greatest(1, CAST(round(CAST(lim AS DOUBLE) * count(*) OVER (PARTITION BY sub_id, m) / day(last_day(d))) AS BIGINT)) AS pro FROM hd WHERE plan_id NOT IN (1, 5)),
px AS (SELECT sub_id, m, i, item, w, {_between(_BASE_U, "greatest(1, CAST(round(pro * 0.5::DOUBLE) AS BIGINT))", "pro")} AS total FROM pm)
"""
    + _split("ps", "px", "sub_id, m", 0)
    + ", hist AS (SELECT sub_id, d AS day, m AS yyyymm, CAST(used AS BIGINT) AS used FROM flat UNION ALL SELECT sub_id, item, m, used FROM ps)"
)
APPS_SQL = (
    HISTORY
    + f""",
ap AS (SELECT sub_id, day, used AS total, a AS item, row_number() OVER (PARTITION BY sub_id, day ORDER BY {_u("'app'", "sub_id", "day", "a")}, a) AS i, {_u("'weight'", "sub_id", "day", "a")} AS uw FROM hist, range(1, 20) AS t(a) WHERE a NOT IN (1, 5)),
ax AS (SELECT sub_id, day, total, item, i, CASE i WHEN 1 THEN 24.0::DOUBLE WHEN 2 THEN 16.0::DOUBLE WHEN 3 THEN 8.0::DOUBLE WHEN 4 THEN 8.0::DOUBLE WHEN 5 THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END * (0.8::DOUBLE + uw * 0.5::DOUBLE) AS w FROM ap)
"""
    + _split("asplit", "ax", "sub_id, day", 1)
)
SLOTS_SQL = (
    HISTORY
    + f""",
sx AS (SELECT sub_id, day, used AS total, lpad(CAST((i - 1) * 3 AS VARCHAR), 2, '0') || '_used' AS item, i, [7.0::DOUBLE, 3.0, 6.0, 14.0, 16.0, 17.0, 23.0, 14.0][i] * (0.85::DOUBLE + {_u("'slot'", "sub_id", "day", "lpad(CAST((i - 1) * 3 AS VARCHAR), 2, '0')")} * 0.3::DOUBLE) AS w FROM hist, range(1, 9) AS t(i))
"""
    + _split("ssplit", "sx", "sub_id, day", 1)
)


def takes(select: str) -> str:
    return BASE + ALLOCATED + select


def _totals(period: str) -> str:
    b = lambda x, y: f"CAST(sum({x}) AS BIGINT) AS {y}"
    return takes(f"SELECT sub_id, {period}, {b('bytes', 'total_used')}, {b('plan_take', 'plan_used')}, {b('family_take', 'member_family_used')}, {b('gift_take', 'gift_used')}, {b('overflow', 'overflow_used')} FROM al GROUP BY sub_id, {period}")


def _outbox() -> str:
    def part(source: str, kind: str, sub: str, family: str, gift: str, owner: str, quota: str, used: str) -> str:
        return (
            f"SELECT sha256('{kind}|' || event_id || '|' || {owner} || '|' || CAST(threshold AS VARCHAR)) AS alert_id, 'user-alert' AS aggregatetype, {owner} AS aggregateid, 'USAGE_THRESHOLD' AS event_type, '{kind}' AS alert_type, event_id, "
            f"CAST({sub} AS BIGINT) AS sub_id, CAST({family} AS BIGINT) AS family_id, CAST(threshold AS VARCHAR) AS threshold, {gift} AS gift_id, CAST(CAST(greatest(0, {quota}) AS BIGINT) AS VARCHAR) AS provided_amount, "
            f"CAST(100 - remaining_pct AS VARCHAR) AS used_percent, CAST(CAST(CASE WHEN {quota} > 0 THEN least({used}, {quota}) ELSE {used} END AS BIGINT) AS VARCHAR) AS used_amount, kst AS created_time FROM {source}"
        )

    return BASE + ALLOCATED + ALERTS + " UNION ALL ".join([
        part("pa", "PLAN_REMAINING", "sub_id", "NULL", "CAST(NULL AS VARCHAR)", "'sub:' || CAST(sub_id AS VARCHAR)", "plan_limit", "plan_used"),
        part("fa", "FAMILY_POOL_REMAINING", "NULL", "family_id", "CAST(NULL AS VARCHAR)", "'family:' || CAST(family_id AS VARCHAR)", "family_limit", "family_used"),
        part("ga", "GIFT_REMAINING", "sub_id", "NULL", "gift_id", "'gift:' || gift_id", "gift_limit", "gift_used"),
    ])


LOG = takes("""SELECT al.event_id, sub_id, family_id, app_id, kst AS occurred_at, yyyymm, yyyymmdd, bytes AS usage_amount,
  CAST(gift_take AS BIGINT) AS gift_used, CAST(plan_take AS BIGINT) AS plan_used, CAST(family_take AS BIGINT) AS family_used, coalesce('[' || d || ']', '[]') AS gift_detail_json
FROM al LEFT JOIN (
  SELECT event_id, array_to_string(list_transform(list_sort(list({'score': score, 'id': gift_id, 'take': CAST(take AS BIGINT)})), lambda x: '{"giftId":"' || x.id || '","usedAmount":' || CAST(x.take AS VARCHAR) || '}'), ',') AS d
  FROM sp GROUP BY event_id) g USING (event_id)""")

ORACLES = {
    "usage_total_month": BASE + "SELECT sub_id, yyyymm, CAST(sum(bytes) AS BIGINT) AS total_used FROM ev GROUP BY ALL",
    "usage_app_month": BASE + "SELECT sub_id, app_id, yyyymm, CAST(sum(bytes) AS BIGINT) AS used FROM ev GROUP BY ALL",
    "usage_app_day": BASE + "SELECT sub_id, app_id, yyyymmdd, CAST(sum(bytes) AS BIGINT) AS used FROM ev GROUP BY ALL",
    "usage_3hourly": BASE + "SELECT sub_id, yyyymmdd, slot, CAST(sum(bytes) AS BIGINT) AS used FROM ev GROUP BY ALL",
    "usage_3hourly_wide": BASE + "SELECT sub_id, yyyymmdd, " + ", ".join(f"CAST(coalesce(sum(bytes) FILTER (WHERE slot = '{h:02d}_used'), 0) AS BIGINT) AS h{h:02d}_used" for h in range(0, 24, 3)) + " FROM ev GROUP BY ALL",
    "valid_events": BASE + "SELECT event_id, arrival_seq, bytes FROM raw WHERE bytes > 0",
    "quarantined_events": BASE + "SELECT event_id, arrival_seq, 'INVALID_BYTES' AS reason FROM raw WHERE bytes <= 0",
    "dedup_events": BASE + "SELECT event_id, sub_id, family_id, bytes, app_id, kst, arrival_seq FROM ev",
    "status_counts": BASE + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN bytes <= 0 THEN 'invalid_bytes' WHEN row_number() OVER (PARTITION BY event_id, bytes > 0 ORDER BY arrival_seq) > 1 THEN 'dup' ELSE 'ok' END AS status FROM raw) GROUP BY status",
    "block_immediate": BASE + BLOCKS + "SELECT event_id FROM ev WHERE sub_id IN (SELECT sub_id FROM bi)",
    "block_time": BASE + BLOCKS + "SELECT event_id FROM ev WHERE sub_id IN (SELECT sub_id FROM bt)",
    "block_app": BASE + BLOCKS + "SELECT event_id FROM ev WHERE (sub_id, app_id) IN (SELECT sub_id, app_id FROM ba)",
    "block_repeat": BASE + BLOCKS + "SELECT event_id FROM ev WHERE sub_id IN (SELECT sub_id FROM br)",
    "policy_pass": BASE + BLOCKS + "SELECT event_id FROM pass",
    "policy_pass_morning": BASE + MORNING + "SELECT event_id FROM pass",
    "block_repeat_morning": BASE + MORNING + "SELECT event_id FROM ev WHERE sub_id IN (SELECT sub_id FROM br)",
    "allocate_waterfall": takes("SELECT event_id, sub_id, family_id, yyyymm, bytes, CAST(gift_take AS BIGINT) AS gift_take, CAST(plan_take AS BIGINT) AS plan_take, CAST(family_take AS BIGINT) AS family_take, CAST(overflow AS BIGINT) AS overflow, CAST(plan_used AS BIGINT) AS plan_used, CAST(family_used AS BIGINT) AS family_used FROM al"),
    "gift_split": takes("SELECT event_id, gift_id, CAST(take AS BIGINT) AS take, CAST(gift_used AS BIGINT) AS gift_used FROM sp"),
    "usage_sub_month": _totals("yyyymm"),
    "usage_sub_day": _totals("yyyymmdd"),
    "usage_family_month": takes("SELECT family_id, yyyymm, CAST(sum(family_take) AS BIGINT) AS family_used FROM al WHERE family_take > 0 GROUP BY ALL"),
    "usage_family_day": takes("SELECT family_id, yyyymmdd, CAST(sum(family_take) AS BIGINT) AS family_used FROM al WHERE family_take > 0 GROUP BY ALL"),
    "usage_gift": takes("SELECT sub_id, gift_id, yyyymm, CAST(sum(take) AS BIGINT) AS gift_used FROM sp GROUP BY ALL"),
    "plan_alerts": BASE + ALLOCATED + ALERTS + "SELECT event_id, sub_id, yyyymm, CAST(threshold AS INTEGER) AS threshold, CAST(remaining_pct AS INTEGER) AS remaining_pct, CAST(plan_used AS BIGINT) AS plan_used FROM pa",
    "family_alerts": BASE + ALLOCATED + ALERTS + "SELECT event_id, family_id, yyyymm, CAST(threshold AS INTEGER) AS threshold, CAST(remaining_pct AS INTEGER) AS remaining_pct, CAST(family_used AS BIGINT) AS family_used FROM fa",
    "gift_alerts": BASE + ALLOCATED + ALERTS + "SELECT event_id, gift_id, yyyymm, CAST(threshold AS INTEGER) AS threshold, CAST(remaining_pct AS INTEGER) AS remaining_pct, CAST(gift_used AS BIGINT) AS gift_used FROM ga",
    "outbox_rows": _outbox(),
    "applied_log": LOG,
    "rebuild_from_log": _totals("yyyymm"),
    "rebuild_family": takes("SELECT family_id, yyyymm, CAST(sum(family_take) AS BIGINT) AS family_used FROM al WHERE family_take > 0 GROUP BY ALL"),
    "topk_apps": BASE + "SELECT sub_id, app_id, yyyymm, used, place FROM (SELECT *, row_number() OVER (PARTITION BY sub_id, yyyymm ORDER BY used DESC, app_id ASC NULLS LAST) AS place FROM (SELECT sub_id, app_id, yyyymm, CAST(sum(bytes) AS BIGINT) AS used FROM ev GROUP BY ALL)) WHERE place <= 3",
    "plan_limits": BASE + "SELECT sub_id, CAST(plan_limit AS BIGINT) AS plan_limit FROM plan_limit",
    "family_limits": BASE + "SELECT family_id, CAST(family_limit AS BIGINT) AS family_limit FROM family_limit",
    "members": BASE + "SELECT family_id, sub_id, CAST(member_limit AS BIGINT) AS member_limit FROM member",
    "priorities": BASE + "SELECT family_id, sub_id, CAST(priority AS BIGINT) AS score FROM member WHERE priority >= 0",
    "locked_subs": BASE + "SELECT sub_id FROM subs WHERE sub_id % 17 = 3",
    "blocked_apps": BASE + "SELECT sub_id, sub_id % 8 + 1 AS app_id FROM subs WHERE sub_id % 3 <> 1 AND sub_id % 8 + 1 NOT IN (1, 5)",
    "gift_app": "SELECT CAST(min(event_id % 20 + 1) AS BIGINT) AS app_id FROM events WHERE event_id % 20 + 1 NOT IN (1, 5)",
    "policy_repeat_parse": BASE + f"SELECT sub_id, policy_id, value AS encoded FROM subs JOIN {POLICY_ROWS} ON policy_id = sub_id % 10 + 1 WHERE sub_id % 6 <> 0 AND kind = 'SCHEDULED'",
    "policy_once_parse": BASE + f"SELECT sub_id, policy_id, CAST(value AS BIGINT) AS expire_epoch FROM subs JOIN {POLICY_ROWS} ON policy_id = sub_id % 10 + 1 WHERE sub_id % 6 <> 0 AND kind = 'ONCE'",
    "seed_gifts": BASE + "SELECT sub AS sub_id, CAST(event_id AS VARCHAR) AS gift_id, strftime(ts, '%Y%m') AS yyyymm, CAST(floor(abs(value)) * 1000 + 1000 AS BIGINT) AS gift_limit, CAST(floor(epoch(ts)) AS BIGINT) - 32400 AS score FROM src WHERE event_id % 25 = 0",
    "seed_donor_usage": BASE + """, g AS (SELECT (user_id + 3) % 15 + 1 AS sub_id, CAST(floor(abs(value)) * 1000 + 1000 AS BIGINT) AS amount, strftime(ts, '%Y%m') AS m, strftime(ts, '%Y%m%d') AS d, lpad(CAST(hour(ts) // 3 * 3 AS VARCHAR), 2, '0') || '_used' AS slot FROM src WHERE event_id % 25 = 0),
u AS (SELECT sub_id, amount, 'plan_month' AS kind, m AS period, CAST(NULL AS VARCHAR) AS item FROM g UNION ALL SELECT sub_id, amount, 'plan_day', d, NULL FROM g UNION ALL SELECT sub_id, amount, 'app_month', m, '2' FROM g UNION ALL SELECT sub_id, amount, 'app_day', d, '2' FROM g UNION ALL SELECT sub_id, amount, 'slot', d, slot FROM g)
SELECT sub_id, kind, period, item, CAST(sum(amount) AS BIGINT) AS used FROM u GROUP BY ALL""",
    "gate_left": BASE + GATE + """SELECT 'gift' AS kind, sub_id, CAST(NULL AS BIGINT) AS family_id, CAST(g AS BIGINT) AS amount_left FROM gsum
UNION ALL SELECT 'plan', sub_id, NULL, CAST(nullif(p, -1) AS BIGINT) FROM pleft UNION ALL SELECT 'pool', NULL, family_id, CAST(f AS BIGINT) FROM fleft
UNION ALL SELECT 'member', sub_id, family_id, CAST(m AS BIGINT) FROM mleft""",
    "gate_personal": BASE + GATE + "SELECT event_id, sub_id, nullif(path, '') AS path FROM walk",
    "gate_family": BASE + GATE + "SELECT event_id, family_id, CASE WHEN family_id % 2 = 0 THEN 'PRIORITY' ELSE 'FIFO' END AS mode FROM fam",
    "approved_events": BASE + GATE + "SELECT event_id, path FROM walk WHERE path <> '' UNION ALL SELECT event_id, 'family' FROM fam",
    "published_events": BASE + GATE + "SELECT event_id, sub_id, bytes FROM batch WHERE event_id IN (SELECT event_id FROM walk WHERE path <> '' UNION ALL SELECT event_id FROM fam)",
    "block_time_pruned": BASE + "SELECT sub_id, CAST(1705505400 AS BIGINT) AS expire_epoch FROM subs WHERE sub_id % 13 = 5 AND sub_id % 2 = 0",
    "first_gift": BASE + "SELECT sub AS sub_id, min(event_id) AS present_data_id, arg_min(CAST(floor(abs(value)) * 1000 + 1000 AS BIGINT), event_id) AS data_amount FROM src WHERE event_id % 25 = 0 GROUP BY sub",
    "control_parsed": BASE + CONTROL + "SELECT 'c-' || CAST(seq AS VARCHAR) AS event_id, kind, seq FROM ctl",
    "plan_latest": BASE + CONTROL + "SELECT sub_id, CAST(coalesce((SELECT arg_max(amount, seq) FROM ctl WHERE kind = 'PLAN_CHANGED' AND sub = sub_id), plan_limit) AS BIGINT) AS plan_limit FROM plan_limit",
    "lock_latest": BASE + CONTROL + "SELECT sub_id FROM subs WHERE coalesce((SELECT arg_max(kind, seq) = 'SUBSCRIPTION_LOCKED' FROM ctl WHERE kind LIKE 'SUBSCRIPTION%' AND sub = sub_id), sub_id % 17 = 3)",
    "app_block_latest": BASE + CONTROL + """, la AS (SELECT sub, arg_max(n, seq) AS n FROM ctl WHERE kind = 'APP_BLOCK_LIST_UPDATED' GROUP BY sub)
SELECT sub_id, CAST(3 AS BIGINT) AS app_id FROM subs WHERE sub_id % 7 = 2 AND sub_id NOT IN (SELECT sub FROM la) UNION ALL SELECT sub, CAST(n % 9 + d AS BIGINT) FROM la, range(2) AS t(d) WHERE n % 5 <> 0""",
    "policy_latest": BASE + CONTROL + """, snap AS (SELECT sub, max(seq) AS since FROM ctl WHERE kind = 'POLICY_SNAPSHOT' GROUP BY sub),
pe AS (SELECT seq, sub + d AS sub_id, policy, n, amount, true AS live FROM ctl, range(2) AS t(d) WHERE kind = 'POLICY_CHANGED'
  UNION ALL SELECT seq, sub, policy, n, amount, false FROM ctl WHERE kind IN ('POLICY_DEACTIVATE', 'POLICY_DELETED') AND n % 7 <> 0 UNION ALL SELECT seq, sub, policy, n, amount, true FROM ctl WHERE kind = 'POLICY_SNAPSHOT'),
pl AS (SELECT *, row_number() OVER (PARTITION BY sub_id, policy ORDER BY seq DESC) AS rn FROM pe LEFT JOIN snap ON snap.sub = pe.sub_id WHERE since IS NULL OR seq >= since)
SELECT sub_id, policy AS policy_id, CASE WHEN n % 3 = 0 THEN 'time' ELSE 'repeat' END AS store, CASE WHEN n % 3 <> 0 THEN '1,' || CAST(n % 5 + 2 AS VARCHAR) || '|09:00|10:00' END AS encoded, CASE WHEN n % 3 = 0 THEN 1700000000 + amount END AS expire_epoch FROM pl WHERE rn = 1 AND live""",
    "policy_stored": BASE + CONTROL + POLICY_STATE + "SELECT sub_id, policy_id, kind AS type, encoded, expire_epoch FROM stored",
    "policy_now": BASE + CONTROL + POLICY_STATE + "SELECT sub_id, policy_id, store, encoded, expire_epoch FROM now_policy",
    "policy_pass_latest": BASE + CONTROL + POLICY_STATE + """SELECT event_id FROM ev WHERE sub_id NOT IN (SELECT sub_id FROM shut)
  AND NOT EXISTS (SELECT 1 FROM app_now WHERE app_now.sub_id = ev.sub_id AND app_now.app_id = ev.app_id)""",
    "member_limit_latest": BASE + CONTROL + """, nl AS (SELECT fam AS family_id, sub AS sub_id, arg_max(amount, seq) AS v FROM ctl WHERE kind = 'FAMILY_SUB_LIMIT_CHANGED' GROUP BY ALL)
SELECT family_id, sub_id, CAST(coalesce(v, member_limit) AS BIGINT) AS member_limit FROM member FULL JOIN nl USING (family_id, sub_id)""",
    "family_created": BASE + CONTROL + ", fc AS (SELECT fam + 100000 AS family_id, arg_max(sub, seq) AS s FROM ctl WHERE kind = 'FAMILY_CREATE' GROUP BY ALL) SELECT family_id, s + d AS sub_id, CAST(15728640 AS BIGINT) AS member_limit, CAST(15728640 AS BIGINT) AS family_limit FROM fc, range(3) AS t(d)",
    "family_state": BASE + CONTROL + """, lt AS (SELECT family_id, sub_id, arg_max(added, seq) AS added, max(seq) AS seq, arg_max(size, seq) AS size FROM sized GROUP BY ALL), sz AS (SELECT family_id, sum(CASE WHEN added THEN 1 ELSE -1 END) AS n FROM real GROUP BY family_id)
SELECT family_id, sub_id, CAST(CASE WHEN seq >= 0 THEN size * 5242880 ELSE member_limit END AS BIGINT) AS member_limit, CAST(n * 5242880 AS BIGINT) AS family_limit FROM lt JOIN sz USING (family_id) LEFT JOIN member USING (family_id, sub_id) WHERE added""",
    "priority_state": BASE + CONTROL + """, steps AS (SELECT family_id, sub_id, added, row_number() OVER (PARTITION BY family_id ORDER BY seq) AS i FROM real WHERE seq >= 0),
lists AS (
  WITH RECURSIVE p AS (
    SELECT family_id, CAST(0 AS BIGINT) AS i, list({'sub': sub_id, 'score': CAST(priority AS BIGINT)}) AS l FROM member WHERE priority >= 0 GROUP BY family_id
    UNION ALL
    SELECT family_id, i, CASE WHEN len(l) = 0 THEN l
      WHEN added THEN list_append(list_filter(l, lambda x: x.sub <> sub_id), {'sub': sub_id, 'score': list_max(list_transform(l, lambda x: x.score)) + 1})
      ELSE list_transform(list_filter(l, lambda x: x.sub <> sub_id), lambda x: {'sub': x.sub, 'score': CASE WHEN x.score > own THEN x.score - 1 ELSE x.score END}) END
    FROM (SELECT p.family_id, steps.i, l, added, CAST(steps.sub_id AS BIGINT) AS sub_id, list_max(list_transform(list_filter(l, lambda x: x.sub = steps.sub_id), lambda x: x.score)) AS own
      FROM p JOIN steps ON steps.family_id = p.family_id AND steps.i = p.i + 1)
  ) SELECT * FROM p)
SELECT family_id, CAST(x.sub AS BIGINT) AS sub_id, x.score AS score FROM (SELECT family_id, unnest(arg_max(l, i)) AS x FROM lists GROUP BY family_id)""",
    "mode_latest": BASE + CONTROL + """, lm AS (SELECT fam, arg_max(n, seq) AS n, arg_max(sub, seq) AS s FROM ctl WHERE kind = 'FAMILY_MODE_CHANGED' GROUP BY fam)
SELECT family_id, sub_id, CAST(priority AS BIGINT) AS score FROM member WHERE priority >= 0 AND family_id NOT IN (SELECT fam FROM lm) UNION ALL SELECT fam, s + d, 1 - d FROM lm, range(2) AS t(d) WHERE n % 2 = 0""",
    "gift_append": BASE + CONTROL + """, ng AS (SELECT sub AS sub_id, 'g' || CAST(seq AS VARCHAR) AS gift_id, strftime(ts, '%Y%m') AS yyyymm, amount AS gift_limit, row_number() OVER (PARTITION BY sub, strftime(ts, '%Y%m') ORDER BY seq) AS p FROM ctl WHERE kind = 'GIFT_RECEIVED')
SELECT sub_id, gift_id, yyyymm, CAST(gift_limit AS BIGINT) AS gift_limit, CAST(score AS BIGINT) AS score FROM gift UNION ALL
SELECT sub_id, gift_id, yyyymm, gift_limit, CAST(coalesce((SELECT max(score) FROM gift WHERE gift.sub_id = ng.sub_id AND gift.yyyymm = ng.yyyymm), -1) + p AS BIGINT) FROM ng""",
    "generator_fixed": BASE + "SELECT sub_id, family_id, CAST(1000 AS BIGINT) AS bytes FROM subs WHERE sub_id IN (1, 2, 3) AND family_id > 0",
    "generator_random": BASE + f"SELECT sub_id, family_id, CAST(n AS INTEGER) AS n, {_between(_u("'bytes'", "'7'", "sub_id", "n"), '50', '500')} AS bytes, CAST(floor({_u("'app'", "'7'", "sub_id", "n")} * 19) + 1 AS BIGINT) AS app_id FROM subs, range(1, 21) AS t(n)",
    "history_days": HISTORY + "SELECT sub_id, day, yyyymm, used FROM hist",
    "history_apps": APPS_SQL + "SELECT sub_id, day, item AS app_id, CAST(used AS BIGINT) AS used FROM asplit",
    "history_slots": SLOTS_SQL + "SELECT sub_id, day, item AS slot, CAST(used AS BIGINT) AS used FROM ssplit",
    "donor_usage": BASE + CONTROL + """, g AS (SELECT (user_id + 3) % 15 + 1 AS sub_id, amount, strftime(ts, '%Y%m') AS m, strftime(ts, '%Y%m%d') AS d FROM ctl WHERE kind = 'GIFT_RECEIVED'),
u AS (SELECT sub_id, amount, 'plan_month' AS kind, m AS period, CAST(NULL AS VARCHAR) AS item FROM g UNION ALL SELECT sub_id, amount, 'plan_day', d, NULL FROM g UNION ALL SELECT sub_id, amount, 'app_month', m, '20' FROM g UNION ALL SELECT sub_id, amount, 'app_day', d, '20' FROM g)
SELECT sub_id, kind, period, item, CAST(sum(amount) AS BIGINT) AS used FROM u GROUP BY ALL""",
}
