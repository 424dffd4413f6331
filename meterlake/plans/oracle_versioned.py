"""SQL of the queries in which limits change between events: recursion over a key's rows, one after the other."""

from __future__ import annotations

from .oracle import BASE, level

#: Changes of limits as the fixture makes them, each id once in its space.
CHANGES = """,
lk AS (SELECT ['FAMILY_MEMBER_ADDED', 'FAMILY_MODE_CHANGED', 'FAMILY_MEMBER_REMOVED', 'FAMILY_SUB_LIMIT_CHANGED', 'FAMILY_MEMBER_ADDED', 'FAMILY_MEMBER_REMOVED',
  'PLAN_CHANGED', 'GIFT_RECEIVED'] AS k),
lm0 AS (SELECT event_id AS seq, CASE WHEN event_id % 31 = 7 THEN event_id - 1 ELSE event_id END AS id, ts + INTERVAL 9 HOUR AS kst, ts, sub, (sub - 1) // 5 + 1 AS fam,
    CASE WHEN event_id % 97 = 5 THEN 'FAMILY_CREATE' ELSE k[event_id % 8 + 1] END AS kind, CAST(floor(abs(value)) * 100000 AS BIGINT) AS amount
  FROM src, lk),
lm AS MATERIALIZED (SELECT *, (fam - 1) * 5 + seq % 7 + 1 AS target FROM lm0
  QUALIFY row_number() OVER (PARTITION BY kind LIKE 'FAMILY%', id ORDER BY seq) = 1),
pools AS (SELECT DISTINCT family_id, CASE WHEN family_id % 6 <> 4 THEN family_id * 1234567 % 9000001 ELSE 0 END AS pool FROM member),
"""

#: How a change `kind` of a family leaves its pool, members (ms), caps and scores (sc); target, sub, amount, seq are the change's.
_IN = "list_contains(ms, target)"
_SCORE = "list_max(list_transform(list_filter(sc, lambda x: x.sub = target), lambda x: x.score))"
FAMILY_STEP = {
    "pool": f"""CASE WHEN kind = 'FAMILY_CREATE' THEN 10485760 WHEN kind = 'FAMILY_MEMBER_ADDED' AND NOT {_IN} THEN pool + 5242880
      WHEN kind = 'FAMILY_MEMBER_REMOVED' AND {_IN} THEN greatest(0, pool - 5242880) ELSE pool END""",
    "ms": f"""CASE WHEN kind = 'FAMILY_CREATE' THEN list_distinct(list_concat(ms, [target, sub])) WHEN kind = 'FAMILY_MEMBER_ADDED' AND NOT {_IN} THEN list_append(ms, target)
      WHEN kind = 'FAMILY_MEMBER_REMOVED' THEN list_filter(ms, lambda x: x <> target) ELSE ms END""",
    "caps": f"""CASE WHEN kind = 'FAMILY_CREATE' THEN list_concat(list_filter(caps, lambda x: x.sub <> target AND x.sub <> sub), [{{'sub': target, 'cap': 10485760}}, {{'sub': sub, 'cap': 10485760}}])
      WHEN kind = 'FAMILY_MEMBER_ADDED' AND NOT {_IN} THEN list_append(list_filter(caps, lambda x: x.sub <> target), {{'sub': target, 'cap': pool + 5242880}})
      WHEN kind = 'FAMILY_MEMBER_REMOVED' AND {_IN} THEN list_filter(caps, lambda x: x.sub <> target)
      WHEN kind = 'FAMILY_SUB_LIMIT_CHANGED' THEN list_append(list_filter(caps, lambda x: x.sub <> target), {{'sub': target, 'cap': amount}}) ELSE caps END""",
    "sc": f"""CASE WHEN kind = 'FAMILY_MODE_CHANGED' AND seq % 3 = 0 THEN sc[1:0]
      WHEN kind = 'FAMILY_MODE_CHANGED' THEN [{{'sub': (fam - 1) * 5 + 1, 'score': seq % 4}}, {{'sub': (fam - 1) * 5 + 2, 'score': (seq + 3) % 4}}, {{'sub': (fam - 1) * 5 + 3, 'score': (seq + 6) % 4}}]
      WHEN kind = 'FAMILY_MEMBER_ADDED' AND NOT {_IN} AND len(sc) > 0
        THEN list_append(list_filter(sc, lambda x: x.sub <> target), {{'sub': target, 'score': list_max(list_transform(sc, lambda x: x.score)) + 1}})
      WHEN kind = 'FAMILY_MEMBER_REMOVED' AND {_IN} AND own IS NOT NULL
        THEN list_transform(list_filter(sc, lambda x: x.sub <> target), lambda x: {{'sub': x.sub, 'score': CASE WHEN x.score > own THEN x.score - 1 ELSE x.score END}})
      ELSE sc END""",
}
_STRUCTS = "CAST(coalesce({0}, []) AS STRUCT(sub BIGINT, {1} BIGINT)[])"

#: The state of each family at the start.
START = f"""
start AS MATERIALIZED (SELECT family_id, CAST(pool AS BIGINT) AS pool, CAST(list(sub_id) AS BIGINT[]) AS ms,
    {_STRUCTS.format("list({'sub': sub_id, 'cap': member_limit})", "cap")} AS caps,
    {_STRUCTS.format("list({'sub': sub_id, 'score': priority}) FILTER (WHERE priority >= 0)", "score")} AS sc
  FROM member JOIN pools USING (family_id) GROUP BY family_id, pool)
"""

FAMILY_FINAL = (
    BASE
    + CHANGES
    + START
    + f""",
fc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY seq) AS i FROM lm WHERE kind LIKE 'FAMILY%'),
walk AS (
  WITH RECURSIVE f AS (
    SELECT family_id, CAST(0 AS BIGINT) AS i, pool, ms, caps, sc FROM start
    UNION ALL
    SELECT family_id, i, CAST({FAMILY_STEP["pool"]} AS BIGINT), {FAMILY_STEP["ms"]}, {FAMILY_STEP["caps"]}, {FAMILY_STEP["sc"]}
    FROM (SELECT f.family_id, c.i, pool, ms, caps, sc, kind, target, sub, fam, amount, c.seq, {_SCORE} AS own FROM f JOIN fc c ON c.fam = f.family_id AND c.i = f.i + 1))
  SELECT * FROM f),
last AS (SELECT family_id, arg_max(pool, i) AS pool, arg_max(ms, i) AS ms, arg_max(caps, i) AS caps, arg_max(sc, i) AS sc FROM walk GROUP BY family_id),
each AS (SELECT *, unnest(ms) AS s FROM last)
SELECT family_id, CAST(s AS BIGINT) AS sub_id, CAST(list_max(list_transform(list_filter(caps, lambda x: x.sub = s), lambda x: x.cap)) AS BIGINT) AS member_limit,
  CAST(pool AS BIGINT) AS family_limit, CAST(list_max(list_transform(list_filter(sc, lambda x: x.sub = s), lambda x: x.score)) AS BIGINT) AS score
FROM each
"""
)

_PAID = "least(bytes, coalesce(list_sum(list_transform(list_filter(gifts, lambda x: x.m = yyyymm), lambda x: x.cap - x.used)), 0))"
_GIFT = """CASE WHEN kind = 'GIFT_RECEIVED' THEN list_append(gifts, {'m': gm, 'cap': amount, 'used': 0})
      WHEN kind = 'USAGE' THEN list_transform(gifts, lambda x, j: {'m': x.m, 'cap': x.cap, 'used': x.used + CASE WHEN x.m <> yyyymm THEN 0 ELSE
        least(x.cap - x.used, greatest(0, bytes - coalesce(list_sum(list_transform(list_filter(gifts[1:j - 1], lambda y: y.m = yyyymm), lambda y: y.cap - y.used)), 0))) END})
      ELSE gifts END"""

VERSIONED = (
    BASE
    + CHANGES
    + START
    + f""",
orows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY kst, kind = 'USAGE', seq, event_id) AS i FROM (
  SELECT sub_id AS sub, 'USAGE' AS kind, kst, CAST(0 AS BIGINT) AS seq, event_id, bytes, yyyymm, yyyymmdd, family_id, CAST(0 AS BIGINT) AS amount, '' AS gm FROM ev
  UNION ALL
  SELECT sub, kind, kst, seq, '', 0, '', '', 0, CASE WHEN kind = 'PLAN_CHANGED' AND seq % 5 = 0 THEN 1048576 WHEN kind = 'PLAN_CHANGED' AND seq % 11 = 0 THEN -1 ELSE amount END, strftime(ts, '%Y%m')
  FROM lm WHERE kind IN ('PLAN_CHANGED', 'GIFT_RECEIVED'))),
own AS MATERIALIZED (
  WITH RECURSIVE o AS (
    SELECT sub_id AS sub, CAST(0 AS BIGINT) AS i, CAST(plan_limit AS BIGINT) AS lim, '' AS mon, CAST(0 AS BIGINT) AS mused, '' AS day, CAST(0 AS BIGINT) AS dused, CAST(101 AS BIGINT) AS lev,
      CAST(coalesce((SELECT list({{'m': yyyymm, 'cap': gift_limit, 'used': 0}} ORDER BY score, gift_id) FROM gift WHERE gift.sub_id = plan_limit.sub_id), []) AS STRUCT(m VARCHAR, cap BIGINT, used BIGINT)[]) AS gifts,
      '' AS kind, CAST(NULL AS TIMESTAMP) AS kst, '' AS event_id, CAST(0 AS BIGINT) AS bytes, '' AS yyyymm, CAST(0 AS BIGINT) AS family_id,
      CAST(0 AS BIGINT) AS gift_take, CAST(0 AS BIGINT) AS plan_take, CAST(0 AS BIGINT) AS plan_used, CAST(NULL AS BIGINT) AS plan_alert
    FROM plan_limit
    UNION ALL
    SELECT sub, i, CASE WHEN kind = 'PLAN_CHANGED' THEN amount ELSE lim END, CASE WHEN kind = 'USAGE' THEN yyyymm ELSE mon END, CASE WHEN kind = 'USAGE' THEN m0 + take ELSE mused END,
      CASE WHEN kind = 'USAGE' THEN yyyymmdd ELSE day END, CASE WHEN kind = 'USAGE' THEN d0 + take ELSE dused END,
      CASE WHEN kind <> 'USAGE' THEN lev WHEN take > 0 AND th < l0 THEN th ELSE l0 END, {_GIFT}, kind, kst, event_id, bytes, yyyymm, family_id, paid, take, base + take,
      CASE WHEN kind = 'USAGE' AND take > 0 AND th < l0 THEN th END
    FROM (SELECT *, {level("lim", "(base + take)")} AS th FROM (
      SELECT *, CASE WHEN kind <> 'USAGE' THEN 0 WHEN lim < 0 THEN bytes - paid ELSE least(bytes - paid, greatest(0, lim - base)) END AS take FROM (
        SELECT *, CASE WHEN lim = 1048576 THEN d0 ELSE m0 END AS base FROM (
          SELECT o.sub, r.i, lim, mon, mused, day, dused, lev, gifts, r.kind, r.kst, r.event_id, r.bytes, r.yyyymm, r.yyyymmdd, r.family_id, r.amount, r.gm,
            CASE WHEN mon = r.yyyymm THEN mused ELSE 0 END AS m0, CASE WHEN day = r.yyyymmdd THEN dused ELSE 0 END AS d0, CASE WHEN mon = r.yyyymm THEN lev ELSE 101 END AS l0,
            CAST(CASE WHEN r.kind = 'USAGE' THEN {_PAID.replace("bytes", "r.bytes").replace("yyyymm", "r.yyyymm")} ELSE 0 END AS BIGINT) AS paid
          FROM o JOIN orows r ON r.sub = o.sub AND r.i = o.i + 1)))))
  SELECT * FROM o WHERE kind = 'USAGE'),
srows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY kst, kind = 'USAGE', seq, event_id) AS i FROM (
  SELECT CASE WHEN family_id > 0 THEN family_id ELSE -sub END AS grp, kind, kst, CAST(0 AS BIGINT) AS seq, event_id, bytes - gift_take - plan_take AS rest, yyyymm, sub, sub AS target, CAST(0 AS BIGINT) AS amount, family_id AS fam FROM own
  UNION ALL SELECT fam, kind, kst, seq, '', 0, '', sub, target, amount, fam FROM lm WHERE kind LIKE 'FAMILY%')),
every AS (SELECT * FROM start UNION ALL SELECT DISTINCT grp, 0, CAST([] AS BIGINT[]), {_STRUCTS.format("[]", "cap")}, {_STRUCTS.format("[]", "score")} FROM srows WHERE grp NOT IN (SELECT family_id FROM start)),
shared AS MATERIALIZED (
  WITH RECURSIVE f AS (
    SELECT family_id AS grp, CAST(0 AS BIGINT) AS i, pool, ms, caps, sc, '' AS mon, CAST(0 AS BIGINT) AS pused, MAP(CAST([] AS BIGINT[]), CAST([] AS BIGINT[])) AS spent, CAST(101 AS BIGINT) AS lev,
      '' AS kind, '' AS event_id, CAST(0 AS BIGINT) AS take, CAST(0 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS family_alert
    FROM every
    UNION ALL
    SELECT grp, i, CAST({FAMILY_STEP["pool"]} AS BIGINT), {FAMILY_STEP["ms"]}, {FAMILY_STEP["caps"]}, {FAMILY_STEP["sc"]}, CASE WHEN kind = 'USAGE' THEN yyyymm ELSE mon END,
      CASE WHEN kind = 'USAGE' THEN p0 + take ELSE pused END, CASE WHEN kind = 'USAGE' THEN map_concat(s0, MAP([target], [s + take])) ELSE spent END,
      CASE WHEN kind <> 'USAGE' THEN lev WHEN take > 0 AND th < l0 THEN th ELSE l0 END, kind, event_id, take, rest, CASE WHEN take > 0 AND th < l0 THEN th END
    FROM (SELECT *, {level("pool", "(p0 + take)")} AS th FROM (
      SELECT *, CASE WHEN kind = 'USAGE' THEN greatest(0, least(pool - p0, CASE WHEN cap > 0 THEN least(rest, greatest(0, cap - s)) ELSE rest END)) ELSE 0 END AS take FROM (
        SELECT *, coalesce(s0[target], 0) AS s FROM (
          SELECT f.grp, r.i, pool, ms, caps, sc, mon, pused, spent, lev, r.kind, r.event_id, r.rest, r.yyyymm, r.sub, CAST(r.target AS BIGINT) AS target, r.amount, r.seq, r.fam, {_SCORE.replace("target", "r.target")} AS own,
            CASE WHEN mon = r.yyyymm THEN pused ELSE 0 END AS p0, CASE WHEN mon = r.yyyymm THEN spent ELSE MAP(CAST([] AS BIGINT[]), CAST([] AS BIGINT[])) END AS s0,
            CASE WHEN mon = r.yyyymm THEN lev ELSE 101 END AS l0, coalesce(list_max(list_transform(list_filter(caps, lambda x: x.sub = r.target), lambda x: x.cap)), 0) AS cap
          FROM f JOIN srows r ON r.grp = f.grp AND r.i = f.i + 1)))))
  SELECT * FROM f WHERE kind = 'USAGE')
SELECT event_id, own.sub AS sub_id, family_id, yyyymm, own.bytes, gift_take, plan_take, CAST(take AS BIGINT) AS family_take, CAST(rest - take AS BIGINT) AS overflow, lim AS plan_limit, plan_used,
  CAST(plan_alert AS INTEGER) AS plan_alert, pool AS family_limit, pused AS family_used, CAST(family_alert AS INTEGER) AS family_alert
FROM own JOIN shared USING (event_id)
"""
)

ORACLES = {"family_final": FAMILY_FINAL, "allocate_versioned": VERSIONED}
