"""The rules of one subscriber and of one family as state machines, for where limits change between events.

A machine takes rows of its key in order: changes of limits, and usage. It keeps what it knows in a store: `limits` (what changes set),
`used` (counters) and `levels` (alert levels reached). The same machines run over a stream, where the store is Spark's keyed state, and over
a table, where a partition's rows are sorted and run past them (`folded`): no key's rows are ever held together.

Gifts and the plan belong to the subscriber, whatever families its events name; the pool and the members' caps to the family that an event
names, as a member's cap counts what the pool has paid, which only the family's own order of events tells.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.quota import DAILY_PLAN_LIMIT, MEMBER_LIMIT, NO_ALERT

#: Kinds of rows besides those of change events: usage, and what is stored at the start.
USAGE, STORED_PLAN, STORED_GIFT, STORED_POOL, STORED_MEMBER, STORED_USE = "USAGE", "STORED_PLAN", "STORED_GIFT", "STORED_POOL", "STORED_MEMBER", "STORED_USE"
SUBSCRIBER_KINDS = ("PLAN_CHANGED", "GIFT_RECEIVED")
FAMILY_KINDS = ("FAMILY_CREATE", "FAMILY_MEMBER_ADDED", "FAMILY_MEMBER_REMOVED", "FAMILY_MODE_CHANGED", "FAMILY_SUB_LIMIT_CHANGED")
#: A change as a machine takes it: limit is what the kind sets, name and month whose; members and priorities lists of a family.
CHANGE = "kind string, sub_id bigint, amount bigint, name string, yyyymm string, score bigint, mode string, members array<bigint>, priorities array<struct<subId:bigint,priority:bigint>>"


def level(quota: int, used: int) -> int:
    """The alert level that a use of a quota has reached."""
    if quota <= 0:
        return NO_ALERT
    left = max(0, quota - used)
    percent = left * 100 // quota
    return 0 if not left else next((x for x in (10, 30, 50) if percent <= x), NO_ALERT)


class Table(dict):
    """One table of a store, in memory."""

    def put(self, name: str, value) -> None:
        self[name] = value

    def drop(self, name: str) -> None:
        self.pop(name, None)


class Store:
    def __init__(self, table: Callable[[], Table] = Table):
        self.limits, self.used, self.levels = table(), table(), table()


class Machine:
    def __init__(self, store: Store):
        self.limits, self.used, self.levels = store.limits, store.used, store.levels

    def _add(self, name: str, amount: int) -> int:
        total = (self.used.get(name) or 0) + amount
        if amount:
            self.used.put(name, total)
        return total

    def _stored_use(self, name: str, amount: int, quota: int, alert: str) -> None:
        """Usage before the first row: levels that it had reached are not alerted again."""
        total = self._add(name, amount)
        self._fires(alert, quota, total)

    def _fires(self, name: str, quota: int, used: int) -> int | None:
        now, last = level(quota, used), self.levels.get(name)
        if now == NO_ALERT or now >= (NO_ALERT if last is None else last):
            return None
        self.levels.put(name, now)
        return now


@lru_cache(maxsize=1024)
def _parsed(text: str) -> tuple:
    """A stored list of gifts, parsed once for the events in a row that draw on it."""
    return tuple(map(tuple, json.loads(text)))


class Subscriber(Machine):
    """Gifts in order of their scores, then the plan."""

    RESULT = "gift_take bigint, plan_take bigint, rest bigint, plan_limit bigint, plan_used bigint, plan_fired int, gift_detail string"

    def _gifts(self, month: str) -> tuple:
        return _parsed(self.limits.get(f"gifts|{month}") or "[]")

    def change(self, kind: str, c) -> None:
        if kind in ("PLAN_CHANGED", STORED_PLAN):
            self.limits.put("plan", str(c["amount"]))
        elif kind in ("GIFT_RECEIVED", STORED_GIFT):
            gifts = [g for g in self._gifts(c["yyyymm"]) if g[1] != c["name"]]
            score = c["score"] if kind == STORED_GIFT else max((g[0] for g in gifts), default=-1) + 1
            gifts = sorted([*gifts, (score, c["name"], c["amount"])])
            self.limits.put(f"gifts|{c['yyyymm']}", json.dumps(gifts))
        elif kind == STORED_USE and c["name"] is None:
            period, limit = c["yyyymm"], int(self.limits.get("plan") or 0)
            # a daily plan's levels come of its days, another's of its months
            self._stored_use(f"plan|{period}", c["amount"], limit if (limit == DAILY_PLAN_LIMIT) == (len(period) == 8) else 0, f"plan|{period[:6]}")
        elif kind == STORED_USE:
            limit = next((g[2] for g in self._gifts(c["yyyymm"]) if g[1] == c["name"]), 0)
            self._stored_use(f"gift|{c['name']}|{c['yyyymm']}", c["amount"], limit, f"gift|{c['name']}|{c['yyyymm']}")

    def usage(self, amount: int, month: str, day: str) -> dict:
        left, gifts = amount, []
        for _, gift, limit in self._gifts(month):
            name = f"gift|{gift}|{month}"
            take = min(left, max(0, limit - (self.used.get(name) or 0)))
            if take > 0:
                used = self._add(name, take)
                gifts.append({"giftId": gift, "limit": limit, "usedAmount": take, "giftUsed": used, "fired": self._fires(name, limit, used)})
                left -= take
        limit = int(self.limits.get("plan") or 0)
        used = self.used.get(f"plan|{day if limit == DAILY_PLAN_LIMIT else month}") or 0
        take = left if limit < 0 else min(left, max(0, limit - used))
        self._add(f"plan|{month}", take)  # a plan may change from monthly to daily and back
        self._add(f"plan|{day}", take)
        fired = self._fires(f"plan|{month}", limit, used + take) if take > 0 else None
        return {"gift_take": amount - left, "plan_take": take, "rest": left - take, "plan_limit": limit, "plan_used": used + take, "plan_fired": fired, "gift_detail": json.dumps(gifts) if gifts else "[]"}


class Family(Machine):
    """Members, their caps, the order of priority, and the pool."""

    RESULT = "family_take bigint, overflow bigint, family_limit bigint, family_used bigint, family_fired int"

    def _number(self, name: str) -> int:
        return int(self.limits.get(name) or 0)

    def _list(self, name: str) -> dict:
        return {int(k): v for k, v in json.loads(self.limits.get(name) or "{}").items()}

    def _scores(self, scores: dict) -> None:
        self.limits.put("scores", json.dumps(scores)) if scores else self.limits.drop("scores")

    def change(self, kind: str, c) -> None:
        sub = c["sub_id"]
        if kind == STORED_POOL:
            self.limits.put("pool", str(c["amount"]))
        elif kind == STORED_MEMBER:
            self._join(sub, c["amount"])
            if c["score"] is not None:
                self._scores(self._list("scores") | {sub: c["score"]})
        elif kind == STORED_USE and sub is None:
            self._stored_use(f"pool|{c['yyyymm']}", c["amount"], self._number("pool"), f"pool|{c['yyyymm']}")
        elif kind == STORED_USE:
            self._add(f"member|{sub}|{c['yyyymm']}", c["amount"])
        elif kind == "FAMILY_CREATE":
            limit = len(c["members"]) * MEMBER_LIMIT
            self.limits.put("pool", str(limit))
            for member in c["members"]:
                self._join(member, limit)
        elif kind == "FAMILY_MEMBER_ADDED" and not self._in(sub):
            limit = self._number("pool") + MEMBER_LIMIT
            self.limits.put("pool", str(limit))
            self._join(sub, limit)
            scores = self._list("scores")
            if scores:
                self._scores(scores | {sub: max(scores.values()) + 1})
        elif kind == "FAMILY_MEMBER_REMOVED" and self._in(sub):
            self.limits.put("pool", str(max(0, self._number("pool") - MEMBER_LIMIT)))
            self.limits.drop(f"in|{sub}")
            self.limits.drop(f"member|{sub}")
            scores = self._list("scores")
            if sub in scores:
                gone = scores.pop(sub)
                self._scores({k: v - 1 if v > gone else v for k, v in scores.items()})
        elif kind == "FAMILY_SUB_LIMIT_CHANGED":
            self.limits.put(f"member|{sub}", str(c["amount"]))
        elif kind == "FAMILY_MODE_CHANGED":
            self._scores({p["subId"]: p["priority"] for p in c["priorities"] or []} if c["mode"] == "PRIORITY" else {})

    def _in(self, sub: int) -> bool:
        return self.limits.get(f"in|{sub}") is not None

    def _join(self, sub: int, limit: int | None) -> None:
        self.limits.put(f"in|{sub}", "1")
        if limit is not None:
            self.limits.put(f"member|{sub}", str(limit))

    def usage(self, sub: int, rest: int, month: str) -> dict:
        cap, limit = self._number(f"member|{sub}"), self._number("pool")
        member, pool = f"member|{sub}|{month}", f"pool|{month}"
        asked = rest if cap <= 0 else min(rest, max(0, cap - (self.used.get(member) or 0)))
        take = min(asked, max(0, limit - (self.used.get(pool) or 0)))
        self._add(member, take)
        used = self._add(pool, take)
        fired = self._fires(pool, limit, used) if take > 0 else None
        return {"family_take": take, "overflow": rest - take, "family_limit": limit, "family_used": used, "family_fired": fired}

    def members(self) -> list[dict]:
        """Of a store that can be listed: each member with the limits and its place in the order of priority, if there is one."""
        scores = self._list("scores")
        limit = self._number("pool")
        subs = sorted(int(name[3:]) for name in self.limits if name.startswith("in|"))
        return [{"sub_id": s, "member_limit": None if (own := self.limits.get(f"member|{s}")) is None else int(own), "family_limit": limit, "score": scores.get(s)} for s in subs]


def values(column: pa.Array) -> list:
    """A column as `to_pylist` gives it, by way of numpy where that is the same, and without a step for what is null."""
    known = column.drop_null()
    kind = column.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_string(kind) or kind == pa.timestamp("us")
    some = known.to_numpy(zero_copy_only=False).tolist() if plain else known.to_pylist()
    if len(some) == len(column):
        return some
    out = [None] * len(column)
    for i, value in zip(np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist(), some, strict=True):
        out[i] = value
    return out


def folded(rows: DataFrame, key: str, order: list, step: Callable[[object, dict], Iterator[dict]], start: Callable[[], object], end: Callable[[object, object], Iterator[dict]], schema: str) -> DataFrame:
    """The rows of each key, in order, through step(state, row), which yields rows; end(key, state) yields more when a key is over.

    One exchange by key and a sort; rows run past one state at a time, so memory is that of a state, however many rows a key has. The
    exchange keeps all its partitions: by their bytes, adaptive execution would make about one a core, and the longest would be waited for."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(tasks, F.col(key)).sortWithinPartitions(F.col(key), *order)
    kinds = sorted_rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(kinds)
        begun, now, state = False, None, None
        for batch in batches:
            out: list[dict] = []
            for row in map(dict, map(zip, repeat(batch.schema.names), zip(*map(values, batch.columns), strict=True))):
                if not begun or row[key] != now:
                    if begun:
                        out += end(now, state)
                    begun, now, state = True, row[key], start()
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if begun:
            yield pa.RecordBatch.from_pylist(list(end(now, state)), schema=out_schema)

    return sorted_rows.mapInArrow(run, kinds)
