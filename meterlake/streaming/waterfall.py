"""The waterfall over a stream: usage and change events run past the same machines as in the versioned batch form, in Spark's keyed state.

Two stateful steps follow each other in one query, gifts and plan by subscriber, then members and pool by family. Limits are state, not static
joins: what is stored at the start fills them, change events change them, and an event sees the limits that have arrived before it. In one
batch changes come first, then usage in the order of its time.

An event counts in its own month, however late it comes. Counters and alert levels expire by the time since they were last written, event ids
by the time since they arrived, so state is bounded by what is in use. Ids of changes are kept for good.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterlake.operators import control, versioned
from meterlake.operators.machines import USAGE, Family, Store, Subscriber

# fixed values: how long counters, levels and event ids are kept, in seconds
USED_SECONDS, LEVEL_SECONDS, ONCE_SECONDS = 15_552_000, 2_678_400, 86_400


class Kept:
    """A map of Spark's state as a machine's table: read once and written once for the rows of a key in a batch."""

    def __init__(self, state):
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, name: str):
        if name not in self.seen:
            value = self.state.getValue((name,))
            self.seen[name] = None if value is None else value[0]
        return self.seen[name]

    def put(self, name: str, value) -> None:
        self.seen[name] = value
        self.changed.add(name)

    def drop(self, name: str) -> None:
        self.put(name, None)

    def flush(self) -> None:
        for name in sorted(self.changed):
            if self.seen[name] is not None:
                self.state.updateValue((name,), (self.seen[name],))
            elif self.state.containsKey((name,)):
                self.state.removeKey((name,))


class Keyed(StatefulProcessor):
    """A machine whose tables are maps in Spark's state."""

    machine, step, columns = None, None, ()

    def __init__(self, used_seconds: int = USED_SECONDS, level_seconds: int = LEVEL_SECONDS):
        self.used_seconds, self.level_seconds = used_seconds, level_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.limits = handle.getMapState("limits", "name string", "value string")
        self.used = handle.getMapState("used", "name string", "value bigint", self.used_seconds * 1000)
        self.levels = handle.getMapState("levels", "name string", "value int", self.level_seconds * 1000)

    def _run(self, rows: list[dict]) -> list[dict]:
        tables = [Kept(s) for s in (self.limits, self.used, self.levels)]
        store = Store()
        store.limits, store.used, store.levels = tables
        machine, out = self.machine(store), []
        for row in rows:
            out += type(self).step(machine, row)
        for t in tables:
            t.flush()
        return out

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._run([r if isinstance(r, dict) else r.asDict() for r in initialState.stored])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changes, usage = [], []
        for r in rows:
            (usage if r.kind == USAGE else changes).append(r.asDict(recursive=True))
        changes.sort(key=lambda r: (r["seq"] is not None, r["seq"], r["event_id"] or ""))
        usage.sort(key=lambda r: (r["kst"], r["event_id"]))
        for row in self._run(changes + usage):
            yield Row(**{c: row.get(c) for c in self.columns})

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    """Column names of a schema whose types hold no comma at the top level."""
    out, depth, word = [], 0, ""
    for sign in ddl + ",":
        depth += (sign == "<") - (sign == ">")
        if sign == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += sign
    return out


class OwnStep(Keyed):
    machine, step, columns = Subscriber, versioned.own_step, _names(versioned.OWN)


class SharedStep(Keyed):
    machine, step, columns = Family, versioned.shared_step, _names(versioned.SHARED)


def initial(stored: DataFrame):
    """Stored rows as the first state: one row a key, with what it has in order."""
    row = F.struct("seq", "kind", *[c for c in stored.columns if c not in ("seq", "kind", "key")])
    return stored.groupBy("key").agg(F.sort_array(F.collect_list(row.dropFields("members", "priorities", "kst"))).alias("stored")).groupBy("key")


def once_by_arrival(events: DataFrame, seconds: int = ONCE_SECONDS) -> DataFrame:
    """The first of each event id; ids are remembered for a time since they arrived. The watermark is one of arrival, in `arrived`, so no
    event is late for it, whatever its own time."""
    return events.withWatermark("arrived", f"{seconds} seconds").dropDuplicatesWithinWatermark(["event_id"])


def apply(events: DataFrame, subscribers: DataFrame, families: DataFrame, changes: DataFrame | None = None, **seconds: int) -> DataFrame:
    """Applied rows, in the columns of the batch forms, of a stream of accepted events with calendar keys; changes: a stream of parsed
    change events, with `seq`, those that can be applied. subscribers, families: what is stored at the start."""
    rows = versioned.usage_rows(events)
    if changes is not None:
        changes = changes.withColumn("space", control.id_space(F.col("kind"))).dropDuplicates(["space", "event_id"]).drop("space")
        rows = rows.unionByName(versioned.subscriber_changes(changes))
    own = rows.groupBy("key").transformWithState(OwnStep(**seconds), versioned.OWN, "Append", "ProcessingTime", initial(subscribers))
    if changes is not None:
        own = own.unionByName(versioned.fitted(versioned.family_changes(changes), versioned.OWN))
    shared = own.groupBy("key").transformWithState(SharedStep(**seconds), versioned.SHARED, "Append", "ProcessingTime", initial(families))
    return versioned.finished(shared)
