"""Figures of streaming queries: rows a second, time by phase, and named counters observed on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(statuses: DataFrame, name: str = "usage_status") -> DataFrame:
    """statuses with counters of ok, dup and invalid_bytes, as an observation of that name."""
    return statuses.observe(name, *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ok", "dup", "invalid_bytes")])


def tallied(rows: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """rows with counters, as an observation of that name, of those that meet each condition."""
    return rows.observe(name, *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()])


class Progress(StreamingQueryListener):
    """Keeps the latest figures of each query for a scraper, and a running sum of rows."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        self.rows[key] = self.rows.get(key, 0) + (p.numInputRows or 0)
        self.latest[key] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": dict(p.durationMs or {}), "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.latest.pop(str(event.id), None)

    def exposition(self) -> str:
        """The figures as lines of text for a metrics endpoint."""
        lines = [f'usage_rows_total{{query="{q}"}} {n}' for q, n in sorted(self.rows.items())]
        for q, f in sorted(self.latest.items()):
            lines += [f'usage_phase_ms{{query="{q}",phase="{p}"}} {ms}' for p, ms in sorted(f["ms"].items())]
            lines += [f'usage_status_total{{query="{q}",status="{s}"}} {n}' for o in f["observed"].values() for s, n in sorted(o.items())]
        return "\n".join(lines)
