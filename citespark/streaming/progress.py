"""Progress of jobs: observed metrics of a batch, a listener for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observe(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The table with metrics that are complete once an action has run over it."""
    seen = Observation(name)
    wanted = metrics or {"rows": F.count(F.lit(1))}
    return df.observe(seen, *[c.alias(n) for n, c in wanted.items()]), seen


def sync_progress(plan: DataFrame) -> tuple[DataFrame, Observation]:
    """Progress of a synchronisation: items and libraries seen, counts per action."""
    counts = {a: F.count_if(F.col("action") == a) for a in ("insert", "update", "link", "skip")}
    return observe(plan, "sync_progress", items=F.count(F.lit(1)), **counts)


class ProgressListener(StreamingQueryListener):
    """Keeps the state of every stream: status, rows so far, last batch."""

    def __init__(self) -> None:
        self.state: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = {"status": "starting", "current": 0, "batch": -1}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        entry = self.state.setdefault(str(p.id), {"status": "starting", "current": 0, "batch": -1})
        entry.update(status="processing", current=entry["current"] + p.numInputRows, batch=p.batchId)

    def onQueryIdle(self, event) -> None:
        self.state.setdefault(str(event.id), {})["status"] = "idle"

    def onQueryTerminated(self, event) -> None:
        entry = self.state.setdefault(str(event.id), {"current": 0, "batch": -1})
        entry["status"] = "failed" if event.exception else "completed"
