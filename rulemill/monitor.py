"""Metrics of running batches and streams, for whoever collects them: a registry that may be replaced, observations of batches, and a listener of streams."""

from __future__ import annotations

import re
import threading
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class MetricsRegistry(Protocol):
    """What takes metrics: counters that grow, and values as last recorded."""

    def add(self, name: str, amount: float) -> None: ...

    def record(self, name: str, value: float) -> None: ...


class MemoryRegistry:
    """Keeps metrics in memory and renders them as text in the exposition format that scrapers read."""

    def __init__(self):
        self.counters: dict[str, float] = {}
        self.values: dict[str, float] = {}
        self._lock = threading.Lock()

    def add(self, name: str, amount: float) -> None:
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + amount

    def record(self, name: str, value: float) -> None:
        with self._lock:
            self.values[name] = value

    def text(self, prefix: str = "rulemill_") -> str:
        with self._lock:
            rows = [(n, "counter", v) for n, v in self.counters.items()] + [(n, "gauge", v) for n, v in self.values.items()]
        out = []
        for name, kind, value in sorted(rows):
            name = prefix + re.sub(r"[^a-zA-Z0-9_]", "_", name)
            out.append(f"# TYPE {name} {kind}\n{name} {value:g}\n")
        return "".join(out)


def observed(matches: DataFrame, name: str = "matches") -> tuple[DataFrame, Observation]:
    """The matches, and an observation that is filled when an action runs over them: their number, and the largest priority. No further pass is needed."""
    seen = Observation(name)
    return matches.observe(seen, F.count(F.lit(1)).alias("matches"), F.max("priority").alias("top_priority")), seen


def report(seen: Observation, registry: MetricsRegistry) -> None:
    """Hand an observation's numbers to a registry; waits for the action."""
    got = seen.get
    registry.add("matches", got["matches"] or 0)
    if got["top_priority"] is not None:
        registry.record("top_priority", got["top_priority"])


class StreamMetrics(StreamingQueryListener):
    """Hands each micro-batch's rows, rates and durations to a registry."""

    def __init__(self, registry: MetricsRegistry):
        self.registry = registry

    def onQueryStarted(self, event) -> None:
        self.registry.add("streams_started", 1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.registry.add("stream_rows", p.numInputRows)
        self.registry.add("stream_batches", 1)
        self.registry.record("stream_rows_per_second", p.processedRowsPerSecond or 0)
        self.registry.record("stream_batch_ms", p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.registry.add("streams_ended", 1)
