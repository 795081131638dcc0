"""Rules over streams: stateless evaluation, and hot reload between micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.events import EventView, event_view
from ..model import ALL_MATCHES, CompilationError
from ..plans.compiler import CompiledRules, compile_rules
from ..plans.evaluate import evaluate
from ..sources.rules import load_rules

log = logging.getLogger(__name__)


def evaluate_stream(view: EventView, compiled: CompiledRules, selection: str = ALL_MATCHES, k: int = 1) -> DataFrame:
    """Matches of a streaming view, in append mode and without state: rules are compiled into columns and the selection is made within each event's array."""
    return evaluate(view, compiled, "columns", selection, k)


@dataclass
class RuleSource:
    """A rule file that may change. ``compiled()`` gives the newest set that compiles; a faulty file keeps the last good one."""

    spark: SparkSession
    path: str
    last: CompiledRules | None = None
    stamp: tuple | None = None
    faults: list[str] = field(default_factory=list)
    loaded: int = 0
    compiler: Callable[..., CompiledRules] = compile_rules

    def _stamp(self) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files = [(f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(p)]  # of a file, itself; object stores keep no time of a folder
        return tuple(sorted(files))

    def compiled(self) -> CompiledRules:
        try:
            stamp = self._stamp()
            if stamp != self.stamp:
                self.stamp = stamp
                self.last = self.compiler(load_rules(self.spark, self.path))
                self.loaded += 1
        except Exception as e:
            if self.last is None:
                raise
            self.faults.append(str(e))
            log.warning("rules not reloaded: %s", e)
        if self.last is None:
            raise CompilationError("there are no rules")
        return self.last


@dataclass
class StreamEvaluator:
    """A ``foreachBatch`` function: each micro-batch is evaluated by one rule set, the newest good one when it starts."""

    source: RuleSource
    sink: Callable[[DataFrame, int], None]
    id_col: str = "event_id"
    json: dict[str, str] | None = None
    strategy: str = "join"
    selection: str = ALL_MATCHES

    def __call__(self, batch: DataFrame, number: int) -> None:
        compiled = self.source.compiled()
        self.sink(evaluate(event_view(batch, self.id_col, self.json), compiled, self.strategy, self.selection), number)
