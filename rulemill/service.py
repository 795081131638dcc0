"""The engine behind one object: rules from a catalog, events as Python dictionaries, results as rows with statistics.

For requests and tools. Large batches go through ``evaluate`` on DataFrames directly.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import diagnose, metrics
from .catalog import RuleCatalog
from .functions.events import BOOLEAN, NUMBER, OTHER, STRING, EventView, canonical
from .model import FIRST_MATCH, CompilationError, Rule
from .monitor import MetricsRegistry
from .operators.registry import kind_of_value
from .plans import CompiledRules, compile_rules, evaluate, match_arrays

MOST_EVENTS = 1000
_TYPES = {STRING: T.StringType(), NUMBER: T.DoubleType(), BOOLEAN: T.BooleanType(), OTHER: T.StringType()}


def flatten(attributes: dict[str, Any], path: str = "") -> dict[str, Any]:
    """Canonical dotted names and their values; lists stay values, the first of equal names wins."""
    out: dict[str, Any] = {}
    for k, v in attributes.items():
        name = canonical(f"{path}{k}")
        if isinstance(v, dict):
            for n, x in flatten(v, f"{path}{k}.").items():
                out.setdefault(n, x)
        else:
            out.setdefault(name, v)
    return out


def views(spark: SparkSession, events: list[dict]) -> list[EventView]:
    """Events ``{eventId, eventType, attributes}`` as views, one for each set of attribute types, so that every value keeps its own type."""
    groups: dict[tuple, list[tuple]] = {}
    for e in events:
        flat = flatten(e.get("attributes") or {})
        kinds = tuple(sorted((n, kind_of_value(v) or OTHER) for n, v in flat.items() if v is not None))
        groups.setdefault(kinds, []).append((str(e.get("eventId")), *(float(flat[n]) if k == NUMBER else str(flat[n]) if k == OTHER else flat[n] for n, k in kinds)))
    out = []
    for kinds, rows in groups.items():
        schema = T.StructType([T.StructField("event_id", T.StringType()), *[T.StructField(f"@{n}", _TYPES[k]) for n, k in kinds]])
        out.append(EventView(spark.createDataFrame(rows, schema), dict(kinds)))
    return out


class RuleService:
    """Evaluates with the catalog's enabled rules as last compiled. A change that leaves a set that doesn't compile keeps the last good one."""

    def __init__(self, spark: SparkSession, catalog: RuleCatalog, selection: str = FIRST_MATCH, listener: Callable[[str, dict], None] | None = None, compiler: Callable[..., CompiledRules] = compile_rules, registry: MetricsRegistry | None = None):
        self.spark, self.catalog, self.selection, self.listener, self.compiler, self.registry = spark, catalog, selection, listener, compiler, registry
        self.compiled: CompiledRules | None = None
        self.fault = ""
        self.reload()

    def reload(self) -> bool:
        """Compile the catalog's rules; whether that worked."""
        try:
            self.compiled, self.fault = self.compiler(self.catalog.rules(), self.listener), ""
            return True
        except CompilationError as e:
            self.fault = str(e)
            return False

    def create(self, rule: dict | Rule, by: str | None = None) -> Rule:
        out = self.catalog.create(rule, by)
        self.reload()
        return out

    def update(self, code: str, rule: dict | Rule, by: str | None = None) -> Rule:
        out = self.catalog.update(code, rule, by)
        self.reload()
        return out

    def delete(self, *codes: str) -> int:
        n = self.catalog.delete(*codes)
        self.reload()
        return n

    def status(self) -> DataFrame:
        """Rules with what compiling them gave; ERROR for rules that aren't in the compiled set."""
        rules = self.spark.createDataFrame([(r.rule_code, r.priority) for r in self.catalog.rules()], "rule_code string, priority int")
        report = diagnose.compile_report(self.spark, self._rules())
        return rules.join(F.broadcast(report), "rule_code", "left").select("rule_code", "priority", F.coalesce("status", F.lit("ERROR")).alias("status"), "note", "predicates", "combinations")

    def _rules(self) -> CompiledRules:
        if self.compiled is None:
            raise CompilationError(self.fault or "there are no rules")
        return self.compiled

    def _matches(self, events: list[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, [evaluate(v, self._rules(), "columns", self.selection) for v in views(self.spark, events)])

    def evaluate(self, event: dict) -> dict:
        """One event's result: its id and the matched rules, highest priority first."""
        return self.evaluate_batch([event])["results"][0]

    def evaluate_batch(self, events: list[dict]) -> dict:
        """Results of up to MOST_EVENTS events, in their order, and the batch's statistics."""
        if not 1 <= len(events) <= MOST_EVENTS:
            raise ValueError(f"a batch has 1 to {MOST_EVENTS} events")
        began = time.perf_counter_ns()
        found = {r.event_id: [m.asDict() for m in r.matched_rules] for r in match_arrays(self._matches(events)).collect()}
        nanos = (time.perf_counter_ns() - began) // len(events)
        results = [{"eventId": str(e.get("eventId")), "matchedRules": found.get(str(e.get("eventId")), []), "rulesEvaluated": len(self._rules().rules), "predicatesEvaluated": len(self._rules().predicates()), "evaluationTimeNanos": nanos} for e in events]
        frame = self.spark.createDataFrame([(r["eventId"], len(r["matchedRules"]), nanos) for r in results], "event_id string, n_matched long, nanos long")
        stats = metrics.batch_stats(frame, "nanos").first().asDict()
        if self.registry is not None:
            self.registry.add("events_evaluated", stats["total_events"])
            self.registry.add("rules_matched", stats["total_matched"])
            self.registry.record("evaluation_nanos", nanos)
        return {"results": results, "stats": stats}

    def explain(self, event: dict, code: str) -> list[dict]:
        (view,) = views(self.spark, [event])
        return [r.asDict() for r in diagnose.explain_rule(view, self._rules(), code).orderBy("position").collect()]

    def trace(self, event: dict, level: str = diagnose.FULL, only_if_matched: bool = False) -> list[dict]:
        (view,) = views(self.spark, [event])
        return [r.asDict(recursive=True) for r in diagnose.trace(view, self._rules(), level, only_if_matched).orderBy("rule_code").collect()]
