"""Rules, conditions and what compiling them yields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

ALL_MATCHES, FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, TOP_K = "ALL_MATCHES", "FIRST_MATCH", "MAX_PRIORITY_PER_FAMILY", "TOP_K"
SELECTIONS = (ALL_MATCHES, FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, TOP_K)


class CompilationError(ValueError):
    """A rule set that cannot be compiled. Nothing of it is used."""


@dataclass(frozen=True)
class Condition:
    """A test of one event attribute. ``value`` is a scalar, a list or None, as in JSON."""

    field: str
    operator: str
    value: Any = None

    def text(self) -> str:
        return f"{self.field} {self.operator} {json.dumps(self.value, ensure_ascii=False, sort_keys=True)}"


@dataclass(frozen=True)
class Rule:
    """Conditions that must all hold, with a priority (larger wins) and catalog metadata."""

    rule_code: str
    conditions: tuple[Condition, ...] = ()
    priority: int = 0
    description: str | None = None
    enabled: bool = True
    tags: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict, hash=False)
    version: int = 1

    @staticmethod
    def of(data: dict | Rule) -> Rule:
        """From a JSON object. Missing or null members take their defaults; unknown ones are passed over."""
        if isinstance(data, Rule):
            return data
        if not isinstance(data, dict):
            raise CompilationError(f"a rule must be an object, not {type(data).__name__}")
        conditions = data.get("conditions")
        if conditions is None:
            raise CompilationError(f"rule {data.get('rule_code')!r}: conditions are missing")
        get = lambda key, default: default if data.get(key) is None else data[key]
        return Rule(
            rule_code=data.get("rule_code"),
            conditions=tuple(c if isinstance(c, Condition) else Condition(c.get("field"), c.get("operator"), c.get("value")) for c in conditions),
            priority=int(get("priority", 0)),
            description=data.get("description"),
            enabled=bool(get("enabled", True)),
            tags=tuple(get("tags", ())),
            labels=dict(get("labels", {})),
            version=int(get("version", 1)),
        )

    def to_dict(self) -> dict:
        return {
            "rule_code": self.rule_code,
            "conditions": [{"field": c.field, "operator": c.operator, "value": c.value} for c in self.conditions],
            "priority": self.priority,
            "description": self.description,
            "enabled": self.enabled,
            "tags": list(self.tags),
            "labels": dict(self.labels),
            "version": self.version,
        }

    @property
    def family(self) -> str:
        """The part of the code before its first dot, else the ``family:`` tag, else ``general``."""
        code = self.rule_code or ""
        if "." in code:
            return code.split(".")[0]
        return next((t.split("family:", 1)[1] for t in self.tags if "family:" in t), "general")

    def with_(self, **changes) -> Rule:
        return replace(self, **changes)


#: A rule as a row; condition values and labels are JSON text.
RULE_ROW = T.StructType(
    [
        T.StructField("rule_code", T.StringType()),
        T.StructField("conditions", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("operator", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("priority", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("version", T.IntegerType()),
    ]
)


def rule_row(rule: Rule) -> tuple:
    return (
        rule.rule_code,
        [(c.field, c.operator, json.dumps(c.value, sort_keys=True)) for c in rule.conditions],
        rule.priority,
        rule.description,
        rule.enabled,
        list(rule.tags),
        {str(k): str(v) for k, v in rule.labels.items()},
        rule.version,
    )


def row_rule(row) -> Rule:
    d = row.asDict(recursive=True)
    for c in d["conditions"] or ():
        c["value"] = None if c["value"] is None else json.loads(c["value"])
    return Rule.of(d | {"conditions": d["conditions"] or []})
