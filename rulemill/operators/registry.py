"""The condition operators: names, checks of their values, and the Column each one compiles to.

All tests are strictly typed by the event column: numeric operators hold on numeric columns only, text operators on text only. A null or absent attribute satisfies
nothing but IS_NULL. Text is compared without regard to case, except by REGEX, which must match the whole raw text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.events import BOOLEAN, NUMBER, STRING
from ..model import CompilationError


@dataclass(frozen=True)
class Operator:
    """``check`` turns a rule's value into its canonical form or raises; ``build`` makes the Column from the event column, its kind and that value."""

    name: str
    check: Callable[[Any], Any]
    build: Callable[[Column, str, Any], Column]
    cost: float
    selectivity: Callable[[float, Any], float]
    needs_value: bool = True


#: Fixed names: what rule authors may write for an operator.
ALIASES = {
    "EQUAL_TO": ["EQUALS", "EQ", "==", "=", "IS_EQUAL_TO", "IS_EQUAL"],
    "NOT_EQUAL_TO": ["NOT_EQUALS", "NE", "NEQ", "!=", "<>", "IS_NOT_EQUAL_TO", "IS_NOT_EQUAL"],
    "GREATER_THAN": ["GT", ">", "IS_GREATER_THAN", "GREATER"],
    "GREATER_THAN_OR_EQUAL": ["GTE", "GE", ">=", "IS_GREATER_THAN_OR_EQUAL"],
    "LESS_THAN": ["LT", "<", "IS_LESS_THAN", "LESS"],
    "LESS_THAN_OR_EQUAL": ["LTE", "LE", "<=", "IS_LESS_THAN_OR_EQUAL"],
    "BETWEEN": ["IN_RANGE", "RANGE"],
    "IS_ANY_OF": ["IN", "ANY_OF", "ONE_OF"],
    "IS_NONE_OF": ["NOT_IN", "NONE_OF"],
    "CONTAINS": ["HAS", "INCLUDES"],
    "STARTS_WITH": ["BEGINS_WITH", "PREFIX"],
    "ENDS_WITH": ["SUFFIX"],
    "REGEX": ["MATCHES", "REGEXP", "PATTERN"],
    "IS_NULL": ["NULL", "ISNULL"],
    "IS_NOT_NULL": ["NOT_NULL", "NOTNULL", "ISNOTNULL"],
}

OPERATORS: dict[str, Operator] = {}
_NAMES: dict[str, str] = {}


def register_operator(name: str, build: Callable[[Column, str, Any], Column], check: Callable[[Any], Any] | None = None, cost: float = 1.0, selectivity: float = 0.5, aliases: list[str] | None = None, needs_value: bool = True) -> Operator:
    """Add an operator of one's own: ``build(column, kind, value)`` gives its Column. It is evaluated as a compiled column."""
    return _add(Operator(name, check or (lambda v: v), build, cost, lambda base, _: selectivity, needs_value), aliases or [])


def _add(op: Operator, aliases: list[str]) -> Operator:
    OPERATORS[op.name] = op
    for n in (op.name, *aliases):
        _NAMES[n.upper()] = op.name
    return op


def resolve(name: Any) -> Operator:
    """The operator of a name or alias, whatever its case and outer blanks."""
    if not isinstance(name, str) or not name.strip():
        raise CompilationError("an operator is missing")
    try:
        return OPERATORS[_NAMES[name.strip().upper()]]
    except KeyError:
        raise CompilationError(f"unknown operator {name!r}") from None


def kind_of_value(v: Any) -> str | None:
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, (int, float)):
        return NUMBER
    return STRING if isinstance(v, str) else None


def number(v: Any) -> float | int:
    """A number, or a text that reads as one."""
    if isinstance(v, str):
        try:
            v = float(v.strip())
            v = int(v) if v.is_integer() and abs(v) < 2**53 else v
        except ValueError:
            raise CompilationError(f"not a number: {v!r}") from None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or math.isnan(v):
        raise CompilationError(f"not a number: {v!r}")
    return v


def scalar(v: Any) -> Any:
    """Equality values: text in upper case, numbers and truth values as they are; a whole list is compared as text of its members."""
    if v is None:
        raise CompilationError("a value is missing")
    if isinstance(v, str):
        return v.upper()
    if isinstance(v, list):
        return [scalar(x) for x in v]
    return v


def members(v: Any) -> list:
    """Distinct members of a non-empty list of texts only, or of numbers only, in their order."""
    if not isinstance(v, (list, tuple)) or not v:
        raise CompilationError(f"a non-empty list is due, not {v!r}")
    kinds = {kind_of_value(x) for x in v}
    if len(kinds) != 1 or None in kinds:
        raise CompilationError(f"members of a list must be of one kind: {v!r}")
    return list(dict.fromkeys(scalar(x) for x in v))


def bounds(v: Any) -> list:
    if not isinstance(v, (list, tuple)) or len(v) != 2:
        raise CompilationError(f"two bounds are due, not {v!r}")
    lo, hi = number(v[0]), number(v[1])
    return [min(lo, hi), max(lo, hi)]


def text(v: Any) -> str:
    if not isinstance(v, str):
        raise CompilationError(f"a text is due, not {v!r}")
    return v.upper()


def pattern(v: Any) -> str:
    if not isinstance(v, str):
        raise CompilationError(f"a pattern is due, not {v!r}")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:  # the dialect is Java's
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(v)
        else:
            import re

            re.compile(v)
    except Exception as e:
        raise CompilationError(f"not a pattern: {v!r}") from e
    return v


def nothing(v: Any) -> None:
    return None


def false() -> Column:
    return F.lit(False)


def equal(c: Column, kind: str, v: Any) -> Column:
    if isinstance(v, list):
        return false() if kind in (STRING, NUMBER, BOOLEAN) else c == F.array(*[F.lit(x) for x in v])
    if kind_of_value(v) != kind:
        return false()
    return F.upper(c) == F.lit(v) if kind == STRING else c == F.lit(v)


def any_of(c: Column, kind: str, v: list) -> Column:
    if kind_of_value(v[0]) != kind:
        return false()
    return (F.upper(c) if kind == STRING else c).isin(v)


def _compare(test: Callable[[Column, Any], Column]) -> Callable[[Column, str, Any], Column]:
    def build(c: Column, kind: str, v: Any) -> Column:
        if kind != NUMBER:
            return false()
        x = c.cast("double")
        return test(x, v) & ~F.isnan(x)

    return build


def _text(test: Callable[[Column, str], Column], raw: bool = False) -> Callable[[Column, str, Any], Column]:
    return lambda c, kind, v: test(c if raw else F.upper(c), v) if kind == STRING else false()


def _fixed(share: float) -> Callable[[float, Any], float]:
    return lambda base, v: base * share


_NUMERIC = {
    "GREATER_THAN": (lambda x, v: x > F.lit(float(v)), 0.3),
    "GREATER_THAN_OR_EQUAL": (lambda x, v: x >= F.lit(float(v)), 0.35),
    "LESS_THAN": (lambda x, v: x < F.lit(float(v)), 0.3),
    "LESS_THAN_OR_EQUAL": (lambda x, v: x <= F.lit(float(v)), 0.35),
}
_TEXT = {
    "CONTAINS": lambda x, v: x.contains(v),
    "STARTS_WITH": lambda x, v: x.startswith(v),
    "ENDS_WITH": lambda x, v: x.endswith(v),
}

for _name, _op in {
    "EQUAL_TO": Operator("EQUAL_TO", scalar, equal, 1.0, _fixed(0.1)),
    "NOT_EQUAL_TO": Operator("NOT_EQUAL_TO", scalar, lambda c, kind, v: c.isNotNull() & ~F.coalesce(equal(c, kind, v), F.lit(False)), 1.0, _fixed(0.1)),
    "IS_ANY_OF": Operator("IS_ANY_OF", members, any_of, 2.0, lambda base, v: min(1.0, base * len(v) * 0.15)),
    "IS_NONE_OF": Operator("IS_NONE_OF", members, lambda c, kind, v: c.isNotNull() & ~F.coalesce(any_of(c, kind, v), F.lit(False)), 2.0, _fixed(0.2)),
    "BETWEEN": Operator("BETWEEN", bounds, _compare(lambda x, v: x.between(float(v[0]), float(v[1]))), 1.0, lambda base, v: 0.5),
    "REGEX": Operator("REGEX", pattern, _text(lambda x, v: x.rlike(rf"\A(?:{v})\z"), raw=True), 10.0, _fixed(0.5)),
    "IS_NULL": Operator("IS_NULL", nothing, lambda c, kind, v: c.isNull(), 1.0, _fixed(0.05), False),
    "IS_NOT_NULL": Operator("IS_NOT_NULL", nothing, lambda c, kind, v: c.isNotNull(), 1.0, _fixed(0.05), False),
    **{n: Operator(n, number, _compare(t), 1.5, _fixed(s)) for n, (t, s) in _NUMERIC.items()},
    **{n: Operator(n, text, _text(t), 3.0, _fixed(0.4)) for n, t in _TEXT.items()},
}.items():
    _add(_op, ALIASES[_name])
