"""Golden cases of the operators, each by all three strategies."""

import pytest

from rulemill.functions import canonical, event_view
from rulemill.model import CompilationError
from rulemill.operators import OPERATORS, register_operator, resolve
from rulemill.operators.registry import ALIASES
from rulemill.plans import compile_rules, evaluate

STRATEGIES = ("join", "columns", "division")


def rule(code, *conditions, priority=0, **more):
    return {"rule_code": code, "priority": priority, "conditions": [{"field": f, "operator": o, "value": v} for f, o, v in conditions], **more}


def matched(spark, rules, rows, schema, strategy, **kw):
    view = event_view(spark.createDataFrame(rows, schema))
    return sorted((r.event_id, r.rule_code) for r in evaluate(view, compile_rules(rules), strategy, **kw).collect())


S, N = "event_id int, x string", "event_id int, x double"
CASES = [
    (S, "EQUAL_TO", "ACTIVE", ["ACTIVE", "active", "INACTIVE", "", None], [1, 1, 0, 0, 0]),
    (S, "EQUAL_TO", "", ["", " ", None], [1, 0, 0]),
    (S, "NOT_EQUAL_TO", "a", ["A", "b", None], [0, 1, 0]),
    (S, "IS_ANY_OF", ["US", "CA", "uk"], ["CA", "Uk", "FR", None], [1, 1, 0, 0]),
    (S, "IS_NONE_OF", ["BLOCKED", "SUSPENDED"], ["ACTIVE", "blocked", "SUSPENDED", None], [1, 0, 0, 0]),
    (S, "CONTAINS", "urgent", ["This is URGENT please", "no", None, "x" * 20000 + "urgent"], [1, 0, 0, 1]),
    (S, "STARTS_WITH", "ab", ["ABc", "cab", None], [1, 0, 0]),
    (S, "ENDS_WITH", "BC", ["abc", "bcd", None], [1, 0, 0]),
    (S, "REGEX", r"^[a-z]+@example\.com$", ["user@example.com", "USER@example.com", "xuser@example.com!", "user@example.com\n", None], [1, 0, 0, 0, 0]),
    (S, "IS_NULL", None, [None, "", "x"], [1, 0, 0]),
    (S, "IS_NOT_NULL", None, [None, "", "x"], [0, 1, 1]),
    (S, "GREATER_THAN", 1, ["5", None], [0, 0]),
    (N, "EQUAL_TO", 42, [42.0, 42.5, None], [1, 0, 0]),
    (N, "EQUAL_TO", "42", [42.0], [0]),
    (N, "NOT_EQUAL_TO", 42, [42.0, 1.0, None], [0, 1, 0]),
    (N, "IS_ANY_OF", [1, 2.0], [1.0, 2.0, 3.0, None], [1, 1, 0, 0]),
    (N, "IS_NONE_OF", [1, 2], [1.0, 3.0, None], [0, 1, 0]),
    (N, "GREATER_THAN", 1000, [2000.0, 1000.0, float("nan"), None], [1, 0, 0, 0]),
    (N, "GREATER_THAN", 1e9, [2e9], [1]),
    (N, "GREATER_THAN_OR_EQUAL", 1000, [1000.0, 999.9, float("nan")], [1, 0, 0]),
    (N, "LESS_THAN", 100, [50.0, 100.0, -100.0, float("nan"), None], [1, 0, 1, 0, 0]),
    (N, "LESS_THAN_OR_EQUAL", " 100 ", [100.0, 100.1], [1, 0]),
    (N, "BETWEEN", [18, 65], [18.0, 65.0, 17.0, 66.0, float("nan"), None], [1, 1, 0, 0, 0, 0]),
    (N, "BETWEEN", [65, 18], [30.0, 70.0], [1, 0]),
    (N, "GREATER_THAN", 0.1, [0.1], [0]),
    (N, "CONTAINS", "1", [1.0], [0]),
    ("event_id int, x boolean", "EQUAL_TO", True, [True, False, None], [1, 0, 0]),
    ("event_id int, x boolean", "NOT_EQUAL_TO", True, [True, False, None], [0, 1, 0]),
    ("event_id int, x long", "EQUAL_TO", 42.0, [42, 41, None], [1, 0, 0]),
    ("event_id int, x array<string>", "IS_NOT_NULL", None, [["a"], None], [1, 0]),
]


@pytest.mark.parametrize("schema,op,value,inputs,expected", CASES)
def test_golden(spark, schema, op, value, inputs, expected):
    rows = list(enumerate(inputs))
    want = [(i, "R") for i, e in enumerate(expected) if e]
    for strategy in STRATEGIES:
        assert matched(spark, [rule("R", ("x", op, value))], rows, schema, strategy) == want, strategy
        # With an equality beside it, the join has a hash key.
        keyed = [rule("R", ("x", op, value), ("k", "EQUAL_TO", "Y"))]
        assert matched(spark, keyed, [(*r, "y") for r in rows], schema + ", k string", strategy) == want, strategy


def test_absent_field(spark):
    for strategy in STRATEGIES:
        rules = [rule("A", ("nope", "IS_NULL", None)), rule("B", ("nope", "IS_NOT_NULL", None)), rule("C", ("nope", "EQUAL_TO", "test")), rule("D", ("nope", "NOT_EQUAL_TO", "test"), ("x", "EQ", "a"))]
        assert matched(spark, rules, [(1, "a")], S, strategy) == [(1, "A")]


def test_canonical_names(spark):
    assert canonical("field_with-special.chars") == "FIELD_WITH_SPECIAL.CHARS"
    view = event_view(spark.sql("SELECT 1 AS event_id, named_struct('user', named_struct('status', 'on', 'a-b', 3)) AS attributes, 'x' AS `field_with-special.chars`"), attributes="attributes")
    assert set(view.kinds) == {"USER.STATUS", "USER.A_B", "FIELD_WITH_SPECIAL.CHARS"}
    rules = [rule("A", ("user.status", "EQ", "ON"), ("USER.A-B", ">", 2)), rule("B", ("field-with-special.chars", "EQ", "X"))]
    for strategy in STRATEGIES:
        assert sorted(r.rule_code for r in evaluate(view, compile_rules(rules), strategy).collect()) == ["A", "B"]


def test_names_that_clash(spark):
    rows, schema = [(1, "a", "b", 3)], "id int, rule_code string, event_id string, priority int"
    view = event_view(spark.createDataFrame(rows, schema), "id")
    rules = [rule("R", ("rule_code", "EQ", "a"), ("event_id", "EQ", "b"), ("priority", ">", 2), priority=7)]
    for strategy in STRATEGIES:
        assert [(r.event_id, r.rule_code, r.priority) for r in evaluate(view, compile_rules(rules), strategy).collect()] == [(1, "R", 7)]


def test_aliases():
    for name, aliases in ALIASES.items():
        for a in (name, *aliases):
            assert resolve(f" {a.lower()} ").name == name
    for bad in (None, "", "NO_SUCH", 3):
        with pytest.raises(CompilationError):
            resolve(bad)


def test_own_operator(spark):
    from pyspark.sql import functions as F

    register_operator("LONGER_THAN", lambda c, kind, v: F.length(c) > v if kind == "string" else F.lit(False), aliases=["LONGER"])
    try:
        for strategy in STRATEGIES:
            assert matched(spark, [rule("R", ("x", "longer", 2), ("x", "starts_with", "a"))], [(1, "abc"), (2, "a"), (3, None)], S, strategy) == [(1, "R")]
    finally:
        OPERATORS.pop("LONGER_THAN")
