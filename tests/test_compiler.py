import pytest

from rulemill.model import CompilationError, Rule
from rulemill.plans import compile_rules
from rulemill.sources import parse_rules, read_rule_table, rules_frame, write_rule_table
from rulemill.sources.rules import from_text_columns, load_rules

from .test_operators import rule

BAD = [
    [],
    [{"conditions": []}],
    [{"rule_code": " ", "conditions": []}],
    [{"rule_code": "A"}],
    [rule("A", ("x", "EQ", 1)), rule("A", ("x", "EQ", 2))],
    [rule("A", ("x", "NO_SUCH", 1))],
    [rule("A", ("x", None, 1))],
    [rule("A", (None, "EQ", 1))],
    [rule("A", ("x", "EQ", None))],
    [rule("A", ("x", "IN", "US"))],
    [rule("A", ("x", "IN", []))],
    [rule("A", ("x", "IN", ["a", 1]))],
    [rule("A", ("x", "GT", "abc"))],
    [rule("A", ("x", "BETWEEN", [1]))],
    [rule("A", ("x", "BETWEEN", [1, "z"]))],
    [rule("A", ("x", "REGEX", "["))],
    [rule("A", ("x", "REGEX", 5))],
    [rule("A", *[(f"f{i}", "IN", [str(j) for j in range(50)]) for i in range(3)])],
]


@pytest.mark.parametrize("rules", BAD)
def test_refused(spark, rules):
    with pytest.raises(CompilationError):
        compile_rules(rules)


DEAD = [
    [("s", "EQ", "ACTIVE"), ("s", "EQ", "INACTIVE")],
    [("s", "IN", ["a", "b"]), ("s", "IN", ["c"])],
    [("s", "EQ", "a"), ("s", "IN", ["b"])],
    [("n", "GT", 5), ("n", "LT", 5)],
    [("n", "GT", 5), ("n", "LE", 5)],
    [("n", "GE", 5), ("n", "LT", 5)],
    [("n", "GE", 6), ("n", "LE", 5)],
    [("n", "BETWEEN", [1, 2]), ("n", "GT", 2)],
    [("n", "IS_NULL", None), ("n", "GT", 2)],
]
ALIVE = [[("s", "EQ", "Active"), ("s", "EQ", "ACTIVE")], [("n", "GE", 5), ("n", "LE", 5)], [("n", "EQ", 42), ("n", "IN", [42.0, 1])], [("s", "IN", ["a", "b"]), ("s", "IN", ["B"])]]


def test_contradictions():
    for c in DEAD:
        r = compile_rules([rule("A", *c)]).rules[0]
        assert r.dead and r.status == "WARNING" and not r.live
    for c in ALIVE:
        assert compile_rules([rule("A", *c)]).rules[0].live
    empty = compile_rules([rule("A")]).rules[0]
    assert empty.dead and empty.status == "OK"


def test_stats_and_stages():
    heard = []
    gold = [("tier", "EQ", "GOLD"), ("region", "IN", ["US", "CA"])]
    c = compile_rules([rule("A", *gold), rule("B", *gold)], lambda stage, facts: heard.append(stage))
    assert (c.stats()["expanded_combinations"], c.stats()["unique_combinations"], c.stats()["dedup_rate"]) == (4, 2, 50.0)
    assert heard == ["VALIDATION", "SELECTIVITY", "MODEL"]
    many = compile_rules([rule(f"R{i}", ("x", "IN", [f"a{i}", f"b{i}"])) for i in range(100)])
    assert many.stats()["expanded_combinations"] == 200
    factored = compile_rules([rule("A", ("c", "IN", ["US", "CA", "UK"])), rule("B", ("c", "IN", ["US", "CA", "MX"]))])
    assert (factored.stats()["expanded_combinations"], factored.stats()["unique_combinations"]) == (6, 4)


def test_disabled_rules_count_as_logical():
    c = compile_rules([rule("A", ("x", "EQ", 1)), rule("B", ("x", "EQ", 2), enabled=False)])
    assert c.stats()["logical_rules"] == 2 and [r.code for r in c.live] == ["A"]


def test_cheap_predicates_first():
    r = compile_rules([rule("A", ("t", "REGEX", "a.*"), ("n", "GT", 1), ("s", "EQ", "x"))]).rules[0]
    assert [p[1] for p in r.predicates] == ["EQUAL_TO", "GREATER_THAN", "REGEX"]


def test_family():
    assert Rule("TX.A").family == "TX" and Rule("A", tags=("x", "family:f")).family == "f" and Rule("A").family == "general"


def test_parse():
    assert parse_rules('[{"rule_code": "A"}]') == parse_rules('{"rule_code": "A"}') == [{"rule_code": "A"}]
    assert len(parse_rules('{"rule_code": "A"}\n\n{"rule_code": "B"}\n')) == 2
    with pytest.raises(CompilationError, match="line 3"):
        parse_rules('{"rule_code": "A"}\n{"rule_code": "B"}\n{"rule_code"')
    for bad in ("", '[{"rule_code"'):
        with pytest.raises(CompilationError):
            parse_rules(bad)


def test_files_and_tables(spark, tmp_path):
    rules = [rule("A", ("x", "IN", ["a", "b"]), priority=3, tags=["t"], labels={"k": "v"}), rule("B", ("y", "IS_NULL", None), priority=5, enabled=False)]
    import json

    (tmp_path / "r.json").write_text(json.dumps(rules))
    assert load_rules(spark, str(tmp_path / "r.json")) == rules
    write_rule_table(spark, rules, str(tmp_path / "t"))
    back = read_rule_table(spark.read.parquet(str(tmp_path / "t")))
    assert [r.rule_code for r in back] == ["B", "A"] and back[1].conditions[0].value == ["a", "b"] and back[1].labels == {"k": "v"}
    assert [r.rule_code for r in read_rule_table(rules_frame(spark, rules), enabled_only=True)] == ["A"]
    text = spark.createDataFrame([("A", '[{"field":"x","operator":"IN","value":["a",null]},{"field":"n","operator":"GT","value":1.5}]', 1, None, True, "a,b", '{"k":"v"}', 1)], "rule_code string, conditions string, priority int, description string, enabled boolean, tags string, labels string, version int")
    (one,) = read_rule_table(from_text_columns(text))
    assert one.tags == ("a", "b") and one.conditions[1].value == 1.5 and one.conditions[0].value == ["a", None]
