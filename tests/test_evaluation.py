import random
import sys

import pytest
from pyspark.sql import functions as F

from rulemill import diagnose, metrics
from rulemill.functions import event_view
from rulemill.model import FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, TOP_K
from rulemill.plans import compile_rules, evaluate, match_arrays
from rulemill.plans import evaluate as _evaluate

from .test_operators import STRATEGIES, matched, rule

SCHEMA = "event_id int, s string, t string, n double, b boolean"


def random_rules(r, count):
    def condition():
        k = r.randrange(12)
        word = lambda: r.choice(["a", "B", "ab", "c", ""])
        num = lambda: r.choice([0, 1, 2, 2.5, -1])
        f = r.choice("st")
        return [
            (f, "EQ", word()), (f, "NE", word()), (f, "IN", [word() for _ in range(3)]), (f, "NOT_IN", [word()]), (f, "CONTAINS", word()), (f, "PREFIX", word()),
            ("n", r.choice(["GT", "GE", "LT", "LE"]), num()), ("n", "BETWEEN", [num(), num()]), (r.choice("stnb"), r.choice(["IS_NULL", "IS_NOT_NULL"]), None), ("b", "EQ", r.random() < 0.5), ("n", "IN", [num(), num()]), (f, "REGEX", r.choice(["a.*", "[bB]"])),
        ][k]

    return [rule(f"F{r.randrange(3)}.{i}" if r.random() < 0.7 else f"R{i}", *[condition() for _ in range(r.randint(1, 3))], priority=r.randrange(4)) for i in range(count)]


@pytest.mark.parametrize("seed", range(4))
def test_strategies_agree(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "A", "b", "ab", "c", "", None]), r.choice(["a", "B", "abc", None]), r.choice([0.0, 1.0, 2.0, 2.5, None, float("nan")]), r.choice([True, False, None])) for i in range(60)]
    rules = random_rules(r, 40)
    view = event_view(spark.createDataFrame(rows, SCHEMA))
    compiled = compile_rules(rules)
    for selection in ("ALL_MATCHES", FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, TOP_K):
        found = [sorted(map(tuple, evaluate(view, compiled, s, selection, 2).collect()), key=str) for s in STRATEGIES]
        assert found[0] == found[1] == found[2] and found[0]
    r.shuffle(rules)
    assert sorted(map(tuple, evaluate(view, compile_rules(rules)).collect()), key=str) == sorted(map(tuple, evaluate(view, compiled).collect()), key=str)


def test_many_shapes_fall_back_to_columns(spark, monkeypatch):
    import sys

    module = sys.modules["rulemill.plans.evaluate"]
    r = random.Random(9)
    rows = [(i, r.choice("abc"), r.choice("abc"), float(i % 4), True) for i in range(30)]
    rules = random_rules(r, 30)
    want = matched(spark, rules, rows, SCHEMA, "join")
    monkeypatch.setattr(module, "MOST_SHAPES", 2)
    assert matched(spark, rules, rows, SCHEMA, "join") == want
    monkeypatch.setattr(module, "MOST_BROADCAST_ROWS", 0)
    assert matched(spark, rules, rows, SCHEMA, "join") == want


def test_selection(spark):
    rows, schema = [(1, "ACTIVE", 150.0), (2, "ACTIVE", 2000.0)], "event_id int, status string, amount double"
    ties = [rule(f"R{n}", ("status", "EQ", "ACTIVE"), ("amount", "GT", n), priority=5) for n in (100, 500, 1000)]
    for s in STRATEGIES:
        assert matched(spark, ties, rows, schema, s, selection=FIRST_MATCH) == [(1, "R100"), (2, "R100"), (2, "R1000"), (2, "R500")]
        winner = [rule("LOW", ("amount", "GT", 100), priority=10), rule("HIGH", ("amount", "GT", 1500), ("status", "EQ", "active"), priority=200)]
        assert matched(spark, winner, rows, schema, s, selection=FIRST_MATCH) == [(1, "LOW"), (2, "HIGH")]
        family = [rule("F.A", ("amount", "GT", 1), priority=1), rule("F.B", ("amount", "GT", 1), priority=2), rule("G", ("amount", "GT", 1), priority=0)]
        assert matched(spark, family, rows[:1], schema, s, selection=MAX_PRIORITY_PER_FAMILY) == [(1, "F.B"), (1, "G")]


def test_shared_alternatives(spark):
    rules = [rule("A", ("c", "IN", ["US", "CA"])), rule("B", ("c", "IN", ["US", "UK"])), rule("C", ("c", "IN", ["US", "CA", "UK"])), rule("D", ("c", "IN", ["US", "CA", "MX"]))]
    rows = list(enumerate(["US", "CA", "UK", "FR"]))
    for s in STRATEGIES:
        got = matched(spark, rules, rows, "event_id int, c string", s)
        assert [sum(e == i for e, _ in got) for i in range(4)] == [4, 3, 2, 0] and (2, "C") in got


def test_nothing_to_match(spark):
    view = event_view(spark.createDataFrame([(1, "a")], "event_id int, x string"))
    for s in STRATEGIES:
        for rules in ([rule("A")], [rule("A", ("x", "EQ", "a"), enabled=False)]):
            assert _evaluate(view, compile_rules(rules), s).count() == 0
        assert _evaluate(event_view(view.df.limit(0).select("event_id", F.lit("").alias("x"))), compile_rules([rule("A", ("x", "EQ", "a"))]), s).count() == 0


def test_bad_names(spark):
    view = event_view(spark.createDataFrame([(1, "a")], "event_id int, x string"))
    c = compile_rules([rule("A", ("x", "EQ", "a"))])
    with pytest.raises(ValueError):
        evaluate(view, c, "no-such")
    with pytest.raises(ValueError):
        evaluate(view, c, selection="no-such")


def test_only_referenced_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.sql("SELECT id AS event_id, string(id % 3) AS a, id AS b, 'x' AS unused FROM range(10)").write.parquet(path)
    plan = evaluate(event_view(spark.read.parquet(path)), compile_rules([rule("A", ("a", "EQ", "1"), ("b", "GT", 2))]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in text and "BroadcastHashJoin" in text and plan.count() == 2


def test_arrays_are_ordered(spark):
    view = event_view(spark.createDataFrame([(1, "a")], "event_id int, x string"))
    rules = [rule("B", ("x", "EQ", "a"), priority=1), rule("A", ("x", "EQ", "a"), priority=1, description="d"), rule("C", ("x", "IN", ["a", "b"]), priority=9)]
    (row,) = match_arrays(evaluate(view, compile_rules(rules))).collect()
    assert [(m.rule_code, m.description) for m in row.matched_rules] == [("C", None), ("A", "d"), ("B", None)] and row.n_matched == 3


# --- Diagnosis and metrics --------------------------------------------------------------------------------------------------------


def test_explain(spark):
    view = event_view(spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, "a", None)], "event_id int, x string, n double"))
    c = compile_rules([rule("R", ("x", "EQ", "a"), ("n", "GT", 1), ("gone", "IS_NULL", None))])
    got = {(r.event_id, r.position): (r.passed, r.reason, r.actual) for r in diagnose.explain_rule(view, c, "R").collect()}
    assert got[1, 0] == (True, "Passed", "a") and got[1, 2][0]
    assert got[2, 0] == (False, "Value mismatch", "b") and got[2, 1] == (False, "Not evaluated (short-circuit)", None)
    assert got[3, 1] == (False, "Field missing from event", None)
    whole = {(r.event_id, r.position): r.reason for r in diagnose.explain_rule(view, c, "R", short_circuit=False).collect()}
    assert whole[2, 1] == "Field missing from event"
    with pytest.raises(KeyError):
        diagnose.explain_rule(view, c, "NOPE")
    assert diagnose.explain_rule(view, compile_rules([rule("E")]), "E").count() == 0


def test_trace_levels(spark):
    view = event_view(spark.createDataFrame([(1, "a", 5.0), (2, "b", None)], "event_id int, x string, n double"))
    c = compile_rules([rule("R", ("x", "EQ", "a"), ("n", "GT", 1)), rule("Q", ("x", "EQ", "zz"))])
    full = {(r.event_id, r.rule_code): r for r in diagnose.trace(view, c).collect()}
    assert full[1, "R"].matched and full[1, "R"].match_percent == 100.0 and full[2, "R"].failed == ['X EQUAL_TO "A"', "N GREATER_THAN 1"]
    assert {o.predicate: o.actual for o in full[1, "R"].outcomes} == {'X EQUAL_TO "A"': "a", "N GREATER_THAN 1": "5.0"}
    standard = diagnose.trace(view, c, diagnose.STANDARD).collect()
    assert all(o.actual is None for r in standard for o in r.outcomes)
    assert "outcomes" not in diagnose.trace(view, c, diagnose.BASIC).columns
    some = {r.event_id: r.outcomes for r in diagnose.trace(view, c, diagnose.FULL, only_if_matched=True).collect()}
    assert some[1] and some[2] is None


def test_combinations_and_conflicts(spark):
    c = compile_rules([rule("A", ("x", "IN", ["a", "b"]), ("y", "EQ", 1)), rule("B", ("x", "EQ", "a"), ("y", "EQ", 1), priority=3)])
    assert diagnose.combinations(spark, c).select("combination").distinct().count() == 3
    assert diagnose.conflicts(diagnose.rule_predicates(spark, c), 0.3).first().overlap == pytest.approx(1 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        diagnose.conflicts(diagnose.rule_predicates(spark, c), 1.5)


def test_empty_batch_stats(spark):
    empty = spark.createDataFrame([], "event_id int, n_matched long, ns long")
    assert set(metrics.batch_stats(empty, "ns").first()) == {0, 0.0}
    some = spark.createDataFrame([(1, 0, 10), (2, 3, 21)], "event_id int, n_matched long, ns long")
    r = metrics.batch_stats(some, "ns").first()
    assert (r.total_events, r.match_rate, r.avg_nanos, r.min_nanos, r.max_nanos, r.avg_matched) == (2, 0.5, 15, 10, 21, 1.5)


def test_percentile_sketch(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS v")
    exact, near = ({r.k: r.p99 for r in metrics.latency_by(df, "k", "v", exact=e).collect()} for e in (True, False))
    assert exact == {0: 988, 1: 989} and all(abs(exact[k] - near[k]) <= 2 for k in exact)


def test_doubles_as_join_keys(spark):
    """The text of a double in a parameter table is the text that Spark casts it to."""
    from rulemill.plans.evaluate import _double_text

    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.5, 1e7, 9999999.0, 12345678.9, 1e-3, 9.99e-4, 1e21, 1e-300, 42.0, 2.0**53, 0.1, 1 / 3, 1e22, float("inf"), 100.0, 1234567.0]
    xs += [r.uniform(-1, 1) * 10 ** r.randint(-12, 15) for _ in range(500)] + [float(r.randint(-(10**r.randint(1, 15)), 10**9)) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", "cast(x + 0.0D AS string) AS t").collect()
    assert [(row.x, row.t) for row in rows if _double_text(row.x) != row.t] == []


def test_keys_cannot_run_together(spark):
    rules = [rule("A", ("s", "EQ", "a1:b"), ("t", "EQ", "c")), rule("B", ("n", "EQ", 0), ("s", "IN", ["x", "y"]), ("t", "NE", "q"))]
    rows = [(1, "a1:b", "c", 5.0, None), (2, "a", "b1:c", 5.0, None), (3, "x", "r", -0.0, None), (4, "y", "q", 0.0, None), (5, "y", None, 0.0, None)]
    for s in STRATEGIES:
        assert matched(spark, rules, rows, SCHEMA, s) == [(1, "A"), (3, "B")]


def test_events_are_read_once(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.sql("SELECT id AS event_id, string(id % 3) AS a, id AS b FROM range(10)").write.parquet(path)
    rules = [rule("A", ("a", "EQ", "1"), ("b", "GT", 2)), rule("B", ("b", "EQ", 3)), rule("C", ("a", "IN", ["0", "2"]), ("b", "LT", 5))]
    plan = evaluate(event_view(spark.read.parquet(path)), compile_rules(rules))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and plan.count() == 2 + 1 + 3


def test_division_counts_a_bounded_number_of_postings_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["rulemill.plans.evaluate"], "MOST_COUNTED", 10_000)
    rules = compile_rules([{"rule_code": f"R{i}", "priority": 1, "conditions": [{"field": "a", "operator": "GREATER_THAN", "value": i}, {"field": "b", "operator": "NOT_EQUAL_TO", "value": i}]} for i in range(50)])  # 100 predicates: more than one number's bits
    view = event_view(spark.range(2000).selectExpr("id AS event_id", "id % 60 AS a", "id % 7 AS b"))
    found = evaluate(view, rules, "division")
    got = sorted((r.event_id, r.rule_code) for r in found.collect())
    assert got == sorted((e, f"R{i}") for e in range(2000) for i in range(50) if e % 60 > i and e % 7 != i)
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().toString()) and "20), REPARTITION" in plan  # 2000 events of 100 postings, 10,000 to a task
    # Rows of one event count as one, whichever of them satisfies a predicate.
    two = event_view(spark.createDataFrame([(1, 5, 0), (1, 0, 9), (2, 5, 0), (None, 1, 9)], "event_id int, a int, b int"))
    one = compile_rules([{"rule_code": "R", "priority": 1, "conditions": [{"field": "a", "operator": "GREATER_THAN", "value": 3}, {"field": "b", "operator": "GREATER_THAN", "value": 3}]}])
    assert [r.event_id for r in evaluate(two, one, "division").collect()] == [1]
