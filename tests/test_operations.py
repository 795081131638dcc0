"""Operators over rule sets, statistics at size, sources and metrics, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill import catalog, diagnose, metrics, monitor
from rulemill.catalog import RuleCatalog
from rulemill.functions import event_view
from rulemill.plans import compile_rules, evaluate, match_arrays, match_counts, match_lists
from rulemill.service import RuleService
from rulemill.sources.rules import load_rules, read_jdbc
from rulemill.streaming.engine import RuleSource


def rule(code, *conditions, **more):
    return {"rule_code": code, "priority": 10, "conditions": [{"field": f, "operator": op, "value": v} for f, op, v in conditions], **more}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_conflicts_equal_brute_force(spark, threshold):
    r = random.Random(7)
    sets = {f"R{i}": {r.randrange(12) if r.random() < 0.7 else r.randrange(60) for _ in range(r.randint(1, 9))} for i in range(90)}
    sets["R90"] = sets["R91"] = {1, 2, 3}
    posts = spark.createDataFrame([(c, i % 3, p) for i, (c, s) in enumerate(sets.items()) for p in [*s, *s]], "rule_code string, priority int, predicate_id int")
    want = {(a, b): (len(x & y), round(len(x & y) / len(x | y), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= threshold}
    got = {(g.rule_1, g.rule_2): (g.shared, g.overlap) for g in diagnose.conflicts(posts, threshold).collect()}
    assert got == want
    priority = {c: i % 3 for i, c in enumerate(sets)}
    apart = {(g.rule_1, g.rule_2) for g in diagnose.conflicts(posts, threshold, different_priority=True).collect()}
    assert apart == {p for p in want if priority[p[0]] != priority[p[1]]}
    ranked = [g.overlap for g in diagnose.by_overlap(diagnose.conflicts(posts, threshold), 7).collect()]
    assert ranked == sorted((o for _, o in want.values()), reverse=True)[:7]


@pytest.mark.parametrize("threshold", [0.0, 0.5])
@pytest.mark.parametrize("wide,blocks", [(False, 1), (False, 7), (True, 46)])
def test_conflicts_by_blocks_equal_brute_force(spark, threshold, wide, blocks):
    r = random.Random(8)
    values = [f"p{i}" for i in range(5000 if wide else 40)]  # wide: numbers take less room than bits
    sets = {f"R{i}": {values[r.randrange(12)] if r.random() < 0.7 else r.choice(values) for _ in range(r.randint(1, 9))} for i in range(90)}
    sets["R90"] = sets["R91"] = set(values[:3])
    posts = spark.createDataFrame([(c, i % 3, p) for i, (c, s) in enumerate(sets.items()) for p in [*s, *s]], "rule_code string, priority int, predicate_id string")
    want = {tuple(sorted((a, b))): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= threshold}
    got = diagnose._by_blocks(posts, threshold, len(sets), -(-len(sets) // blocks)).collect()
    assert len(got) == len(want) and {tuple(sorted((g.code_1, g.code_2))): g.shared for g in got} == want
    priority = {c: i % 3 for i, c in enumerate(sets)}
    assert all((g.n_1, g.n_2, g.priority_1, g.priority_2) == (len(sets[g.code_1]), len(sets[g.code_2]), priority[g.code_1], priority[g.code_2]) for g in got)


def test_conflicts_of_many_frequent_predicates_compare_blocks(spark):
    posts = spark.range(3_000_000).select(F.concat(F.lit("R"), F.col("id") % 5000).alias("rule_code"), F.lit(1).alias("priority"), F.pmod(F.xxhash64("id"), F.lit(600)).alias("predicate_id"))
    found = diagnose.conflicts(posts)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    sets = np.zeros((5000, 600), np.float32)
    for r in posts.groupBy("rule_code").agg(F.collect_set("predicate_id").alias("p")).collect():
        sets[int(r.rule_code[1:]), r.p] = 1
    shared, n = sets @ sets.T, sets.sum(1)
    want = np.triu(shared / (n[:, None] + n[None, :] - shared) >= 0.5, 1).sum()
    assert found.count() == want > 0


def test_order_statistics_of_large_and_small_keys(spark):
    r = np.random.default_rng(1)
    data = {"hot": np.round(r.exponential(50, 60_000), 2), "ties": np.repeat([1.0, 2.0, 3.0], 20_000), "few": np.array([5.0, 1.0, 3.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("none", None), (None, 4.0)], "k string, v double").repartition(7)
    points = (0.5, 0.95, 0.99, 1.0)
    got = {(g.k, g.point): (g.n, g.nearest, g.interpolated) for g in metrics.order_statistics(df, "k", "v", points).collect()}
    for k, vs in {**data, None: np.array([4.0])}.items():
        vs = np.sort(vs)
        for p in points:
            n, nearest, interpolated = got[k, p]
            assert n == len(vs) and nearest == vs[max(0, math.ceil(round(p * len(vs), 6)) - 1)] and interpolated == pytest.approx(np.quantile(vs, p))
    late = {g.k: g for g in metrics.latency_by(df, "k", "v").collect()}
    assert late["none"].p99 is None and late["none"].n == 0 and late[None].p99 == 4.0


def test_counts_and_lists_need_no_shuffle(spark):
    df = spark.createDataFrame([(i, i % 7, "ab"[i % 2]) for i in range(50)], "event_id int, x int, y string")
    compiled = compile_rules([rule("A", ("x", "GT", 3)), rule("B", ("y", "EQ", "a"), priority=20), rule("C", ("x", "EQ", 2), description="two")])
    view = event_view(df)
    assert "Exchange" not in match_lists(view, compiled)._jdf.queryExecution().toString() and "Exchange" not in match_counts(view, compiled)._jdf.queryExecution().toString()
    for selection in ("ALL_MATCHES", "FIRST_MATCH"):
        want = {r.event_id: (r.matched_rules, r.n_matched) for r in match_arrays(evaluate(view, compiled, selection=selection)).collect()}
        assert {r.event_id: (r.matched_rules, r.n_matched) for r in match_lists(view, compiled, selection).collect()} == want
    per = {r.event_id: r.n_matched for r in metrics.per_event(df, evaluate(view, compiled)).collect()}
    assert {r.event_id: r.n_matched for r in match_counts(view, compiled).collect()} == per and 0 in per.values()


def test_averages_and_empty_batches(spark):
    empty = spark.createDataFrame([], "event_id int, n_matched long, nanos long")
    assert metrics.evaluation_averages(empty, 5, "nanos").first().asDict() == {"evaluations": 0, "predicates_per_evaluation": 0.0, "matches_per_evaluation": 0.0, "avg_nanos": 0}
    assert metrics.summary(empty, 3, 60).first().asDict() == {"evaluations": 0, "matches": 0, "match_rate": 0.0, "rules": 3, "events_per_minute": 0.0}


def test_jdbc_rule_table(spark, tmp_path):
    rows = [("A", 5, "first", True, "eu,core", '[{"field":"amount","operator":"GREATER_THAN","value":10},{"field":"c","operator":"IS_ANY_OF","value":["US","CA"]}]', '{"team":"x"}', 2, True), ("A", 5, "old", True, "", "[]", "{}", 1, False), ("B", 9, "b", False, "", '[{"field":"x","operator":"IS_NULL"}]', "{}", 1, True), ("C", 9, "c", True, "", '[{"field":"x","operator":"IS_NULL"}]', "{}", 1, True)]
    url, driver = f"jdbc:derby:{tmp_path}/rules;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame(rows, "rule_code string, priority int, description string, enabled boolean, tags string, conditions string, labels string, version int, is_current boolean")
    df.write.option("createTableColumnTypes", "rule_code VARCHAR(60), description VARCHAR(200), tags VARCHAR(200), conditions VARCHAR(4000), labels VARCHAR(400)").jdbc(url, "rules", properties=driver)
    got = read_jdbc(spark, url, "rules", driver)
    assert [(r.rule_code, r.version) for r in got] == [("C", 1), ("A", 2)]
    assert got[1].tags == ("eu", "core") or list(got[1].tags) == ["eu", "core"]
    assert [c.value for c in got[1].conditions] == [10, ["US", "CA"]] and dict(got[1].labels) == {"team": "x"}


def test_compile_writes_status_back(spark, tmp_path):
    c = RuleCatalog(spark, f"file://{tmp_path}/c")
    c.create(rule("OK", ("a", "EQ", 1)))
    c.create(rule("NEVER", ("a", "LT", 1), ("a", "GT", 2)))
    assert {r.compile_status for r in c.history().collect()} == {"PENDING"}
    assert {r.rule_code: r.compile_status for r in c.compile().collect()} == {"OK": "OK", "NEVER": "WARNING"}
    now = catalog.current(c.history())
    assert [r.rule_code for r in catalog.search(now, compile_status="WARNING").collect()] == ["NEVER"]
    assert [r.rule_code for r in catalog.search(now, "ok", status="active", compile_status="OK").collect()] == ["OK"]
    c.update("OK", rule("OK", ("a", "EQ", 2)))
    assert catalog.current(c.history()).where("rule_code = 'OK'").first().compile_status == "PENDING"


def test_injected_compiler_and_registry(spark, tmp_path):
    c = RuleCatalog(spark, f"file://{tmp_path}/c")
    c.create(rule("A", ("a", "EQ", 1)))
    c.create(rule("B", ("a", "EQ", 1)))
    registry = monitor.MemoryRegistry()
    only_a = lambda rules, listener=None: compile_rules([r for r in rules if r.rule_code == "A"], listener)
    service = RuleService(spark, c, compiler=only_a, registry=registry)
    got = service.evaluate({"eventId": "e", "attributes": {"a": 1}})
    assert [m["rule_code"] for m in got["matchedRules"]] == ["A"] and got["predicatesEvaluated"] == 1
    assert registry.counters == {"events_evaluated": 1, "rules_matched": 1} and "# TYPE rulemill_events_evaluated counter\nrulemill_events_evaluated 1\n" in registry.text()
    path = f"file://{tmp_path}/rules"
    spark.createDataFrame([('[{"rule_code": "A", "conditions": [{"field": "a", "operator": "EQ", "value": 1}]}]',)], "value string").coalesce(1).write.text(path)
    assert len(load_rules(spark, path)) == 1 and [r.code for r in RuleSource(spark, path, compiler=only_a_of_dicts).compiled().rules] == ["A"]


def only_a_of_dicts(rules):
    return compile_rules(rules)


def test_reload_sees_a_new_file_in_a_folder(spark, tmp_path):
    path = tmp_path / "rules"
    path.mkdir()
    (path / "one.json").write_text('[{"rule_code": "A", "conditions": [{"field": "a", "operator": "EQ", "value": 1}]}]')
    source = RuleSource(spark, f"file://{path}")
    assert len(source.compiled().rules) == 1 and len(source.compiled().rules) == 1 and source.loaded == 1
    (path / "two.json").write_text('[{"rule_code": "B", "conditions": [{"field": "a", "operator": "EQ", "value": 1}]}]')
    assert len(source.compiled().rules) == 2 and source.loaded == 2
    (path / "two.json").write_text('[{"rule_code": "B2", "conditions": [{"field": "a", "operator": "EQ", "value": 10}]}]')
    assert {r.code for r in source.compiled().rules} == {"A", "B2"}


def test_observations_and_stream_metrics(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("x"))
    df.write.parquet(f"{tmp_path}/in")
    compiled, registry = compile_rules([rule("A", ("x", "EQ", 1)), rule("B", ("x", "EQ", 1), priority=30)]), monitor.MemoryRegistry()
    found, seen = monitor.observed(evaluate(event_view(df), compiled, "columns"))
    found.write.format("noop").mode("overwrite").save()
    monitor.report(seen, registry)
    assert registry.counters["matches"] == 10 and registry.values["top_priority"] == 30
    listener = monitor.StreamMetrics(registry)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = evaluate(event_view(stream), compiled, "columns").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if registry.counters.get("streams_ended"):
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert registry.counters["stream_rows"] == 20 and registry.counters["streams_started"] == registry.counters["streams_ended"] == 1


def test_base_conditions_and_representatives(spark):
    posts = spark.createDataFrame([("c1", 1, "EQUAL_TO"), ("c1", 2, "GREATER_THAN"), ("c2", 1, "EQUAL_TO"), ("c2", 3, "REGEX"), ("c3", 2, "GREATER_THAN"), ("c4", 1, "EQUAL_TO"), ("c4", 4, "IS_NULL")], "combination string, predicate_id int, operator string")
    assert tuple(diagnose.base_conditions(posts).first()) == (4, 2, 1, round((1 - 2 / 3) * 100, 6), 1.5, 1.5)
    assert tuple(diagnose.base_conditions(posts.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    sets = spark.createDataFrame([("B", 5, "B", 1), ("A", 5, "A", 1), ("Z", 9, "Z", 1), ("Z", 9, "Z", 2)], "rule_code string, priority int, combination string, predicate_id int")
    assert sorted(map(tuple, diagnose.representatives(sets).collect())) == [("A", 1, 2), ("Z", 2, 1)]
