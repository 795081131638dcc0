import json

import pytest

from rulemill import catalog
from rulemill.catalog import CatalogError, RuleCatalog
from rulemill.functions import event_view
from rulemill.plans import compile_rules, evaluate
from rulemill.sources import csv_report, json_report
from rulemill.streaming import RuleSource, StreamEvaluator, evaluate_stream

from .test_operators import rule


@pytest.fixture
def rules(spark, tmp_path):
    c = RuleCatalog(spark, str(tmp_path / "catalog"))
    c.create(rule("A", ("x", "EQ", "a"), priority=5, description="first"), by="me")
    return c


def test_versions(rules):
    assert rules.exists("A") and not rules.exists("B") and rules.count() == 1
    with pytest.raises(CatalogError):
        rules.create(rule("A", ("x", "EQ", "b")))
    for bad in (rule("Z"), rule("Z", ("x", "NO_SUCH", 1)), rule("Z", ("x", "EQ", None))):
        with pytest.raises(CatalogError):
            rules.create(bad)
    rules.create(rule("N", ("x", "IS_NULL", None)))
    same = rules.update("A", rule("A", ("x", "EQ", "a"), priority=9, description="first"))
    assert same.version == 1 and rules.find("A").priority == 9
    assert rules.update("A", rule("A", ("x", "EQ", "b"), priority=9, description="first")).version == 2
    with pytest.raises(CatalogError):
        rules.update("A", rule("B", ("x", "EQ", "b")))
    with pytest.raises(CatalogError):
        rules.update("Q", rule("Q", ("x", "EQ", "b")))
    for version in (2, 7):
        with pytest.raises(CatalogError):
            rules.rollback("A", version)
    assert rules.rollback("A", 1).version == 3 and rules.find("A").conditions[0].value == "a"
    types = [(r.version, r.change_type, r.is_current, r.change_summary) for r in catalog.versions(rules.history(), "A").collect()]
    assert types == [(3, "ROLLBACK", True, "Rolled back to version 1"), (2, "UPDATED", False, "conditions changed"), (1, "CREATED", False, "priority changed")]
    assert [r.rule_code for r in rules.rules()] == ["A", "N"]
    assert rules.delete("A", "NOPE") == 1 and not rules.exists("A")
    assert rules.create(rule("A", ("x", "EQ", "c"))).version == 4


def test_failed_write_keeps_the_old_state(spark, rules, tmp_path):
    (tmp_path / "catalog" / "00000099").mkdir()
    assert rules.snapshot() == 1 and rules.exists("A")


def test_import(rules):
    batch = [rule("A", ("x", "GE", 1), priority=1, description="again"), rule("A", ("x", "GT", 1), priority=1, description="twice"), rule("B", ("x", "[", 1), priority=1, description="bad"), rule("C", ("x", "IN", []), priority=1, description="refused"), rule("D", ("x", "EQ", 1), priority=1, description="off", enabled=False)]
    issues = {(r.rule_code, r.status) for r in rules.import_validate(batch).collect()}
    assert ("B", "ERROR") in issues and ("D", "VALID") in issues and ("A", "WARNING") in issues
    out = [(r.rule_code, r.outcome) for r in rules.import_execute(batch, catalog.RENAME, enable=False).collect()]
    assert out == [("A_imported_1", "imported"), ("A_imported_2", "imported"), ("B", "failed"), ("C", "failed"), ("D", "imported")]
    assert not rules.find("D").enabled and rules.find("A_imported_1").description == "again (imported)"
    assert rules.find("A_imported_1").conditions[0].operator == "GE"
    with pytest.raises(ValueError):
        rules.import_execute(batch, "NO_SUCH")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "event_id int, n_matched int")
    csv_report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["event_id", "n_matched"]
    json_report(df, df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "stats")).count() == 1


def test_stream_with_hot_reload(spark, tmp_path):
    path, data, out = tmp_path / "rules.json", tmp_path / "in", str(tmp_path / "out")
    data.mkdir()
    path.write_text(json.dumps([rule("ONE", ("x", "EQ", "a"))]))
    source = RuleSource(spark, str(path))
    run = StreamEvaluator(source, lambda df, n: df.write.mode("append").parquet(out))
    schema = "event_id int, x string"

    def batch(i):
        spark.createDataFrame([(i, "a")], schema).coalesce(1).write.mode("append").parquet(str(data))
        stream = spark.readStream.schema(schema).parquet(str(data))
        stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    batch(1)
    path.write_text(json.dumps([rule("TWO", ("x", "EQ", "a")), rule("THREE", ("x", "IN", ["a", "q"]))]))
    batch(2)
    path.write_text("[{ broken")
    batch(3)
    got = sorted((r.event_id, r.rule_code) for r in spark.read.parquet(out).collect())
    assert got == [(1, "ONE"), (2, "THREE"), (2, "TWO"), (3, "THREE"), (3, "TWO")] and len(source.faults) == 1 and source.loaded == 2


def test_first_load_must_succeed(spark, tmp_path):
    (tmp_path / "r.json").write_text("[")
    with pytest.raises(ValueError):
        RuleSource(spark, str(tmp_path / "r.json")).compiled()


def test_stateless_stream_equals_batch(spark, tmp_path):
    schema = "event_id int, x string"
    data = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], schema)
    data.write.parquet(str(tmp_path / "in"))
    c = compile_rules([rule("A", ("x", "EQ", "a"), priority=2), rule("ANY", ("x", "IN", ["a", "b"]), priority=1)])
    stream = evaluate_stream(event_view(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), c, "FIRST_MATCH")
    stream.writeStream.format("memory").queryName("matches").trigger(availableNow=True).start().awaitTermination()
    want = evaluate(event_view(data), c, "join", "FIRST_MATCH")
    assert sorted(map(tuple, spark.table("matches").collect())) == sorted(map(tuple, want.collect()))
