import pytest

from rulemill.catalog import RuleCatalog
from rulemill.service import MOST_EVENTS, RuleService, flatten

from .test_operators import rule


@pytest.fixture
def service(spark, tmp_path):
    c = RuleCatalog(spark, str(tmp_path / "c"))
    c.create(rule("HIGH", ("user.status", "EQ", "active"), ("amount", "GT", 100), priority=9, description="d"))
    return RuleService(spark, c)


def event(i, **attributes):
    return {"eventId": i, "eventType": "t", "attributes": attributes}


def test_flatten():
    assert flatten({"a": {"b-c": 1, "d": {"e": [1]}}, "a.b-c": 2, "x": None}) == {"A.B_C": 1, "A.D.E": [1], "X": None}


def test_events(service):
    out = service.evaluate_batch([event(1, user={"status": "ACTIVE"}, amount=200), event(2, user={"status": "ACTIVE"}, amount="200"), event(3), event(4, user={"status": "Active"}, amount=100.5, more=[1])])
    assert [len(r["matchedRules"]) for r in out["results"]] == [1, 0, 0, 1]
    assert out["stats"]["total_events"] == 4 and out["stats"]["match_rate"] == 0.5
    assert service.evaluate(event(5, user={"status": "active"}, amount=101))["matchedRules"] == [{"rule_code": "HIGH", "priority": 9, "description": "d"}]
    for bad in ([], [event(1)] * (MOST_EVENTS + 1)):
        with pytest.raises(ValueError):
            service.evaluate_batch(bad)


def test_changes_take_effect(service):
    e = event(1, user={"status": "active"}, amount=50)
    assert not service.evaluate(e)["matchedRules"]
    service.update("HIGH", rule("HIGH", ("user.status", "EQ", "active"), ("amount", "GT", 10), priority=9))
    assert service.evaluate(e)["matchedRules"]
    service.create(rule("DEAD", ("x", "GT", 2), ("x", "LT", 1)))
    assert {(r.rule_code, r.status) for r in service.status().collect()} == {("HIGH", "OK"), ("DEAD", "WARNING")}
    assert service.delete("HIGH", "DEAD") == 2 and service.fault and service.evaluate(e)["matchedRules"]


def test_explain_and_trace(service):
    e = event(1, user={"status": "active"}, amount=50)
    assert [(r["field"], r["passed"]) for r in service.explain(e, "HIGH")] == [("USER.STATUS", True), ("AMOUNT", False)]
    assert service.trace(e)[0]["failed"] == ["AMOUNT GREATER_THAN 100"]
    with pytest.raises(KeyError):
        service.explain(e, "NOPE")
