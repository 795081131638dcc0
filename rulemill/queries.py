"""The queries of the rule engine over the driver's tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import catalog, diagnose, metrics
from .functions import event_view
from .functions.events import EventView
from .model import ALL_MATCHES, FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, TOP_K
from .plans import compile_rules, evaluate, match_counts, match_lists
from .shared import shared_dir
from .sources import match_json, rules_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> EventView:
    return event_view(_read(spark, sf_dir, "events"), json={"props": "k long"})


def orders(spark: SparkSession, sf_dir: str) -> EventView:
    return event_view(_read(spark, sf_dir, "orders"), "o_orderkey")


def transactions(spark: SparkSession, sf_dir: str) -> EventView:
    """orders with their customer's segment, country and region, as payment events."""
    t = {n: _read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    df = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return event_view(
        df.select(
            F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("order-status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("account.balance".replace(".", "_"))
        )
    )


_TX_SQL = """(SELECT o_orderkey AS event_id, o_totalprice AS amount, o_orderstatus AS order_status, o_orderpriority AS priority, c_mktsegment AS segment, n_name AS country, r_name AS region, c_acctbal AS account_balance
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_EV_SQL = "(SELECT event_id, event_type, value, user_id, ts, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"


def rule(code: str, *conditions: tuple, priority: int = 10, **more) -> dict:
    return {"rule_code": code, "priority": priority, "conditions": [{"field": f, "operator": op, "value": v} for f, op, v in conditions], **more}


def _out(matches: DataFrame) -> DataFrame:
    return matches.select("event_id", "rule_code", "priority")


# --- One operator at a time -------------------------------------------------------------------------------------------------------


def _operator(name: str, view: Callable, key: str, table: str, conditions: list[tuple], where: str, strategy: str = "join") -> None:
    rules = [rule("R", *conditions)]
    QUERIES[name] = lambda spark, sf_dir: _out(evaluate(view(spark, sf_dir), compile_rules(rules), strategy))
    ORACLE_SQL[name] = f"SELECT {key} AS event_id, 'R' AS rule_code, 10 AS priority FROM {table} WHERE {where}"


def _table(name: str, key: str) -> Callable:
    return lambda spark, sf_dir: event_view(_read(spark, sf_dir, name), key)


def customers_with_orders(spark: SparkSession, sf_dir: str) -> EventView:
    """Every customer with the price of a possible large order: nulls for those without one."""
    large = _read(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.max("o_orderstatus").alias("status"))
    df = _read(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    return event_view(df.select("c_custkey", "c_mktsegment", "price", "status"), "c_custkey")


_CO_SQL = "(SELECT c_custkey, c_mktsegment, price, status FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey)"

_operator("op_equal_to", events, "event_id", _EV_SQL, [("event_type", "EQUAL_TO", "Click")], "upper(event_type) = 'CLICK'")
_operator("op_equal_to_number", events, "event_id", _EV_SQL, [("props.k", "EQUAL_TO", 42.0)], "k = 42")
_operator("op_not_equal_to", events, "event_id", _EV_SQL, [("event_type", "NOT_EQUAL_TO", "view")], "upper(event_type) <> 'VIEW'")
_operator("op_is_any_of", events, "event_id", _EV_SQL, [("event_type", "IS_ANY_OF", ["click", "ERROR"])], "upper(event_type) IN ('CLICK', 'ERROR')")
_operator("op_is_none_of", events, "event_id", _EV_SQL, [("event_type", "IS_NONE_OF", ["click", "error"])], "upper(event_type) NOT IN ('CLICK', 'ERROR')")
_operator("op_greater_than", events, "event_id", _EV_SQL, [("props.k", "GREATER_THAN", 50)], "k > 50")
_operator("op_greater_than_or_equal", events, "event_id", _EV_SQL, [("props.k", "GREATER_THAN_OR_EQUAL", 50)], "k >= 50")
_operator("op_less_than", events, "event_id", _EV_SQL, [("props.k", "LESS_THAN", 50)], "k < 50")
_operator("op_less_than_or_equal", events, "event_id", _EV_SQL, [("props.k", "LESS_THAN_OR_EQUAL", "50")], "k <= 50")
_operator("op_between", orders, "o_orderkey", "orders", [("o_totalprice", "BETWEEN", [200000, 100000])], "o_totalprice BETWEEN 100000 AND 200000")
_operator("op_contains", _table("part", "p_partkey"), "p_partkey", "part", [("p_name", "CONTAINS", "re")], "contains(upper(p_name), 'RE')")
_operator("op_starts_with", _table("part", "p_partkey"), "p_partkey", "part", [("p_type", "STARTS_WITH", "s")], "starts_with(upper(p_type), 'S')")
_operator("op_ends_with", _table("customer", "c_custkey"), "c_custkey", "customer", [("c_name", "ENDS_WITH", "7")], "suffix(upper(c_name), '7')")
_operator("op_regex", _table("customer", "c_custkey"), "c_custkey", "customer", [("c_name", "REGEX", "Customer#0*[1-9]*5")], "regexp_full_match(c_name, 'Customer#0*[1-9]*5')")
_operator("op_is_null", customers_with_orders, "c_custkey", _CO_SQL, [("price", "IS_NULL", None)], "price IS NULL")
_operator("op_is_null_absent_field", customers_with_orders, "c_custkey", _CO_SQL, [("no_such_field", "IS_NULL", None), ("c_mktsegment", "EQUAL_TO", "BUILDING")], "c_mktsegment = 'BUILDING'")
_operator("op_is_not_null", customers_with_orders, "c_custkey", _CO_SQL, [("status", "IS_NOT_NULL", None)], "status IS NOT NULL")
_operator("op_null_satisfies_nothing", customers_with_orders, "c_custkey", _CO_SQL, [("price", "NOT_EQUAL_TO", 1), ("status", "IS_NONE_OF", ["X"])], "price <> 1 AND status NOT IN ('X')")
_operator("op_and_rule", events, "event_id", _EV_SQL, [("event_type", "EQUAL_TO", "purchase"), ("value", "GREATER_THAN", 20), ("props.k", "BETWEEN", [10, 60])], "upper(event_type) = 'PURCHASE' AND value > 20 AND k BETWEEN 10 AND 60")
_operator("alias_operators", events, "event_id", _EV_SQL, [("event_type", " in ", ["click", "view"]), ("value", ">=", 5), ("props.k", "lt", 90)], "upper(event_type) IN ('CLICK', 'VIEW') AND value >= 5 AND k < 90")
_operator("canonical_fields", transactions, "event_id", _TX_SQL, [("Order-Status", "EQUAL_TO", "f"), ("ACCOUNT_BALANCE", "LESS_THAN", 0)], "upper(order_status) = 'F' AND account_balance < 0")
_operator("nested_json_field", events, "event_id", _EV_SQL, [("PROPS.K", "GREATER_THAN", 80)], "k > 80")
_operator("numeric_operator_on_text", events, "event_id", _EV_SQL, [("event_type", "GREATER_THAN", 0)], "false")
_operator("duplicate_condition", events, "event_id", _EV_SQL, [("event_type", "EQUAL_TO", "click"), ("EVENT_TYPE", "EQ", "CLICK")], "upper(event_type) = 'CLICK'")
_operator("overlapping_any_of", events, "event_id", _EV_SQL, [("event_type", "IS_ANY_OF", ["click", "view"]), ("event_type", "IS_ANY_OF", ["view", "error"])], "upper(event_type) = 'VIEW'")
_operator("contradiction_never_matches", events, "event_id", _EV_SQL, [("event_type", "EQUAL_TO", "click"), ("event_type", "EQUAL_TO", "view")], "false")
_operator("contradictory_bounds", orders, "o_orderkey", "orders", [("o_totalprice", "GREATER_THAN", 5), ("o_totalprice", "LESS_THAN_OR_EQUAL", 5)], "false")
_operator("empty_rule_never_matches", events, "event_id", _EV_SQL, [], "false")

# --- Several rules: strategies, selections, aggregates ----------------------------------------------------------------------------

#: A mixed rule set over payment events: code, priority, conditions, and the same test in SQL.
PAYMENTS = [
    ("FRAUD.LARGE", 100, [("amount", "GREATER_THAN", 400000)], "amount > 400000"),
    ("FRAUD.NEGATIVE", 90, [("account_balance", "LESS_THAN", 0), ("amount", "GREATER_THAN_OR_EQUAL", 250000)], "account_balance < 0 AND amount >= 250000"),
    ("VIP.BUILDING", 80, [("segment", "EQUAL_TO", "building"), ("amount", "BETWEEN", [100000, 300000])], "upper(segment) = 'BUILDING' AND amount BETWEEN 100000 AND 300000"),
    ("VIP.AUTO", 80, [("segment", "EQUAL_TO", "AUTOMOBILE"), ("amount", "BETWEEN", [150000, 350000])], "upper(segment) = 'AUTOMOBILE' AND amount BETWEEN 150000 AND 350000"),
    ("REGION.EUROPE", 50, [("region", "EQUAL_TO", "Europe"), ("order-status", "IS_ANY_OF", ["O", "P"])], "upper(region) = 'EUROPE' AND upper(order_status) IN ('O', 'P')"),
    ("REGION.REST", 40, [("region", "IS_NONE_OF", ["EUROPE", "ASIA"]), ("priority", "STARTS_WITH", "1-")], "upper(region) NOT IN ('EUROPE', 'ASIA') AND starts_with(upper(priority), '1-')"),
    ("OPS.URGENT", 40, [("priority", "CONTAINS", "urgent"), ("order-status", "NOT_EQUAL_TO", "F")], "contains(upper(priority), 'URGENT') AND upper(order_status) <> 'F'"),
    ("OPS.PATTERN", 30, [("country", "REGEX", "[A-M].*")], "regexp_full_match(country, '[A-M].*')"),
    ("LOW", 5, [("segment", "IS_ANY_OF", ["MACHINERY", "FURNITURE", "HOUSEHOLD"]), ("priority", "ENDS_WITH", "low")], "upper(segment) IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD') AND suffix(upper(priority), 'LOW')"),
    ("SHARED", 5, [("segment", "IS_ANY_OF", ["MACHINERY", "BUILDING"]), ("priority", "ENDS_WITH", "low")], "upper(segment) IN ('MACHINERY', 'BUILDING') AND suffix(upper(priority), 'LOW')"),
]
PAYMENT_RULES = [rule(code, *conditions, priority=p, description=f"{code} of payments") for code, p, conditions, _ in PAYMENTS]
_PAY_SQL = " UNION ALL ".join(f"SELECT event_id, '{code}' AS rule_code, {p} AS priority, '{code.split('.')[0] if '.' in code else 'general'}' AS family FROM t WHERE {where}" for code, p, _, where in PAYMENTS)
_PAY = f"WITH t AS {_TX_SQL}, m AS ({_PAY_SQL})"


def _payments(strategy: str, selection: str = ALL_MATCHES, k: int = 1) -> Callable:
    return lambda spark, sf_dir: _out(evaluate(transactions(spark, sf_dir), compile_rules(PAYMENT_RULES), strategy, selection, k))


for _name, _strategy in (("shape_join", "join"), ("compiled_columns", "columns"), ("relational_division", "division")):
    QUERIES[_name] = _payments(_strategy)
    ORACLE_SQL[_name] = f"{_PAY} SELECT event_id, rule_code, priority FROM m"
for _name, _selection, _k, _where in (
    ("select_all", ALL_MATCHES, 1, "true"),
    ("select_first_match_ties", FIRST_MATCH, 1, "priority = max(priority) OVER (PARTITION BY event_id)"),
    ("select_max_per_family", MAX_PRIORITY_PER_FAMILY, 1, "priority = max(priority) OVER (PARTITION BY event_id, family)"),
    ("select_top_k", TOP_K, 2, "dense_rank() OVER (PARTITION BY event_id ORDER BY priority DESC) <= 2"),
):
    for _suffix, _strategy in (("", "join"), ("_columns", "columns")):
        QUERIES[_name + _suffix] = _payments(_strategy, _selection, _k)
        ORACLE_SQL[_name + _suffix] = f"{_PAY} SELECT event_id, rule_code, priority FROM m " + (f"QUALIFY {_where}" if _where != "true" else "")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(transactions(spark, sf_dir), compile_rules(PAYMENT_RULES))


def _per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(transactions(spark, sf_dir), compile_rules(PAYMENT_RULES))


#: The payment rules and one that never matches, for the statistics that cover all rules.
COUNTED_RULES = [*PAYMENT_RULES, rule("NEVER", ("segment", "EQUAL_TO", "no such segment"), priority=1)]


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = evaluate(transactions(spark, sf_dir), compile_rules(COUNTED_RULES))
    return metrics.rule_load(_read(spark, sf_dir, "orders"), matches, rules_frame(spark, COUNTED_RULES))


_COUNT = f"{_PAY}, c AS (SELECT t.event_id, count(m.rule_code) AS n_matched FROM t LEFT JOIN m USING (event_id) GROUP BY 1)"
_CODES = "r(rule_code) AS (VALUES " + ", ".join(f"('{r['rule_code']}')" for r in COUNTED_RULES) + ")"
_LOAD = f"{_PAY}, {_CODES}, load AS (SELECT r.rule_code, (SELECT count(*) FROM orders) AS evaluations, count(m.event_id) AS matches, round(count(m.event_id) / (SELECT count(*) FROM orders), 6) AS match_rate FROM r LEFT JOIN m USING (rule_code) GROUP BY 1)"


@query("disabled_rule_skipped", f"{_PAY} SELECT event_id, rule_code, priority FROM m WHERE rule_code <> 'OPS.PATTERN'")
def _(spark, sf_dir):
    rules = [r | {"enabled": r["rule_code"] != "OPS.PATTERN"} for r in PAYMENT_RULES]
    return _out(evaluate(transactions(spark, sf_dir), compile_rules(rules)))


@query("minimum_slice", f"WITH t AS {_EV_SQL} SELECT event_id, 'ERROR_HIGH' AS rule_code, 100 AS priority FROM t WHERE upper(event_type) = 'ERROR' AND value > 10 UNION ALL SELECT event_id, 'CLICK_OR_VIEW', 50 FROM t WHERE upper(event_type) IN ('CLICK', 'VIEW')")
def _(spark, sf_dir):
    rules = [rule("ERROR_HIGH", ("event_type", "EQUAL_TO", "error"), ("value", "GREATER_THAN", 10), priority=100), rule("CLICK_OR_VIEW", ("event_type", "IS_ANY_OF", ["click", "view"]), priority=50)]
    return _out(evaluate(events(spark, sf_dir), compile_rules(rules)))


@query("match_array_form", f"{_PAY} SELECT event_id, string_agg(rule_code || ':' || priority, ',' ORDER BY priority DESC, rule_code) AS matched, count(*)::INTEGER AS n_matched FROM m GROUP BY 1")
def _(spark, sf_dir):
    found = match_lists(transactions(spark, sf_dir), compile_rules(PAYMENT_RULES))
    return found.select("event_id", F.array_join(F.transform("matched_rules", lambda x: F.concat_ws(":", x["rule_code"], x["priority"])), ",").alias("matched"), "n_matched")


@query("match_json", f"""{_PAY} SELECT '{{"eventId":' || event_id || ',"matchedRules":[' || string_agg('{{"rule_code":"' || rule_code || '","priority":' || priority || ',"description":"' || rule_code || ' of payments"}}', ',' ORDER BY priority DESC, rule_code) || ']}}' AS value FROM m GROUP BY event_id""")
def _(spark, sf_dir):
    return match_json(_matches(spark, sf_dir))


query("matches_per_event", f"{_COUNT} SELECT event_id, n_matched FROM c")(_per_event)


@query("batch_stats", f"{_COUNT} SELECT count(*) AS total_events, coalesce(sum(n_matched), 0)::BIGINT AS total_matched, round(count(*) FILTER (n_matched > 0) / count(*), 6) AS match_rate, round(sum(n_matched) / count(*), 6) AS avg_matched FROM c")
def _(spark, sf_dir):
    return metrics.batch_stats(_per_event(spark, sf_dir))


@query("match_rate_by_rule", f"{_LOAD} SELECT * FROM load")
def _(spark, sf_dir):
    return _load(spark, sf_dir)


@query("hot_rules_topn", f"{_LOAD} SELECT * FROM load ORDER BY matches DESC, rule_code LIMIT 3")
def _(spark, sf_dir):
    return metrics.hot_rules(_load(spark, sf_dir), 3)


# Every event type is a rule, with one that never occurs; the samples of a rule's latency are the values of the events that it matched.
_TYPES = ["click", "view", "purchase", "error", "signup", "none"]


@query(
    "rule_metrics",
    f"""WITH r(rule_code) AS (VALUES {", ".join(f"('T.{t}')" for t in _TYPES)}), m AS (SELECT 'T.' || event_type AS rule_code, event_id, ts, value FROM events WHERE value > 5),
    s AS (SELECT rule_code, quantile_disc(value, 0.99)::DOUBLE AS p99, floor(avg(value))::DOUBLE AS avg_value, max(value)::DOUBLE AS max_value FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rule_code ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY 1)
    SELECT r.rule_code, (SELECT count(*) FROM events) AS evaluations, count(m.event_id) AS matches, round(count(m.event_id) / (SELECT count(*) FROM events), 6) AS match_rate, coalesce(any_value(p99), 0) AS p99, coalesce(any_value(avg_value), 0) AS avg_value, coalesce(any_value(max_value), 0) AS max_value
    FROM r LEFT JOIN m USING (rule_code) LEFT JOIN s USING (rule_code) GROUP BY 1""",
)
def _(spark, sf_dir):
    rules = [rule(f"T.{t}", ("event_type", "EQUAL_TO", t), ("value", "GREATER_THAN", 5)) for t in _TYPES]
    table = _read(spark, sf_dir, "events")
    matches = evaluate(events(spark, sf_dir), compile_rules(rules))
    samples = matches.select("rule_code", "event_id").join(table.select("event_id", "ts", "value"), "event_id")
    return metrics.rule_metrics(metrics.rule_load(table, matches, rules_frame(spark, rules)), samples, "value", [F.desc("ts"), F.desc("event_id")])


@query("metrics_summary", f"{_COUNT} SELECT count(*) AS evaluations, count(*) FILTER (n_matched > 0) AS matches, round(count(*) FILTER (n_matched > 0) / count(*), 6) AS match_rate, {len(PAYMENT_RULES)}::BIGINT AS rules, round(count(*) * 60 / 30.0::DOUBLE, 6) AS events_per_minute FROM c")
def _(spark, sf_dir):
    return metrics.summary(_per_event(spark, sf_dir), len(PAYMENT_RULES), 30)


@query("evaluation_averages", f"{_COUNT} SELECT count(*) AS evaluations, 17.0::DOUBLE AS predicates_per_evaluation, round(sum(n_matched) / count(*), 6) AS matches_per_evaluation FROM c")
def _(spark, sf_dir):
    compiled = compile_rules(PAYMENT_RULES)
    return metrics.evaluation_averages(_per_event(spark, sf_dir), len(compiled.predicates()))


@query("batch_unmatched_sorted", f"{_COUNT} SELECT event_id, n_matched FROM c WHERE n_matched = 0")
def _(spark, sf_dir):
    return metrics.batch_results(_per_event(spark, sf_dir), "id", matched=False)


@query("batch_matched_by_matches", f"{_COUNT} SELECT event_id, n_matched FROM c WHERE n_matched > 0")
def _(spark, sf_dir):
    return metrics.batch_results(_per_event(spark, sf_dir), "matches", matched=True)


@query("batch_by_time", f"WITH t AS {_EV_SQL} SELECT event_id, (upper(event_type) = 'CLICK')::BIGINT AS n_matched, value FROM t")
def _(spark, sf_dir):
    counts = match_counts(events(spark, sf_dir), compile_rules([rule("CLICK", ("event_type", "EQUAL_TO", "click"))]))
    return metrics.batch_results(counts.join(_read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), "time", time="value")


@query("slow_events_top10", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query("p99_by_rule", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_value, max(value) AS max_value, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark, sf_dir):
    return metrics.latency_by(_read(spark, sf_dir, "events"), "event_type", "value")


@query("slow_rules", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_value, max(value) AS max_value, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1 HAVING quantile_disc(value, 0.99) > 45 ORDER BY p99 DESC, event_type LIMIT 3")
def _(spark, sf_dir):
    return metrics.slow(metrics.latency_by(_read(spark, sf_dir, "events"), "event_type", "value"), "event_type", 45.0, 3)


@query("p_interp_by_rule", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(spark, sf_dir):
    return metrics.percentiles(_read(spark, sf_dir, "events"), "event_type", "value")


_HIST = "h AS (SELECT least(floor(value), 100)::BIGINT AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), r AS (SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS running FROM h)"


@query("latency_histogram", f"WITH {_HIST} SELECT * FROM r")
def _(spark, sf_dir):
    return metrics.histogram(_read(spark, sf_dir, "events"), "value")


@query("histogram_percentile", f"WITH {_HIST} SELECT min(bucket) + 0.5::DOUBLE AS percentile FROM r WHERE running >= ceil((SELECT max(running) FROM r) * 0.95)")
def _(spark, sf_dir):
    return metrics.histogram_percentile(metrics.histogram(_read(spark, sf_dir, "events"), "value"), 0.95)


@query("throughput_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return metrics.throughput(_read(spark, sf_dir, "events"), "ts", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("last_samples", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def _(spark, sf_dir):
    return metrics.latest(_read(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100).select("event_type", "event_id", "value")


# --- Diagnosis --------------------------------------------------------------------------------------------------------------------

_EXPLAINED = rule("EXPLAINED", ("status", "EQUAL_TO", "o"), ("price", "GREATER_THAN", 420000), ("c_mktsegment", "IS_ANY_OF", ["BUILDING", "MACHINERY"]))
_PASS = {"STATUS": "coalesce(upper(status) = 'O', false)", "PRICE": "coalesce(price > 420000, false)", "C_MKTSEGMENT": "upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')"}


def _explain_sql() -> str:
    parts, before = [], "true"
    for i, ((f, test), op, expected) in enumerate(zip(_PASS.items(), ("EQUAL_TO", "GREATER_THAN", "IS_ANY_OF"), ('"O"', "420000", '["BUILDING", "MACHINERY"]'), strict=True)):
        parts.append(
            f"SELECT c_custkey AS event_id, {i} AS position, '{f}' AS field, '{op}' AS operator, '{expected}' AS expected, ({test} AND {before}) AS passed, "
            f"CASE WHEN NOT ({before}) THEN 'Not evaluated (short-circuit)' WHEN {test} THEN 'Passed' WHEN {f.lower()} IS NULL THEN 'Field missing from event' ELSE 'Value mismatch' END AS reason FROM t"
        )
        before += f" AND {test}"
    return f"WITH t AS {_CO_SQL} " + " UNION ALL ".join(parts)


@query("explain_rule", _explain_sql())
def _(spark, sf_dir):
    return diagnose.explain_rule(customers_with_orders(spark, sf_dir), compile_rules([_EXPLAINED]), "EXPLAINED").drop("actual")


@query("explain_counts", f"WITH e AS ({_explain_sql()}) SELECT event_id, sum(passed::INTEGER)::BIGINT AS passed, sum((NOT passed)::INTEGER)::BIGINT AS failed FROM e GROUP BY 1")
def _(spark, sf_dir):
    e = diagnose.explain_rule(customers_with_orders(spark, sf_dir), compile_rules([_EXPLAINED]), "EXPLAINED")
    return e.groupBy("event_id").agg(F.sum(F.col("passed").cast("int")).alias("passed"), F.sum((~F.col("passed")).cast("int")).alias("failed"))


_SATISFIED = " + ".join(f"({t})::INTEGER" for t in _PASS.values())
_TRACED = f"WITH t AS {_CO_SQL}, s AS (SELECT c_custkey AS event_id, {_SATISFIED} AS satisfied, concat_ws('; ', CASE WHEN NOT {_PASS['STATUS']} THEN 'STATUS EQUAL_TO \"O\"' END, CASE WHEN NOT {_PASS['PRICE']} THEN 'PRICE GREATER_THAN 420000' END, CASE WHEN NOT {_PASS['C_MKTSEGMENT']} THEN 'C_MKTSEGMENT IS_ANY_OF [\"BUILDING\", \"MACHINERY\"]' END) AS failed FROM t)"


@query("trace_failed_predicates", f"{_TRACED} SELECT event_id, satisfied = 3 AS matched, list_aggregate(list_sort(str_split(failed, '; ')), 'string_agg', '; ') AS failed FROM s")
def _(spark, sf_dir):
    found = diagnose.trace(customers_with_orders(spark, sf_dir), compile_rules([_EXPLAINED]), diagnose.BASIC)
    return found.select("event_id", "matched", F.array_join(F.array_sort("failed"), "; ").alias("failed"))


@query("rule_match_percent", f"{_TRACED} SELECT event_id, 3 AS required, satisfied, round(100.0::DOUBLE * satisfied / 3, 6) AS match_percent FROM s")
def _(spark, sf_dir):
    return diagnose.trace(customers_with_orders(spark, sf_dir), compile_rules([_EXPLAINED]), diagnose.NONE).select("event_id", "required", "satisfied", "match_percent")


_SET = [
    rule("A", ("status", "EQUAL_TO", "ACTIVE"), ("amount", "GREATER_THAN", 100), ("country", "IS_ANY_OF", ["US", "CA"]), priority=10),
    rule("B", ("status", "EQUAL_TO", "active"), ("amount", "GREATER_THAN", 100), ("country", "IS_ANY_OF", ["US", "CA"]), priority=20),
    rule("C", ("status", "EQUAL_TO", "ACTIVE"), ("amount", "GREATER_THAN", 100), priority=10),
    rule("D", ("status", "EQUAL_TO", "ACTIVE"), ("tier", "EQUAL_TO", "GOLD"), priority=30),
    rule("E", ("amount", "LESS_THAN", 1), ("amount", "GREATER_THAN", 2)),
    rule("F", ("name", "REGEX", "x.*"), enabled=False),
]


@query("dedup_stats", "SELECT 6 AS logical_rules, 6 AS expanded_combinations, 4 AS unique_combinations, 4 AS predicates, round((1 - 4 / 6.0::DOUBLE) * 100, 6) AS dedup_rate")
def _(spark, sf_dir):
    s = compile_rules(_SET).stats()
    return spark.createDataFrame([tuple(s.values())], "logical_rules int, expanded_combinations int, unique_combinations int, predicates int, dedup_rate double")


_SEL = {"AMOUNT": 5 / 6, "COUNTRY": 2 / 6, "STATUS": 4 / 6, "TIER": 1 / 6}


@query(
    "predicate_listing",
    "SELECT * FROM (VALUES (0, 'AMOUNT', 'GREATER_THAN', round(5/6.0::DOUBLE*0.3, 6), 1.5::DOUBLE, 3), (1, 'COUNTRY', 'IS_ANY_OF', round(2/6.0::DOUBLE*2*0.15, 6), 2.0, 2), (2, 'STATUS', 'EQUAL_TO', round(4/6.0::DOUBLE*0.1, 6), 1.0, 4), (3, 'TIER', 'EQUAL_TO', round(1/6.0::DOUBLE*0.1, 6), 1.0, 1)) v(predicate_id, field, operator, selectivity, cost, rules)",
)
def _(spark, sf_dir):
    return diagnose.predicate_listing(spark, compile_rules(_SET)).select("predicate_id", "field", "operator", "selectivity", "cost", "rules")


@query("rule_cost_order", "SELECT * FROM (VALUES (1, 'STATUS'), (2, 'TIER'), (3, 'AMOUNT'), (4, 'COUNTRY')) v(place, field)")
def _(spark, sf_dir):
    listing = diagnose.predicate_listing(spark, compile_rules(_SET)).orderBy("weight", "field").select("field")
    return spark.createDataFrame([(i, r.field) for i, r in enumerate(listing.collect(), 1)], "place int, field string")


@query("field_selectivity", "SELECT * FROM (VALUES ('STATUS', round(4/6.0::DOUBLE, 6)), ('AMOUNT', round(5/6.0::DOUBLE, 6)), ('COUNTRY', round(2/6.0::DOUBLE, 6)), ('TIER', round(1/6.0::DOUBLE, 6)), ('NAME', round(1/6.0::DOUBLE, 6))) v(field, share)")
def _(spark, sf_dir):
    return spark.createDataFrame([(f, round(s, 6)) for f, s in compile_rules(_SET).field_share().items()], "field string, share double")


@query("dictionaries", "SELECT * FROM (VALUES ('field', 0, 'AMOUNT'), ('field', 1, 'COUNTRY'), ('field', 2, 'STATUS'), ('field', 3, 'TIER'), ('value', 0, 'ACTIVE'), ('value', 1, 'CA'), ('value', 2, 'GOLD'), ('value', 3, 'US')) v(dictionary, id, entry)")
def _(spark, sf_dir):
    return diagnose.dictionaries(spark, compile_rules(_SET))


@query("compile_report", "SELECT * FROM (VALUES ('A', 'OK', true, 3, 2), ('B', 'OK', true, 3, 2), ('C', 'OK', true, 2, 1), ('D', 'OK', true, 2, 1), ('E', 'WARNING', true, 0, 0), ('F', 'OK', false, 1, 1)) v(rule_code, status, enabled, predicates, combinations)")
def _(spark, sf_dir):
    return diagnose.compile_report(spark, compile_rules(_SET)).drop("note")


_CONFLICTS = "(VALUES ('A', 'B', 3, 0, 0, 1.0::DOUBLE, 'HIGH'), ('A', 'C', 2, 1, 0, round(2/3.0::DOUBLE, 6), 'MEDIUM'), ('B', 'C', 2, 1, 0, round(2/3.0::DOUBLE, 6), 'MEDIUM')) v(rule_1, rule_2, shared, unique_1, unique_2, overlap, severity)"


@query("rule_conflicts", f"SELECT rule_1, rule_2, shared::BIGINT AS shared, unique_1::BIGINT AS unique_1, unique_2::BIGINT AS unique_2, overlap, severity FROM {_CONFLICTS}")
def _(spark, sf_dir):
    return diagnose.conflicts(diagnose.rule_predicates(spark, compile_rules(_SET)))


@query("conflicts_of_different_priority", f"SELECT rule_1, rule_2, overlap, severity FROM {_CONFLICTS} WHERE rule_1 || rule_2 IN ('AB', 'BC')")
def _(spark, sf_dir):
    return diagnose.conflicts(diagnose.rule_predicates(spark, compile_rules(_SET)), different_priority=True).select("rule_1", "rule_2", "overlap", "severity")


@query("conflicts_ranked", f"SELECT rule_1, rule_2, overlap, severity FROM {_CONFLICTS} ORDER BY overlap DESC, rule_1, rule_2 LIMIT 2")
def _(spark, sf_dir):
    return diagnose.by_overlap(diagnose.conflicts(diagnose.rule_predicates(spark, compile_rules(_SET))), 2).select("rule_1", "rule_2", "overlap", "severity")


@query("base_condition_stats", "SELECT 6::BIGINT AS total_combinations, 4::BIGINT AS base_sets, 0::BIGINT AS without_base, round((1 - 4 / 6.0::DOUBLE) * 100, 6) AS reduction_percent, 1.5::DOUBLE AS avg_reuse, 1.75::DOUBLE AS avg_set_size")
def _(spark, sf_dir):
    return diagnose.base_conditions(diagnose.combinations(spark, compile_rules(_SET)))


# Rules as data at scale: the parts, in 600 classes, that a supplier sold are a rule-like predicate set. All order lines are read.
_POSTS = "p AS (SELECT DISTINCT 'S' || l_suppkey AS rule_code, l_partkey % 600 AS predicate_id FROM lineitem)"


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("rule_code"), F.lit(1).alias("priority"), (F.col("l_partkey") % 600).alias("predicate_id"))


def _suppliers(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").where(where).select(F.concat(F.lit("S"), "s_suppkey").alias("rule_code"))


@query(
    "conflicts_of_profiles",
    f"""WITH {_POSTS}, n AS (SELECT rule_code, predicate_id, count(*) OVER (PARTITION BY rule_code) AS n FROM p),
    s AS (SELECT a.rule_code AS rule_1, b.rule_code AS rule_2, a.n AS n1, b.n AS n2, count(*) AS shared FROM n a JOIN n b USING (predicate_id) WHERE a.rule_code < b.rule_code GROUP BY ALL)
    SELECT rule_1, rule_2, shared, n1 - shared AS unique_1, n2 - shared AS unique_2, round(shared / (n1 + n2 - shared), 6) AS overlap, CASE WHEN round(shared / (n1 + n2 - shared), 6) > 0.8 THEN 'HIGH' WHEN round(shared / (n1 + n2 - shared), 6) > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s WHERE shared / (n1 + n2 - shared) >= 0.5""",
)
def _(spark, sf_dir):
    return diagnose.conflicts(_posts(spark, sf_dir))


@query("affected_rules", f"WITH {_POSTS} SELECT DISTINCT rule_code FROM p WHERE predicate_id IN (SELECT p_partkey % 600 FROM part WHERE p_size = 1)")
def _(spark, sf_dir):
    small = _read(spark, sf_dir, "part").where("p_size = 1").select((F.col("p_partkey") % 600).alias("predicate_id"))
    return diagnose.affected(_posts(spark, sf_dir), small)


@query("eligible_postings", f"WITH {_POSTS} SELECT rule_code, count(*) AS n FROM p WHERE rule_code IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(spark, sf_dir):
    kept = diagnose.eligible(_posts(spark, sf_dir), _suppliers(spark, sf_dir, "s_acctbal > 0"))
    return kept.groupBy("rule_code").agg(F.count_distinct("predicate_id").alias("n"))


@query("surviving_rules", f"WITH {_POSTS} SELECT DISTINCT rule_code FROM p WHERE rule_code NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 12)")
def _(spark, sf_dir):
    return diagnose.surviving(_posts(spark, sf_dir), _suppliers(spark, sf_dir, "s_nationkey < 12"))


@query("rules_in_both", "SELECT 'S' || s_suppkey AS rule_code FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 12")
def _(spark, sf_dir):
    return diagnose.in_both(_suppliers(spark, sf_dir, "s_acctbal > 0"), _suppliers(spark, sf_dir, "s_nationkey < 12"))


@query(
    "combination_representatives",
    """WITH p AS (SELECT DISTINCT 'C' || o_custkey AS rule_code, o_custkey % 7 AS priority, o_orderpriority || o_orderstatus AS predicate_id FROM orders), s AS (SELECT rule_code, priority, list_sort(list(predicate_id)) AS s FROM p GROUP BY 1, 2)
    SELECT first(rule_code ORDER BY priority DESC, rule_code) AS representative, len(s)::INTEGER AS predicates, count(*) AS rules FROM s GROUP BY s""",
)
def _(spark, sf_dir):
    code = F.concat(F.lit("C"), "o_custkey")
    return diagnose.representatives(_read(spark, sf_dir, "orders").select(code.alias("rule_code"), (F.col("o_custkey") % 7).alias("priority"), code.alias("combination"), F.concat("o_orderpriority", "o_orderstatus").alias("predicate_id")))


# --- Catalog ----------------------------------------------------------------------------------------------------------------------

_HISTORY = [
    ("TX.A", 1, 10, "first", True, ["eu", "core"], [("amount", "GREATER_THAN", "1"), ("country", "EQUAL_TO", '"US"')]),
    ("TX.A", 2, 10, "first", True, ["eu", "core"], [("amount", "GREATER_THAN", "5"), ("country", "EQUAL_TO", '"US"')]),
    ("TX.A", 3, 20, "second", True, ["eu"], [("amount", "GREATER_THAN", "5"), ("tier", "EQUAL_TO", '"GOLD"')]),
    ("PLAIN", 1, 5, "a plain Rule", False, ["family:misc", "eu"], [("x", "IS_NULL", "null")]),
    ("OTHER", 1, 5, None, True, [], [("y", "IS_NOT_NULL", "null")]),
]


def _history(spark: SparkSession) -> DataFrame:
    rows = [(code, v, p, d, e, tags, [(f, o, x) for f, o, x in conditions]) for code, v, p, d, e, tags, conditions in _HISTORY]
    return spark.createDataFrame(rows, "rule_code string, version int, priority int, description string, enabled boolean, tags array<string>, conditions array<struct<field:string,operator:string,value:string>>")


_H = "(VALUES " + ", ".join(f"('{c}', {v}, {p}, {'NULL' if d is None else repr(d)}, {str(e).lower()}, {t!r}::VARCHAR[])" for c, v, p, d, e, t, _ in _HISTORY) + ") h(rule_code, version, priority, description, enabled, tags)"
_CUR = f"cur AS (SELECT * FROM {_H} QUALIFY row_number() OVER (PARTITION BY rule_code ORDER BY version DESC) = 1)"
_FAMILY = "CASE WHEN contains(rule_code, '.') THEN split_part(rule_code, '.', 1) WHEN len(list_filter(tags, lambda x: contains(x, 'family:'))) > 0 THEN split_part(list_filter(tags, lambda x: contains(x, 'family:'))[1], 'family:', 2) ELSE 'general' END"


@query("rules_current", f"WITH {_CUR} SELECT rule_code, version, priority FROM cur")
def _(spark, sf_dir):
    return catalog.current(_history(spark)).select("rule_code", "version", "priority")


@query("rule_history", f"SELECT rule_code, version, priority FROM {_H} WHERE rule_code = 'TX.A'")
def _(spark, sf_dir):
    return catalog.versions(_history(spark), "TX.A").select("rule_code", "version", "priority")


@query("change_summary", "SELECT * FROM (VALUES ('TX.A', 1, 'Rule created'), ('TX.A', 2, 'conditions changed'), ('TX.A', 3, 'conditions changed, priority changed, description changed, tags changed'), ('PLAIN', 1, 'Rule created'), ('OTHER', 1, 'Rule created')) v(rule_code, version, summary)")
def _(spark, sf_dir):
    return catalog.change_summary(_history(spark))


@query("version_diff", """SELECT * FROM (VALUES ('AMOUNT', 'GREATER_THAN 1', 'GREATER_THAN 5', 'modified'), ('COUNTRY', 'EQUAL_TO "US"', NULL, 'removed'), ('TIER', NULL, 'EQUAL_TO "GOLD"', 'added')) v(field, old_condition, new_condition, change)""")
def _(spark, sf_dir):
    return catalog.version_diff(_history(spark), "TX.A", 1, 3)


@query("version_counts", f"SELECT rule_code, count(*) AS versions, max(version) AS last_version FROM {_H} GROUP BY 1")
def _(spark, sf_dir):
    return catalog.version_counts(_history(spark))


@query("rules_by_tag", f"WITH {_CUR} SELECT rule_code FROM cur WHERE list_contains(tags, 'eu')")
def _(spark, sf_dir):
    return catalog.search(catalog.current(_history(spark)), tags=["eu"]).select("rule_code")


@query("tag_counts", f"WITH {_CUR} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cur) GROUP BY 1")
def _(spark, sf_dir):
    return catalog.tag_counts(catalog.current(_history(spark)))


@query("family_counts", f"WITH {_CUR} SELECT {_FAMILY} AS family, count(*) AS n FROM cur GROUP BY 1")
def _(spark, sf_dir):
    return catalog.family_counts(catalog.current(_history(spark)))


@query("rule_search", f"WITH {_CUR} SELECT rule_code, {_FAMILY} AS family, CASE WHEN enabled THEN 'active' ELSE 'inactive' END AS status FROM cur WHERE contains(lower(rule_code), 'plain') OR contains(lower(description), 'plain')")
def _(spark, sf_dir):
    return catalog.search(catalog.current(_history(spark)), "PLAIN").select("rule_code", "family", "status")


@query("rules_page", f"WITH {_CUR} SELECT rule_code, priority FROM cur ORDER BY priority DESC, rule_code LIMIT 1 OFFSET 1")
def _(spark, sf_dir):
    return catalog.page(catalog.current(_history(spark)), 1, 1).select("rule_code", "priority")


@query("rules_table", f"WITH t(rule_code, priority) AS (VALUES {', '.join(f'({c!r}, {p})' for c, p, _, _ in PAYMENTS)}) SELECT rule_code, priority FROM t")
def _(spark, sf_dir):
    return rules_frame(spark, PAYMENT_RULES).select("rule_code", "priority")


_IMPORT = [
    rule("TX.A", ("amount", "GT", 1), priority=10, description="fine, but known"),
    rule("NEW", ("amount", "GE", 1), priority=950, description="high"),
    rule("BAD", ("amount", "NO_SUCH", 1), priority=10, description="bad operator"),
    rule("FAR", ("amount", "GT", 1), priority=5000, description="bad priority"),
    rule("GOOD", ("country", "IN", ["US"]), priority=10, description="good", enabled=False),
    {"rule_code": "NONE", "description": "no conditions", "conditions": []},
]


def _catalog(spark: SparkSession) -> catalog.RuleCatalog:
    c = catalog.RuleCatalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    c.create(rule("TX.A", ("amount", "GREATER_THAN", 7), priority=1, description="kept"))
    return c


@query("import_validate", "SELECT * FROM (VALUES ('TX.A', 'WARNING', true, 1), ('NEW', 'WARNING', false, 1), ('BAD', 'ERROR', false, 1), ('FAR', 'ERROR', false, 1), ('GOOD', 'VALID', false, 0), ('NONE', 'ERROR', false, 1)) v(rule_code, status, conflict, n_issues)")
def _(spark, sf_dir):
    return _catalog(spark).import_validate(_IMPORT).select("rule_code", "status", "conflict", F.size("issues").alias("n_issues"))


@query("import_totals", "SELECT 6::BIGINT AS total, 1::BIGINT AS valid, 2::BIGINT AS warnings, 3::BIGINT AS errors")
def _(spark, sf_dir):
    return catalog.import_totals(_catalog(spark).import_validate(_IMPORT))


for _mode, _rows in (
    (catalog.SKIP, "('TX.A', 1, 1, true), ('NEW', 950, 1, true), ('GOOD', 10, 1, true)"),
    (catalog.OVERWRITE, "('TX.A', 10, 2, true), ('NEW', 950, 1, true), ('GOOD', 10, 1, true)"),
    (catalog.RENAME, "('TX.A', 1, 1, true), ('TX.A_imported_1', 10, 1, true), ('NEW', 950, 1, true), ('GOOD', 10, 1, true)"),
):

    def _imported(spark, sf_dir, mode=_mode):
        c = _catalog(spark)
        c.import_execute(_IMPORT, mode)
        return catalog.current(c.history().where("is_current")).select("rule_code", "priority", "version", "enabled")

    query(f"import_{_mode.lower()}", f"SELECT * FROM (VALUES {_rows}) v(rule_code, priority, version, enabled)")(_imported)


@query("catalog_rollback", "SELECT * FROM (VALUES ('TX.A', 1, false, 'CREATED'), ('TX.A', 2, false, 'UPDATED'), ('TX.A', 3, true, 'ROLLBACK')) v(rule_code, version, is_current, change_type)")
def _(spark, sf_dir):
    c = _catalog(spark)
    c.update("TX.A", rule("TX.A", ("amount", "GREATER_THAN", 8), priority=1, description="kept"))
    c.rollback("TX.A", 1)
    return c.history().select("rule_code", "version", "is_current", "change_type")


@query("import_execution_totals", "SELECT 6::BIGINT AS total, 2::BIGINT AS imported, 1::BIGINT AS skipped, 3::BIGINT AS failed")
def _(spark, sf_dir):
    return catalog.import_outcome_totals(_catalog(spark).import_execute(_IMPORT, catalog.SKIP))


def _compiled_catalog(spark: SparkSession) -> tuple[catalog.RuleCatalog, DataFrame]:
    c = _catalog(spark)
    c.create(rule("NEVER", ("amount", "LESS_THAN", 1), ("amount", "GREATER_THAN", 2), priority=2))
    return c, c.compile()


@query("compile_from_table", "SELECT * FROM (VALUES ('TX.A', 'OK'), ('NEVER', 'WARNING')) v(rule_code, compile_status)")
def _(spark, sf_dir):
    return _compiled_catalog(spark)[1].select("rule_code", "compile_status")


@query("rules_by_compile_status", "SELECT 'NEVER' AS rule_code, 2 AS priority")
def _(spark, sf_dir):
    c, _done = _compiled_catalog(spark)
    return catalog.search(catalog.current(c.history().where("is_current")), compile_status="WARNING").select("rule_code", "priority")


# The same views over a history of real size: every order is a version of its customer's rule.

_ORDER_HISTORY = """h AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'C' ELSE 'CUST.C' END || o_custkey AS rule_code, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS version, (floor(o_totalprice) % 1000)::INTEGER AS priority,
 'Order of ' || o_orderpriority AS description, o_orderstatus <> 'F' AS enabled, [o_orderpriority, 'family:' || o_orderstatus] AS tags, floor(o_totalprice)::BIGINT::VARCHAR AS amount, '"' || o_orderstatus || '"' AS status FROM orders)"""
_ORDER_RULES = f"WITH {_ORDER_HISTORY}, cur AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY rule_code ORDER BY version DESC) = 1)"


def _order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = lambda f, op, v: F.struct(F.lit(f).alias("field"), F.lit(op).alias("operator"), v.alias("value"))
    return _read(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_custkey") % 3 == 0, "C").otherwise("CUST.C"), "o_custkey").alias("rule_code"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"),
        (F.floor("o_totalprice") % 1000).cast("int").alias("priority"),
        F.concat(F.lit("Order of "), "o_orderpriority").alias("description"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
        F.array("o_orderpriority", F.concat(F.lit("family:"), "o_orderstatus")).alias("tags"),
        F.array(condition("amount", "GREATER_THAN", F.floor("o_totalprice").cast("string")), condition("status", "EQUAL_TO", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))).alias("conditions"),
    )


@query("orders_rules_current", f"{_ORDER_RULES} SELECT rule_code, version, priority FROM cur")
def _(spark, sf_dir):
    return catalog.current(_order_history(spark, sf_dir)).select("rule_code", "version", "priority")


@query("orders_version_counts", f"WITH {_ORDER_HISTORY} SELECT rule_code, count(*) AS versions, max(version) AS last_version FROM h GROUP BY 1")
def _(spark, sf_dir):
    return catalog.version_counts(_order_history(spark, sf_dir))


@query(
    "orders_change_summary",
    f"""WITH {_ORDER_HISTORY}, l AS (SELECT *, lag(version) OVER w AS v0, lag(amount || status) OVER w AS c0, lag(priority) OVER w AS p0, lag(description) OVER w AS d0, lag(enabled) OVER w AS e0, lag(tags) OVER w AS t0 FROM h WINDOW w AS (PARTITION BY rule_code ORDER BY version)),
    s AS (SELECT rule_code, version, v0, concat_ws(', ', CASE WHEN c0 <> amount || status THEN 'conditions changed' END, CASE WHEN p0 <> priority THEN 'priority changed' END, CASE WHEN d0 <> description THEN 'description changed' END, CASE WHEN e0 <> enabled THEN 'status changed' END, CASE WHEN t0 <> tags THEN 'tags changed' END) AS c FROM l)
    SELECT rule_code, version, CASE WHEN v0 IS NULL THEN 'Rule created' WHEN c = '' THEN 'Rule updated' ELSE c END AS summary FROM s""",
)
def _(spark, sf_dir):
    return catalog.change_summary(_order_history(spark, sf_dir))


@query(
    "orders_version_diff",
    f"""WITH {_ORDER_HISTORY}, o AS (SELECT * FROM h WHERE rule_code = 'CUST.C1' AND version = 1), n AS (SELECT * FROM h WHERE rule_code = 'CUST.C1' AND version = 2),
    d AS (SELECT 'AMOUNT' AS field, 'GREATER_THAN ' || o.amount AS old_condition, 'GREATER_THAN ' || n.amount AS new_condition FROM o, n UNION ALL SELECT 'STATUS', 'EQUAL_TO ' || o.status, 'EQUAL_TO ' || n.status FROM o, n)
    SELECT *, CASE WHEN old_condition = new_condition THEN 'unchanged' ELSE 'modified' END AS change FROM d""",
)
def _(spark, sf_dir):
    return catalog.version_diff(_order_history(spark, sf_dir), "CUST.C1", 1, 2)


@query("orders_tag_counts", f"{_ORDER_RULES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cur) GROUP BY 1")
def _(spark, sf_dir):
    return catalog.tag_counts(catalog.current(_order_history(spark, sf_dir)))


@query("orders_family_counts", f"{_ORDER_RULES} SELECT {_FAMILY} AS family, count(*) AS n FROM cur GROUP BY 1")
def _(spark, sf_dir):
    return catalog.family_counts(catalog.current(_order_history(spark, sf_dir)))


@query("orders_rule_search", f"{_ORDER_RULES} SELECT rule_code, {_FAMILY} AS family, CASE WHEN enabled THEN 'active' ELSE 'inactive' END AS status FROM cur WHERE (contains(lower(rule_code), 'high') OR contains(lower(description), 'high')) AND enabled AND list_contains(tags, '2-HIGH') AND list_contains(tags, 'family:O')")
def _(spark, sf_dir):
    return catalog.search(catalog.current(_order_history(spark, sf_dir)), "HIGH", status="active", tags=["2-HIGH", "family:O"]).select("rule_code", "family", "status")


@query("orders_rules_page", f"{_ORDER_RULES} SELECT rule_code, priority FROM cur ORDER BY priority DESC, rule_code LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    return catalog.page(catalog.current(_order_history(spark, sf_dir)), 2, 20).select("rule_code", "priority")


# --- Streams ----------------------------------------------------------------------------------------------------------------------


@query("stream_evaluate", ORACLE_SQL["minimum_slice"])
def _(spark, sf_dir):
    """The events file as a stream, one run over all that is there, matches written in append mode."""
    from .streaming import evaluate_stream

    rules = [rule("ERROR_HIGH", ("event_type", "EQUAL_TO", "error"), ("value", "GREATER_THAN", 10), priority=100), rule("CLICK_OR_VIEW", ("event_type", "IS_ANY_OF", ["click", "view"]), priority=50)]
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    found = _out(evaluate_stream(event_view(stream, json={"props": "k long"}), compile_rules(rules)))
    found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


@query(
    "hot_reload",
    f"WITH t AS {_EV_SQL} SELECT event_id, 'OLD' AS rule_code, 1 AS priority FROM t WHERE event_id % 3 = 0 AND upper(event_type) = 'CLICK' UNION ALL SELECT event_id, 'NEW', 2 FROM t WHERE event_id % 3 <> 0 AND upper(event_type) = 'VIEW'",
)
def _(spark, sf_dir):
    """Three micro-batches: the rules change before the second; before the third they break, which keeps the second's."""
    from .streaming import RuleSource, StreamEvaluator

    base = f"{shared_dir(spark)}/reload-{uuid.uuid4().hex}"
    files = [json.dumps([rule("OLD", ("event_type", "EQ", "click"), priority=1)]), json.dumps([rule("NEW", ("event_type", "EQ", "view"), priority=2)]), "[{ broken"]
    run = StreamEvaluator(RuleSource(spark, f"{base}/rules"), lambda df, n: _out(df).write.mode("append").parquet(f"{base}/out"))
    events_ = _read(spark, sf_dir, "events")
    for n, text in enumerate(files):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/rules")
        run(events_.where(F.col("event_id") % 3 == n), n)
    return spark.read.parquet(f"{base}/out")


@query("throughput_stream", "SELECT time_bucket(INTERVAL 1 SECOND, ts::TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Events by second on a stream with a watermark. Each micro-batch writes the windows that it changed; a window's last count is the result."""
    base = f"{shared_dir(spark)}/throughput-{uuid.uuid4().hex}"
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = metrics.throughput(stream, "ts", "1 second", late="10 minutes")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
    counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out").groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
