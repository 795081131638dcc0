"""Match events against a compiled rule set.

Three ways, equal in result:

* ``join`` (default): rules of one shape (the same fields, operators and value types) form one small table of parameters, and all shapes are one join, so events are read once. Equality and list parameters are
  hash keys, everything else is a residual test. Rules whose shape is rare, or whose operators can't be parameters, are compiled into columns instead.
* ``columns``: every rule becomes a boolean Column, and the matching rules an array. Nothing is shuffled or joined.
* ``division``: events are unpivoted, joined with all predicates by field, and a rule matches an event that satisfies as many distinct predicates as it has. General and slow; the others are tested against it.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.events import BOOLEAN, NUMBER, STRING, EventView
from ..model import ALL_MATCHES, FIRST_MATCH, MAX_PRIORITY_PER_FAMILY, SELECTIONS, TOP_K
from ..operators import OPERATORS
from ..operators.registry import kind_of_value
from .compiler import CompiledRule, CompiledRules, Predicate

MATCH = "event_id, rule_code, priority, description, family"
#: A parameter table of at most so many rows is broadcast; a larger one is joined as Spark sees fit.
MOST_BROADCAST_ROWS = 200_000
#: With more shapes than this, those of fewer than RARE rules are compiled into columns.
MOST_SHAPES, RARE = 24, 3
CHUNK = 50
#: Relational division: predicates in one number, and pairs of an event and a posting in one task.
BITS, MOST_COUNTED = 62, 4_000_000


def predicate_column(view: EventView, p: Predicate) -> Column:
    """A predicate as a Column that is never null. An attribute that the events lack is null."""
    name, op, v = p
    if name not in view.kinds:
        return F.lit(op == "IS_NULL")
    value = list(v) if isinstance(v, tuple) else v
    return F.coalesce(OPERATORS[op].build(view.column(name), view.kinds[name], value), F.lit(False))


def rule_column(view: EventView, rule: CompiledRule) -> Column:
    """All predicates of a rule, cheapest first."""
    return reduce(lambda a, b: a & b, [predicate_column(view, p) for p in rule.predicates])


def evaluate(view: EventView, compiled: CompiledRules, strategy: str = "join", selection: str = ALL_MATCHES, k: int = 1) -> DataFrame:
    """One row for each event and matching rule: event_id, rule_code, priority, description, family.

    Rows of the same event_id count as one event for the selection. ``k`` is for TOP_K: the rules of the k highest distinct priorities.
    """
    if selection not in SELECTIONS:
        raise ValueError(f"unknown selection {selection!r}")
    view = view.prune(compiled.fields)
    if strategy == "columns":
        return _exploded(_arrays(view, compiled.live, selection, k)) if compiled.live else _none(view)
    if strategy == "join":
        return select_matches(_joined(view, compiled), selection, k)
    if strategy == "division":
        return select_matches(relational_division(view, compiled), selection, k)
    raise ValueError(f"unknown strategy {strategy!r}")


def select_matches(matches: DataFrame, selection: str, k: int = 1) -> DataFrame:
    """Keep all matches, all of the highest priority of an event (ties included), the highest of each family, or those of the k highest priorities."""
    if selection == ALL_MATCHES:
        return matches
    keys = ["event_id", "family"] if selection == MAX_PRIORITY_PER_FAMILY else ["event_id"]
    if selection == TOP_K:
        return matches.withColumn("_rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc("priority")))).where(F.col("_rank") <= k).drop("_rank")
    return matches.withColumn("_top", F.max("priority").over(W.partitionBy(*keys))).where("priority = _top").drop("_top")


def match_arrays(matches: DataFrame) -> DataFrame:
    """One row per event with matches: the matched rules, highest priority first, then by code."""
    item = F.struct((-F.col("priority")).alias("order"), "rule_code", "priority", "description")
    return matches.groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select(
        "event_id", F.transform("m", lambda x: F.struct(x["rule_code"].alias("rule_code"), x["priority"].alias("priority"), x["description"].alias("description"))).alias("matched_rules"), F.size("m").alias("n_matched")
    )


def match_counts(view: EventView, compiled: CompiledRules) -> DataFrame:
    """Number of matching rules of every event, 0 included, without a shuffle: rules are columns."""
    view = view.prune(compiled.fields)
    n = F.size("m") if compiled.live else F.lit(0)
    return (_arrays(view, compiled.live) if compiled.live else view.df).select("event_id", n.cast("long").alias("n_matched"))


def match_lists(view: EventView, compiled: CompiledRules, selection: str = ALL_MATCHES, k: int = 1) -> DataFrame:
    """What ``match_arrays`` gives, without a shuffle: rules are columns, and an event's matches are selected and ordered within its array."""
    if not compiled.live:
        return match_arrays(_none(view))
    found = _arrays(view.prune(compiled.fields), compiled.live, selection, k).where(F.size("m") > 0)
    ordered = F.array_sort(F.transform("m", lambda x: F.struct((-x["priority"]).alias("order"), x["rule_code"].alias("rule_code"), x["priority"].alias("priority"), x["description"].alias("description"))))
    return found.select("event_id", F.transform(ordered, lambda x: F.struct(x["rule_code"].alias("rule_code"), x["priority"].alias("priority"), x["description"].alias("description"))).alias("matched_rules"), F.size("m").alias("n_matched"))


def _none(view: EventView) -> DataFrame:
    return view.df.limit(0).select("event_id", F.lit("").alias("rule_code"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("description"), F.lit("").alias("family"))


# --- columns ----------------------------------------------------------------------------------------------------------------------


def _arrays(view: EventView, rules: list[CompiledRule], selection: str = ALL_MATCHES, k: int = 1) -> DataFrame:
    """event_id and the array of matches. Predicates that several rules share are computed once, in an inner projection."""
    uses: dict[Predicate, int] = {}
    for r in rules:
        for p in r.predicates:
            uses[p] = uses.get(p, 0) + 1
    shared = {p: f"_p{i}" for i, p in enumerate(p for p, n in uses.items() if n > 1)}
    df = view.df.withColumns({alias: predicate_column(view, p) for p, alias in shared.items()}) if shared else view.df
    chunks = []
    for at in range(0, len(rules), CHUNK):
        cases = []
        for r in rules[at : at + CHUNK]:
            test = reduce(lambda a, b: a & b, [F.col(shared[p]) if p in shared else predicate_column(view, p) for p in r.predicates])
            cases.append(F.when(test, F.struct(F.lit(r.code).alias("rule_code"), F.lit(r.rule.priority).alias("priority"), F.lit(r.rule.description).cast("string").alias("description"), F.lit(r.rule.family).alias("family"))))
        chunks.append(F.array_compact(F.array(*cases)))
    found = F.concat(*chunks) if len(chunks) > 1 else chunks[0]
    out = df.select("event_id", found.alias("m"))
    top = F.array_max(F.transform("m", lambda x: x["priority"]))
    if selection == FIRST_MATCH:
        return out.select("event_id", F.filter("m", lambda x: x["priority"] == top).alias("m"))
    if selection == MAX_PRIORITY_PER_FAMILY:
        return out.select("event_id", F.filter("m", lambda x: ~F.exists("m", lambda y: (y["family"] == x["family"]) & (y["priority"] > x["priority"]))).alias("m"))
    if selection == TOP_K:
        ranks = F.slice(F.sort_array(F.array_distinct(F.transform("m", lambda x: x["priority"])), asc=False), 1, k)
        return out.select("event_id", F.filter("m", lambda x: F.array_contains(ranks, x["priority"])).alias("m"))
    return out


def _exploded(arrays: DataFrame) -> DataFrame:
    return arrays.select("event_id", F.explode("m").alias("m")).select("event_id", "m.rule_code", "m.priority", "m.description", "m.family")


# --- join by shape ----------------------------------------------------------------------------------------------------------------

_KEYS = ("EQUAL_TO", "IS_ANY_OF")
_PARAMETRIC = {*_KEYS, "NOT_EQUAL_TO", "IS_NONE_OF", "GREATER_THAN", "GREATER_THAN_OR_EQUAL", "LESS_THAN", "LESS_THAN_OR_EQUAL", "BETWEEN", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "IS_NULL", "IS_NOT_NULL"}
_SQL = {STRING: T.StringType(), NUMBER: T.DoubleType(), BOOLEAN: T.BooleanType()}


def _value_kind(p: Predicate) -> str:
    v = p[2][0] if isinstance(p[2], tuple) and p[2] else p[2]
    return kind_of_value(v) or "none"


def shape(rule: CompiledRule) -> tuple:
    """Fields, operators and value types of a rule's predicates, sorted."""
    return tuple(sorted((p[0], p[1], _value_kind(p)) for p in rule.predicates))


def _joinable(view: EventView, s: tuple) -> bool:
    """Whether a hash key exists and all parts can be parameters."""
    keyed = any(op in _KEYS and view.kinds.get(f) == kind and kind in (STRING, NUMBER, BOOLEAN) for f, op, kind in s)
    return keyed and all(op in _PARAMETRIC for _, op, _ in s) and not any(op in ("EQUAL_TO", "NOT_EQUAL_TO") and kind == "none" for _, op, kind in s)


def _joined(view: EventView, compiled: CompiledRules) -> DataFrame:
    shapes: dict[tuple, list[CompiledRule]] = {}
    for r in compiled.live:
        shapes.setdefault(shape(r), []).append(r)
    compiled_ones, parts = [], []
    for s, rules in shapes.items():
        if not _joinable(view, s) or len(shapes) > MOST_SHAPES and len(rules) < RARE:
            compiled_ones.extend(rules)
    taken = {r.code for r in compiled_ones}
    joined = {s: rules for s, rules in shapes.items() if rules[0].code not in taken}
    if len(joined) == 1:
        ((s, rules),) = joined.items()
        parts.append(_shape_join(_normalised(view, [s]), s, rules))
    elif joined:
        parts.append(_merged_join(_normalised(view, list(joined)), joined))
    if compiled_ones:
        parts.append(_exploded(_arrays(view, compiled_ones)))
    return reduce(DataFrame.unionByName, parts) if parts else _none(view)


def _merged_join(view: EventView, shapes: dict[tuple, list[CompiledRule]]) -> DataFrame:
    """One join for all shapes, so that events are read once however many there are.

    An event becomes one row for each shape, with a key of the shape's number and the values of its hash-key fields, each led by its length. A parameter row has the same key, and its other
    parameters in arrays; the residual test is chosen by the shape.
    """
    keys, residual, rows = [], None, []
    for i, (s, rules) in enumerate(shapes.items()):
        parts, tests = [F.lit(f"{i}|")], []
        slots = {"nums": 0, "strs": 0, "num_lists": 0, "str_lists": 0}
        plan: list[str] = []

        def param(kind: str, slots=slots, plan=plan) -> Column:
            slots[kind] += 1
            plan.append(kind)
            return F.col(kind)[slots[kind] - 1]

        for f, op, kind in s:
            here = view.kinds.get(f)
            raw = view.column(f) if here else None
            c = F.col(f"`_u_{f}`") if here == STRING else F.col(f"`_d_{f}`") if here == NUMBER else raw
            if op in _KEYS and here == kind:
                text = (c + F.lit(0.0)).cast("string") if kind == NUMBER else c.cast("string")  # -0.0 is 0.0
                parts += [F.length(text).cast("string"), F.lit(":"), text]
                plan.append("key")
                continue
            value = {NUMBER: "nums", STRING: "strs", BOOLEAN: "strs"}.get(kind)
            if here is None or op in ("IS_NULL", "IS_NOT_NULL"):
                plan.append("none")
                tests.append(F.lit(op == "IS_NULL") if here is None else raw.isNull() if op == "IS_NULL" else raw.isNotNull())
            elif op in _KEYS:
                plan.append("none")
                tests.append(F.lit(False))
            elif op == "NOT_EQUAL_TO":
                if here == kind:
                    tests.append((c.cast("string") if kind == BOOLEAN else c) != param(value))
                else:
                    plan.append("none")
                    tests.append(raw.isNotNull())
            elif op == "IS_NONE_OF":
                if here == kind:
                    tests.append(raw.isNotNull() & ~F.array_contains(param("num_lists" if kind == NUMBER else "str_lists"), c))
                else:
                    plan.append("none")
                    tests.append(raw.isNotNull())
            elif op in ("CONTAINS", "STARTS_WITH", "ENDS_WITH"):
                q = param("strs")
                tests.append({"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}[op](c, q) if here == STRING else F.lit(False))
            elif op == "BETWEEN":
                q = param("num_lists")
                tests.append(c.between(q[0], q[1]) & ~F.isnan(c) if here == NUMBER else F.lit(False))
            else:
                q = param("nums")
                tests.append({"GREATER_THAN": c > q, "GREATER_THAN_OR_EQUAL": c >= q, "LESS_THAN": c < q, "LESS_THAN_OR_EQUAL": c <= q}[op] & ~F.isnan(c) if here == NUMBER else F.lit(False))
        keys.append(F.struct(F.lit(i).alias("shape"), F.concat(*parts).alias("key")))
        test = reduce(lambda x, y: x & y, tests) if tests else F.lit(True)
        residual = F.when(F.col("e.shape") == i, test) if residual is None else residual.when(F.col("e.shape") == i, test)
        for r in rules:
            rows.extend(_merged_rows(i, r, plan))
    schema = "_key string, rule_code string, priority int, description string, family string, nums array<double>, strs array<string>, num_lists array<array<double>>, str_lists array<array<string>>"
    table = view.df.sparkSession.createDataFrame(rows, schema)
    side = F.broadcast(table) if len(rows) <= MOST_BROADCAST_ROWS else table
    dealt = view.df.withColumn("e", F.explode(F.array(*keys))).where(F.col("e.key").isNotNull())
    return dealt.join(side, (F.col("e.key") == F.col("_key")) & residual).select("event_id", "rule_code", "priority", "description", "family")


def _merged_rows(i: int, r: CompiledRule, plan: list[str]) -> list[tuple]:
    """Parameter rows of a rule: one for each choice of list members among its hash keys."""
    keys, slots = [f"{i}|"], {"nums": [], "strs": [], "num_lists": [], "str_lists": []}
    for p, kind in zip(sorted(r.predicates, key=lambda p: (p[0], p[1], _value_kind(p))), plan, strict=True):
        v = p[2]
        if kind == "key":
            texts = [_key_text(x) for x in (v if p[1] == "IS_ANY_OF" else [v])]
            keys = [f"{k}{len(t)}:{t}" for k in keys for t in texts]
        elif kind in ("num_lists", "str_lists"):
            slots[kind].append([_param(x) for x in v])
        elif kind != "none":
            slots[kind].append(str(v).lower() if isinstance(v, bool) else _param(v))
    return [(k, r.code, r.rule.priority, r.rule.description, r.rule.family, *slots.values()) for k in keys]


def _key_text(v: Any) -> str:
    """As Spark casts the value to text."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return _double_text(float(v))
    return v


def _double_text(x: float) -> str:
    """A double as Java writes it: plain from 10**-3 to 10**7, else with an exponent; the shortest digits that read back as x."""
    x = x + 0.0
    if x == 0:
        return "0.0"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent  # 0.text * 10**point
    if 1e-3 <= abs(x) < 1e7:
        if point <= 0:
            body = "0." + "0" * -point + text
        elif point >= len(text):
            body = text + "0" * (point - len(text)) + ".0"
        else:
            body = text[:point] + "." + text[point:]
    else:
        body = f"{text[0]}.{text[1:] or '0'}E{point - 1}"
    return "-" * sign + body


def _normalised(view: EventView, shapes: list[tuple]) -> EventView:
    """Upper-case texts and double numbers of the fields that joins read, each made once."""
    fields = {f for s in shapes for f, _, _ in s if f in view.kinds}
    extra = {}
    for f in sorted(fields):
        if view.kinds[f] == STRING:
            extra[f"_u_{f}"] = F.upper(view.column(f))
        elif view.kinds[f] == NUMBER:
            extra[f"_d_{f}"] = view.column(f).cast("double")
    return EventView(view.df.withColumns(extra), view.kinds)


def _shape_join(view: EventView, s: tuple, rules: list[CompiledRule]) -> DataFrame:
    """The join of one shape. A list's members become rows of the parameter table, so a rule may stand in several rows but matches an event in one at most."""
    fields = [T.StructField("rule_code", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("description", T.StringType()), T.StructField("family", T.StringType())]
    keys, tests = [], []
    for i, (f, op, kind) in enumerate(s):
        here, p = view.kinds.get(f), f"p{i}"
        raw = view.column(f) if here else None
        c = F.col(f"`_u_{f}`") if here == STRING else F.col(f"`_d_{f}`") if here == NUMBER else raw
        typed = _SQL.get(kind, T.StringType())
        fields.append(T.StructField(p, typed if op != "IS_NONE_OF" and op != "BETWEEN" else T.ArrayType(typed)))
        q = F.col(p)
        if here is None:
            tests.append(F.lit(op == "IS_NULL"))
        elif op == "IS_NULL":
            tests.append(raw.isNull())
        elif op == "IS_NOT_NULL":
            tests.append(raw.isNotNull())
        elif op in _KEYS:
            keys.append(c == q) if here == kind else tests.append(F.lit(False))
        elif op == "NOT_EQUAL_TO":
            tests.append(c != q if here == kind else raw.isNotNull())
        elif op == "IS_NONE_OF":
            tests.append(raw.isNotNull() & ~F.array_contains(q, c) if here == kind else raw.isNotNull())
        elif op in ("CONTAINS", "STARTS_WITH", "ENDS_WITH"):
            tests.append({"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}[op](c, q) if here == STRING else F.lit(False))
        elif here != NUMBER:
            tests.append(F.lit(False))
        elif op == "BETWEEN":
            tests.append(c.between(q[0], q[1]) & ~F.isnan(c))
        else:
            tests.append({"GREATER_THAN": c > q, "GREATER_THAN_OR_EQUAL": c >= q, "LESS_THAN": c < q, "LESS_THAN_OR_EQUAL": c <= q}[op] & ~F.isnan(c))
    rows = []
    for r in rules:
        ordered = sorted(r.predicates, key=lambda p: (p[0], p[1], _value_kind(p)))
        variants: list[tuple] = [()]
        for p in ordered:
            values = list(p[2]) if p[1] == "IS_ANY_OF" else [list(p[2]) if isinstance(p[2], tuple) else p[2]]
            variants = [(*v, _param(x)) for v in variants for x in values]
        rows.extend((r.code, r.rule.priority, r.rule.description, r.rule.family, *v) for v in variants)
    table = view.df.sparkSession.createDataFrame(rows, T.StructType(fields))
    side = F.broadcast(table) if len(rows) <= MOST_BROADCAST_ROWS else table
    return view.df.join(side, reduce(lambda a, b: a & b, keys + tests)).select("event_id", "rule_code", "priority", "description", "family")


def _param(v: Any) -> Any:
    if isinstance(v, list):
        return [_param(x) for x in v]
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


# --- relational division ----------------------------------------------------------------------------------------------------------


def relational_division(view: EventView, compiled: CompiledRules) -> DataFrame:
    """Count satisfied distinct predicates per event and rule; keep those with as many as the rule has.

    An event's satisfied predicates travel as bits of a few numbers, so rows of one event are joined by bitwise or. Only then are they unpivoted, joined with the rules' postings and counted, within partitions
    whose number follows from the number of events: a task never counts more than about MOST_COUNTED pairs of an event and a posting, however many events there are.
    """
    rules = compiled.live
    predicates = compiled.predicates()
    if not predicates:
        return _none(view)
    spark = view.df.sparkSession
    number = {p: i for i, p in enumerate(predicates)}
    needs = spark.createDataFrame([(i, r.code, r.rule.priority, r.rule.description, r.rule.family, len(r.predicates), [number[p] for p in r.predicates]) for i, r in enumerate(rules)], "rule int, rule_code string, priority int, description string, family string, needs int, preds array<int>")
    # Values are tested by the operators' own columns, so absent attributes count as null ones.
    words = [predicates[at : at + BITS] for at in range(0, len(predicates), BITS)]
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(predicate_column(view, p), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, p in enumerate(word)]).alias(f"_m{w}") for w, word in enumerate(words)]
    postings = sum(len(r.predicates) for r in rules)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-view.df.count() * postings // MOST_COUNTED))
    events = view.df.select("event_id", *masks).repartition(parts, "event_id").groupBy("event_id").agg(*[F.bit_or(f"_m{w}").alias(f"_m{w}") for w in range(len(words))])
    # A satisfied predicate is a row (event, predicate).
    held = F.array_compact(F.array(*[F.when(F.getbit(f"_m{i // BITS}", F.lit(i % BITS)) == 1, F.lit(i)) for i in number.values()]))
    satisfied = events.select("event_id", F.explode(held).alias("pred"))
    posts, named = needs.select("rule", F.explode("preds").alias("pred")), needs.drop("preds")
    side = F.broadcast if postings <= MOST_BROADCAST_ROWS else lambda table: table
    counts = satisfied.join(side(posts), "pred").groupBy("event_id", "rule").agg(F.count("*").alias("n"))
    return counts.join(side(named), "rule").where("n = needs").select("event_id", "rule_code", "priority", "description", "family")
