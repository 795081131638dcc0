"""Why rules match or don't, and what a rule set looks like from inside."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.events import EventView
from .model import Condition
from .operators import OPERATORS
from .plans.compiler import CompiledRules, Predicate
from .plans.evaluate import predicate_column

NONE, BASIC, STANDARD, FULL = "NONE", "BASIC", "STANDARD", "FULL"


def _text(view: EventView, name: str) -> Column:
    return view.column(name).cast("string") if name in view.kinds else F.lit(None).cast("string")


def explain_rule(view: EventView, compiled: CompiledRules, code: str, short_circuit: bool = True) -> DataFrame:
    """One row for each event and condition of a rule, in the rule's order: event_id, position, field, operator, expected, actual, passed, reason.

    After the first failed condition the others are not evaluated, unless ``short_circuit`` is off. Raises KeyError for an unknown code.
    """
    conditions: tuple[Condition, ...] = compiled.get(code).rule.conditions
    view = view.prune({c.field for c in conditions})
    if not conditions:
        return view.df.limit(0).select("event_id", F.lit(0).alias("position"), *[F.lit("").alias(n) for n in ("field", "operator", "expected", "actual")], F.lit(True).alias("passed"), F.lit("").alias("reason"))
    passed = [predicate_column(view, (c.field, c.operator, tuple(c.value) if isinstance(c.value, list) else c.value)) for c in conditions]
    df = view.df.withColumns({f"_c{i}": p for i, p in enumerate(passed)})
    rows, before = [], F.lit(True)
    for i, c in enumerate(conditions):
        own, value = F.col(f"_c{i}"), _text(view, c.field)
        missing = F.lit(True) if c.field not in view.kinds else view.column(c.field).isNull()
        why = F.when(own, F.lit("Passed")).when(missing, F.lit("Field missing from event")).otherwise(F.lit("Value mismatch"))
        if short_circuit:
            why = F.when(~before, F.lit("Not evaluated (short-circuit)")).otherwise(why)
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c.field).alias("field"), F.lit(c.operator).alias("operator"), F.lit(json.dumps(c.value)).alias("expected"), value.alias("actual"), (own & before if short_circuit else own).alias("passed"), why.alias("reason")))
        before = before & own
    return df.select("event_id", F.explode(F.array(*rows)).alias("r")).select("event_id", "r.*")


def trace(view: EventView, compiled: CompiledRules, level: str = FULL, only_if_matched: bool = False) -> DataFrame:
    """One row for each event and live rule: event_id, rule_code, matched, required, satisfied, match_percent, failed, and from STANDARD on outcomes.

    ``failed`` lists failed predicates as texts; outcomes are (predicate, passed), with the event's value on FULL. With ``only_if_matched`` an
    event without any match has no outcomes.
    """
    view = view.prune(compiled.fields)
    predicates = compiled.predicates()
    alias: dict[Predicate, str] = {p: f"_p{i}" for i, p in enumerate(predicates)}
    df = view.df.withColumns({a: predicate_column(view, p) for p, a in alias.items()})
    rules = []
    for r in compiled.live:
        texts = [Condition(p[0], p[1], list(p[2]) if isinstance(p[2], tuple) else p[2]).text() for p in r.predicates]
        hits = [F.col(alias[p]) for p in r.predicates]
        satisfied = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
        outcome = F.array(*[F.struct(F.lit(t).alias("predicate"), h.alias("passed"), (_text(view, p[0]) if level == FULL else F.lit(None).cast("string")).alias("actual")) for t, h, p in zip(texts, hits, r.predicates, strict=True)])
        rules.append(
            F.struct(
                F.lit(r.code).alias("rule_code"),
                (satisfied == len(hits)).alias("matched"),
                F.lit(len(hits)).alias("required"),
                satisfied.alias("satisfied"),
                F.array_compact(F.array(*[F.when(~h, F.lit(t)) for t, h in zip(texts, hits, strict=True)])).alias("failed"),
                *([outcome.alias("outcomes")] if level in (STANDARD, FULL) else []),
            )
        )
    out = df.select("event_id", F.array(*rules).alias("a"))
    if level in (STANDARD, FULL) and only_if_matched:
        out = out.withColumn("any", F.exists("a", lambda x: x["matched"]))
        out = out.select("event_id", "any", F.explode("a").alias("r")).select("event_id", "r.*", "any").withColumn("outcomes", F.when(F.col("any"), F.col("outcomes"))).drop("any")
    else:
        out = out.select("event_id", F.explode("a").alias("r")).select("event_id", "r.*")
    return out.withColumn("match_percent", match_percent(F.col("satisfied"), F.col("required")))


def match_percent(satisfied: Column, required: Column) -> Column:
    return F.when(required > 0, F.round(100.0 * satisfied / required, 6)).otherwise(F.lit(0.0))


# --- Rule-set views ---------------------------------------------------------------------------------------------------------------


def predicate_listing(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    """Distinct predicates with selectivity, cost, weight and the number of rules that use them."""
    uses = {p: sum(p in r.predicates for r in compiled.live) for p in compiled.predicates()}
    rows = [(i, p[0], p[1], json.dumps(p[2]), compiled.selectivity(p), OPERATORS[p[1]].cost, compiled.weight(p), uses[p]) for i, p in enumerate(uses)]
    return spark.createDataFrame(rows, "predicate_id int, field string, operator string, value string, selectivity double, cost double, weight double, rules int")


def dictionaries(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    """Distinct field names and text values with a number each, in order of name."""
    fields = sorted({p[0] for p in compiled.predicates()})
    values = sorted({x for p in compiled.predicates() for x in (p[2] if isinstance(p[2], tuple) else [p[2]]) if isinstance(x, str)})
    return spark.createDataFrame([("field", i, x) for i, x in enumerate(fields)] + [("value", i, x) for i, x in enumerate(values)], "dictionary string, id int, entry string")


def compile_report(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    """Status of every rule after compilation."""
    rows = [(r.code, r.status, r.note, r.rule.enabled, len(r.predicates), r.combinations) for r in compiled.rules]
    return spark.createDataFrame(rows, "rule_code string, status string, note string, enabled boolean, predicates int, combinations int")


def rule_predicates(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    """The posting list: one row for each live rule and predicate."""
    number = {p: i for i, p in enumerate(compiled.predicates())}
    return spark.createDataFrame([(r.code, r.rule.priority, number[p]) for r in compiled.live for p in r.predicates], "rule_code string, priority int, predicate_id int")


def combinations(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    """One row for each alternative of a rule and each of its single-value predicates, with the operator of these."""
    number: dict = {}
    rows, priority, seen = [], {r.code: r.rule.priority for r in compiled.rules}, {}
    for code, preds in compiled.expanded:
        seen[code] = seen.get(code, -1) + 1
        rows.extend((code, priority[code], f"{code}#{seen[code]}", number.setdefault(p, len(number)), p[1]) for p in sorted(preds, key=str))
    return spark.createDataFrame(rows, "rule_code string, priority int, combination string, predicate_id int, operator string")


#: Pairs of rules go by rare predicates while the join of these has at most so many rows, or so few that it is cheaper than comparing blocks.
MOST_JOINED = 1_000_000
BLOCK_RULES = 1_000


def conflicts(posts: DataFrame, threshold: float = 0.5, different_priority: bool = False) -> DataFrame:
    """Pairs of rules whose predicate sets overlap by Jaccard >= threshold: rule_1, rule_2, shared, unique_1, unique_2, overlap, severity.

    ``posts`` is a posting list (rule_code, priority, predicate_id). Each rule's predicates are ordered from rare to frequent; two sets of enough overlap share one of the first
    n - ceil(threshold * n) + 1, so only these rare ones are joined, between rules whose sizes allow the overlap, and each pair found is confirmed once on the whole sets.
    Where even rare predicates are held by so many rules that this join would exceed the work of comparing all rules, blocks of rules are compared instead. Rows without code or predicate are left out.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    posts = posts.where(F.col("rule_code").isNotNull() & F.col("predicate_id").isNotNull())
    both = _by_blocks(posts, threshold, rules) if (rules := _crowded(posts, threshold)) else _by_rare_predicates(posts, threshold)
    if different_priority:
        both = both.where("priority_1 <> priority_2")
    both = both.withColumn("swap", F.col("code_1") > F.col("code_2"))
    side = lambda first, name: F.when(F.col("swap") == first, F.col(f"{name}_2")).otherwise(F.col(f"{name}_1"))
    overlap = F.col("shared") / (F.col("n_1") + F.col("n_2") - F.col("shared"))
    out = both.where(overlap >= threshold).select(side(True, "code").alias("rule_1"), side(False, "code").alias("rule_2"), "shared", (side(True, "n") - F.col("shared")).alias("unique_1"), (side(False, "n") - F.col("shared")).alias("unique_2"), F.round(overlap, 6).alias("overlap"))
    severity = F.when(F.col("overlap") > 0.8, "HIGH").when(F.col("overlap") > 0.6, "MEDIUM").otherwise("LOW")
    return out.withColumn("severity", severity)


def _crowded(posts: DataFrame, threshold: float) -> int | None:
    """The number of rules, if a join of rare predicates would exceed the work of comparing all rules. A row of the join costs about as much as 20,000 multiplications of two blocks' matrices."""
    n = posts.dropDuplicates(["rule_code", "predicate_id"]).groupBy("rule_code").agg(F.count("*").alias("n"))
    rules, rare = n.agg(F.count("*"), F.coalesce(F.sum(_reach(threshold)), F.lit(0))).first()
    if rare * rules / 2 <= MOST_JOINED:
        return None
    predicates = posts.select("predicate_id").distinct().count()
    crowded = lambda joined: joined > MOST_JOINED and joined * 20_000 >= rules * rules / 2 * predicates
    if crowded(rare * rare / predicates / 2):  # a join has the fewest rows where all predicates are held alike
        return rules
    held = _rare(_sets(posts), threshold).groupBy("_id").agg(F.count("*").cast("double").alias("c"))
    return rules if crowded(held.agg(F.sum(F.col("c") * F.col("c") / 2)).first()[0]) else None


def _sets(posts: DataFrame) -> DataFrame:
    """One row per rule: its predicates p from rare to frequent and their number n. Rules go by 64-bit hashes h of their codes until pairs are confirmed."""
    distinct = posts.dropDuplicates(["rule_code", "predicate_id"])
    uses = distinct.groupBy(F.col("predicate_id").alias("_id")).agg(F.count("*").alias("_uses"))
    ordered = distinct.join(uses, F.col("predicate_id") == F.col("_id"))
    sets = ordered.groupBy("rule_code").agg(F.first("priority").alias("priority"), F.array_sort(F.collect_list(F.struct("_uses", "predicate_id"))).alias("p"))
    return sets.select(F.xxhash64("rule_code").alias("h"), "rule_code", "priority", F.transform("p", lambda x: x["predicate_id"]).alias("p"), F.size("p").alias("n"))


def _reach(threshold: float) -> Column:
    """How many of a rule's n predicates count as rare."""
    return F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) if threshold else F.col("n")


def _rare(sets: DataFrame, threshold: float) -> DataFrame:
    return sets.select("h", "n", F.explode(F.slice("p", F.lit(1), _reach(threshold).cast("int"))).alias("_id"))


def _by_rare_predicates(posts: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a rare predicate: code, priority and n of both, and shared."""
    sets = _sets(posts)
    rare = _rare(sets, threshold)
    a, b = (rare.select("_id", F.col("h").alias(f"h_{i}"), F.col("n").alias(f"n_{i}")) for i in (1, 2))
    pairs = a.join(b, "_id").where("h_1 < h_2").where(F.least("n_1", "n_2") >= F.greatest("n_1", "n_2") * threshold - 1e-9).select("h_1", "h_2").distinct()
    # Pairs are small and their confirmation is not: without a set number of partitions they would be put into one task.
    pairs = pairs.repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h_1", "h_2")
    one, two = (sets.select(F.col("h").alias(f"h_{i}"), F.struct("rule_code", "priority", "p", "n").alias(f"s_{i}")) for i in (1, 2))
    both = pairs.join(one, "h_1").join(two, "h_2")
    names = [F.col(f"s_{i}.{name}").alias(f"{alias}_{i}") for i in (1, 2) for name, alias in (("rule_code", "code"), ("priority", "priority"), ("n", "n"))]
    return both.select(*names, F.size(F.array_intersect("s_1.p", "s_2.p")).cast("long").alias("shared"))


def _by_blocks(posts: DataFrame, threshold: float, rules: int, block_rules: int | None = None) -> DataFrame:
    """The same by comparing all rules: a task multiplies the 0/1 matrices of two blocks of about ``block_rules`` rules, over some of their common predicates at a time, and returns pairs of enough overlap.

    A task holds two blocks and their matrix of counts, however many rules there are; tasks are as many as pairs of blocks.
    """
    code, predicate = (posts.schema[c].dataType.simpleString() for c in ("rule_code", "predicate_id"))
    blocks = max(1, -(-rules // (block_rules or BLOCK_RULES)))
    distinct = posts.dropDuplicates(["rule_code", "predicate_id"])
    sets = distinct.groupBy("rule_code").agg(F.first("priority").cast("int").alias("priority"), F.collect_list("predicate_id").alias("p"))

    # Workers get these functions by value, so they import what they need and name nothing of this module.
    def pack(table):
        import numpy as np
        import pyarrow as pa

        lists = table.column("p").combine_chunks()
        words = lists.flatten().dictionary_encode()
        n = lists.value_lengths().to_numpy().astype(np.int32)
        at, width = words.indices.to_numpy(), len(words.dictionary)
        if width <= 32 * max(1, n.mean()):  # as bits, unless these take more room than numbers
            bits = np.zeros((len(n), width), bool)
            bits[np.repeat(np.arange(len(n)), n), at] = True
            kind, raw = True, np.packbits(bits, axis=1).tobytes()
        else:
            kind, raw = False, at.astype(np.int32).tobytes()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [table.column("block")[:1].combine_chunks(), one(table.column("rule_code").combine_chunks()), one(table.column("priority").combine_chunks()), one(pa.array(n)), one(words.dictionary), pa.array([kind]), pa.array([raw], pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "codes", "priorities", "n", "predicates", "bits", "raw"])

    def compare(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        own, last = table.column("own")[0].as_py(), table.num_rows - 1

        def side(row):
            codes, priorities, n, predicates = (table.column(c).chunk(0)[row].values for c in ("codes", "priorities", "n", "predicates"))
            n, raw = n.to_numpy(), table.column("raw")[row].as_py()
            if table.column("bits")[row].as_py():
                rules, at = np.nonzero(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(n), -1), axis=1, count=len(predicates)))
            else:
                rules, at = np.repeat(np.arange(len(n)), n), np.frombuffer(raw, np.int32)
            return codes, priorities, n.astype(np.int64), predicates, rules, at

        def matrix(side, columns):
            place = np.full(len(side[3]), -1)
            place[columns] = np.arange(len(columns))
            column = place[side[5]]
            out = np.zeros((len(side[2]), len(columns)), np.float32)
            out[side[4][column >= 0], column[column >= 0]] = 1
            return out

        a, b = side(0), side(last)
        match = np.arange(len(a[3])) if last == 0 else pc.fill_null(pc.index_in(b[3], value_set=a[3]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        common = np.flatnonzero(match >= 0)
        shared = np.zeros((len(a[2]), len(b[2])), np.float32)
        for k in range(0, len(common), 2048):
            part = common[k : k + 2048]
            shared += matrix(a, match[part]) @ matrix(b, part).T
        enough = (shared > 0) & (shared.astype(np.float64) / (a[2][:, None] + b[2][None, :] - shared) >= threshold)
        if own:
            enough = np.triu(enough, 1)
        elif last == 0:  # the other block has no rules
            enough[:] = False
        i, j = np.nonzero(enough)
        columns = [c for s, x in ((a, i), (b, j)) for c in (s[0].take(pa.array(x)), s[1].take(pa.array(x)), pa.array(s[2][x].astype(np.int32)))]
        return pa.Table.from_arrays([*columns, pa.array(shared[i, j].astype(np.int64))], ["code_1", "priority_1", "n_1", "code_2", "priority_2", "n_2", "shared"])

    # Tasks are set by number: bytes are few, work is not, so they must not be put together by size.
    placed = sets.withColumn("block", F.pmod(F.xxhash64("rule_code"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    packed = placed.groupBy("block").applyInArrow(pack, f"block int, codes array<{code}>, priorities array<int>, n array<int>, predicates array<{predicate}>, bits boolean, raw binary")
    pairs = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"_i": F.least("block", "_o"), "_j": F.greatest("block", "_o")}).withColumn("own", F.col("_i") == F.col("_j")).drop("_o")
    tasks = max(1, min(blocks * (blocks + 1) // 2, max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * blocks // 8)))
    return pairs.repartition(tasks, "_i", "_j").groupBy("_i", "_j").applyInArrow(compare, f"code_1 {code}, priority_1 int, n_1 int, code_2 {code}, priority_2 int, n_2 int, shared long")


def by_overlap(found: DataFrame, n: int | None = None) -> DataFrame:
    """Conflicts with the largest overlap first, equals in order of their rules; of these the first n on demand."""
    out = found.orderBy(F.desc("overlap"), "rule_1", "rule_2")
    return out if n is None else out.limit(n)


# --- Rule sets over posting lists -------------------------------------------------------------------------------------------------


def affected(posts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Rules that hold any of the predicates (predicate_id): the union of their posting lists."""
    return posts.join(predicates.select("predicate_id").distinct(), "predicate_id", "left_semi").select("rule_code").distinct()


def eligible(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """The posting list cut to the given rules (rule_code): a semi join."""
    return posts.join(rules.select("rule_code").distinct(), "rule_code", "left_semi")


def surviving(rules: DataFrame, failed: DataFrame) -> DataFrame:
    """Rules and not the failed ones: an anti join."""
    return rules.select("rule_code").distinct().join(failed.select("rule_code").distinct(), "rule_code", "left_anti")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rules (rule_code) of both sets."""
    return a.select("rule_code").intersect(b.select("rule_code"))


STATIC = ("EQUAL_TO", "NOT_EQUAL_TO", "IS_NULL", "IS_NOT_NULL")


def base_conditions(posts: DataFrame) -> DataFrame:
    """One row on how combinations share their static predicates. ``posts`` is (combination, predicate_id, operator).

    total_combinations, base_sets (distinct sets of static predicates), without_base, reduction_percent, avg_reuse (combinations of a set) and avg_set_size.
    """
    static = F.when(F.col("operator").isin(*STATIC), F.col("predicate_id"))
    sets = posts.groupBy("combination").agg(F.array_sort(F.collect_set(static)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    has = F.size("s") > 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    out = sets.agg(total(F.col("n")).alias("total_combinations"), total(F.when(has, 1)).alias("base_sets"), total(F.when(~has, F.col("n"))).alias("without_base"), F.coalesce(F.round(F.avg(F.when(has, F.size("s"))), 6), F.lit(0.0)).alias("avg_set_size"))
    based = F.col("total_combinations") - F.col("without_base")
    reduction = F.when(F.col("total_combinations") > 0, F.round((1 - F.col("base_sets") / F.greatest(F.lit(1), based)) * 100, 6)).otherwise(0.0)
    reuse = F.when(F.col("base_sets") > 0, F.round(based / F.col("base_sets"), 6)).otherwise(0.0)
    return out.select("total_combinations", "base_sets", "without_base", reduction.alias("reduction_percent"), reuse.alias("avg_reuse"), "avg_set_size")


def representatives(posts: DataFrame) -> DataFrame:
    """The first rule (by priority, then code) of each distinct combination of predicates, and how many rules share it. ``posts`` is (rule_code, priority, combination, predicate_id)."""
    sets = posts.groupBy("rule_code", "priority", "combination").agg(F.array_sort(F.collect_set("predicate_id")).alias("s"))
    return sets.groupBy("s").agg(F.min(F.struct((-F.col("priority")).alias("o"), "rule_code")).alias("m"), F.count_distinct("rule_code").alias("rules")).select(F.col("m.rule_code").alias("representative"), F.size("s").alias("predicates"), "rules")
