"""The versioned rule catalog: a history table with one row per version, and the views and changes over it.

The table is kept as numbered snapshots in one folder. A change writes the next snapshot and then is the current one, since readers take the highest
that Spark's writer has completed; so a failed change leaves the old state. There is one writer at a time. Rules are
small data: a snapshot is read, changed and written as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.events import canonical
from .model import RULE_ROW, CompilationError, Rule, row_rule, rule_row
from .operators import resolve
from .plans.compiler import compile_rules

HISTORY = T.StructType(
    [
        *RULE_ROW.fields,
        T.StructField("is_current", T.BooleanType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("change_summary", T.StringType()),
        T.StructField("changed_by", T.StringType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("compile_status", T.StringType()),
        T.StructField("compile_note", T.StringType()),
    ]
)
CREATED, UPDATED, ROLLBACK = "CREATED", "UPDATED", "ROLLBACK"
SKIP, OVERWRITE, RENAME = "SKIP", "OVERWRITE", "RENAME"


class CatalogError(ValueError):
    """A change that the catalog refuses."""


# --- Views of a history table ------------------------------------------------------------------------------------------------------


def current(history: DataFrame) -> DataFrame:
    """The latest version of each rule."""
    w = W.partitionBy("rule_code").orderBy(F.desc("version"))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(history: DataFrame, code: str) -> DataFrame:
    return history.where(F.col("rule_code") == code).orderBy(F.desc("version"))


def change_summary(history: DataFrame) -> DataFrame:
    """What each version changed against the one before: rule_code, version, summary."""
    w = W.partitionBy("rule_code").orderBy("version")
    text = lambda c: F.to_json(F.struct(F.col(c)))
    old = {c: F.lag(text(c)).over(w) for c in ("conditions", "priority", "description", "enabled", "tags")}
    named = {"conditions": "conditions", "priority": "priority", "description": "description", "enabled": "status", "tags": "tags"}
    df = history.withColumns({"_v": F.lag("version").over(w), **{f"_o_{c}": o for c, o in old.items()}})
    parts = F.concat_ws(", ", *[F.when(F.col(f"_o_{c}") != text(c), F.lit(f"{n} changed")) for c, n in named.items()])
    return df.select("rule_code", "version", F.when(F.col("_v").isNull(), F.lit("Rule created")).when(parts == "", F.lit("Rule updated")).otherwise(parts).alias("summary"))


def version_diff(history: DataFrame, code: str, old: int, new: int) -> DataFrame:
    """Conditions of two versions by canonical field: field, old_condition, new_condition, change (added, removed, modified, unchanged).

    Several conditions on one field are paired in their order.
    """

    def side(v: int, name: str) -> DataFrame:
        rows = history.where((F.col("rule_code") == code) & (F.col("version") == v)).select(F.posexplode("conditions").alias("i", "c"))
        rows = rows.select(F.regexp_replace(F.upper("c.field"), "-", "_").alias("field"), F.concat_ws(" ", "c.operator", "c.value").alias(name), "i")
        return rows.withColumn("k", F.row_number().over(W.partitionBy("field").orderBy("i"))).drop("i")

    both = side(old, "old_condition").join(side(new, "new_condition"), ["field", "k"], "full_outer")
    change = F.when(F.col("old_condition").isNull(), "added").when(F.col("new_condition").isNull(), "removed").when(F.col("old_condition") == F.col("new_condition"), "unchanged").otherwise("modified")
    return both.select("field", "old_condition", "new_condition", change.alias("change"))


def family() -> Column:
    """A rule's family as a Column over a rule table."""
    parts, tags = F.split("rule_code", r"\."), F.filter("tags", lambda t: t.contains("family:"))
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.coalesce(F.element_at(F.split(F.try_element_at(tags, F.lit(1)), "family:"), 2), F.lit("general")))


def with_views(rules: DataFrame) -> DataFrame:
    """Adds family and status."""
    return rules.withColumns({"family": family(), "status": F.when(F.coalesce("enabled", F.lit(True)), "active").otherwise("inactive")})


def search(rules: DataFrame, text: str | None = None, families: list[str] | None = None, status: str | None = None, tags: list[str] | None = None, compile_status: str | None = None) -> DataFrame:
    """Filters of the rule list: text in code or description whatever its case, family, status, all of the tags, and the status of its last compilation."""
    out = with_views(rules)
    if compile_status:
        out = out.where(F.col("compile_status") == compile_status)
    if text:
        t = text.lower()
        out = out.where(F.lower("rule_code").contains(t) | F.coalesce(F.lower("description").contains(t), F.lit(False)))
    if families:
        out = out.where(F.col("family").isin(families))
    if status:
        out = out.where(F.col("status") == status)
    for t in tags or []:
        out = out.where(F.array_contains("tags", t))
    return out


def page(rules: DataFrame, number: int, size: int) -> DataFrame:
    """A page, from 0, of rules by priority and code."""
    return rules.orderBy(F.desc("priority"), "rule_code").offset(number * size).limit(size)


def tag_counts(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def family_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(family().alias("family")).agg(F.count("*").alias("n"))


def version_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("rule_code").agg(F.count("*").alias("versions"), F.max("version").alias("last_version"))


# --- Import -----------------------------------------------------------------------------------------------------------------------


def import_issues(rules: Iterable[dict], existing: set[str]) -> list[dict]:
    """Check rules for import one by one: code, status (VALID, WARNING, ERROR), conflict, issues."""
    out, seen = [], set()
    for data in rules:
        errors, warnings = [], []
        data = data if isinstance(data, dict) else {}
        code = data.get("rule_code")
        if not isinstance(code, str) or not code.strip():
            errors.append("rule_code is required")
        if not data.get("description"):
            errors.append("description is required")
        conditions = data.get("conditions")
        if not isinstance(conditions, list) or not conditions:
            errors.append("conditions are required")
        priority = data.get("priority", 0)
        if isinstance(priority, bool) or not isinstance(priority, (int, float)) or not 0 <= priority <= 1000:
            errors.append("priority must lie between 0 and 1000")
        elif priority > 900:
            warnings.append("priority is very high")
        equal: dict[str, int] = {}
        for c in conditions if isinstance(conditions, list) else []:
            try:
                op = resolve(c.get("operator")).name
            except CompilationError as e:
                errors.append(str(e))
                continue
            if op == "EQUAL_TO":
                name = canonical(str(c.get("field")))
                equal[name] = equal.get(name, 0) + 1
                if c.get("value") is None:
                    warnings.append(f"{name}: to test for null use IS_NULL")
        warnings += [f"{f}: several equalities can't hold together" for f, n in equal.items() if n > 1]
        conflict = code in existing
        if conflict:
            warnings.append("a rule of this code exists")
        if code in seen:
            warnings.append("this code occurs twice in the import")
        seen.add(code)
        out.append({"rule_code": code, "status": "ERROR" if errors else "WARNING" if warnings else "VALID", "conflict": conflict, "issues": errors + warnings})
    return out


def import_totals(issues: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    return issues.agg(F.count("*").alias("total"), count("VALID").alias("valid"), count("WARNING").alias("warnings"), count("ERROR").alias("errors"))


def import_outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Totals of an executed import (rows of rule_code, outcome, reason)."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("outcome") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    return outcomes.agg(F.count("*").alias("total"), count("imported").alias("imported"), count("skipped").alias("skipped"), count("failed").alias("failed"))


class RuleCatalog:
    """Changes to the catalog in a folder of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshot(self) -> int:
        """Number of the current snapshot; 0 if there is none."""
        fs, p = self._fs()
        if not fs.exists(p):
            return 0
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and fs.exists(make(s.getPath(), "_SUCCESS"))]
        return max(numbers, default=0)

    def history(self) -> DataFrame:
        n = self.snapshot()
        return self.spark.read.schema(HISTORY).parquet(f"{self.path}/{n:08d}") if n else self.spark.createDataFrame([], HISTORY)

    def _rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.history().collect()]

    def _write(self, rows: list[dict]) -> None:
        data = [tuple(r[f] for f in HISTORY.fieldNames()) for r in rows]
        self.spark.createDataFrame(data, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.snapshot() + 1:08d}")

    @staticmethod
    def _row(rule: Rule, change: str, summary: str, by: str | None) -> dict:
        row = dict(zip(RULE_ROW.fieldNames(), rule_row(rule), strict=True))
        row["conditions"] = [dict(zip(("field", "operator", "value"), c, strict=True)) for c in row["conditions"]]
        return row | {"is_current": True, "change_type": change, "change_summary": summary, "changed_by": by, "changed_at": datetime.now(timezone.utc).replace(tzinfo=None), "compile_status": "PENDING", "compile_note": None}

    def rules(self) -> list[Rule]:
        """Current rules, highest priority first."""
        rows = [r for r in self._rows() if r["is_current"]]
        return [self._rule(r) for r in sorted(rows, key=lambda r: (-r["priority"], r["rule_code"]))]

    @staticmethod
    def _rule(r: dict) -> Rule:
        return Rule.of(r | {"conditions": [c | {"value": None if c["value"] is None else json.loads(c["value"])} for c in r["conditions"]]})

    def compile(self) -> DataFrame:
        """Compile every current rule by itself and write its status and note back: OK, WARNING (it can never match) or ERROR. Returns rule_code, compile_status, compile_note."""
        rows, out = self._rows(), []
        for r in rows:
            if r["is_current"]:
                try:
                    done = compile_rules([self._rule(r)]).rules[0]
                    r["compile_status"], r["compile_note"] = done.status, done.note or None
                except (CompilationError, ValueError, TypeError) as e:
                    r["compile_status"], r["compile_note"] = "ERROR", str(e)
                out.append((r["rule_code"], r["compile_status"], r["compile_note"]))
        if out:
            self._write(rows)
        return self.spark.createDataFrame(out, "rule_code string, compile_status string, compile_note string")

    def find(self, code: str) -> Rule | None:
        rows = current(self.history().where((F.col("rule_code") == code) & F.col("is_current"))).limit(1).collect()
        return row_rule(rows[0]) if rows else None

    def exists(self, code: str) -> bool:
        return self.find(code) is not None

    def count(self) -> int:
        return self.history().where("is_current").count()

    @staticmethod
    def check(rule: Rule) -> None:
        """What a rule must have to be kept: a code, at least one condition, and fields, operators and values of these."""
        if not rule.conditions:
            raise CatalogError(f"rule {rule.rule_code!r} has no conditions")
        try:
            compile_rules([rule])
        except CompilationError as e:
            raise CatalogError(str(e)) from e

    def create(self, data: dict | Rule, by: str | None = None) -> Rule:
        rule = Rule.of(data)
        self.check(rule)
        rows = self._rows()
        own = [r for r in rows if r["rule_code"] == rule.rule_code]
        if any(r["is_current"] for r in own):
            raise CatalogError(f"rule {rule.rule_code!r} exists")
        rule = rule.with_(version=1 + max((r["version"] for r in own), default=0))
        self._write([*rows, self._row(rule, CREATED, "Rule created", by)])
        return rule

    def update(self, code: str, data: dict | Rule, by: str | None = None) -> Rule:
        """Changed conditions make a new version; other changes are made in place."""
        rule = Rule.of(data)
        if rule.rule_code != code:
            raise CatalogError("the code of a rule can't change")
        self.check(rule)
        rows = self._rows()
        old = next((r for r in rows if r["rule_code"] == code and r["is_current"]), None)
        if old is None:
            raise CatalogError(f"rule {code!r} doesn't exist")
        new = self._row(rule, UPDATED, "", by)
        names = {"conditions": "conditions", "priority": "priority", "description": "description", "enabled": "status", "tags": "tags"}
        new["change_summary"] = ", ".join(f"{n} changed" for k, n in names.items() if old[k] != new[k]) or "Rule updated"
        if old["conditions"] != new["conditions"]:
            new["version"] = 1 + max(r["version"] for r in rows if r["rule_code"] == code)
            old["is_current"] = False
            rows.append(new)
        else:
            old |= {k: v for k, v in new.items() if k not in ("version", "change_type")}
        self._write(rows)
        return self._rule(new if old["conditions"] != new["conditions"] else old)

    def delete(self, *codes: str) -> int:
        """Rules leave the current set; their history stays. Returns how many left."""
        rows, n = self._rows(), 0
        for r in rows:
            if r["rule_code"] in codes and r["is_current"]:
                r["is_current"], n = False, n + 1
        if n:
            self._write(rows)
        return n

    def rollback(self, code: str, version: int, by: str | None = None) -> Rule:
        """A copy of an older version becomes the newest one."""
        rows = self._rows()
        now = next((r for r in rows if r["rule_code"] == code and r["is_current"]), None)
        then = next((r for r in rows if r["rule_code"] == code and r["version"] == version), None)
        if now is None:
            raise CatalogError(f"rule {code!r} doesn't exist")
        if then is None:
            raise CatalogError(f"rule {code!r} has no version {version}")
        if then["version"] == now["version"]:
            raise CatalogError(f"version {version} is the current one")
        rule = self._rule(then).with_(version=1 + max(r["version"] for r in rows if r["rule_code"] == code))
        now["is_current"] = False
        self._write([*rows, self._row(rule, ROLLBACK, f"Rolled back to version {version}", by)])
        return rule

    def import_validate(self, rules: list[dict]) -> DataFrame:
        """One row per rule: rule_code, status, conflict, issues."""
        existing = {r.rule_code for r in self.rules()}
        return self.spark.createDataFrame(import_issues(rules, existing), "rule_code string, status string, conflict boolean, issues array<string>")

    def import_execute(self, rules: list[dict], mode: str = SKIP, enable: bool = True, by: str | None = None) -> DataFrame:
        """Import what can be imported: one row per rule with its code, outcome (imported, skipped, failed) and reason. Rules with errors fail; a rule that the catalog refuses fails too."""
        if mode not in (SKIP, OVERWRITE, RENAME):
            raise ValueError(f"unknown mode {mode!r}")
        rows, taken, out = self._rows(), {r.rule_code for r in self.rules()}, []
        for data, issue in zip(rules, import_issues(rules, taken), strict=True):
            code = issue["rule_code"]
            if issue["status"] == "ERROR":
                out.append((code, "failed", issue["issues"][0]))
                continue
            try:
                rule = Rule.of(data)
                if enable:
                    rule = rule.with_(enabled=True)
                self.check(rule)
            except (CatalogError, CompilationError, TypeError) as e:
                out.append((code, "failed", str(e)))
                continue
            change, summary = CREATED, "Imported"
            if code in taken and mode == SKIP:
                out.append((code, "skipped", "a rule of this code exists"))
                continue
            if code in taken and mode == RENAME:
                rule = rule.with_(rule_code=imported_name(code, taken), description=f"{rule.description} (imported)")
            elif code in taken:
                change, summary = UPDATED, "Overwritten by import"
            for r in rows:
                if r["rule_code"] == rule.rule_code:
                    r["is_current"] = False
            rule = rule.with_(version=1 + max((r["version"] for r in rows if r["rule_code"] == rule.rule_code), default=0))
            rows.append(self._row(rule, change, summary, by))
            taken.add(rule.rule_code)
            out.append((rule.rule_code, "imported", summary))
        if any(o[1] == "imported" for o in out):
            self._write(rows)
        return self.spark.createDataFrame(out, "rule_code string, outcome string, reason string")


def imported_name(code: str, taken: set[str]) -> str:
    n = 1
    while f"{code}_imported_{n}" in taken:
        n += 1
    return f"{code}_imported_{n}"
