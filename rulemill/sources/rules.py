"""Where rules come from: JSON files (an array, one object, or one object a line), Python lists, rule tables (Parquet or JDBC)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RULE_ROW, CompilationError, Rule, row_rule, rule_row


def parse_rules(text: str) -> list[dict]:
    """Rule objects of a JSON array, a single object, or JSON Lines. A fault in a line is reported with its number."""
    stripped = text.strip()
    if not stripped:
        raise CompilationError("there are no rules")
    try:
        data = json.loads(stripped)
        return data if isinstance(data, list) else [data]
    except json.JSONDecodeError as whole:
        lines = [(i, x.strip()) for i, x in enumerate(text.splitlines(), 1) if x.strip()]
        if stripped[0] == "[" or len(lines) < 2:
            raise CompilationError(f"not JSON: {whole}") from None
        out = []
        for i, line in lines:
            try:
                out.append(json.loads(line))
            except json.JSONDecodeError as e:
                raise CompilationError(f"line {i}: {e.msg}") from None
        return out


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Read a rule file from any store that Spark reads. Rule files are small and go to the driver whole."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [r for row in rows for r in parse_rules(row.value)]


def rules_frame(spark: SparkSession, rules: Iterable[dict | Rule]) -> DataFrame:
    return spark.createDataFrame([rule_row(Rule.of(r)) for r in rules], RULE_ROW)


def read_rule_table(source: DataFrame, enabled_only: bool = False) -> list[Rule]:
    """Current rules of a table, highest priority first, then by code. A table with a version history is reduced to its current rows."""
    df = source.where("is_current") if "is_current" in source.columns else source
    if enabled_only:
        df = df.where(F.coalesce("enabled", F.lit(True)))
    return [row_rule(r) for r in df.orderBy(F.desc("priority"), "rule_code").select(*RULE_ROW.fieldNames()).collect()]


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> list[Rule]:
    """A rule table in a database; conditions, tags and labels there are text (JSON, comma-joined, JSON)."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    return read_rule_table(from_text_columns(df), enabled_only=True)


def from_text_columns(df: DataFrame) -> DataFrame:
    """Rows as databases hold them: conditions and labels as JSON text, tags joined by commas."""
    condition = F.from_json("conditions", "array<struct<field:string,operator:string,value:variant>>")
    conditions = F.transform(condition, lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), F.to_json(c["value"]).alias("value")))
    return df.withColumns({"conditions": conditions, "tags": F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: t != ""), "labels": F.from_json("labels", "map<string,string>")})


def write_rule_table(spark: SparkSession, rules: Iterable[dict | Rule], path: str) -> None:
    """Replace a rule table as a whole."""
    rules_frame(spark, rules).write.mode("overwrite").parquet(path)
