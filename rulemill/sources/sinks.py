"""What results are written as."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.evaluate import match_arrays


def match_json(matches: DataFrame) -> DataFrame:
    """One JSON document per event with matches."""
    return match_arrays(matches).select(F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("matched_rules").alias("matchedRules"))).alias("value"))


def csv_report(results: DataFrame, path: str) -> None:
    """Per-event results as CSV with a header line."""
    results.write.option("header", True).mode("overwrite").csv(path)


def json_report(results: DataFrame, stats: DataFrame, path: str) -> None:
    """Results and their one row of statistics as two JSON Lines folders."""
    results.write.mode("overwrite").json(f"{path}/results")
    stats.withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/stats")
