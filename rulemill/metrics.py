"""Statistics of evaluations: batch totals, rules by load and latency, percentiles, histograms and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def per_event(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Number of matches of every event, 0 included."""
    counts = matches.groupBy("event_id").agg(F.count("*").alias("n_matched"))
    return events.select("event_id").join(counts, "event_id", "left").select("event_id", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"))


def batch_results(results: DataFrame, order: str = "id", matched: bool | None = None, time: str = "nanos") -> DataFrame:
    """Per-event results (event_id, n_matched), those with or without a match on demand, by ``id``, by ``time`` (the slowest first) or by ``matches`` (the most first); equals by id."""
    if matched is not None:
        results = results.where((F.col("n_matched") > 0) == matched)
    return results.orderBy(*{"id": ["event_id"], "time": [F.desc(time), "event_id"], "matches": [F.desc("n_matched"), "event_id"]}[order])


def batch_stats(results: DataFrame, nanos: str | None = None) -> DataFrame:
    """One row over per-event results (n_matched, and a column of nanoseconds on demand): totals, match rate, averages, extremes. All zero for an empty batch."""
    total = F.count("*")
    out = [total.alias("total_events"), F.coalesce(F.sum("n_matched"), F.lit(0)).cast("long").alias("total_matched"), _share(F.sum(F.when(F.col("n_matched") > 0, 1).otherwise(0)), total).alias("match_rate"), _share(F.sum("n_matched"), total).alias("avg_matched")]
    if nanos:
        out += [F.coalesce(F.expr(f"sum(`{nanos}`) div count(*)"), F.lit(0)).alias("avg_nanos"), F.coalesce(F.min(nanos), F.lit(0)).alias("min_nanos"), F.coalesce(F.max(nanos), F.lit(0)).alias("max_nanos")]
    return results.agg(*out)


def rule_load(events: DataFrame, matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluations (every event counts for every rule), matches and match rate of all rules named in ``rules`` (rule_code), those that never match among them."""
    n = events.agg(F.count("*").alias("evaluations"))
    by = matches.groupBy("rule_code").agg(F.count("*").alias("_matches"))
    matched = F.coalesce("_matches", F.lit(0)).cast("long")
    return rules.select("rule_code").join(by, "rule_code", "left").join(F.broadcast(n)).select("rule_code", "evaluations", matched.alias("matches"), _share(matched, F.col("evaluations")).alias("match_rate"))


def rule_metrics(load: DataFrame, samples: DataFrame, value: str, order: list[Column], last: int = 1000) -> DataFrame:
    """``load`` with the p99 (nearest rank), average (whole) and maximum of each rule's last ``last`` samples (rule_code, value); 0 for a rule without samples."""
    recent = latency_by(latest(samples, ["rule_code"], order, last), "rule_code", value)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return load.join(recent, "rule_code", "left").select(*load.columns, zero(F.col("p99")).alias("p99"), zero(F.floor("avg_value")).alias("avg_value"), zero(F.col("max_value")).alias("max_value"))


def hot_rules(load: DataFrame, n: int) -> DataFrame:
    """The n rules with most matches; ties in order of code."""
    return load.orderBy(F.desc("matches"), "rule_code").limit(n)


def latest(samples: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n samples of each key."""
    return samples.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: Sketches are off by a ten-thousandth of the rows at most; the ranks sought lie within three of these. Keys of few rows are ranked whole.
_ACCURACY, _SLACK, _FEW = 10_000, 3e-4, 20_000


def order_statistics(samples: DataFrame, key: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """Exact percentiles by key without a key's values in one task: key, point, n, nearest (the nearest rank) and interpolated.

    A sketch bounds where each percentile lies. Then the values below the bounds are only counted, and those between them, about a thousandth of a key's rows, are counted by value and ranked.
    """
    rows = samples.where(F.col(value).isNotNull())
    sides = (("lo", -_SLACK, F.min(value)), ("hi", _SLACK, F.max(value)))
    bounds = [F.when(F.count("*") <= _FEW, end).otherwise(F.expr(f"percentile_approx(`{value}`, {min(1.0, max(0.0, p + d))}, {_ACCURACY})")).alias(f"_{side}{i}") for i, p in enumerate(points) for side, d, end in sides]
    sketch = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), *bounds)
    v = F.col(value)
    cases = F.array_compact(F.array(*[F.when(v <= F.col(f"_hi{i}"), F.struct(F.lit(i).alias("i"), F.when(v >= F.col(f"_lo{i}"), v).alias("v"))) for i in range(len(points))]))
    counted = rows.join(sketch, F.col(key).eqNullSafe(F.col("_key"))).select("_key", "_n", F.explode(cases).alias("x")).groupBy("_key", "_n", "x.i", "x.v").agg(F.count("*").alias("_c"))
    ranked = counted.withColumn("_r", F.sum("_c").over(W.partitionBy("_key", "i").orderBy(F.asc_nulls_first("v"))))
    point = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("i") + 1)
    at = lambda rank: F.min(F.when(F.col("v").isNotNull() & (F.col("_r") >= rank), F.col("v")))
    place = point * (F.col("_n") - 1)
    out = ranked.groupBy("_key", "_n", "i").agg(at(F.greatest(F.lit(1), F.ceil(F.round(point * F.col("_n"), 6)))).alias("nearest"), at(F.floor(place) + 1).alias("_a"), at(F.ceil(place) + 1).alias("_b"))
    return out.select(F.col("_key").alias(key), point.alias("point"), F.col("_n").alias("n"), "nearest", (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("interpolated"))


def latency_by(samples: DataFrame, key: str, value: str, exact: bool = True) -> DataFrame:
    """Count, average, maximum and nearest-rank p99 of a value by key; ``exact=False`` takes the p99 of a sketch, in one pass."""
    totals = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.max(value).alias("max_value")]
    if not exact:
        return samples.groupBy(key).agg(*totals, F.expr(f"percentile_approx(`{value}`, 0.99, {_ACCURACY})").alias("p99"))
    p99 = order_statistics(samples, key, value, (0.99,)).select(F.col(key).alias("_p"), F.col("nearest").alias("p99"))
    return samples.groupBy(key).agg(*totals).join(p99, F.col(key).eqNullSafe(F.col("_p")), "left").drop("_p")


def slow(latencies: DataFrame, key: str, threshold: float | None = None, n: int | None = None) -> DataFrame:
    """Keys whose p99 exceeds the threshold, the slowest first, and of these the first n."""
    out = latencies if threshold is None else latencies.where(F.col("p99") > threshold)
    out = out.orderBy(F.desc("p99"), key)
    return out if n is None else out.limit(n)


def percentiles(samples: DataFrame, key: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Interpolated percentiles by key."""
    found = order_statistics(samples, key, value, points)
    return found.groupBy(key).agg(*[F.round(F.max(F.when(F.col("point") == p, F.col("interpolated"))), 6).alias(f"p{round(p * 100)}") for p in points])


def histogram(samples: DataFrame, value: str, width: float = 1.0, buckets: int = 100) -> DataFrame:
    """Counts by bucket of equal width, values beyond the last in an overflow bucket, with running counts."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.col(value) / width), F.lit(buckets)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("running", F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)))  # at most buckets + 1 rows


def histogram_percentile(counts: DataFrame, p: float, width: float = 1.0) -> DataFrame:
    """The midpoint of the first bucket at which the running count reaches the share p."""
    total = counts.agg(F.max("running").alias("total"))
    hit = counts.join(F.broadcast(total)).where(F.col("running") >= F.ceil(F.col("total") * p))
    return hit.agg(((F.min("bucket") + 0.5) * width).alias("percentile"))


def throughput(events: DataFrame, ts: str, window: str = "1 second", late: str | None = None) -> DataFrame:
    """Events by time window. On a stream, ``late`` is how long a window waits for late events before its state is dropped."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def summary(results: DataFrame, rules: int, seconds: float) -> DataFrame:
    """One row over per-event results (n_matched): evaluated events, events with a match, their share, rules of the model, events per minute."""
    out = results.agg(F.count("*").alias("evaluations"), F.coalesce(F.sum(F.when(F.col("n_matched") > 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("matches"))
    return out.select("evaluations", "matches", _share(F.col("matches"), F.col("evaluations")).alias("match_rate"), F.lit(rules).cast("long").alias("rules"), F.round(F.col("evaluations") * 60 / F.lit(float(seconds)), 6).alias("events_per_minute"))


def evaluation_averages(results: DataFrame, predicates: int, nanos: str | None = None) -> DataFrame:
    """One row over per-event results: evaluations, predicates and matches for each, and the average time on demand.

    All ``predicates`` of the model count for every event: the engine evaluates them as columns and keeps no counter of the work done.
    """
    n = F.count("*")
    out = [n.alias("evaluations"), F.when(n > 0, F.lit(float(predicates))).otherwise(0.0).alias("predicates_per_evaluation"), _share(F.sum("n_matched"), n).alias("matches_per_evaluation")]
    return results.agg(*out, *([F.coalesce(F.expr(f"sum(`{nanos}`) div count(*)"), F.lit(0)).alias("avg_nanos")] if nanos else []))
