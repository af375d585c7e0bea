"""Aggregates, rates, percentiles and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_or_zero(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile(x: str, q: float) -> Column:
    """Nearest rank, 0 where there is nothing. Counts of distinct values are kept, not the rows."""
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"), F.lit(0.0))


def percentile_by_rank(x: str, q: float) -> Column:
    """The variant with rank int(q n + 0.999), kept between 1 and n; for groups that fit in a row."""
    n = F.count(x)
    return F.element_at(F.sort_array(F.collect_list(x)), F.greatest(F.lit(1), F.least(F.floor(n * F.lit(q) + 0.999), n)).cast("int"))


def per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def reduction(baseline: Column, optimized: Column) -> Column:
    """Percent less than the baseline; negative where it grew, 0 where there was nothing."""
    return F.when(baseline > 0, (baseline - optimized) / baseline * 100.0).otherwise(0.0)


def speedup(baseline: Column, optimized: Column) -> Column:
    return F.when(optimized > 0, baseline / optimized).otherwise(0.0)


def difference(after: DataFrame, before: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """after - before by key, never below 0."""
    b = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in counters])
    return after.join(b, F.col(key) == F.col("_k"), "left").select(key, *[F.greatest(F.col(c) - F.coalesce(f"_{c}", F.lit(0)), F.lit(0)).alias(c) for c in counters])


def rates(samples: DataFrame, by: str, at: str, total: str, keep: int = 120) -> DataFrame:
    """Counter to rate, whole units a second: first sample 0, a step back or no time passed 0; with the peak of the last samples."""
    w = Window.partitionBy(by).orderBy(at, "event_id")
    gone = F.col(at) - F.lag(at).over(w)
    more = F.greatest(F.col(total) - F.lag(total).over(w), F.lit(0))
    out = samples.withColumn("rate", F.coalesce(F.when(gone > 0, F.floor(more * 1_000_000 / gone)), F.lit(0)).cast("long"))
    return out.withColumn("peak", F.max("rate").over(w.rowsBetween(-(keep - 1), 0)))


def ewma(samples: DataFrame, by: str, order: list[str], x: str, alpha: float = 0.3) -> DataFrame:
    """(by, ewma, n): seeded by the first sample, NULLs passed over; a group's own samples are folded in order."""
    a = F.transform(F.sort_array(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(*order, F.col(x).alias("_x"))))), lambda s: s["_x"])
    fold = F.aggregate(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.element_at("a", 1), lambda p, v: p * (1 - alpha) + v * alpha)
    return samples.groupBy(by).agg(a.alias("a")).where(F.size("a") > 0).select(by, fold.alias("ewma"), F.size("a").cast("long").alias("n"))


def link(small_ms: Column, large_ms: Column, pad: Column) -> Column:
    """latency_ms and bandwidth (bytes a second) of two pings; no bandwidth where they differ by 1 ms or less."""
    d = large_ms - small_ms
    return F.struct(small_ms.alias("latency_ms"), F.when(d > 1, pad / (d / 1000.0)).alias("bandwidth"))


def recent(history: DataFrame, k: int = 20, cap: int = 64) -> DataFrame:
    return history.orderBy(F.col("at").desc(), F.col("task_id").desc()).limit(min(k, cap))


def pacing(beats: DataFrame, base_s: int, ceiling_s: int, change: float = 0.05) -> DataFrame:
    """Seconds to the next report: the base after work or a change of load, else doubled each quiet time up to the ceiling."""
    w = Window.partitionBy("node_id").orderBy("at", "event_id")
    reset = F.col("worked") | F.coalesce(F.abs(F.col("load") - F.lag("load").over(w)) >= change, F.lit(True))
    b = beats.withColumn("island", F.sum(reset.cast("int")).over(w))
    quiet = F.row_number().over(Window.partitionBy("node_id", "island").orderBy("at", "event_id")) - 1
    return b.withColumn("gap", F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), F.least(quiet, F.lit(40))), F.greatest(F.lit(float(ceiling_s)), F.lit(float(base_s)))).cast("double"))


def span_counts(lines: DataFrame, column: str = "body") -> DataFrame:
    """Spans by name in nested trace documents."""
    schema = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<name:string>>>>>>"
    s = lines.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    return s.groupBy(F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def warnings(baseline_sent: Column, skips: Column, tasks: Column) -> Column:
    """What makes a comparison worthless, as texts."""
    return F.filter(F.array(F.when(baseline_sent == 0, "the baseline moved nothing"), F.when((baseline_sent != 0) & (skips >= tasks), "every transfer was skipped")), lambda x: x.isNotNull())
