"""Decisions: capacity, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import in_order


def ratio(kind: Column, value: Column, nodes: Column, depth: Column, cpu: Column, wait: Column) -> Column:
    """How far the mesh is from its target: 1 is on target. Targets have floors, so that none divides by 0."""
    per_node = depth / (F.greatest(value, F.lit(0.01)) * F.greatest(nodes, F.lit(1)))
    return F.when(kind == "queue", per_node).when(kind == "cpu", cpu / F.greatest(value, F.lit(0.01))).otherwise(wait / F.greatest(value, F.lit(0.001)))


def decide(signals: DataFrame, min_nodes: int = 1, max_nodes: int = 10, tolerance: float = 0.1) -> DataFrame:
    """signals (nodes, depth, ratio) with ``action``, ``to`` and ``reason``. Scaling down waits for an empty queue."""
    n, r = F.col("nodes"), F.col("ratio")
    up = F.least(F.greatest(F.ceil(n * r), F.lit(min_nodes)), F.lit(max_nodes))
    down = F.least(F.greatest(F.greatest(F.floor(n * r), F.lit(1)), F.lit(min_nodes)), F.lit(max_nodes))
    action = F.when(n < min_nodes, "up").when((r > 1 + tolerance) & (up > n), "up").when((r < 1 - tolerance) & (F.col("depth") == 0) & (down < n), "down").otherwise("none")
    to = F.when(n < min_nodes, F.lit(min_nodes)).when(F.col("action") == "up", up).when(F.col("action") == "down", down).otherwise(n).cast("long")
    out = signals.withColumn("action", action).withColumn("to", to)
    return out.withColumn("reason", F.when(n < min_nodes, F.format_string("below the minimum of %d", F.lit(min_nodes))).when(F.col("action") == "none", F.lit("within tolerance")).otherwise(F.concat(F.lit("ratio "), F.format_string("%.2f", r))))


def decide_in_order(signals: DataFrame, group: str, cooldown: int, **policy) -> DataFrame:
    """The same, but a change starts a clock during which nothing is decided: an ordered fold for each group."""
    d = decide(signals, **policy)

    def start():
        last = None

        def step(rows):
            nonlocal last
            out = []
            for at, action in zip(rows["at"], rows["action"], strict=True) if rows else ():
                cooling = last is not None and at - last < cooldown
                out.append((at, "none" if cooling else action))
                if not cooling and action != "none":
                    last = at
            return out

        return step

    return in_order(d.select(group, "at", "action"), group, ["at"], start, f"{group} long, at long, action string")


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, change, regressed, gating): metrics rows are (metric, value, lower_is_better, tolerance, gating).

    Change in percent; from 0 it is 0 or 100. The tolerance itself is no regression.
    """
    out = baseline.select("metric", F.col("value").alias("baseline"), "lower_is_better", "tolerance", "gating").join(current.select("metric", F.col("value").alias("current")), "metric")
    change = F.when(F.col("baseline") != 0, (F.col("current") - F.col("baseline")) / F.col("baseline") * 100.0).when(F.col("current") == 0, 0.0).otherwise(100.0)
    worse = F.when(F.col("lower_is_better"), F.col("change")).otherwise(-F.col("change"))
    return out.withColumn("change", change).withColumn("regressed", worse > F.col("tolerance")).drop("lower_is_better", "tolerance")


def gate(checks: DataFrame, same_work: Column) -> DataFrame:
    """One row: refused (different work), failed (a gating regression), warnings (others)."""
    return checks.agg(F.bool_or(~same_work).alias("refused"), F.bool_or(F.col("gating") & F.col("regressed")).alias("failed"), F.count_if(~F.col("gating") & F.col("regressed")).alias("warnings"))
