"""Graphs of steps: checks, waves, binding of inputs, what fails with what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def _edges(edges: DataFrame) -> DataFrame:
    """Edges are a set: one listed twice is one edge."""
    return edges.select("run", "src", "dst").distinct()


def waves(steps: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(run, step, wave): length of the longest path from a root. Steps on or behind a cycle have no row.

    One round a wave, over steps still to be placed: a step is placed when all its parents are. Rounds cut
    their lineage by checkpoint; they are as many as the deepest run has waves, whatever the number of runs.
    """
    e = _edges(edges)
    rest = steps.select("run", "step").distinct()
    out = None
    for wave in range(most):
        blocked = e.select("run", F.col("dst").alias("step")).distinct()
        ready = cut(rest.join(blocked, ["run", "step"], "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        rest = cut(rest.join(ready.select("run", "step"), ["run", "step"], "left_anti"))
        e = cut(e.join(ready.select("run", F.col("step").alias("src")), ["run", "src"], "left_anti"))
    else:
        raise RuntimeError(f"more than {most} waves")
    return out if out is not None else rest.withColumn("wave", F.lit(0)).limit(0)


def roots(steps: DataFrame, edges: DataFrame) -> DataFrame:
    return steps.select("run", "step").join(edges.select("run", F.col("dst").alias("step")).distinct(), ["run", "step"], "left_anti")


def dependents(edges: DataFrame) -> DataFrame:
    return _edges(edges)


def chain(steps: DataFrame) -> DataFrame:
    """Edges from each step to the next of its run."""
    w = Window.partitionBy("run").orderBy("step")
    return steps.select("run", F.lag("step").over(w).alias("src"), F.col("step").alias("dst")).where("src is not null")


def faults(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, step, fault) of the first fault of each run: a step that depends on itself, or on one that is not there."""
    s = steps.select("run", F.col("step").alias("src"), F.lit(True).alias("there")).distinct()
    met = _edges(edges).join(s, ["run", "src"], "left")
    bad = met.where(F.col("there").isNull() | (F.col("src") == F.col("dst"))).select("run", F.col("dst").alias("step"), F.when(F.col("src") == F.col("dst"), "self").otherwise("unknown").alias("fault"))
    return bad.groupBy("run").agg(F.min(F.struct("step", "fault")).alias("f")).select("run", "f.step", "f.fault")


def stuck(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that can never start: on a cycle or behind one."""
    return steps.select("run", "step").distinct().join(waves(steps, edges).select("run", "step"), ["run", "step"], "left_anti")


def skipped(edges: DataFrame, failed: DataFrame, most: int = 10_000) -> DataFrame:
    """(run, step): all descendants of failed steps, the failed themselves left out unless behind another failed one."""
    e = _edges(edges)
    front = failed.select("run", "step").distinct()
    out = None
    for _ in range(most):
        front = e.join(front.select("run", F.col("step").alias("src")), ["run", "src"], "left_semi").select("run", F.col("dst").alias("step")).distinct()
        front = cut(front if out is None else front.join(out, ["run", "step"], "left_anti"))
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
    else:
        raise RuntimeError(f"failures reach further than {most} steps")
    return front if out is None else out


def outcomes(steps: DataFrame, edges: DataFrame, failing: DataFrame, resumed: DataFrame) -> DataFrame:
    """(run, step, status): resumed, skipped, failed or success. A join runs only if all parents did; a resumed step is never run again."""
    done = resumed.select("run", "step").distinct()
    bad = failing.select("run", "step").distinct().join(done, ["run", "step"], "left_anti")
    gone = skipped(edges, bad).join(done, ["run", "step"], "left_anti")
    mark = lambda df, c: df.select("run", "step", F.lit(True).alias(c))
    out = steps.select("run", "step").distinct().join(mark(done, "r"), ["run", "step"], "left").join(mark(gone, "g"), ["run", "step"], "left").join(mark(bad, "b"), ["run", "step"], "left")
    return out.select("run", "step", F.when(F.col("r"), "resumed").when(F.col("g"), "skipped").when(F.col("b"), "failed").otherwise("success").alias("status"))


def bind_inputs(declared: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """(run, step, inputs): declared inputs in order, then the parents' outputs once each, leaving out those already declared."""
    d = declared.groupBy("run", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "data_id"))), lambda x: x["data_id"]).alias("d"))
    p = _edges(edges).join(outputs.select("run", F.col("step").alias("src"), "output_id"), ["run", "src"]).groupBy("run", F.col("dst").alias("step")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("src", "output_id"))), lambda x: x["output_id"])).alias("p"))
    none = F.array().cast("array<string>")
    out = d.join(p, ["run", "step"], "full")
    return out.select("run", "step", F.concat(F.coalesce("d", none), F.array_except(F.coalesce("p", none), F.coalesce("d", none))).alias("inputs"))


def bytes_moved(edges: DataFrame, placed: DataFrame, outputs: DataFrame) -> DataFrame:
    """(run, moved_bytes): sizes of outputs that a child on another node reads, once for each node."""
    at = placed.select("run", "step", "node_id")
    e = _edges(edges).join(at.select("run", F.col("step").alias("src"), F.col("node_id").alias("src_node")), ["run", "src"]).join(at.select("run", F.col("step").alias("dst"), F.col("node_id").alias("dst_node")), ["run", "dst"])
    m = e.where("src_node <> dst_node").select("run", F.col("src").alias("step"), "dst_node").distinct().join(outputs.select("run", "step", "size_bytes"), ["run", "step"])
    return m.groupBy("run").agg(F.sum("size_bytes").alias("moved_bytes"))
