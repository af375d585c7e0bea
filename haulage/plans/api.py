"""A fluent face: publish data, submit batches of tasks with inputs and constraints, run flows, look at nodes and history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, kinds
from ..operators import catalog, content, metrics, placement
from . import flow


@dataclass(frozen=True)
class Mesh:
    """Tables of nodes, datasets and locations; every method gives a new Mesh or a DataFrame. Placement writes its few candidate nodes when asked for; tasks run with an action."""

    spark: SparkSession
    nodes: DataFrame
    datasets: DataFrame
    locations: DataFrame
    weights: placement.Weights = field(default_factory=placement.Weights)

    def publish(self, blobs: DataFrame, node_id: int | None = None) -> Mesh:
        """blobs: data. Publishing twice changes nothing."""
        made = content.publish(content.address(blobs))
        sets = self.datasets.unionByName(made.select("data_id", "size_bytes")).dropDuplicates(["data_id"])
        at = self.locations if node_id is None else catalog.record(self.locations, made.select("data_id", F.lit(node_id).alias("node_id")))
        return replace(self, datasets=sets, locations=at)

    def publish_file(self, path: str) -> Mesh:
        return self.publish(self.spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))

    def submit(self, tasks: DataFrame, inputs: DataFrame, rule: Column | None = None, blobs: DataFrame | None = None, modules: dict | None = None) -> DataFrame:
        """Place tasks (task_id, constraint_text, payload) and run their kinds: one row for each task.

        inputs: task_id, data_id (read in the order of data_id). With blobs (data_id, data) tasks see their inputs' bytes, and
        miss those that are not there. modules: user functions by kind.
        """
        sized = tasks.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        placed = placement.cheapest(placement.scores(sized, self.nodes, inputs, self.locations, self.datasets, placement.label_rule() if rule is None else rule, self.weights))
        read = None if blobs is None else inputs.join(blobs.select("data_id", "data"), "data_id", "left").select("task_id", F.struct("data_id").alias("pos"), "data_id", "data")
        done = kinds.run_kinds(tasks, read, modules)
        return done.join(placed.select("task_id", "node_id"), "task_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("node_id").isNull(), "no eligible node")))

    def map(self, kind: str, payloads: Sequence[str], where: str | None = None, with_inputs: Sequence = ()) -> DataFrame:
        """One task of a kind for each payload, results in their order. where: a constraint; with_inputs: data_ids that every task reads.

        Functions of the caller's language are refused.
        """
        if callable(kind):
            raise TypeError("a task kind is a name; functions are not sent to nodes")
        rows = self.spark.createDataFrame([(i, kind, p, where) for i, p in enumerate(payloads)], "task_id long, kind string, payload string, constraint_text string")
        ids = self.spark.createDataFrame([(x,) for x in with_inputs], f"data_id {dict(self.datasets.dtypes)['data_id']}")
        return self.submit(rows, rows.select("task_id").crossJoin(ids)).orderBy("task_id")  # the caller's own few rows

    def workflow(self, steps: Sequence[flow.Step], path: str | None = None, name: str = "run") -> flow.Outcome:
        return flow.run(self.spark, steps, path, name)

    def summary(self) -> DataFrame:
        return catalog.node_summary(self.nodes, self.locations, self.datasets, self.nodes)

    def stats(self) -> DataFrame:
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes"), metrics.mean_or_zero("cpu_usage").alias("cpu"), metrics.mean_or_zero("memory_usage").alias("memory"))

    def recent(self, history: DataFrame, k: int = 20) -> DataFrame:
        return metrics.recent(history, k).withColumn("preview", columns.preview(F.col("output").cast("binary")))
