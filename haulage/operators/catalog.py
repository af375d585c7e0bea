"""Which node holds which data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import parts


def record(locations: DataFrame, more: DataFrame) -> DataFrame:
    """Union of location sets."""
    return locations.select("data_id", "node_id").unionByName(more.select("data_id", "node_id")).distinct()


def remove(locations: DataFrame, gone: DataFrame) -> DataFrame:
    return locations.join(gone.select("data_id", "node_id").distinct(), ["data_id", "node_id"], "left_anti")


def forget(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    return locations.join(nodes.select("node_id").distinct(), "node_id", "left_anti")


def known(datasets: DataFrame, locations: DataFrame) -> DataFrame:
    """Datasets that some node holds; the last location takes its dataset with it."""
    return datasets.join(locations.select("data_id").distinct(), "data_id", "left_semi")


def locations_of(datasets: DataFrame, locations: DataFrame) -> DataFrame:
    """(data_id, nodes, first_node): how many nodes hold each dataset, and the least of them; 0 and NULL where none does."""
    held = locations.groupBy("data_id").agg(F.count("node_id").alias("nodes"), F.min("node_id").alias("first_node"))
    return datasets.select("data_id").join(held, "data_id", "left").select("data_id", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), "first_node")


def inputs_at(task_inputs: DataFrame, locations: DataFrame, datasets: DataFrame) -> DataFrame:
    """(task_id, size_bytes, nodes): each known input with all nodes that hold it, one row however many they are; dealt out by task_id."""
    where = locations.groupBy("data_id").agg(F.collect_list("node_id").alias("nodes"))
    return task_inputs.join(datasets.join(where, "data_id"), "data_id").select("task_id", "size_bytes", "nodes").repartition(parts(task_inputs), "task_id")


def local_bytes(task_inputs: DataFrame, locations: DataFrame, datasets: DataFrame) -> DataFrame:
    """(task_id, node_id, local_bytes): a repeated input counts each time, an unknown one not at all. Pairs are made after the last shuffle."""
    each = inputs_at(task_inputs, locations, datasets).select("task_id", "size_bytes", F.explode("nodes").alias("node_id"))
    return each.groupBy("task_id", "node_id").agg(F.sum("size_bytes").alias("local_bytes"))


def total_bytes(task_inputs: DataFrame, locations: DataFrame, datasets: DataFrame) -> DataFrame:
    return task_inputs.join(known(datasets, locations), "data_id").groupBy("task_id").agg(F.sum("size_bytes").alias("total_bytes"))


def held_by(nodes: DataFrame, locations: DataFrame, datasets: DataFrame) -> DataFrame:
    """(node_id, held, held_bytes), zeros where nothing is held."""
    h = locations.join(datasets, "data_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("held"), F.sum("size_bytes").alias("held_bytes"))
    return nodes.select("node_id").join(h, "node_id", "left").select("node_id", F.coalesce("held", F.lit(0)).cast("long").alias("held"), F.coalesce("held_bytes", F.lit(0)).cast("long").alias("held_bytes"))


def unknown_inputs(task_inputs: DataFrame, locations: DataFrame) -> DataFrame:
    """Inputs that nobody holds: their tasks are refused before dispatch."""
    return task_inputs.join(locations.select("data_id").distinct(), "data_id", "left_anti")


def mesh_check(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the first thing wrong with the nodes that were expected (hostname, label), or NULL.

    In order: nothing expected, another number of nodes, a host missing, a label missing.
    """
    counts = expected.agg(F.count(F.lit(1)).alias("want")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("have")))
    met = expected.join(nodes.select("hostname", F.lit(True).alias("there"), F.col("label").alias("has")), "hostname", "left")
    bad = met.agg(F.min(F.when(F.col("there").isNull(), F.col("hostname"))).alias("host"), F.min(F.when(F.col("there") & F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("has")), F.col("hostname"))).alias("unlabelled"))
    error = F.when(F.col("want") == 0, "no nodes are expected").when(F.col("want") != F.col("have"), F.concat(F.lit("expected "), "want", F.lit(", found "), "have")).when(F.col("host").isNotNull(), F.concat(F.lit("missing host "), "host")).when(F.col("unlabelled").isNotNull(), F.concat(F.lit("missing label on "), "unlabelled"))
    return counts.crossJoin(bad).select(error.alias("error"))


def node_summary(nodes: DataFrame, locations: DataFrame, datasets: DataFrame, connected: DataFrame) -> DataFrame:
    h = held_by(nodes, locations, datasets)
    c = connected.select("node_id", F.lit(True).alias("connected")).distinct()
    return nodes.join(h, "node_id").join(c, "node_id", "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


def identify(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests (token) with ``who`` and ``verdict``: of several matches the last (highest no) wins."""
    t = tokens.groupBy("token").agg(F.max_by("who", "no").alias("who"))
    out = requests.join(t, "token", "left")
    return out.withColumn("verdict", F.when(F.col("token").isNull(), "missing").when(F.col("who").isNull(), "invalid").otherwise("ok"))
