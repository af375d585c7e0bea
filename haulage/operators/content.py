"""Content addressing, chunks and what has to be moved where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_id

CHUNK = 1 << 20


def address(blobs: DataFrame, data: str = "data") -> DataFrame:
    """Adds data_id and size_bytes."""
    return blobs.withColumn("data_id", content_id(F.col(data))).withColumn("size_bytes", F.octet_length(data).cast("long"))


def publish(addressed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each distinct content, with its number of chunks: 0 (no manifest) up to one chunk's size."""
    one = addressed.groupBy("data_id").agg(F.first("size_bytes").alias("size_bytes"))
    return one.withColumn("n_chunks", F.when(F.col("size_bytes") > chunk, F.ceil(F.col("size_bytes") / chunk)).otherwise(0).cast("long"))


def verified(offered: DataFrame, held: DataFrame) -> DataFrame:
    """offered (data_id, data) with ``outcome``: mismatch, present or new."""
    out = offered.join(held.select(F.col("data_id"), F.lit(True).alias("_held")).distinct(), "data_id", "left")
    return out.withColumn("outcome", F.when(content_id(F.col("data")) != F.col("data_id"), "mismatch").when(F.col("_held"), "present").otherwise("new")).drop("_held")


def split(blobs: DataFrame, chunk: int = CHUNK, data: str = "data") -> DataFrame:
    """Rows of chunks: index, chunk (bytes), chunk_id, chunk_size. No row for empty data; chunk 0 means the default size."""
    k = chunk or CHUNK
    n = F.ceil(F.octet_length(data) / k)
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(F.col(data), (i * k + 1).cast("int"), F.lit(k))))
    out = blobs.select("*", F.posexplode(cut).alias("index", "chunk"))
    return out.withColumn("chunk_id", content_id(F.col("chunk"))).withColumn("chunk_size", F.octet_length("chunk").cast("long"))


def chunk_range(index: Column, size: Column, chunk: int) -> Column:
    """start, end of a chunk; NULL out of range."""
    lo = index * chunk
    return F.when((index >= 0) & (lo < size), F.struct(lo.alias("start"), F.least(lo + chunk, size).alias("end")))


def reassemble(manifest: DataFrame, received: DataFrame) -> DataFrame:
    """data_id with rebuilt bytes and a status: ok, missing, bad_chunk or bad_data. Chunks may come in any order and twice."""
    got = received.select("data_id", "index", "chunk").dropDuplicates(["data_id", "index"])
    all_ = manifest.select("data_id", "index", "chunk_id").distinct().join(got, ["data_id", "index"], "left")
    out = all_.groupBy("data_id").agg(
        F.sort_array(F.collect_list(F.struct("index", "chunk"))).alias("c"),
        F.bool_and(F.col("chunk").isNotNull()).alias("all"),
        F.bool_and(F.coalesce(content_id(F.col("chunk")) == F.col("chunk_id"), F.lit(True))).alias("sound"),
    )
    out = out.withColumn("data", F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, F.coalesce(x["chunk"], F.lit(b"").cast("binary")))))
    status = F.when(~F.col("all"), "missing").when(~F.col("sound"), "bad_chunk").when(content_id(F.col("data")) != F.col("data_id"), "bad_data").otherwise("ok")
    return out.select("data_id", "data", status.alias("status"))


def missing(manifest: DataFrame, received: DataFrame) -> DataFrame:
    return manifest.join(received.select("data_id", "index").distinct(), ["data_id", "index"], "left_anti")


def satisfied_from_store(manifest: DataFrame, held: DataFrame) -> DataFrame:
    """Manifest rows whose chunk is held anywhere already."""
    return manifest.join(held.select("chunk_id").distinct(), "chunk_id", "left_semi")


def hash_task(tasks: DataFrame, inputs: DataFrame) -> DataFrame:
    """task_id, digest of the payload and then the inputs' bytes in order; a task with a missing input has NULL."""
    parts = inputs.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("p"), F.bool_and(F.col("data").isNotNull()).alias("all"))
    out = tasks.join(parts, "task_id", "left")
    body = F.aggregate(F.coalesce("p", F.array().cast("array<struct<pos:int,data:binary>>")), F.col("payload").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return out.select("task_id", F.when(F.coalesce("all", F.lit(True)), content_id(body)).alias("digest"))


# -- what to move ---------------------------------------------------------------------------------------------


def needed(placed: DataFrame, task_inputs: DataFrame) -> DataFrame:
    """(node_id, data_id, requests): each dataset moves to a node once, however many tasks ask for it."""
    return placed.join(task_inputs, "task_id").groupBy("node_id", "data_id").agg(F.count(F.lit(1)).alias("requests"))


def transfers(placed: DataFrame, task_inputs: DataFrame, locations: DataFrame, datasets: DataFrame) -> DataFrame:
    """needed, with size and whether the node holds it already (skipped)."""
    held = locations.select("node_id", "data_id", F.lit(True).alias("skipped")).distinct()
    return needed(placed, task_inputs).join(datasets, "data_id").join(held, ["node_id", "data_id"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def chunk_transfers(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted (node_id, chunk_id, seq, ...): the first of each chunk for a node, unless the node holds it."""
    w = Window.partitionBy("node_id", "chunk_id").orderBy("seq")
    first = wanted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(held.select("node_id", "chunk_id").distinct(), ["node_id", "chunk_id"], "left_anti")


def channels(sent: DataFrame, n: int, order: str) -> DataFrame:
    """Round robin over a node's n channels."""
    return sent.withColumn("channel", F.pmod(F.row_number().over(Window.partitionBy("node_id").orderBy(order)) - 1, F.lit(n)).cast("int"))


def traffic(moved: DataFrame) -> DataFrame:
    """Totals of moved (raw_bytes, sent_bytes, skipped): saved is never negative, a ratio of nothing is 0."""
    t = moved.agg(*[F.coalesce(F.sum(F.when(~F.col("skipped"), F.col(c))), F.lit(0)).alias(c) for c in ("raw_bytes", "sent_bytes")], F.count_if("skipped").alias("skipped"))
    return t.withColumn("saved_bytes", F.greatest(F.col("raw_bytes") - F.col("sent_bytes"), F.lit(0))).withColumn("ratio", F.when(F.col("raw_bytes") > 0, F.col("sent_bytes") / F.col("raw_bytes")).otherwise(0.0))
