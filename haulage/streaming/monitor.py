"""Heartbeats as a stream: windows with watermarks, silence, state for each node. Replays carry their event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cut import folder

HEARTBEAT = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def replay(spark: SparkSession, sf_dir: str, late: str = "10 minutes", delay: str = "INTERVAL 0 SECONDS") -> DataFrame:
    """The events table as a stream of heartbeats with a watermark, each later by a delay (SQL over its columns)."""
    s = spark.readStream.schema(HEARTBEAT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.select("event_id", F.col("user_id").alias("node_id"), (F.col("ts").cast("timestamp") + F.expr(delay)).alias("ts"), "event_type", "value").withWatermark("ts", late)


def tumbling(beats: DataFrame, width: str = "1 hour") -> DataFrame:
    return beats.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(beats: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return beats.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(beats: DataFrame, gap: str) -> DataFrame:
    """Stretches without a silence of ``gap``: where one ends the node was stale."""
    return beats.groupBy(F.session_window("ts", gap).alias("w"), "node_id").agg(F.count(F.lit(1)).alias("n")).select("node_id", F.col("w.start").alias("start"), "n")


def node_state(beats: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Running state of each node: beats seen and smoothed value. Custom state, one small tuple a node."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, smooth = state.get if state.exists else (0, None)
        for pdf in batches:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                n, smooth = n + 1, v if smooth is None else smooth * (1 - alpha) + v * alpha
        state.update((n, smooth))
        yield pd.DataFrame({"node_id": [key[0]], "n": [n], "smooth": [smooth]})

    return beats.groupBy("node_id").applyInPandasWithState(step, "node_id long, n long, smooth double", "n long, smooth double", "update", GroupStateTimeout.NoTimeout)


def known_only(beats: DataFrame, nodes: DataFrame) -> DataFrame:
    """Late or unknown senders are dropped: a static side decides."""
    return beats.join(nodes.select("node_id"), "node_id", "left_semi")


def reply_times(requests: DataFrame, replies: DataFrame, within: str) -> DataFrame:
    """Requests met with replies of the same key within a time; both sides carry watermarks, so state is bounded."""
    q = requests.select(F.col("key").alias("qk"), F.col("ts").alias("asked"))
    return q.join(replies.select("key", "ts"), F.expr(f"key = qk AND ts >= asked AND ts <= asked + INTERVAL {within}")).select("key", "asked", F.col("ts").alias("replied"))


def expired(requests: DataFrame, replies: DataFrame, within: str) -> DataFrame:
    """Requests without a reply of the same key within a time."""
    q = requests.select(F.col("key").alias("qk"), F.col("ts").alias("asked"))
    return q.join(replies.select("key", "ts"), F.expr(f"key = qk AND ts >= asked AND ts <= asked + INTERVAL {within}"), "left_anti").select(F.col("qk").alias("key"), "asked")


def screen(replies: DataFrame, pending: DataFrame) -> DataFrame:
    """Verdict on replies (seq, sender, claimed, task_id) of senders' connections, in order of seq.

    A sender is taken at its word until it claims another's node: that reply is an impostor's and closes the
    connection, so all later ones are lost. A task's first good reply is accepted if the task is pending; later
    ones find it gone.
    """
    lies = replies.where("claimed <> sender").groupBy("sender").agg(F.min("seq").alias("lie"))
    heard = replies.join(lies, "sender", "left").withColumn("heard", F.coalesce(F.col("seq") < F.col("lie"), F.col("sender").isNotNull()))
    first = heard.where("heard").groupBy("task_id").agg(F.min("seq").alias("first")).join(pending.select("task_id").distinct(), "task_id", "left_semi")
    verdict = (
        F.when(F.col("sender").isNull(), "unregistered").when(F.col("seq") == F.col("lie"), "impostor").when(~F.col("heard"), "closed").when(F.col("seq") == F.col("first"), "accepted").otherwise("unknown or expired task")
    )
    return heard.join(first, "task_id", "left").select("seq", "sender", "claimed", "task_id", verdict.alias("verdict"))


def trigger(seconds: int) -> dict | None:
    """What writeStream.trigger takes for a timer; None where it is off."""
    return {"processingTime": f"{seconds} seconds"} if seconds > 0 else None


def ticks(timers: DataFrame, until: int) -> DataFrame:
    """When timers (name, seconds) fire in the seconds 0 to until, the first time at once; 0 seconds is off."""
    return timers.where("seconds > 0").select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(until).cast("long"), F.col("seconds").cast("long"))).alias("at"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its table (for replays and tests), which lies in files: of a complete
    result the last state, else the rows of all batches."""
    spark, root, shape, last = stream.sparkSession, folder(stream.sparkSession, "drained"), stream.schema, []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={n}")  # a batch that is repeated replaces itself
        last.append(f"{root}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = sorted(set(last)) if mode != "complete" else last[-1:]
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
