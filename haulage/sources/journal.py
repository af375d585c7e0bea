"""Files: an append-only journal, generated data, text reports, frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "run string, fingerprint string, step long, task_id string, node_id string, output_id string, duration_ms long"


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of a journal; a torn or foreign line is passed over."""
    raw = spark.read.schema(f"{RECORD}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record IS NULL AND run IS NOT NULL AND step IS NOT NULL").drop("_corrupt_record")


def blocks(spark: SparkSession, n: int) -> DataFrame:
    """n generated bytes by position: (i / 64) mod 251."""
    return spark.range(n).select(F.col("id").alias("i"), F.pmod(F.floor(F.col("id") / 64), F.lit(251)).cast("int").alias("byte"))


#: Fixed values of the generator.
STEP, SHIFT = 6364136223846793005, 1442695040888963407


def seeded(spark: SparkSession, seed: int, size: int) -> DataFrame:
    """size bytes of a linear congruential generator, eight to a row: position of the first, data. Rows are independent: the state at any place has a closed form."""
    mask = 2**64 - 1

    def jump(n: int) -> tuple[int, int]:
        """n steps as one: a x + c."""
        a, c, by, add = 1, 0, STEP, SHIFT
        while n:
            if n & 1:
                a, c = a * by & mask, (c * by + add) & mask
            by, add, n = by * by & mask, (by + 1) * add & mask, n >> 1
        return a, c

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, c = jump(int(pdf["id"].iloc[0]) + 1)
            x = np.uint64((a * (seed * STEP + 1) + c) & mask)
            by = np.full(len(pdf), STEP, np.uint64)
            by[0] = 1
            by = np.multiply.accumulate(by)  # STEP ** k
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(by[:-1], dtype=np.uint64)))
            words = (by * x + sums * np.uint64(SHIFT)).astype("<u8").tobytes()
            at = pdf["id"].to_numpy() * 8
            yield pd.DataFrame({"pos": at, "data": [words[8 * i : 8 * i + min(8, size - p)] for i, p in enumerate(at.tolist())]})

    return spark.range(-(-size // 8)).mapInPandas(run, "pos long, data binary")


def prometheus(metrics: DataFrame) -> DataFrame:
    """(name, help, kind, labels, value) to one text in the exposition format."""
    line = F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"))
    by = metrics.select("name", "help", "kind", line.alias("line")).groupBy("name", "help", "kind").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    return by.select("name", F.concat(head, "lines", F.lit("\n")).alias("text"))


def frame_length(b: Column) -> Column:
    """Payload length that a frame's four leading bytes (big-endian) give."""
    return F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
