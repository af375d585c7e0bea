"""What the operators share: written intermediates, distributed ranks and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Where intermediates go when the session names no folder (tests on one machine).
LOCAL_SCRATCH = "/tmp/checkpoints"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where the session names none and runs on this machine alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or f"{LOCAL_SCRATCH}/{os.environ.get('USER', 'haulage')}"


@contextmanager
def shuffle_files_end_with_query(spark: SparkSession):
    """Shuffle files of a finished query are of no more use: let Spark delete them at once."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # a Spark without the setting keeps them until the garbage collection
        yield
        return
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written as Parquet under the shared folder: they cut lineage, outlive executors and are deleted with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return the table read back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        with shuffle_files_end_with_query(self.spark):
            df.write.mode("overwrite").parquet(path)
        if self.n == 1:  # what is still there when the session ends goes with it
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(base)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        gc.collect()  # what no table refers to any more: Spark then deletes its shuffle files, on the executors too
        self.spark._jvm.java.lang.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that no later step reads."""
        jvm, hadoop = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._kept_at)
            path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def carried(df: DataFrame, *but: str) -> Column:
    """All columns of df as one struct, so that no name of theirs meets an operator's own; but those named."""
    left = {c.lower() for c in but}
    names = [c for c in df.columns if c.lower() not in left]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).alias("_"))


def unpacked(df: DataFrame, struct: str, *but: str) -> list[Column]:
    """The columns of a struct that ``carried`` made, but those named."""
    left = {c.lower() for c in (*but, "_")}
    return [F.col(struct)[f.name].alias(f.name) for f in df.schema[struct].dataType.fields if f.name.lower() not in left]


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of a and b."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def running(scratch: Scratch, df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str | None = None) -> DataFrame:
    """Add ``_rank`` (0-based place in the group) and, given a value, ``_before`` (sum of the values of earlier rows).

    Rows are dealt out by range of (group, order), so that a group of any size spreads over as many tasks as
    its share asks for; only one row for each (task, group) meets in the window over offsets. The dealt rows
    are written first: a range exchange samples its input, and its borders must not move between two reads.
    """
    group = list(group)
    dealt = df.repartitionByRange(partitions(df.sparkSession), *group, *order).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt)
    local = Window.partitionBy("_part", *group).orderBy(*order)
    rows = dealt.withColumn("_rank", F.row_number().over(local).cast("long") - 1)
    sums = [F.count(F.lit(1)).alias("_n")]
    if value:
        rows = rows.withColumn("_before", F.coalesce(F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        sums.append(F.sum(value).alias("_v"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("_part", *group).agg(*sums)
    per = per.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v0")] if value else []),
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(per, on).withColumn("_rank", F.col("_rank") + F.col("_n0"))
    if value:
        out = out.withColumn("_before", F.col("_before") + F.col("_v0"))
    out = out.drop("_part", "_p", "_n0", "_v0", *[f"_g{i}" for i in range(len(group))])
    out._dealt = dealt
    return out


def components(scratch: Scratch, links: DataFrame, rounds: int = 64) -> DataFrame:
    """Classes of an undirected graph: (node, component), component the smallest node reachable.

    ``links`` has long columns a and b. Alternates the large-star and the small-star step, which need a
    number of rounds that grows with the logarithm of the longest chain. Each step is an aggregation with
    map-side combine and a join that Spark can split, so a node with very many links is no single task.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges)

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        wide = scratch.keep(step(edges, True))
        narrow = scratch.keep(step(wide, False))
        scratch.drop(edges, wide)
        edges, before, seen = narrow, seen, mark(narrow)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives free memory back when its task ends: workers wait for later tasks with what they hold."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, besides what the cluster ships."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
