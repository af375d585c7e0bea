"""How many partitions work needs, so that a task's memory does not grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a stored table, as the planner knows them, that one task takes where each row is multiplied or held in a map.
SHARE = 1 << 19


def parts(df: DataFrame) -> int:
    """Partitions for work that multiplies df's rows: by the planner's size of df, or Spark's own number where that is unknown.

    Given to repartition() they also keep adaptive execution from joining small inputs of tasks whose output is large.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    spark = df.sparkSession
    if size >= 1 << 50:  # rows without a file say nothing
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(-(-size // SHARE), 100_000))
