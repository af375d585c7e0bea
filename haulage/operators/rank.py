"""Places in one order over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal parts that a column's range is cut into, where a lead is needed.
STRETCHES = 1024


def stretch(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the number of the column's stretch: values in order have stretches in order."""
    ends = df.agg(F.min(F.col(column).cast("double")).alias("_lo"), F.max(F.col(column).cast("double")).alias("_hi"))
    at = F.floor((F.col(column).cast("double") - F.col("_lo")) / F.greatest((F.col("_hi") - F.col("_lo")) / STRETCHES, F.lit(1.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, at).drop("_lo", "_hi")  # one row


def numbered(df: DataFrame, lead: Column, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's place from 1 in the order of lead and then order.

    lead has few values, such as days, levels or stretches, and is counted first; only rows of one lead are sorted together.
    """
    d = df.withColumn("_lead", lead)
    counts = d.groupBy("_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.broadcast(counts.select(F.col("_lead").alias("_l"), before.alias("_ahead")))
    own = d.withColumn("_own", F.row_number().over(Window.partitionBy("_lead").orderBy(*order)))
    return own.join(ahead, F.col("_lead").eqNullSafe(F.col("_l"))).select(*df.columns, (F.col("_own") + F.col("_ahead")).cast("long").alias(name))
