"""Operator 8, mixing: systematic sampling of each source towards its target weight.

A source's target is its share of all words by weight, but at most ``most`` times its own words; what a
source can't take is shared again by weight among the others until none is above. Within a source every
document expects target / source size copies. The documents are ordered by size (then doc_id, then the
text's CRC), expected copies are added up in that order, one offset drawn for the source is added, and a
document is emitted once for each whole number that its stretch crosses: so copies are the floor or the
ceiling of the expectation, long and short documents are taken alike, and reruns agree.

Nulls: a null text has no words; a null source is one source, the last; null doc_ids come first in ties.
Empty texts have size 0 and may be taken without adding words. Repeated rows are taken one by one. An
empty table gives an empty result. Texts of any length are counted whole. Other columns are carried only where
asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, running


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``target`` and ``expected`` copies.

    Closed form of sharing again and again: sources are capped in the order of cap / weight, and the level
    that the rest share is the first that lies below the next cap (levels fall from there on, so it is the largest
    such level). One row for each source goes through the windows; documents do not.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("rest"))
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"))


def _offset(source: Column, seed: str) -> Column:
    """A number in 0..1 drawn for the source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\u0000"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, keep: Sequence[str] = (), seed: str = "mix", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id and source with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; keep names other columns to carry, results come before columns of their names."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken")]
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in more] or [F.lit(None).alias("_")]).alias("_kept"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("_crc"))
    ranked = running(scratch, rows, ["source"], ["size", "doc_id", "_crc"])
    share = targets(ranked._dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = share.select(F.col("source").alias("_s"), "source_size", "target", "expected")
    out = ranked.join(share, F.col("source").eqNullSafe(F.col("_s")))
    u = _offset(F.col("source"), seed)
    crossed = F.floor(F.col("expected") * (F.col("_rank") + 1) + u) - F.floor(F.col("expected") * F.col("_rank") + u)
    out = out.withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), crossed.cast("long"))))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", *[F.col("_kept")[c].alias(c) for c in more], "size", "source_size", "target", "copies", "taken")
