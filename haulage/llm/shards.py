"""Operator 1, sharding: a k-d tree over document metadata, split at distributed weighted medians.

A node of the tree is split along its widest metadata dimension, at the place where the bytes to the left
come to the share of the leaves on that side, until every leaf holds about the target bytes. All nodes of a
level are split together. A split searches the border of a 63-bit key (31 bits of the dimension, then 32
hashed bits that break ties) by histograms of 4096 bins, each pass zooming into the bin of the border; nodes,
histograms and borders are tables, and a value held by a third of all rows is still divided. The dimensions of
documents are source and lang (by hash: equal values stay together), size and doc_id (age).

Nulls: a null text has no bytes (size 1), a null lang or source is a value of its own, a null doc_id is
is at the low end of its dimension. Repeated rows are placed one by one. Of equally wide dimensions the first is split. An empty table gives an empty result. Columns of the
input beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running

_SIDE = 31
_TIE = 32
_BITS = 12


def _scaled(c: Column, lo, hi) -> Column:
    """c in lo..hi as a whole number of 31 bits."""
    if lo is None or hi is None or hi <= lo:
        return F.lit(0).cast("long")
    x = (c.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return F.coalesce(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * float(2**_SIDE - 1)), F.lit(0)).cast("long")


def kd_shards(
    scratch: Scratch, docs: DataFrame, size: str, dims: Sequence[str], tie: Column,
    n_shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.0005,
) -> DataFrame:
    """docs with ``shard``: the leaf, counted from the left. Give the number of leaves or their target bytes.

    ``dims`` are numeric columns of docs; their ranges are compared after scaling each to its range in all rows.
    A border is searched until its error is below tolerance times a leaf's bytes, or the key is exhausted.
    Nodes, their histograms and borders are tables: the driver sees counts only, whatever the number of leaves.
    """
    ends = docs.agg(F.sum(size).alias("bytes"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = int(ends["bytes"] or 0)
    leaves = n_shards or max(1, -(-total // int(target_bytes)))
    slack = max(1.0, tolerance * total / leaves)
    at = [f"_d{i}" for i in range(len(dims))]
    out = docs.select("*", tie.bitwiseAND(F.lit(2**_TIE - 1)).alias("_tie"), *[_scaled(F.col(d), ends[f"lo{i}"], ends[f"hi{i}"]).alias(c) for i, (d, c) in enumerate(zip(dims, at, strict=True))])
    # a node is named by its first leaf; _leaves are those below it
    out = scratch.keep(out.withColumn("_node", F.lit(0).cast("long")).withColumn("_leaves", F.lit(leaves).cast("long")))
    key = F.shiftleft(F.get(F.array(*at), F.col("dim")), _TIE) + F.col("_tie")
    for _ in range((leaves - 1).bit_length() if total else 0):
        wide = F.array(*[F.max(c) - F.min(c) for c in at])
        split = out.where("_leaves > 1").groupBy("_node", "_leaves").agg(F.sum(size).alias("bytes"), wide.alias("w"))
        left = F.floor(F.col("_leaves") / 2)
        split = split.select(
            "_node", (F.array_position("w", F.array_max("w")) - 1).cast("int").alias("dim"), left.alias("left"), (F.col("bytes") * left / F.col("_leaves")).alias("want"),
            F.lit(0).cast("long").alias("lo"), F.lit(2**63 - 1).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done"),
        )
        split = first = scratch.keep(split)
        keyed = out.join(split.select("_node", "dim"), "_node").select("_node", key.alias("key"), F.col(size).alias("_size"))
        while not split.where("not done").isEmpty():  # each pass sees 12 bits more of the key
            now = split.where("not done").select("_node", "lo", "hi", F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - _BITS).alias("width"))
            inside = keyed.join(now, "_node").where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
            hist = inside.groupBy("_node", F.expr("shiftright(key - lo, cast(width as int))").alias("bin")).agg(F.sum("_size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
            upto = F.sum("bytes").over(Window.partitionBy("_node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most 2**_BITS + 1 bins of a node
            found = hist.withColumn("upto", upto).join(split.select("_node", "want", "below"), "_node").where(F.col("below") + F.col("upto") > F.col("want"))
            found = found.groupBy("_node").agg(F.min(F.struct("bin", "bytes", "first", "last", "upto")).alias("hit"))
            met = split.join(found, "_node", "left")
            none, hit = F.col("hit").isNull(), F.col("hit")
            before = F.col("below") + hit["upto"] - hit["bytes"]
            over = F.col("want") - before > before + hit["bytes"] - F.col("want")  # the border goes to the nearer side of the bin
            sure = (hit["bytes"] <= slack) | (hit["first"] == hit["last"])
            new = met.select(
                "_node", "dim", "left", "want",
                F.when(F.col("done"), F.col("lo")).when(none, F.col("hi") + F.when(F.col("hi") < 2**63 - 1, 1).otherwise(0)).when(sure & over, hit["last"] + 1).otherwise(hit["first"]).alias("lo"),
                F.when(F.col("done") | none, F.col("hi")).otherwise(hit["last"]).alias("hi"),
                F.when(F.col("done") | none, F.col("below")).otherwise(before).alias("below"),
                (F.col("done") | none | sure).alias("done"),
            )
            old, split = split, scratch.keep(new)
            if old is not first:
                scratch.drop(old)
        cut = split.select("_node", "dim", "left", F.col("lo").alias("border"))
        right = key >= F.col("border")
        moved = out.join(cut, "_node", "left")
        node = F.when(right, F.col("_node") + F.col("left")).otherwise(F.col("_node"))
        below = F.when(F.col("left").isNull(), F.col("_leaves")).when(right, F.col("_leaves") - F.col("left")).otherwise(F.col("left"))
        new = scratch.keep(moved.select(*[c for c in out.columns if c not in ("_node", "_leaves")], node.alias("_node"), below.alias("_leaves")))
        scratch.drop(out, *{id(x): x for x in (first, split)}.values())
        out = new
    return out.withColumn("shard", F.col("_node").cast("int")).drop("_node", "_leaves", *at)


def shard_documents(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    The law is ``bytes``: the leaves hold near equal bytes. ``slot`` counts the rows of a shard from 0.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    code = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.xxhash64(c).bitwiseAND(F.lit(2**31 - 1)))
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), code("source").alias("source_code"), code("lang").alias("lang_code"))
    meta = meta.withColumn("id", F.col("doc_id").cast("double"))
    placed = kd_shards(scratch, meta, "size", ["source_code", "lang_code", "size", "id"], F.xxhash64("doc_id", "text_crc32", "size"), None if target_bytes else n_shards, target_bytes)
    ranked = running(scratch, placed, ["shard"], ["_tie", "doc_id", "text_crc32"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
