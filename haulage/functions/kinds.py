"""Named task kinds as functions of a payload, and codecs and user modules as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ascii_upper, content_id

#: A task of the kind cpu may ask for at most so many steps.
MOST_STEPS = 50_000_000
#: Compressed data are kept only where they save at least this share.
LEAST_SAVING = 0.05


def run_kinds(tasks: DataFrame, inputs: DataFrame | None = None, modules: dict[str, Callable[[bytes, list[bytes]], bytes]] | None = None) -> DataFrame:
    """tasks with ``output`` and ``error``, by kind; a fault is a failed row, never an exception.

    echo: the payload. hash: the digest of the payload and then of all inputs in order; fails where one is missing. cpu: the
    LCG fold of as many steps as the payload says. upper: ASCII upper case. A module of the caller's by its name. Any other
    kind is unknown. inputs: task_id, pos, data_id, data (NULL: not there).
    """
    p, none = F.col("payload").cast("binary"), F.array().cast("array<binary>")
    rows = tasks.withColumn("_inputs", none).withColumn("_lost", F.lit(None).cast("string"))
    if inputs is not None:
        given = inputs.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "data"))), lambda x: x["data"]).alias("_inputs"), F.min(F.when(F.col("data").isNull(), F.struct("pos", F.col("data_id").cast("string").alias("id"))))["id"].alias("_lost"))
        rows = tasks.join(given, "task_id", "left").withColumn("_inputs", F.coalesce("_inputs", none))
    ok = lambda out: F.struct(out.cast("binary").alias("output"), F.lit(None).cast("string").alias("error"))
    bad = lambda why: F.struct(F.lit(None).cast("binary").alias("output"), why.alias("error"))
    mine = lambda k, c: F.when(F.col("kind") == k, c)  # noqa: E731  # what Python sees of other kinds is NULL
    whole = F.aggregate("_inputs", p, lambda a, x: F.concat(a, x))
    known = {
        "echo": ok(p),
        "hash": F.when(F.col("_lost").isNotNull(), bad(F.concat(F.lit("missing input: "), "_lost"))).otherwise(ok(content_id(whole))),
        "cpu": cpu_task(mine("cpu", p)),
        "upper": ok(ascii_upper(F.col("payload").cast("string"))),
    } | {k: module(f)(mine(k, p), mine(k, F.col("_inputs"))) for k, f in (modules or {}).items()}
    out = bad(F.concat(F.lit("unknown task kind: "), "kind"))
    for k, v in known.items():
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return rows.withColumn("_done", out).withColumn("output", F.col("_done.output")).withColumn("error", F.col("_done.error")).drop("_done", "_inputs", "_lost")


def _lcg(n: int) -> int:
    """The fold in closed form by doubling: (multiplier, addend) of n steps, i starting at 0."""
    mask = (1 << 64) - 1
    a = 6364136223846793005
    # state (acc, i): acc' = a acc + i, i' = i + 1, as a 3x3 matrix over (acc, i, 1)
    m, r = ((a, 1, 0), (0, 1, 1), (0, 0, 1)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    mul = lambda x, y: tuple(tuple(sum(x[i][k] * y[k][j] for k in range(3)) & mask for j in range(3)) for i in range(3))
    while n:
        if n & 1:
            r = mul(m, r)
        m, n = mul(m, m), n >> 1
    return r[0][2]


@F.pandas_udf(T.StringType())
def cpu(payload: pd.Series) -> pd.Series:
    """The LCG fold of an 8-byte little-endian count, as text; NULL for another length or too many steps."""

    def one(b):
        if b is None or len(b) != 8 or (n := int.from_bytes(b, "little")) > MOST_STEPS:
            return None
        return str(_lcg(n))

    return payload.map(one)


@F.pandas_udf(T.StructType([T.StructField("output", T.BinaryType()), T.StructField("error", T.StringType())]))
def cpu_task(payload: pd.Series) -> pd.DataFrame:
    """The fold's 8 bytes, little-endian, or why it was refused."""

    def one(b):
        if b is None:
            return None, None
        if len(b) != 8:
            return None, f"a count of steps has 8 bytes, not {len(b)}"
        n = int.from_bytes(b, "little")
        return (None, f"{n} steps are over the limit of {MOST_STEPS}") if n > MOST_STEPS else (_lcg(n).to_bytes(8, "little"), None)

    return pd.DataFrame([one(b) for b in payload], columns=["output", "error"], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("codec", T.StringType()), T.StructField("size", T.LongType())]))
def compressed(data: pd.Series) -> pd.DataFrame:
    """Codec and size after compression, kept only where it saves enough."""
    raw = data.map(lambda b: len(b or b""))
    small = data.map(lambda b: len(zlib.compress(b or b"", 1)))
    keep = small <= raw * (1 - LEAST_SAVING)
    return pd.DataFrame({"codec": np.where(keep, "deflate", "none"), "size": np.where(keep, small, raw)})


def compress(codec: Column, data: Column) -> Column:
    """Data in its codec: none as it is, lz4 as one block after its length (four bytes, little-endian)."""
    return _packed(codec, data)


def decompress(codec: Column, data: Column) -> Column:
    """(data, error): what compress was given, or why it can't be had back."""
    return _unpacked(codec, data)


@F.pandas_udf(T.BinaryType())
def _packed(codec: pd.Series, data: pd.Series) -> pd.Series:
    lz4 = pa.Codec("lz4_raw")
    return pd.Series([None if b is None else len(b).to_bytes(4, "little") + lz4.compress(b, asbytes=True) if c == "lz4" else b for c, b in zip(codec, data, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]))
def _unpacked(codec: pd.Series, data: pd.Series) -> pd.DataFrame:
    lz4 = pa.Codec("lz4_raw")

    def one(c, b):
        if b is None or c == "none":
            return b, None
        if c != "lz4":
            return None, f"unknown codec: {c}"
        try:
            n = int.from_bytes(b[:4], "little")
            if len(b) < 5 or n > 255 * len(b):  # no block says more than 255 bytes a byte
                return None, f"not a block of {n} bytes"
            got = lz4.decompress(b[4:], n, asbytes=True)
            return (got, None) if len(got) == n else (None, f"not a block of {n} bytes")
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(c, b) for c, b in zip(codec, data, strict=True)], columns=["data", "error"], dtype=object)


def read_input(inputs: Column, index: Column, length: Column, memory: Column, ptr: Column) -> Column:
    """What a module reads into its memory: (n, data); n is cut to the input's length and -1 if anything is out of bounds."""
    data = F.when(index >= 0, F.get(inputs, index))
    n = F.least(length, F.octet_length(data)).cast("long")
    fits = F.coalesce((length >= 0) & (ptr >= 0) & (ptr + n <= memory), F.lit(False)) & data.isNotNull()
    return F.struct(F.when(fits, n).otherwise(F.lit(-1).cast("long")).alias("n"), F.when(fits, F.substring(data, F.lit(1), n.cast("int"))).alias("data"))


def check_output(packed: Column, memory: Column, most: int = 64 << 20) -> Column:
    """A module's answer ptr << 32 | len as (ptr, len, error)."""
    ptr, n = F.shiftrightunsigned(packed, 32), packed.bitwiseAND(F.lit(0xFFFFFFFF))
    error = F.when(n > most, F.concat(F.lit("output of "), n.cast("string"), F.lit(f" bytes, at most {most}"))).when(ptr + n > memory, F.concat(F.lit("output outside memory: "), n.cast("string"), F.lit(" bytes at "), ptr.cast("string")))
    return F.struct(ptr.alias("ptr"), n.alias("len"), error.alias("error"))


def module(run: Callable[[bytes, list[bytes]], bytes], most_output: int = 64 << 20) -> Callable[[Column, Column], Column]:
    """A user module as a function of (payload, inputs): output, or an error, for each row; errors never end the query."""

    @F.pandas_udf("output binary, error string")
    def call(payload: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        out, err = [], []
        for p, xs in zip(payload, inputs, strict=True):
            try:
                got = bytes(run(bytes(p or b""), [bytes(x) for x in (xs if xs is not None else [])]))
                if len(got) > most_output:
                    raise ValueError(f"output of {len(got)} bytes, at most {most_output}")
                out.append(got)
                err.append(None)
            except Exception as e:
                out.append(None)
                err.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"output": out, "error": err})

    return call


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
