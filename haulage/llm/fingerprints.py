"""Operator 7, document fingerprints: randomised edit embedding with sampled positions.

All texts take the same random walk: a walker stands on a character, writes it at every step, and moves to
the next character after a number of steps that a shared table gives for the step and the character. Two
texts that differ by edits walk apart at the edit and soon meet again at the same step, so edit distance
becomes Hamming distance of what was written. A fingerprint samples that writing at shared steps: sample k
takes, of the steps up to the walk's end, the one that comes first in k's own random order, so that texts of
nearly the same length are sampled at the same steps, and keeps 8 bits of what the walker saw there (four
characters). Equal samples out of all, less what chance gives, are the likeness.

Likely pairs come from bands of samples (equal in a whole band), and are verified by the likeness.

Nulls: a null text is an empty one, and so is its fingerprint (all zeros); two empty texts are alike (1).
Rows are ordered by doc_id descending, null last, equal doc_ids by their text's hash, then text; repeated rows
follow each other. A table of one row is followed by itself. An empty table gives an empty result. Texts of any
length are walked whole. Rows without a doc_id lead no band. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, ship

SAMPLES = 128
#: Samples of a band: of texts alike to LEAST, 95 in 100 agree in one of the SAMPLES / BAND bands, of those alike to 0.9 all but one in 10,000.
BAND = 8
LEAST = 0.8
#: Bytes of texts in a stretch of the order, and stretches at most (each is streamed, whatever its size).
STRETCH = 64 << 20
MOST_STRETCHES = 10_000
_PERIOD = 1 << 12
_CLASSES = 256
_RNG = np.random.default_rng(7)
#: How many steps the walker stays, by class of the character and step: geometric, 2 on average, 6 at most.
_STAY = np.minimum(_RNG.geometric(0.5, (_CLASSES, _PERIOD)), 6).astype(np.uint8).ravel()
_RECORDS = 48


def _records() -> np.ndarray:
    """Row k: the steps that are first of all earlier ones in sample k's order. Each is about a uniform part of the next."""
    out = np.zeros((SAMPLES, _RECORDS), np.int64)
    for i in range(1, _RECORDS):
        u = _RNG.random(SAMPLES)
        out[:, i] = np.minimum(np.floor((out[:, i - 1] + 1) / np.maximum(u, 1e-6)), 2**40).astype(np.int64)
        out[:, i] = np.maximum(out[:, i], out[:, i - 1] + 1)
    return out


_RECORD = _records()


def _points(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def _walk(points: list[np.ndarray], begin: list[int], step: list[int]) -> list[np.ndarray]:
    """For each text the steps at which the walker comes to its characters from begin on (at step ``step``), and the walk's end.

    All texts of a group walk together, a character at a time, the longest first, so that those still on
    their way are a prefix of the group.
    """
    order = np.argsort([b - len(p) for p, b in zip(points, begin, strict=True)], kind="stable")
    out: list = [None] * len(points)
    lo = 0
    while lo < len(order):
        longest = len(points[order[lo]]) - begin[order[lo]]
        hi = min(len(order), lo + max(1, 2_000_000 // (longest + 1)))
        group = order[lo:hi]
        n = np.array([len(points[i]) - begin[i] for i in group])
        cls = np.zeros((longest, len(group)), np.int32)
        for k, i in enumerate(group):
            cls[: n[k], k] = (points[i][begin[i] :] * np.uint32(2654435761) >> np.uint32(24)).astype(np.int32) * _PERIOD
        at = np.zeros((longest + 1, len(group)), np.int32)
        at[0] = now = np.array([step[i] for i in group], np.int32)
        alive = np.searchsorted(-n, -np.arange(longest), "left")  # texts longer than t
        mask = np.int32(_PERIOD - 1)
        for t in range(longest):
            a = alive[t]
            now = now[:a]
            now = now + _STAY[cls[t, :a] + (now & mask)]
            at[t + 1, :a] = now
        at = at.T
        for k, i in enumerate(group):
            out[i] = at[k, : n[k] + 1].copy()
        lo = hi
    return out


def _sample(points: np.ndarray, steps: np.ndarray) -> bytes:
    """steps: where the walker comes to each character, and the end."""
    if not len(points):
        return bytes(SAMPLES)
    pick = _RECORD[np.arange(SAMPLES), (_RECORD < steps[-1]).sum(1) - 1]
    i = np.searchsorted(steps[:-1], pick, "right") - 1
    seen = np.zeros(SAMPLES, np.uint64)
    for k in range(4):
        j = i + k
        seen = seen * np.uint64(1_000_003) + np.where(j < len(points), points[np.minimum(j, len(points) - 1)], 0).astype(np.uint64) + np.uint64(1)
    seen = (seen ^ (pick.astype(np.uint64) << np.uint64(20))) * np.uint64(0x9E3779B97F4A7C15)
    return (seen >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprints(texts: list[str | None]) -> list[bytes]:
    points = [_points(t or "") for t in texts]
    walks = _walk(points, [0] * len(points), [0] * len(points))
    return [_sample(p, w) for p, w in zip(points, walks, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, other: str) -> str:
    """The last half replaced by the first as many characters of other (all, if it has fewer)."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def _with_edits(pairs: list[tuple[str, str]]) -> list[tuple]:
    """(n_chars, edited text's digest, fingerprint, the edited text's) of (text, next text): the common first half is walked once."""
    texts = [_points(t) for t, _ in pairs]
    walks = _walk(texts, [0] * len(texts), [0] * len(texts))
    changed = [edited(t, o) for t, o in pairs]
    other = [_points(c) for c in changed]
    keep = [len(t) - len(t) // 2 for t, _ in pairs]
    rest = _walk(other, keep, [int(w[k]) for w, k in zip(walks, keep, strict=True)])
    out = []
    for i, c in enumerate(changed):
        steps = np.concatenate((walks[i][: keep[i]], rest[i]))
        out.append((len(texts[i]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest(), _sample(texts[i], walks[i]), _sample(other[i], steps)))
    return out


def _after(cut: Column, k: Column, h: Column) -> Column:
    """Whether a row of key k and hash h stands at or behind a border, in the order of falling keys, nulls last, and rising hashes."""
    below = k.isNull() & cut["k"].isNotNull() | (k < cut["k"])
    return F.coalesce(below, F.lit(False)) | (k.eqNullSafe(cut["k"]) & (h >= cut["h"]))


def _borders(found: list[int], n_null: int) -> list[tuple[int | None, int]]:
    """(key, hash) borders in order. A key that several quantiles fall on, or null, is cut into as many parts by its hashes."""
    parts = lambda m: [-(2**63) + j * (2**64 // m) for j in range(m)]
    keys = Counter(found)
    out: list[tuple[int | None, int]] = [(k, h) for k in sorted(keys, reverse=True) for h in parts(keys[k])]
    return out + [(None, h) for h in parts(n_null)] if n_null else out


def with_next(docs: DataFrame, key: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """Rows of (_bucket, _own, doc_id, text, _h), each bucket holding a stretch of the order and, with _own false, the row that follows it.

    There are as many stretches as the texts' bytes ask for, MOST_STRETCHES at most; one row for each is known to the
    driver. Their borders come from the keys and, for a key in very many rows, from the texts' hashes. Texts are
    moved once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_key"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = min(MOST_STRETCHES, max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size["bytes"] or 0) // stretch))
    own = max(2, round(n * size["with_key"] / max(size["n"], 1)))
    found = rows.agg(F.percentile_approx("k", [i / own for i in range(1, own)], 20 * own).alias("c")).first()["c"] or []
    nulls = size["n"] - size["with_key"]
    cuts = _borders(list(found), max(1, round(n * nulls / size["n"])) if nulls else 0)
    rows = rows.withColumn("_h", F.xxhash64("text"))
    # two steps of about the root of their number each, not one comparison for each border
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda cs: F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in cs])
    behind = lambda c: _after(c, F.col("k"), F.col("_h"))
    if cuts:
        coarse = F.size(F.filter(literal(cuts[step - 1 :: step]), behind))
        fine = F.get(F.array(*[literal(cuts[i : i + step]) for i in range(0, len(cuts), step)]), coarse)
        place = coarse * step + F.coalesce(F.size(F.filter(fine, behind)), F.lit(0))
    else:
        place = F.lit(0)
    rows = rows.withColumn("b", place)
    rank = F.struct(F.col("k").isNull().alias("last"), F.bitwise_not("k").alias("k"), F.col("_h").alias("h"))
    firsts = rows.groupBy("b").agg(F.min(rank).alias("r")).orderBy("b").collect()
    if not firsts:
        return docs.select(F.lit(0).alias("_bucket"), F.lit(True).alias("_own"), F.col(key).cast("long").alias(key), F.lit("").alias("text"), F.lit(0).cast("long").alias("_h")).limit(0)
    # the first row of each stretch is also sent to the one before it
    to_before = [(None if r["r"]["last"] else ~r["r"]["k"], r["r"]["h"], firsts[i - 1]["b"]) for i, r in enumerate(firsts)]
    body = ", ".join(f"({'CAST(NULL AS BIGINT)' if k is None else f'CAST({k} AS BIGINT)'}, CAST('{h}' AS BIGINT), {b})" for k, h, b in to_before)
    extra = F.broadcast(spark.sql(f"SELECT * FROM VALUES {body} AS t(fk, fh, before)"))  # MOST_STRETCHES rows at most
    rows = rows.join(extra, F.col("k").eqNullSafe(F.col("fk")) & (F.col("_h") == F.col("fh")), "left")
    one = lambda b, own: F.struct(b.alias("_bucket"), F.lit(own).alias("_own"))
    to = F.when(F.col("before").isNull(), F.array(one(F.col("b"), True))).otherwise(F.array(one(F.col("b"), True), one(F.col("before"), False)))
    return rows.select(F.inline(to), F.col("k").alias(key), "text", "_h")


def fingerprint_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_lead, lead_likeness of every row.

    near_lead is what ``near_leads`` finds for the row's fingerprint, null where it finds none.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "fingerprints")
    rows = with_next(docs)
    dealt = rows.repartition("_bucket").sortWithinPartitions("_bucket", F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), "_h", "text")

    def run(batches):
        last = None  # the row still without a next one, and whether its stretch is closed

        def pairs():
            nonlocal last
            for batch in batches:
                for b, own, d, t in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_own", "doc_id", "text")), strict=True):
                    if last is not None and last[0] == b:
                        yield last[1], last[2], t
                    last = (b, d, t) if own else None

        def out(held):
            looked = _with_edits([(t, o) for _, t, o in held])
            then = fingerprints([held[-1][2]])[0]
            cols: list[list] = [[] for _ in range(7)]
            for i, ((d, _, o), (n, sha, own, changed)) in enumerate(zip(held, looked, strict=True)):
                after = looked[i + 1][2] if i + 1 < len(held) and held[i + 1][1] is o else fingerprints([o])[0] if i + 1 < len(held) else then
                for c, v in zip(cols, (d, n, sha, own, changed, likeness(own, changed), likeness(own, after)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held, size = [], 0
        for x in pairs():
            held.append(x)
            size += len(x[1])
            if size > 3_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    # kept as bytes, given as text
    out = scratch.keep(dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"))
    out = out.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in out.dtypes])
    lead = scratch.keep(near_leads(scratch, out.select("doc_id", "fingerprint"), least)).withColumnRenamed("fingerprint", "_f")
    met = out.join(lead, F.col("fingerprint") == F.col("_f"), "left")
    return met.select(*out.columns, "near_lead", "lead_likeness")


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """likeness() of fingerprints in hexadecimal."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(bytes.fromhex("".join(c)), np.uint8).reshape(len(c), -1) for c in (a, b))
    return pd.Series(np.maximum(0.0, ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)))


def _bands(nodes: DataFrame, band: int) -> DataFrame:
    """(doc_id, band): a number for each run of ``band`` samples and what they say."""
    cut = F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", 2 * band * i + 1, 2 * band)) for i in range(SAMPLES // band)])
    return nodes.select("doc_id", F.explode(cut).alias("band"))


def _near(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs that are at least so alike."""
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("fingerprint").alias(f"f{c}"))
    met = scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _alike("fa", "fb").alias("likeness")))
    return met.where(F.col("likeness") >= least)


def near_pairs(marks: DataFrame, least: float = LEAST, band: int = BAND) -> DataFrame:
    """(a, b, likeness) of all rows of (doc_id, fingerprint) that agree in a whole band of samples and are at least so alike.

    Each distinct fingerprint is one node, named by its least doc_id. All pairs: for groups see ``near_groups``.
    """
    scratch = Scratch(marks.sparkSession, "near")
    nodes = scratch.keep(marks.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    bands = _bands(nodes, band)
    pairs = bands.select(F.col("doc_id").alias("a"), "band").join(bands.select(F.col("doc_id").alias("b"), "band"), "band").where("a < b")
    return _near(scratch, pairs.select("a", "b").distinct(), nodes, least)


def near_leads(scratch: Scratch, marks: DataFrame, least: float = LEAST, band: int = BAND) -> DataFrame:
    """(fingerprint, near_lead, lead_likeness): of the least doc_ids of each band of a fingerprint the most alike, if it is so alike at all.

    Every distinct fingerprint is compared with one other for each of its bands at most, so the work grows with their
    number whatever a band holds. Links between two that lead no band are not looked for: see ``near_groups``.
    """
    nodes = scratch.keep(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("own")).withColumn("doc_id", F.xxhash64("fingerprint")))
    bands = scratch.keep(_bands(nodes, band).join(nodes.select("doc_id", "own"), "doc_id"))
    lead = bands.groupBy("band").agg(F.min(F.when(F.col("own").isNotNull(), F.struct("own", "doc_id")))["doc_id"].alias("a"))
    pairs = scratch.keep(bands.join(lead, "band").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))).distinct()
    near = _near(scratch, pairs, nodes, least).join(nodes.select(F.col("doc_id").alias("a"), "own"), "a")
    best = near.groupBy("b").agg(F.max(F.struct("likeness", (-F.col("own")).alias("own"))).alias("m"))
    return nodes.join(best, F.col("doc_id") == F.col("b")).select("fingerprint", (-F.col("m.own")).alias("near_lead"), F.col("m.likeness").alias("lead_likeness"))


def near_groups(scratch: Scratch, marks: DataFrame, least: float = LEAST, band: int = BAND) -> DataFrame:
    """(fingerprint, near_group) of every distinct fingerprint of rows with a doc_id.

    Fingerprints that agree in a band are candidates. First each band's least node is compared with the others, so that
    most of a large group becomes one class; then all pairs of a band that are still of different classes are.
    No link between different classes is lost. A band of many classes that are not near is compared pair by pair.
    """
    nodes = scratch.keep(marks.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    bands = scratch.keep(_bands(nodes, band))
    lead = bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("band", "a")
    met = scratch.keep(bands.join(lead, "band").where("doc_id <> a").select("band", "a", F.col("doc_id").alias("b")))
    first = scratch.keep(components(scratch, _near(scratch, met.select("a", "b").distinct(), nodes, least)))
    # all rows of bands with more than one class, by class
    in_play = met.select("band", F.col("b").alias("doc_id")).unionByName(met.select("band", F.col("a").alias("doc_id")).distinct())
    in_play = scratch.keep(in_play.join(first.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").select("band", "doc_id", F.coalesce("c", "doc_id").alias("cls")))
    mixed = in_play.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("band")
    left = scratch.keep(in_play.join(mixed, "band"))
    side = lambda c: left.select("band", F.col("doc_id").alias(c), F.col("cls").alias(f"c{c}"))
    pairs = scratch.keep(side("a").join(side("b"), "band").where("ca < cb").select("a", "b"))
    more = _near(scratch, pairs.distinct(), nodes, least)
    name = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    over = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = scratch.keep(components(scratch, over)).select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    out = nodes.join(first.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").withColumn("c1", F.coalesce("c", "doc_id"))
    return out.join(second, "c1", "left").select("fingerprint", F.coalesce("c2", "c1").alias("near_group"))
