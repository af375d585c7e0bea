"""Operator 9, quality rules: counted base features, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: one of all documents (raw corpus), one of trusted ones (target).
A document's verdict is the mean of log p_target - log p_raw over its n-grams, against a threshold that is
set once from labelled rows. The counts cover every document and every trusted one, the threshold every labelled
row: nothing is a sample.

Nulls: a null text has no words and fails the base rules. Empty texts likewise. Repeated rows get equal
verdicts; a ratio equal to the threshold is kept. With no trusted row the ratio is 0 for all and the threshold
lets all pass. An empty table gives an empty result. Texts of any length are read whole. Extra columns are
carried, but for those named like a result, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, running, shuffle_files_end_with_query, ship, unpacked
from .words import Block, blocks

SLOT_BITS = 18
GRAM = 4
#: Of the trusted rows at least this share must pass the threshold.
TRUSTED_PASS = 0.997
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def _grams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of each n-gram of bytes within a text."""
    d = b.data.astype(np.uint64)
    h = np.zeros(max(0, len(d) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(257) + d[i : i + len(h)]
    doc = np.repeat(np.arange(b.n), np.diff(b.at))
    ok = doc[: len(h)] == doc[GRAM - 1 :] if len(h) else np.zeros(0, bool)
    if len(h):  # the byte that ends a text belongs to none
        ok &= ~np.isin(np.arange(len(h)) + GRAM - 1, b.at[1:] - 1)
    slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return slot[ok], doc[: len(h)][ok]


def count_grams(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for _, b in blocks(texts):
        out += np.bincount(_grams(b)[0], minlength=len(out))
    return out


def ratios(texts: list[str | None], ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 without any."""
    out = np.zeros(len(texts))
    for at, b in blocks(texts):
        slot, doc = _grams(b)
        out[at : at + b.n] = np.bincount(doc, ratio[slot], b.n) / np.maximum(np.bincount(doc, minlength=b.n), 1)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    return np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def base_features(texts: list[str | None]) -> pd.DataFrame:
    cols = {c: np.zeros(len(texts), np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for at, b in blocks(texts):
        to = slice(at, at + b.n)
        cols["n_words"][to] = np.diff(b.first)
        lead = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))  # bytes that begin a character
        cols["word_chars"][to] = np.bincount(b.doc, lead[b.end] - lead[b.start], b.n)
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[b.data])))
        cols["n_symbols"][to] = symbols[b.at[1:]] - symbols[b.at[:-1]]
        h, first = b.windows(5)
        if len(h):
            doc = b.doc[first]
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(len(b.word) + 1, np.int64)
            np.add.at(step, first[twice], 1)
            np.add.at(step, first[twice] + 5, -1)
            cols["n_repeat_words"][to] = np.bincount(b.doc, np.cumsum(step)[:-1] > 0, b.n)
    for i, t in enumerate(texts):
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            cols["n_dup_lines"][i] = len(lines) - len(set(lines))
    return pd.DataFrame(cols)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs with a label. Both sides are shuffled, whatever their size, so that no worker has to hold all labels."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id")


def _counts(rows: DataFrame) -> np.ndarray:
    """The n-grams of all texts by slot."""

    def count(batches):
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            n += count_grams(batch.column("text").to_pylist())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most 2**SLOT_BITS rows
        out[r["slot"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, trusted_pass: float = TRUSTED_PASS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (1: trusted). One pass counts all rows, one the trusted ones, one scores the labelled ones."""
    spark = docs.sparkSession
    ship(spark)
    rows = _labelled(docs, labels)
    with shuffle_files_end_with_query(spark):
        model = Model(log_ratio(_counts(rows.where("quality = 1")), _counts(docs)).astype(np.float32), -np.inf)
    scored = rows.where("quality in (0, 1) and text is not null").select("quality", _ratio(docs, model, F.col("text")).alias("r"))
    model.threshold = pick(Scratch(spark, "quality"), scored, trusted_pass)
    return model


def pick(scratch: Scratch, rows: DataFrame, trusted_pass: float) -> float:
    """The border that tells good from bad rows best (share right of either), among those that let trusted_pass of the good through.

    rows: quality 0 or 1, r. Equal ratios are one row, and all of them are ranked in tables; of equal borders the lowest is taken.
    """
    by = scratch.keep(rows.groupBy("r").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).withColumn("all", F.lit(0)))
    n = by.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n["good"] or not n["bad"]:
        scratch.drop(by)
        return -np.inf
    goods = running(scratch, by, ["all"], ["r"], "good")
    both = running(scratch, goods.select("all", "r", "bad", F.col("_before").alias("lost")), ["all"], ["r"], "bad")
    kept = 1 - F.col("lost") / n["good"]
    right = kept + F.col("_before") / n["bad"]
    best = -both.where(kept >= trusted_pass).agg(F.max(F.struct(right.alias("right"), (-F.col("r")).alias("r"))).alias("m")).first()["m"]["r"]
    under = by.where(F.col("r") < best).agg(F.max("r").alias("r")).first()["r"]
    scratch.drop(by, goods._dealt, both._dealt)
    if under is None:
        return best - 1.0
    cut = (under + best) / 2
    return cut if cut > under else best


def _ratio(docs: DataFrame, model: Model, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model.ratio)  # 1 MB, whatever the input

    @F.pandas_udf("double")
    def ratio(text: pd.Series) -> pd.Series:
        return pd.Series(ratios(text.tolist(), held.value))

    return ratio(text)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio")


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the base features, ratio, base_failed and kept, which replace columns of docs that have these names."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.ratio)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")
    def look(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        return base_features(texts).assign(ratio=ratios(texts, held.value))

    rows = docs.select(carried(docs).alias("row"), look(docs["text"]).alias("q"))
    failed = (F.col("q.n_words") < 10) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * 20)
    kept = ~failed & (F.col("q.ratio") >= F.lit(float(model.threshold)))
    return rows.select(*unpacked(rows, "row", *FEATURES, "base_failed", "kept"), *[F.col("q")[c].alias(c) for c in FEATURES], failed.alias("base_failed"), kept.alias("kept"))
