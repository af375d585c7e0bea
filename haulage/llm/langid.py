"""Operator 5, language identification: hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first letter's
vector permuted twice, the second's once, the third's as it is, multiplied elementwise. A text bundles
(adds) the vectors of all its trigrams; a language's prototype bundles the normalised vectors of its
training texts. A text gets the language whose prototype has the highest cosine with it.

Letters are case-folded; everything else separates words, and words are padded by one separator. Texts that
are null, empty or without letters are ``und`` with score 0, and are never trained on; so are rows with a
null lang or doc_id. Equal cosines go to the first language by name. Without any training row all is
``und``. Repeated rows get equal results, an empty table an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

DIM = 1024
#: Prototypes are fitted on about so many rows at most, chosen by hash of their doc_id.
SAMPLE_ROWS = 40_000
#: Sharpness of the score, a softmax over cosines.
SHARP = 20.0
UNKNOWN = "und"
_RNG = np.random.default_rng(5)
_SYMBOLS = 4096
_LETTER = (_RNG.integers(0, 2, (_SYMBOLS, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)
#: Texts bundled at once, by characters.
_CHUNK = 400_000
_KIND = np.zeros(0x110000, np.uint16)


def _kinds() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, else 1.. by case-folded letter (beyond the table: hashed)."""
    if not _KIND[97]:
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()[0]
                _KIND[c] = ord(low) if 0 < ord(low) < 1024 else 1024 + (ord(low) * 2654435761) % (_SYMBOLS - 1024)
    return _KIND


def _bundles(texts: list[str]) -> np.ndarray:
    """The bundle of each text, exact, as float32. Trigrams are counted by text, then bound vectors are added count times."""
    raw = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _kinds()[raw].astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.zeros(len(sym), np.int32)
    doc[np.minimum(ends, len(sym) - 1)] = 1
    doc = np.minimum(np.cumsum(doc), len(texts) - 1)
    keep = (sym > 0) | np.append(sym[1:] > 0, False) | np.append(False, sym[:-1] > 0)  # a separator beside a letter
    sym, doc = sym[keep], doc[keep]
    if len(sym) < 3:
        return np.zeros((len(texts), DIM), np.float32)
    code = (sym[:-2] * _SYMBOLS + sym[1:-1]) * _SYMBOLS + sym[2:]
    ok = (sym[1:-1] > 0) | ((sym[:-2] > 0) & (sym[2:] > 0) & False)
    owner = doc[1:-1][ok]
    known, at = np.unique(code[ok], return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    if not len(known):
        return out
    pair, n = np.unique(owner.astype(np.int64) * len(known) + at, return_counts=True)
    rows, cols = pair // len(known), pair % len(known)
    a, b, c = known // _SYMBOLS**2, known // _SYMBOLS % _SYMBOLS, known % _SYMBOLS
    step = 2048  # trigrams bound at once
    for lo in range(0, len(known), step):
        hi = min(lo + step, len(known))
        bound = (np.roll(_LETTER[a[lo:hi]], 2, 1) * np.roll(_LETTER[b[lo:hi]], 1, 1) * _LETTER[c[lo:hi]]).astype(np.float32)
        mine = (cols >= lo) & (cols < hi)
        counts = np.zeros((len(texts), hi - lo), np.float32)
        counts[rows[mine], cols[mine] - lo] = n[mine]
        out += counts @ bound
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
        if held and (size >= _CHUNK or i == len(texts) - 1):
            out[held] = _bundles([texts[j] for j in held])
            held, size = [], 0
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray


def predict(texts: list[str | None], p: Profiles) -> pd.DataFrame:
    v = bundles(texts)
    some = np.abs(v).sum(1) > 0
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if p.langs and some.any():
        cos = _unit(v[some]) @ p.prototypes.T
        best = np.argmax(cos, 1)
        e = np.exp(SHARP * (cos - cos.max(1, keepdims=True)))
        lang[some] = np.array(p.langs, object)[best]
        score[some] = e[np.arange(len(best)), best] / e.sum(1)
    return pd.DataFrame({"lang_pred": lang, "score": score})


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """rows: doc_id, text, lang of the documents to learn from. The driver gets languages x DIM sums."""
    ship(rows.sparkSession)
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    n = rows.select("doc_id").count()
    part = min(1.0, sample_rows / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else rows

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            v = _unit(bundles(batch.column("text").to_pylist()))
            for x in set(langs):
                sums[x] = sums.get(x, 0) + v[langs == x].sum(0, dtype=np.float64)
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * DIM), pa.array(np.arange(DIM)), pa.array(np.round(v * 1e6).astype(np.int64))], ["lang", "at", "v"])

    got = rows.select("lang", "text").mapInArrow(add, "lang string, at long, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in got})
    out = np.zeros((len(langs), DIM))
    for r in got:
        out[langs.index(r["lang"]), r["at"]] = r["v"]
    some = np.abs(out).sum(1) > 0 if len(langs) else np.zeros(0, bool)
    return Profiles([x for x, s in zip(langs, some, strict=True) if s], _unit(out[some]).astype(np.float32))


def identify(docs: DataFrame, p: Profiles) -> Column:
    """A struct of lang_pred and score for ``text``."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(p)  # languages x DIM floats

    @F.pandas_udf("lang_pred string, score double")
    def look(text: pd.Series) -> pd.DataFrame:
        return predict(text.tolist(), held.value)

    return look(docs["text"])
