"""Operator 10, toxicity: multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence's probability is a logistic function of its words; the
document's is one minus the product of the sentences' complements. Weights are trained from document labels
alone, by gradient steps on the likelihood of the noisy-or, and the sentences that carry a document's score
are then found with the same weights.

Words are runs of letters and digits, ASCII lower-cased; sentences end at ``.``, ``!``, ``?`` or a line
break. Nulls and texts without words score 0. A null doc_id is scored like any other row and never trained
on. Labels that are null are left out; of several labels of one doc_id the highest holds. With no label to
learn from every score is 0. Repeated rows get equal scores; of rows that share a labelled doc_id the one with
the least text is learned from. Texts of any length are learned from and scored whole. Features of equal gain
are taken by their hash. An empty table gives an empty result. Only doc_id and text are read, whatever other
columns are named; ``toxicity`` and ``judged`` are columns that the caller names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, ship
from .words import NO_LETTER, Block, blocks

#: The classifier is fitted on at most so many labelled rows of label 1 and of label 0, the first by hash of doc_id, ...
SAMPLE_ROWS = (1_500, 3_000)
#: ... and on so many features, the most telling ones that so many of its documents of label 1 have. Scoring has no bounds.
FEATURES = 4_096
LEAST_DOCS = 3
#: Sentences of less than this probability count in a score as one sentence, their mean: what the model grants to any sentence does not add up with a text's length.
#: Chosen inside the rows that may be learned from (trained on remainders 0 and 1, judged on 3): of the values that catch as many toxic rows as the plain noisy-or, the one at which the fewest long clean texts reach 0.3.
WEAK = 0.05
#: Besides the whole word, its first k bytes count where it has more: inflected and lengthened forms.
PREFIXES = (3, 4, 5, 6, 7, 8)
SLOT_BITS = 20
_END = np.zeros(256, bool)
_END[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


@dataclass
class Model:
    """Weights by slot of a word's hash; ``check`` tells a known word from another in its slot."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOT_BITS, np.float32))
    check: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOT_BITS, np.uint32))
    bias: float = -np.inf  # without labels every score is 0


def _sentences(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence that has words, and the sentence's text."""
    no = np.searchsorted(np.flatnonzero(_END[b.data]), b.start)
    first = np.flatnonzero(np.diff(no, prepend=-1))
    return first, b.doc[first]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _hashes(b: Block) -> Iterator[np.ndarray]:
    """Features by word, one array for each kind: 32 bits, 0 where a word has none of the kind."""
    yield (b.word >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for k in PREFIXES:
        yield (b.prefix(k) >> np.uint64(32)).astype(np.uint32)


def _logits(b: Block, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, doc = _sentences(b)
    w = np.zeros(len(b.word), np.float32)
    for h in _hashes(b):
        slot = h >> np.uint32(32 - SLOT_BITS)
        w += np.where(m.check[slot] == h, m.weight[slot], np.float32(0))
    z = np.add.reduceat(w, first).astype(np.float64) + m.bias if len(first) else np.empty(0)
    return z, first, doc


def gains(with1: np.ndarray, with0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How much more often documents of label 1 have a feature."""
    return with1 * np.log((with1 + 0.5) / n1 / ((with0 + 0.5) / n0))


@dataclass
class Bags:
    """A document's sentences by the chosen features they have: alike ones once, with how often they occur."""

    plain: int  # sentences without any chosen feature
    times: np.ndarray  # by distinct bag
    size: np.ndarray  # features of each bag
    feature: np.ndarray  # one bag after the other, as places in the chosen features


def bags(words: np.ndarray, firsts: np.ndarray, chosen: np.ndarray) -> Bags:
    """words: features, a row for each word; firsts: the sentences' first words; chosen: sorted features."""
    if not len(chosen) or not len(words):
        return Bags(len(firsts), *(np.empty(0, np.int32) for _ in range(3)))
    at = np.minimum(np.searchsorted(chosen, words), len(chosen) - 1)
    r, c = np.nonzero(chosen[at] == words)
    if not len(r):
        return bags(words[:0], firsts, chosen)
    sentence, f = np.searchsorted(firsts, r, "right") - 1, at[r, c]
    order = np.lexsort((f, sentence))
    sentence, f = sentence[order], f[order].astype(np.int32)
    cut = np.flatnonzero(np.diff(sentence, prepend=-1))
    known: Counter[bytes] = Counter(f[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(f)), strict=True))
    kept = sorted(known)
    return Bags(len(firsts) - len(cut), np.array([known[k] for k in kept], np.int32), np.array([len(k) // 4 for k in kept], np.int32), np.frombuffer(b"".join(kept), np.int32))


def descend(docs: list[Bags], labels: np.ndarray, chosen: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), steps: int = 300, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Weights of the chosen features, fitted together by full-batch Adam on the likelihood of the noisy-or.

    weight: how many labelled rows a row of label 0 and of label 1 stands for.
    """
    m = Model()
    if not len(labels) or labels.min() == labels.max():
        return m
    n, k = len(labels), len(chosen)
    rows = np.where(labels == 1, weight[1], weight[0])
    rows = rows / rows.sum()
    plain = np.array([d.plain for d in docs], float)
    held = np.array([len(d.times) for d in docs])
    times = np.concatenate([d.times for d in docs]).astype(float)
    f = np.concatenate([d.feature for d in docs]).astype(np.int64)
    bag = np.repeat(np.arange(len(times)), np.concatenate([d.size for d in docs]))
    doc = np.repeat(np.arange(n), held)
    sentences = plain + np.bincount(doc, times, n)
    w, b = np.zeros(k), np.log((rows @ labels) / max(1.0, sentences.mean()))
    moment, power = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(bag, w[f], len(times)) + b
        total = np.maximum(np.bincount(doc, times * _softplus(z), n) + plain * _softplus(b), 1e-9)
        slope = np.maximum(np.where(labels == 1, -1.0 / np.expm1(np.minimum(total, 700.0)), 1.0) * rows, -1.0)
        gz = slope[doc] * times / (1.0 + np.exp(-np.clip(z, -500, 500)))
        gb = gz.sum() + (slope * plain).sum() / (1.0 + np.exp(-np.clip(b, -500, 500)))
        g = np.append(np.bincount(f, gz[bag], k) + decay * w, gb)
        moment = 0.9 * moment + 0.1 * g
        power = 0.99 * power + 0.01 * g * g
        d = rate * (moment / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.99**t)) + 1e-8)
        w -= d[:-1]
        b -= d[-1]
    strong = np.argsort(np.abs(w), kind="stable")  # of two features in one slot the stronger stays
    slot = chosen >> np.uint32(32 - SLOT_BITS)
    m.weight[slot[strong]] = w[strong]
    m.check[slot[strong]] = chosen[strong]
    m.bias = float(b)
    return m


def fit(words: list[np.ndarray], sentences: list[np.ndarray], labels: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), n_features: int = FEATURES) -> Model:
    """The same on rows that are at hand: what ``train`` does, in one place."""
    if not len(labels) or labels.min() == labels.max():
        return Model()
    own = [np.unique(w[w > 0]) for w in words]
    known, code = np.unique(np.concatenate(own), return_inverse=True)
    label = np.repeat(labels, [len(x) for x in own])
    with1, with0 = np.bincount(code, label == 1, len(known)), np.bincount(code, label == 0, len(known))
    gain = gains(with1, with0, (labels == 1).sum(), (labels == 0).sum())
    use = np.flatnonzero((gain > 0) & (with1 >= LEAST_DOCS))
    chosen = np.sort(known[use[np.argsort(-gain[use], kind="stable")[:n_features]]])
    return descend([bags(w, s, chosen) for w, s in zip(words, sentences, strict=True)], labels, chosen, weight)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the features of its words and the first words of its sentences."""
    for _, b in blocks(texts, lower=True, sep=NO_LETTER):
        first, doc = _sentences(b)
        cut = np.searchsorted(doc, np.arange(b.n + 1))
        all_ = np.stack(list(_hashes(b)), 1)
        for i in range(b.n):
            lo, hi = b.first[i], b.first[i + 1]
            yield all_[lo:hi], first[cut[i] : cut[i + 1]] - lo


def _labelled_texts(batches: Iterable[pa.RecordBatch], rows: int = 100) -> Iterator[tuple[list[int], list[str | None]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part.column("toxic").to_pylist(), part.column("text").to_pylist()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, with1, with0): documents of either label that have a feature; feature 0 counts them all."""
    for labels, texts in _labelled_texts(batches):
        own = [np.append(np.unique(w[w > 0]), np.uint32(0)) for w, _ in features(texts)]
        known, code = np.unique(np.concatenate(own), return_inverse=True)
        label = np.repeat(labels, [len(x) for x in own])
        with1, with0 = (np.bincount(code, label == x, len(known)).astype(np.int64) for x in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(with1), pa.array(with0)], ["feature", "with1", "with0"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS, n_features: int = FEATURES) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic.

    Features of the sample's whole texts are counted and ranked in Spark. Only the chosen ones reach the driver, and
    of each sampled document its distinct bags of them, whose number does not grow with repeated sentences.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda label, n: ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = first(1, sample_rows[0]).unionByName(first(0, sample_rows[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample_rows ids
    rows = scratch.keep(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))
    counts = scratch.keep(rows.mapInArrow(released(_count), "feature long, with1 long, with0 long").groupBy("feature").agg(F.sum("with1").alias("with1"), F.sum("with0").alias("with0")))
    n = counts.where("feature = 0").first()
    if n is None or not n["with1"] or not n["with0"]:
        return Model()
    gain = F.col("with1") * F.log((F.col("with1") + 0.5) / n["with1"] / ((F.col("with0") + 0.5) / n["with0"]))
    top = counts.where(F.col("feature") > 0).where((gain > 0) & (F.col("with1") >= LEAST_DOCS)).orderBy(gain.desc(), "feature").limit(n_features)
    chosen = np.sort(np.array([r["feature"] for r in top.select("feature").collect()], np.uint32))

    def put(batches):
        for label, texts in _labelled_texts(batches):
            found = [bags(w, s, chosen) for w, s in features(texts)]
            raw = lambda c: pa.array([getattr(x, c).astype(np.int32).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([x.plain for x in found], pa.int64()), raw("times"), raw("size"), raw("feature")], ["toxic", "plain", "times", "size", "feature"])

    got = sorted(rows.mapInArrow(released(put), "toxic int, plain long, times binary, size binary, feature binary").collect(), key=lambda r: (r["toxic"], r["plain"], bytes(r["feature"]), bytes(r["times"]), bytes(r["size"])))
    scratch.drop(rows, counts)
    y = np.array([r["toxic"] for r in got], np.int64)
    weight = tuple(there.get(x, 0) / max(1, (y == x).sum()) for x in (0, 1))
    whole = lambda x: np.frombuffer(x, np.int32)
    return descend([Bags(r["plain"], whole(r["times"]), whole(r["size"]), whole(r["feature"])) for r in got], y, chosen, weight)


def _total(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """-log of the probability that no sentence is toxic; weak sentences count by their mean."""
    loss, weak = _softplus(z), z < np.log(WEAK / (1 - WEAK))
    return np.bincount(doc, np.where(weak, 0.0, loss), n) + np.bincount(doc, np.where(weak, loss, 0.0), n) / np.maximum(np.bincount(doc, weak, n), 1)


def judge_texts(texts: list[str | None], m: Model, threshold: float = 0.3) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of each text and, where it reaches the threshold, the sentences to blame: those that reach it alone, or else the worst."""
    out, spans = np.zeros(len(texts)), [[] for _ in texts]
    for at, b in blocks(texts, lower=True, sep=NO_LETTER):
        z, first, doc = _logits(b, m)
        own = np.clip(-np.expm1(-_total(z, doc, b.n)), 0.0, 1.0) + 0.0  # no negative zeros
        out[at : at + b.n] = own
        cut, last = np.searchsorted(doc, np.arange(b.n + 1)), np.append(first[1:], len(b.word)) - 1
        for i in np.flatnonzero((own >= threshold) & (np.diff(cut) > 0)):
            p = 1 / (1 + np.exp(-z[cut[i] : cut[i + 1]]))
            worst = np.flatnonzero(p >= threshold) if p.max() >= threshold else [int(np.argmax(p))]
            spans[at + i] = [{"start": int(b.start[first[k]] - b.at[i]), "end": int(b.end[last[k]] - b.at[i]), "score": float(p[k - cut[i]])} for k in worst + cut[i]]
    return out, spans


def score_texts(texts: list[str | None], m: Model) -> np.ndarray:
    return judge_texts(texts, m, np.inf)[0]


def toxicity(docs: DataFrame, model: Model) -> Column:
    """The score of ``text``, 0 to 1."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(text.tolist(), held.value))

    return score(docs["text"])


def judged(docs: DataFrame, model: Model, threshold: float = 0.3) -> Column:
    """A struct of score and ``offending``: start, end (bytes of the UTF-8 text) and score of the sentences to blame."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start: long, end: long, score: double>>")
    def judge(text: pd.Series) -> pd.DataFrame:
        score, spans = judge_texts(text.tolist(), held.value, threshold)
        return pd.DataFrame({"score": score, "offending": spans})

    return judge(docs["text"])


def offending(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, start, end, score of each sentence to blame for a document at or above the threshold."""
    return docs.select("doc_id", F.explode(judged(docs, model, threshold)["offending"]).alias("s")).select("doc_id", "s.*")
