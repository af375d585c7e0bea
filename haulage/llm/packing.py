"""Operator 6, packing: documents into windows of L tokens by non-negative least squares.

A document of more than L tokens first fills whole windows of its own; what is left (1 to L-1 tokens) is
packed. Leftover lengths are rounded up to a grid of L / GRID tokens and counted. All shallow combinations of
two, three or four grid lengths that fill a window exactly (four: on a coarser grid), and the single ones near
L, are the columns of a least-squares problem whose non-negative solution says how often each is to be used.
Counts are rounded down, and never use more pieces of a length than there are. The pieces that remain are
packed greedily: their tokens follow each other and are cut where a window ends. Padding comes only from
rounding lengths up to the grid, and from the last window.

Only the histogram (GRID counts) and the combinations used reach the driver. Documents get their place in
their length class by a distributed rank, and their window by arithmetic on it.

Nulls: a null text is an empty one and still has its end token. A null doc_id is packed like any other.
Repeated rows are packed one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, released, running, ship

GRID = 128
END = 1


# -- tokens ---------------------------------------------------------------------------------------------------

#: Code points up to here are split by table; a text with others goes through the tokenizer whole.
_PLAIN = 0x250
_L, _N, _S, _W, _O = range(5)
_RNG = np.random.default_rng(6)
_CHAR = _RNG.integers(1, 2**63, _PLAIN, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts handed to a Python worker at once.
SLICE = 500
#: Characters split at once (about 50 bytes of memory each), and pieces remembered at most (about 65 bytes each).
_CHUNK = 500_000
_REMEMBER = 1_000_000
#: Characters of new pieces that the BPE model gets at once.
_TOGETHER = 20_000
_TABLES: dict = {}
_ENCODERS: dict = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "kind" not in _TABLES:
        kind = np.full(_PLAIN, _O, np.uint8)
        for c in range(_PLAIN):
            s = chr(c)
            kind[c] = _S if s == " " else _W if s.isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else _L if s.isalpha() else _N if s.isnumeric() else _O
        _TABLES["kind"] = kind
    if len(_TABLES.get("pow", ())) < n:
        m = max(n, _CHUNK + 200_000)
        for name, base in (("pow", _P), ("inv", _P_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _TABLES[name] = np.multiply.accumulate(a)
    return _TABLES["kind"], _TABLES["pow"], _TABLES["inv"]


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern starts a piece in the code points cp; first marks where texts begin.

    Runs of letters, of numbers, and of other visible characters are pieces, each with a space before it; of
    longer white space all but its last character is a piece; 's 't 're 've 'm 'll 'd are pieces where an
    apostrophe begins one.
    """
    kind = _tables(1)[0][cp]
    n = len(cp)
    white = (kind == _S) | (kind == _W)
    run = np.ones(n, bool)
    group = np.where(white, np.uint8(_S), kind)
    run[1:] = (group[1:] != group[:-1]) | first[1:]
    start = run.copy()
    last_white = np.zeros(n, bool)  # a white character with something visible after it in its text
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= last_white
    joined = np.zeros(n, bool)  # the run here took the space before it
    joined[1:] = last_white[:-1] & (kind[:-1] == _S)
    start &= ~joined
    at = np.flatnonzero((cp == 39) & start & ~joined)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == _L) & ~first[at + 1]]
    if len(at):
        a, b = cp[at + 1], np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0)
        b = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], b, 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for sel, k in ((one, 1), (two & ~one, 2)):
            p = at[sel]
            start[p + 1] = False
            q = p + 1 + k
            q = q[q < n]
            q = q[(kind[q] == _L) & ~first[q]]
            start[q] = True
    return start


class Encoder:
    """Token ids of texts as the tokenizer gives them.

    Byte-level BPE works on each piece of the text alone, so equal pieces are encoded once: pieces are found in
    numpy, told apart by a hash that is checked character by character, and only those not met before go to the
    BPE model. A chunk in which two pieces share a hash goes to the tokenizer whole, and so do texts that name an
    added token or have characters beyond the table.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None  # the tokenizer cuts these out before pieces are made
        self.bare = Tokenizer(self.tokenizer.model)  # the model alone: its input is one piece
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        alphabet = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}  # the byte-level alphabet: hidden bytes get characters from 256 on
        self.spelt = np.zeros((_PLAIN + 1, 2), np.uint16)  # each code point in that alphabet, and last what stands between pieces
        for c in range(_PLAIN):
            for i, x in enumerate(chr(c).encode()):
                self.spelt[c, i] = alphabet[x]
        self.spelt[_PLAIN, 0] = alphabet[0xFF]  # no UTF-8 text has this byte
        self.between = self._between(chr(alphabet[0xFF]))
        self.clear()

    def _between(self, mark: str) -> int | None:
        """The id of what stands between pieces, if no other token has that character (then it merges with nothing)."""
        own = self.tokenizer.get_vocab(with_added_tokens=False)
        return own[mark] if [t for t in own if mark in t] == [mark] else None

    def clear(self) -> None:
        self.hashes, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted; where the arrays below have the piece
        self.chars, self.char_at = np.empty(1 << 20, np.uint16), np.zeros(1, np.int64)
        self.ids, self.id_at = np.empty(1 << 20, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, cp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. Pieces are final, so they go straight to the BPE model."""
        n, at = len(size), np.cumsum(size)
        if self.between is None:
            words = [self.spelt[x].ravel() for x in np.split(cp, at[:-1])]
            found = [self.bare.encode(w[w != 0].tobytes().decode("utf-16-le"), add_special_tokens=False).ids for w in words]
            return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, n)
        out, counts = [], []
        marked = np.insert(cp, at, _PLAIN)
        ends = at + np.arange(1, n + 1)
        lo = done = 0
        while done < n:
            up = max(done + 1, int(np.searchsorted(ends, lo + _TOGETHER, "right")))
            spelt = self.spelt[marked[lo : ends[up - 1]]].ravel()
            text = spelt[spelt != 0].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode(text, add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(ids == self.between)
            counts.append(np.diff(stop, prepend=-1) - 1)
            out.append(np.delete(ids, stop))
            lo, done = int(ends[up - 1]), up
        return np.concatenate(out), np.concatenate(counts)

    def _learn(self, h: np.ndarray, cp: np.ndarray, size: np.ndarray) -> None:
        """Pieces not met before: their hashes in order, their characters in a row, and how many each has."""
        ids, count = self._model(cp, size)
        n0 = len(self.char_at) - 1
        for name, more in (("chars", cp), ("ids", ids)):
            have, used = getattr(self, name), int(getattr(self, name[:-1] + "_at")[-1])
            if used + len(more) > len(have):
                have = np.concatenate((have[:used], np.empty(max(len(have), len(more)), have.dtype)))
                setattr(self, name, have)
            have[used : used + len(more)] = more
        self.char_at = np.append(self.char_at, self.char_at[-1] + np.cumsum(size))
        self.id_at = np.append(self.id_at, self.id_at[-1] + np.cumsum(count))
        at = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, at, h)
        self.place = np.insert(self.place, at, np.arange(n0, n0 + len(h)))

    @staticmethod
    def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The stretches of values that begin there, in a row."""
        at = np.repeat(begin - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return values.take(at)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(sizes)))
        if not len(cp):
            return [np.empty(0, np.uint32) for _ in texts]
        first = np.zeros(len(cp), bool)
        first[at[:-1][sizes > 0]] = True
        start = np.flatnonzero(piece_starts(cp, first))
        size = np.diff(start, append=len(cp))
        _, pow_, inv = _tables(len(cp) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CHAR[cp] * pow_[: len(cp)], dtype=np.uint64)))
        h = (sums[start + size] - sums[start]) * inv[start]
        cp = cp.astype(np.uint16)  # the table's code points are
        h, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > _REMEMBER or self.char_at[-1] > 20 * _REMEMBER:
            self.clear()
        at_hash = np.searchsorted(self.hashes, h)
        new = np.ones(len(h), bool)
        inside = at_hash < len(self.hashes)
        new[inside] = self.hashes[at_hash[inside]] != h[inside]
        if new.any():
            self._learn(h[new], self._gather(cp, start[one[new]], size[one[new]]), size[one[new]])
            at_hash = np.searchsorted(self.hashes, h)
        which = self.place[at_hash][back]
        begin = self.char_at[which]
        if not (np.array_equal(self.char_at[which + 1] - begin, size) and np.array_equal(self._gather(self.chars, begin, size), cp)):
            return [np.array(ids, np.uint32) for ids in self._ids(texts)]
        begin = self.id_at[which]
        size = self.id_at[which + 1] - begin
        flat = self._gather(self.ids, begin, size)
        cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, at)]
        return [flat[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        held, size = [], 0
        for t in texts:
            t = t or ""
            plain = (t.isascii() or np.frombuffer(t.encode("utf-32-le"), np.uint32).max() < _PLAIN) and not (self.added and self.added.search(t))
            if held and (not plain or size + len(t) > _CHUNK):
                yield from self._chunk(held)
                held, size = [], 0
            if plain:
                held.append(t)
                size += len(t)
            else:
                yield np.array(self._ids([t])[0], np.uint32)
        if held:
            yield from self._chunk(held)


def encoder(path: str) -> Encoder:
    """One for each Python worker: what it has learnt serves its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of fewer rows, so that neither side of the Python worker holds many texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, with the end token), doc_tokens."""
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                ids = [np.append(x, np.uint32(END)) for x in enc.encode(batch.column("text").slice(lo, SLICE).to_pylist())]
                narrow = [x.astype(np.uint16).tobytes() if x.max() < 65536 else x.astype(np.uint32).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, SLICE), pa.array(narrow, pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, ids binary, doc_tokens long")


def unpack(ids: bytes, n: int) -> np.ndarray:
    """The ids of a row of tokenize()."""
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4")


# -- the plan -------------------------------------------------------------------------------------------------


def patterns(grid: int = GRID, coarse: int = 4) -> list[tuple[int, ...]]:
    """Shallow combinations of grid lengths that sum to the grid, and the single lengths that nearly do."""
    out: list[tuple[int, ...]] = [(grid,)]
    for i in range(1, grid):
        if grid - i >= i:
            out.append((i, grid - i))
    for i in range(1, grid):
        for j in range(i, grid):
            if (k := grid - i - j) >= j:
                out.append((i, j, k))
    for c in combinations_with_replacement(range(coarse, grid, coarse), 3):
        if (k := grid - sum(c)) >= c[-1]:
            out.append((*c, k))
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Lawson and Hanson's active sets: argmin |a x - b| with x >= 0."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(most or 4 * m):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            active[at[x[at] <= 1e-12]] = False
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to use each; hist[g] pieces have grid length g (1-based, index 0 unused)."""
    grid = len(hist) - 1
    combos = [c for c in patterns(grid) if all(hist[i] for i in c)]
    if not combos:
        return []
    a = np.zeros((grid + 1, len(combos)))
    for j, c in enumerate(combos):
        for i in c:
            a[i, j] += 1
    x = nnls(a, hist.astype(float))
    left, out = hist.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        need = {i: combos[j].count(i) for i in combos[j]}
        n = min(int(x[j] + 1e-9), *(left[i] // k for i, k in need.items()))
        if n > 0:
            out.append((combos[j], int(n)))
            for i, k in need.items():
                left[i] -= n * k
    return out


def pack(docs: DataFrame, path: str, window: int = 2048, grid: int = GRID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = tokenize(docs, path).withColumn("_row", F.monotonically_increasing_id())
    with small_batches(spark, SLICE):
        tokens = scratch.keep(made)  # written once, so that _row and the ids are the same in every later read
    lens = tokens.select("_row", "doc_tokens", F.pmod("doc_tokens", F.lit(window)).alias("rest"), F.floor(F.col("doc_tokens") / window).cast("long").alias("whole"))
    lens = lens.withColumn("g", F.ceil(F.col("rest") * grid / F.lit(window)).cast("int"))
    hist = np.zeros(grid + 1, np.int64)
    for r in lens.where("rest > 0").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect():  # at most grid rows
        hist[r["g"]] = r["n"]
    uses = plan(hist)
    # ranks 0.. of a grid length are dealt to the places of the combinations, one stretch after the other
    taken, stretches, seq = np.zeros(grid + 1, np.int64), [], 0
    for c, n in uses:
        for place, g in enumerate(c):
            stretches.append((int(g), int(taken[g]), int(taken[g]) + n, seq, place))
            taken[g] += n
        seq += n
    packed = seq
    ranked = running(scratch, lens.where("rest > 0"), ["g"], ["_row"])
    values = ", ".join(f"({g}, {lo}L, {hi}L, {s}L, {p})" for g, lo, hi, s, p in stretches) or "(0, 0L, 0L, 0L, 0)"
    deal = spark.sql(f"SELECT * FROM VALUES {values} AS t(sg, lo, hi, first, place)")  # bounded by the grid: a solution has at most grid combinations
    placed = ranked.join(F.broadcast(deal), (F.col("g") == F.col("sg")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")), "left")
    placed = scratch.keep(placed.select("_row", "doc_tokens", "rest", "whole", (F.col("first") + F.col("_rank") - F.col("lo")).alias("seq"), "place"))
    inside = Window.partitionBy("seq").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("whole") * window).alias("start")
    one = placed.where("seq is not null").select("_row", start, F.col("rest").alias("length"), "seq", F.coalesce(F.sum("rest").over(inside), F.lit(0)).alias("offset"))
    # the others follow each other and are cut at the windows' ends
    stream = running(scratch, placed.where("seq is null").select("_row", "rest", "whole", F.lit(0).alias("all")), ["all"], ["_row"], "rest")
    first, last = F.floor(F.col("_before") / window), F.floor((F.col("_before") + F.col("rest") - 1) / window)
    cut = stream.withColumn("w", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("_before"), F.col("w") * window), F.least(F.col("_before") + F.col("rest"), (F.col("w") + 1) * window)
    two = cut.select("_row", (F.col("whole") * window + lo - F.col("_before")).alias("start"), (hi - lo).alias("length"), (F.col("w") + packed).alias("seq"), (lo - F.col("w") * window).alias("offset"))
    # whole windows of long documents come after both
    after = packed + int(stream._dealt.agg(F.coalesce(F.ceil(F.sum("rest") / window), F.lit(0)).alias("n")).first()["n"])
    long = running(scratch, lens.where("whole > 0").select("_row", "whole", F.lit(0).alias("all")), ["all"], ["_row"], "whole")
    three = long.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    three = three.select("_row", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.lit(after) + F.col("_before") + F.col("i")).alias("seq"), F.lit(0).cast("long").alias("offset"))
    pieces = one.unionByName(two).unionByName(three)
    by_row = pieces.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "seq", "offset"))).alias("pieces"))
    joined = tokens.join(by_row, "_row").select("doc_id", "ids", "doc_tokens", "pieces")

    def crc(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, ids, n, ps in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "doc_tokens", "pieces")), strict=True):
                raw = unpack(ids, n).tobytes()
                for p in ps:
                    for c, v in zip(cols, (doc, p["start"], p["length"], zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]), n, p["seq"], p["offset"]), strict=True):
                        cols[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], list(cols))

    return joined.mapInArrow(released(crc), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
