"""Words of whole texts as 64-bit hashes, a block of texts at a time, in numpy.

A word's hash is a polynomial modulo 2**64 with random byte values, mixed afterwards. Two different words,
or two different word sequences, have equal hashes with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once; a longer text makes a block of its own.
BLOCK = 500_000
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 8, dtype=np.uint64)]
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but letters, digits and bytes of characters beyond ASCII.
NO_LETTER = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, BLOCK + 1000)
        with np.errstate(over="ignore"):
            for base in (_P, _P_INV):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                a = np.multiply.accumulate(a)
                if base is _P:
                    _POW = a
                else:
                    _INV = a
    return _POW, _INV


class Block:
    """A run of texts. ``word`` (hash), ``start`` and ``end`` (bytes of ``data``) and ``doc`` are by word; ``first`` by text."""

    def __init__(self, texts: list[bytes], lower: bool, sep: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        self.n = len(texts)
        self.data = np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        inside = ~sep[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        self.start, self.end = edge[::2], edge[1::2]
        pow_, inv = _powers(len(self.data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * pow_[: len(self.data)], dtype=np.uint64)))
        self._sums, self._inv = sums, inv
        self.word = mix((sums[self.end] - sums[self.start]) * inv[self.start])
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def prefix(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word that has more; 0 for the others."""
        longer = self.end - self.start > k
        out = np.zeros(len(self.word), np.uint64)
        at = self.start[longer]
        out[longer] = mix((self._sums[at + k] - self._sums[at]) * self._inv[at] + np.uint64(k)) | np.uint64(1)
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word's place of every window of k words within a text."""
        m = len(self.word) - k + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h += self.word[at + i] * _Q[i]
        return mix(h + np.uint64(k)), at


def blocks(texts: Iterable[str | None], lower: bool = False, sep: np.ndarray = SPACE) -> Iterator[tuple[int, Block]]:
    """(place of the first text, block) over all texts; a null text is an empty one."""
    held: list[bytes] = []
    size = at = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > BLOCK:
            yield at, Block(held, lower, sep)
            at, held, size = at + len(held), [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, Block(held, lower, sep)


def shingle_sets(block: Block, k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; with fewer words the whole sequence as one; none without words."""
    h, at = block.windows(k)
    cut = np.searchsorted(block.doc[at], np.arange(block.n + 1))
    out = []
    for i in range(block.n):
        n = block.first[i + 1] - block.first[i]
        if n >= k:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            w = block.word[block.first[i] : block.first[i + 1]]
            s = np.zeros(1, np.uint64)
            for j in range(n):
                s += w[j : j + 1] * _Q[j]
            out.append(mix(s + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
