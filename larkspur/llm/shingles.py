"""Vectorised words, shingles and BagMinHash over a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import WORD_TABLE

U = np.uint64
MIX1, MIX2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE, BLOCK = U(0x5851F42D4C957F2D), 1 << 16
INVERSE, FAR = (U(pow(int(BASE), -n, 1 << 64)) for n in (1, BLOCK))
POWERS = np.multiply.accumulate(np.full(BLOCK, BASE))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ..., n - 1, modulo 2^64."""
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


UNDO = powers(INVERSE, BLOCK)


def word_sums(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range of bytes the sum of its bytes times powers of BASE, the first power at its first byte: differences of
    one running sum, divided by the power at the start (BASE is odd, so it has an inverse)."""
    blocks = -(-len(part) // BLOCK)
    until = np.zeros(blocks * BLOCK + 1, U)
    until[1 : len(part) + 1] = part
    square = until[1:].reshape(blocks, BLOCK)
    square *= POWERS
    square *= powers(POWERS[-1], blocks)[:, None]
    np.cumsum(until, out=until)
    sums = (until[end] - until[start]) * UNDO[start & (BLOCK - 1)]
    return sums * powers(FAR, blocks)[start >> 16] if blocks > 1 else sums


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Words:
    """Words of a batch of texts: text number, byte range within the text, and a 64-bit hash of each. Words are those
    of ``common.words``."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        data = np.frombuffer((b"\n".join(raw) + b"\n").translate(WORD_TABLE), np.uint8)
        inside = data != 32
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.hash = np.zeros(len(self.starts), U)
        step = 1 << 17  # words at a time, so that a very long text needs no large arrays
        for a in range(0, len(self.starts), step):
            s, e = self.starts[a : a + step], self.ends[a : a + step]
            part = data[s[0] : e[-1]]
            size = e - s
            self.hash[a : a + step] = mix(word_sums(part, s - s[0], e - s[0]) + size.astype(U) * STEP)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def digest(self, i: int) -> bytes:
        """16 bytes that stand for the whole sequence of words."""
        return hashlib.blake2b(self.of(i).tobytes(), digest_size=16).digest()


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    out = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        out = out * STEP + h[j : len(h) - k + 1 + j]
    return mix(out)


def counted_shingles(words: Words, n: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted; a text of fewer than k words, but not none, has one shingle of all its words."""
    h, t = words.hash, words.text
    if len(h) >= k:
        own = window_hashes(h, k)
        same = t[: len(own)] == t[k - 1 :]
        own, texts = own[same], t[: len(own)][same]
    else:
        own, texts = np.zeros(0, U), np.zeros(0, np.int64)
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.array([window_hashes(words.of(i), int(sizes[i]))[0] for i in short], U)
        own, texts = np.concatenate([own, extra]), np.concatenate([texts, short])
    order = np.lexsort((own, texts))
    own, texts = own[order], texts[order]
    if not len(own):
        return texts, own, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (texts[1:] != texts[:-1])]))
    return texts[new], own[new], np.diff(np.concatenate([new, [len(own)]]))


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures of weighted sets: two agree in a component with the probability of their weighted Jaccard
    similarity.

    Every element has Poisson points on the plane of time and weight, m for each unit of either, each with a component;
    a set takes the points below its element's weight; a component's value is its first point. Weight is discretised
    into the dyadic ranges [0,1), [1,2), [2,4), ...: one process for each range, whose points are thinned to the part
    below the weight, so a weight w takes about log2 w processes. Times are generated in order and only up to a limit
    by which all components very likely have a point; a text with a gap is done again with twice the limit.
    """
    out = np.zeros((n, m), U)
    total = np.bincount(text, weights=weight, minlength=n).astype(float)
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = factor * (np.log(m) + 3) / total[todo]
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        use = chosen[text]
        t, e, w = text[use], element[use], weight[use]
        found: list[tuple] = []
        level, low, wide = 0, 0, 1
        while len(t):
            seed = mix(e + np.array([level + 1], U) * MIX1)
            at, ww, tt, x = seed.copy(), w, t, np.zeros(len(t))
            while len(at):
                at = at + STEP
                x = x - np.log(((mix(at) >> U(11)).astype(float) + 0.5) * 2.0**-53) / (m * wide)
                live = x < limit[tt]
                at, x, ww, tt = at[live], x[live], ww[live], tt[live]
                if not len(at):
                    break
                point = mix(at ^ MIX2)
                if wide > 1:
                    height = low + (mix(point) >> U(11)).astype(float) * 2.0**-53 * wide
                    fine = height < ww
                    found.append((tt[fine], point[fine], x[fine]))
                else:
                    found.append((tt, point, x))
            low, wide, level = (1, 1, 1) if level == 0 else (low + wide, wide * 2, level + 1)
            more = w > low
            t, e, w = t[more], e[more], w[more]
        tt, point, x = (np.concatenate([f[i] for f in found]) for i in range(3))
        cell = tt * m + ((point >> U(33)) % U(m)).astype(np.int64)
        order = np.argsort(x)[::-1]
        flat = out.reshape(-1)
        flat[cell[order]] = point[order]  # the earliest point is written last
        todo = todo[(out[todo] == 0).any(1)]
        out[todo] = 0
        factor *= 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """n x bands: one 64-bit key for each band of ``rows`` components."""
    n, m = signatures.shape
    bands = m // rows
    key = np.zeros((n, bands), U) + (np.arange(bands).astype(U) + U(1)) * MIX1
    for r in range(rows):
        key = mix(key * STEP + signatures[:, np.arange(bands) * rows + r])
    return key.view(np.int64)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two (elements sorted, counts)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))
