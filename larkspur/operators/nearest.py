"""The k nearest (or farthest) rows of many queries inside one task, in numpy.

Squares of distances come from one matrix product, which is fast but rounds differently; they only say which pairs may be among
the k best, with a margin above their rounding error. Distances of those pairs are then summed in the order of the dimensions,
so results are the same as pair by pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries and rows of one matrix product, and pairs summed at once.
QUERIES, ROWS, PAIRS = 1_024, 4_096, 65_536


def vectors(column, rows: int) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64, copy=False) if rows else np.zeros((0, 0))


def names(column) -> np.ndarray:
    """An Arrow column of keys: whole numbers as they are, others as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def norms(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def squares(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, kind=np.float64, sign: int = 1) -> np.ndarray:
    """Squares of all distances, or their negatives, from one product."""
    left, right = np.empty((len(a), a.shape[1] + 2), kind), np.empty((len(b), a.shape[1] + 2), kind)
    left[:, :-2], left[:, -2], left[:, -1] = a, an * sign, sign
    right[:, :-2], right[:, -2], right[:, -1] = b, 1, bn
    left[:, :-2] *= -2 * sign
    return left @ right.T


def margins(an: np.ndarray, bn: np.ndarray, dims: int, kind=np.float64) -> np.ndarray:
    """By how much squares may be wrong at most, for each row of the left side."""
    return 8 * (dims + 8) * float(np.finfo(kind).eps) * (an + bn.max(initial=0))


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs, summed in the order of the dimensions."""
    out = np.zeros(len(i))
    for s in range(0, len(i), PAIRS):
        gap = (a[i[s : s + PAIRS]] - b[j[s : s + PAIRS]]).T
        for g in np.ascontiguousarray(gap * gap):
            out[s : s + PAIRS] += g
    return np.sqrt(out)


class Own:
    """Finds the places of keys in a list of keys that may repeat."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """i, j: keys[i] is at place j."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        i = np.repeat(np.arange(len(keys)), high - low)
        at = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[i]
        return i, self.order[at]


class Best:
    """The k best rows so far of every query: distance and key, in order; ties by least key. ``limit``: the distance that a
    row must not exceed (fall short of, with ``farthest``) to count; nan: none yet."""

    def __init__(self, queries: np.ndarray, k: int, farthest: bool = False, limit: np.ndarray | None = None):
        self.q, self.n, self.k, self.farthest = queries, norms(queries), k, farthest
        self.limit = np.full(len(queries), np.nan) if limit is None else limit.astype(float)
        self.d, self.key, self.full = np.full((len(queries), k), np.nan), None, np.zeros(len(queries), int)

    def add(self, rows: np.ndarray, rn: np.ndarray, keys: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None, of: np.ndarray | None = None) -> None:
        """Looks at rows for the queries ``of`` (all). own: pairs (query, place) that do not count."""
        of = np.arange(len(self.q)) if of is None else of
        for s in range(0, len(of), QUERIES):
            for r in range(0, len(rows), ROWS):
                self._block(of[s : s + QUERIES], rows[r : r + ROWS], rn[r : r + ROWS], keys[r : r + ROWS], own, r)

    def _block(self, of, rows, rn, keys, own, start) -> None:
        whole = len(of) == len(self.q)
        q = self.q if whole else self.q[of]
        limit, sign = self.limit[of], -1 if self.farthest else 1
        base = np.where(np.isnan(limit), np.inf, sign * limit * limit)
        # single precision halves the time where its error is small beside the limits
        kind, dims = np.float32, q.shape[1]
        margin = margins(self.n[of], rn, dims, kind)
        if not (np.isfinite(base) & (margin <= 0.01 * np.abs(base))).all():
            kind, margin = np.float64, margins(self.n[of], rn, dims)
        near, not_own = squares(q, self.n[of], rows, rn, kind, sign), None
        if own is not None and len(own[0]):
            place = np.full(len(self.q), -1)
            place[of] = np.arange(len(of))
            i, j = place[own[0]], own[1] - start
            fine = (i >= 0) & (j >= 0) & (j < len(rows))
            not_own = i[fine], j[fine]
            near[not_own] = np.inf
        bound = base + margin
        none = np.flatnonzero(np.isinf(bound))
        if len(none) and len(rows) > self.k:
            bound[none] = np.partition(near[none], self.k - 1, axis=1)[:, self.k - 1] + 2 * margin[none]
        far = near > (bound if kind is np.float64 else np.nextafter(bound.astype(kind), np.float32(np.inf)))[:, None]
        if not_own is not None:
            far[not_own] = True
        i, j = np.divmod(np.flatnonzero(~far), len(rows))
        if len(i):
            d = exact(q, i, rows, j)
            fine = np.isnan(limit[i]) | ~(d < limit[i] if self.farthest else d > limit[i])
            self._merge(of[i[fine]], d[fine], keys[j[fine]])

    def _merge(self, i: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
        if not len(i):
            return
        if self.key is None:
            self.key = np.zeros((len(self.q), self.k), keys.dtype)
        who = np.unique(i)
        had = np.arange(self.k)[None, :] < self.full[who][:, None]
        i = np.concatenate([np.repeat(who, self.full[who]), i])
        d, keys = np.concatenate([self.d[who][had], d]), np.concatenate([self.key[who][had], keys])
        rank = keys if keys.dtype != object else np.unique(keys, return_inverse=True)[1]
        order = np.lexsort((rank, -d if self.farthest else d, i))
        i, d, keys = i[order], d[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        place = np.arange(len(i)) - np.repeat(first, np.diff([*first, len(i)]))
        taken = place < self.k
        i, place = i[taken], place[taken]
        self.d[i, place], self.key[i, place] = d[taken], keys[taken]
        np.maximum.at(self.full, i, place + 1)
        done = who[self.full[who] == self.k]
        self.limit[done] = self.d[done, self.k - 1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, keys and distances."""
        if self.key is None:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.full[:, None])
        return i, self.key[i, j], self.d[i, j]
