"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of its encoding: a token t that ends the prefix and
whose merges, next to the last token of the prefix before it, are undone by nothing, that is, the two alone encode to
themselves. The table of these last tokens gives the encoding by walking back, can be extended byte by byte (appends
keep all earlier entries), and after an edit only entries from the edit on are computed anew, until they agree with
those the old table had at the same text.

Pieces are the matches of the vocabulary's pattern, each encoded on its own; a piece that is itself a token is that
token. Scale: one scan, no shuffle; a bounded cache of pieces per worker. Defined results: a null text counts as empty
(no ids, decoded to no bytes); repeated rows each give a row.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, sole

_LOADED: dict[tuple, BytePairs] = {}
#: Bytes of a piece's start whose table is kept and extended for every piece with the same start.
HEAD = 6


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class BytePairs:
    """A ranked byte vocabulary; encode(), decode() and prefix tables. Pieces seen lately are kept in two generations of
    ``cache`` entries, so frequent ones stay while rare ones go."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000):
        self.ranks, self.split, self.cache_size = ranks, regex.compile(pattern).findall, cache
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: b for b, r in ranks.items()}
        # only a token that its own bytes merge to can stand in an encoding
        self.standing = {b: r for b, r in ranks.items() if len(b) == 1 or self.merged(b) == [b]}
        self.forget()

    def forget(self) -> None:
        """Empties the memory of pieces, their starts, and pairs of tokens."""
        self.pairs: dict[int, bool] = {}
        self._heads: dict[bytes, PrefixTable] = {}
        self._seen = _Seen(self, {})

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: always merge the leftmost pair of lowest rank. Used on one or two tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        costs = [get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while costs:
            best = min(costs)
            if best == 1 << 60:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], 1 << 60)
        return parts

    def together(self, a: int, b: int) -> bool:
        """The two tokens side by side stay as they are."""
        if len(self.pairs) > 600_000:
            self.pairs.clear()
        x, y = self.bytes_of[a], self.bytes_of[b]
        known = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= HEAD:
            return PrefixTable(self, piece).ids()
        head = piece[:HEAD]
        known = self._heads.get(head)
        if known is None:
            if len(self._heads) > self.cache_size:
                self._heads.clear()
            known = self._heads[head] = PrefixTable(self, head)
        return known.copy().append(piece[HEAD:]).ids()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as int32."""
        sole(self)
        out = np.frombuffer(b"".join(map(self._seen.__getitem__, self.split(text))), np.int32)
        if len(self._seen) > self.cache_size:
            self._seen = _Seen(self, dict(self._seen))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Seen(dict):
    """Pieces -> ids as bytes; what is missing comes from the generation before or is encoded."""

    def __init__(self, vocabulary: BytePairs, old: dict):
        self.vocabulary, self.old = vocabulary, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        self[piece] = ids
        return ids


class PrefixTable:
    """last[i]: the one valid last token of the encoding of the first i bytes; size[i]: its length."""

    __slots__ = ("vocabulary", "data", "last", "size")

    def __init__(self, vocabulary: BytePairs, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.size = vocabulary, data, [-1], [0]
        self._extend()

    def copy(self) -> PrefixTable:
        other = PrefixTable.__new__(PrefixTable)
        other.vocabulary, other.data, other.last, other.size = self.vocabulary, self.data, self.last[:], self.size[:]
        return other

    def _extend(self, stop=None) -> int:
        """Computes entries up to the end, or until stop(i, token, size) says that the rest is known."""
        v, data, last, size = self.vocabulary, self.data, self.last, self.size
        get, pairs, longest = v.standing.get, v.pairs, v.longest
        begun = len(last)
        for i in range(begun, len(data) + 1):
            for a in range(i - longest if i > longest else 0, i):
                t = get(data[a:i])
                if t is not None:
                    if not a:
                        break
                    before = last[a]
                    fine = pairs.get(before << 32 | t)
                    if fine or fine is None and v.together(before, t):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(t)
            size.append(i - a)
            if stop and stop(i, t, i - a):
                break
        return len(last) - begun

    def append(self, more: bytes) -> PrefixTable:
        """The table of the text and ``more``; entries so far stay."""
        self.data += more
        self._extend()
        return self

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for the bytes start..end. Returns how many entries were computed: from the edit on, until as
        many in a row as a token can be long agree with the old ones and reach back to no byte before."""
        last, size = self.last[end + 1 :], self.size[end + 1 :]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :], self.size[start + 1 :]
        after, run = start + len(new), 0

        def agrees(i: int, token: int, n: int) -> bool:
            nonlocal run
            at = i - after - 1
            run = run + 1 if at >= 0 and last[at] == token and n <= i - after else 0
            return run > self.vocabulary.longest

        made = self._extend(agrees)
        known = len(self.last) - 1 - after
        if len(self.last) <= len(self.data):
            self.last.extend(last[known:])
            self.size.extend(size[known:])
        return made

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= self.size[i]
        return out[::-1]


def load(path: str, pattern: str) -> BytePairs:
    """The vocabulary, loaded once per process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True
) -> DataFrame:
    """Per row: doc_id, ids array<int> and, decoded from these ids, decoded binary."""
    frame = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in slices(batches, 128, bpe):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            cols = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
            if decode:
                cols.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    return frame.mapInArrow(run, "doc_id bigint, ids array<int>" + ", decoded binary" * decode)


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
