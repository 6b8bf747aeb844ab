"""Substring deduplication: MinHash banding of paragraphs, exact Jaccard, components, removal of all but the first.

Paragraphs of at least ``min_words`` words are compared as near copies on three levels: real lines, blocks between blank
lines, and paragraphs cut by content for text without either: one starts at a word whose hash (with the word after it)
is least among 4 x ``half`` words on either side. A paragraph has the set of its five-word shingles; ``bands`` keys of one
MinHash each (recall 1 - (1 - J)^bands: 0.992 at J = 0.8 with 3, 1 for equal ones) propose pairs, the exact Jaccard
similarity of their sets decides, links form components (``near.linked``). Of each component the first occurrence (least
id, then position) stays.

A passage may stand anywhere in a text and be shorter than a line, so two more kinds of units are compared for equality
alone: pieces cut with ``half`` words (about a dozen words; one changed word leaves too few shingles for similarity) and
winnowed runs of words, of which any equal passage of ``passage`` words or more has one. A chain of equal runs is
extended word by word against the first occurrence to where it stops equalling it. What is removed of any kind is
united; a removed run of fewer than ``min_words`` words stays, it is a phrase, not a passage. min_words = 1 leaves none.

Scale: a first scan deals (key, unit) rows by key, repeats within a batch already counted; what no other unit or
occurrence shares, nearly everything, ends there. The hashes of what is left become a bit map of fixed size
(``FILTER_BITS``), sent to a second scan, which gives the places and sets of those units only; hashes that meet in the map
by chance come along and fall out in the joins, so the map's size decides speed, never results. Texts are shuffled for
the ends of equal runs only, and only those that have such ends. The only groups put together are a document's own
units.

Defined results: a null text counts as empty and has no paragraphs; repeated rows of one id and text are one document;
null ids sort first; positions are bytes of the UTF-8 text and never cut a character; an empty table gives no runs; of
further columns none is read, and ``remove_repeats`` keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, stored
from .near import linked
from .shingles import MIX2, STEP, U, Words, mix, window_hashes

TOP = U((1 << 64) - 1)
BITS = 56
#: Bits of the maps by which whole sets are compared before they are intersected.
WIDE = 1024
#: Size of the bit maps of wanted hashes: 8 MB.
FILTER_BITS = 1 << 26
#: Kinds of units. PIECE and RUN are compared for equality alone.
PIECE, CUT, LINE, BLOCK, RUN = range(5)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbouring values: of two halves of a window, cut at a multiple of
    ``width``, one is a suffix of a block and the other a prefix, so running extremes of blocks suffice."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    f = np.minimum if least else np.maximum
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, TOP if least else U(0))
    full[: len(values)] = values
    square = full.reshape(blocks, width)
    suffix = f.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    prefix = f.accumulate(square, axis=1).reshape(-1)
    return f(suffix[:n], prefix[width - 1 : width - 1 + n])


def cut(words: Words, half: int) -> np.ndarray:
    """Indexes of the words that start a paragraph."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64)
    value = mix(words.hash * STEP + np.concatenate([words.hash[1:], words.hash[:1]]))
    last = np.flatnonzero(np.diff(np.concatenate([words.text, [-1]])))
    value[last] = mix(words.hash[last])  # the last word has no word after it in its own text
    at = np.arange(n) + half * (words.text + 1)
    padded = np.full(at[-1] + half + 1, TOP)
    padded[at] = value
    least = sliding(padded, half)
    fine = (value < least[at - half]) & (value <= least[at + 1])
    fine[np.concatenate([[True], words.text[1:] != words.text[:-1]])] = True
    return np.flatnonzero(fine)


def winnow(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of words, and the hash of the ``k`` words from each: of every ``w`` neighbouring runs of k words those of
    least hash, so that equal passages of k + w - 1 words and more have one at the same place, at both ends as well."""
    if len(words.hash) < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, U)
    value = window_hashes(words.hash, k)
    least = sliding(value, w)
    inside = words.text[: len(least)] == words.text[k + w - 2 :]
    least = np.concatenate([np.zeros(w - 1, U), np.where(inside, least, U(0)), np.zeros(w - 1, U)])
    at = np.flatnonzero(sliding(least, w, False) == value)
    return at, value[at]


@dataclass
class Units:
    """Runs of words of a batch of texts: index of the first word, number of words, hash of the words."""

    kind: int
    first: np.ndarray
    size: np.ndarray
    node: np.ndarray


def _tiles(words: Words, kind: int, first: np.ndarray) -> Units:
    """Paragraphs that start at these words."""
    n = len(words.hash)
    size = np.append(first[1:], n).astype(np.int64) - first
    local = (np.arange(n) - np.repeat(first, size)).astype(U)
    node = mix(np.add.reduceat(mix(words.hash + local * STEP), first) + size.astype(U) * MIX2)
    return Units(kind, first, size, mix(node + mix(np.array([kind], U))))


def _lines(texts: list, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words that start a line, and those that follow a blank line or start a text."""
    raw = b"\n".join(t.encode("utf-8", "surrogatepass") if t else b"" for t in texts) + b"\n"
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), words.starts)
    step = np.diff(line, prepend=-2)
    new = np.diff(words.text, prepend=-1) > 0
    return np.flatnonzero((step > 0) | new), np.flatnonzero((step > 1) | new)


@dataclass(frozen=True)
class Sizes:
    half: int = 6
    min_words: int = 16
    passage: int = 50

    @property
    def run(self) -> int:
        # no shorter than half a passage, so that neighbouring runs of a passage overlap or touch
        return self.passage // 2 + 1

    @property
    def window(self) -> int:
        return self.passage - self.run + 1


def units(texts: list, words: Words, sizes: Sizes) -> Iterator[Units]:
    """All units of a batch of texts."""
    if not len(words.hash):
        return
    yield _tiles(words, PIECE, cut(words, sizes.half))
    line, block = _lines(texts, words)
    for kind, first in ((CUT, cut(words, 4 * sizes.half)), (LINE, line), (BLOCK, block)):
        u = _tiles(words, kind, first)
        keep = u.size >= sizes.min_words
        if kind == BLOCK:  # of several lines
            keep &= np.searchsorted(line, first + u.size) - np.searchsorted(line, first) > 1
        yield Units(kind, u.first[keep], u.size[keep], u.node[keep])
    at, value = winnow(words, sizes.run, sizes.window)
    yield Units(RUN, at, np.full(len(at), sizes.run), mix(value + mix(np.array([RUN], U))))


class Shingles:
    """MinHash keys and bit maps of the paragraphs of a batch."""

    def __init__(self, words: Words, bands: int, k: int = 5):
        n = len(words.hash)
        self.k, windows = k, np.zeros(n + 1, U)
        windows[: max(0, n - k + 1)] = window_hashes(words.hash, k)
        self.short = (windows >> U(32)).astype(np.uint32)
        self.hashes = [mix(windows ^ U(j * 0x9E3779B9 + 1)) for j in range(bands)]
        self.bits = U(1) << (self.short % np.uint32(BITS)).astype(U)

    def banded(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """Of units in the order of a text: keys, one column for each band; mark: a map of BITS bits of the set of
        shingles, and above it their number, 255 and more as 255."""
        count = np.maximum(u.size - self.k + 1, 1)
        ends = np.stack([u.first, u.first + count], 1).reshape(-1)
        seed = [U(j + 1 + 1000 * u.kind) for j in range(len(self.hashes))]
        keys = np.stack([mix(np.minimum.reduceat(h, ends)[::2] + s) for h, s in zip(self.hashes, seed, strict=True)], 1)
        bits = np.bitwise_or.reduceat(self.bits, ends)[::2]
        few = u.size < self.k  # such a paragraph has its node for a shingle
        keys[few] = mix(u.node[few, None] + np.array(seed, U))
        bits[few] = U(1) << (u.node[few] % U(BITS))
        return keys, bits | (np.minimum(count, 255).astype(U) << U(BITS))

    def content(self, u: Units, i: int) -> np.ndarray:
        """The set of a paragraph: 32-bit shingles."""
        first, size = u.first[i], u.size[i]
        if size < self.k:
            return np.array([u.node[i] >> U(32)], np.uint32).view(np.int32)
        return np.unique(self.short[first : first + size - self.k + 1]).view(np.int32)


def possible_columns(a, b, threshold: float):
    """False only for marks of sets that are less similar: sets that differ in d shingles have maps that differ in at most
    d bits, and similar sets differ in at most (1 - t) of their union, which is at most (|A| + |B|) / (1 + t)."""
    size = lambda m: F.shiftrightunsigned(m, BITS)
    differ = F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit((1 << BITS) - 1)))
    return (differ * (1 + threshold) <= (size(a) + size(b)) * (1 - threshold) + 1e-9) | (F.greatest(size(a), size(b)) == 255)


def possible_matrix(a: list[int], b: list[int], threshold: float) -> np.ndarray:
    """The same for all pairs of two lists."""
    x, y = np.asarray(a, np.int64).view(U)[:, None], np.asarray(b, np.int64).view(U)[None, :]
    p, q = (x >> U(BITS)).astype(int), (y >> U(BITS)).astype(int)
    differ = np.bitwise_count((x ^ y) & U((1 << BITS) - 1))
    return (differ * (1 + threshold) <= (p + q) * (1 - threshold) + 1e-9) | (np.maximum(p, q) == 255)


def possible_pairs(marks: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The same for pairs of places of a list."""
    x, size = marks.view(U) & U((1 << BITS) - 1), (marks.view(U) >> U(BITS)).astype(np.int64)
    p, q = size[a], size[b]
    return (np.bitwise_count(x[a] ^ x[b]) * (1 + threshold) <= (p + q) * (1 - threshold) + 1e-9) | (np.maximum(p, q) == 255)


def possible_sets(contents: pa.ListArray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The same for pairs of places of whole sets, by maps of WIDE bits, which tell long sets apart as well."""
    size = np.diff(contents.offsets.to_numpy()).astype(np.int64)
    bits = np.zeros((len(contents), WIDE), bool)
    bits[np.repeat(np.arange(len(size)), size), contents.flatten().to_numpy() & (WIDE - 1)] = True
    maps = np.packbits(bits, axis=1).view(U)
    out = np.zeros(len(a), bool)
    step = 1 << 14  # pairs at a time
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
        out[i : i + step] = differ * (1 + threshold) <= (size[x] + size[y]) * (1 - threshold) + 1e-9
    return out


def _shared_keys(texts: DataFrame, sizes: Sizes, bands: int) -> DataFrame:
    """key, node, mark, shared (another node has the key), again (the node has more than one occurrence) of keys that have
    more than one occurrence. Of units compared for equality key is the node, and mark null."""
    from pyspark.sql import Window

    def run(batches):
        for batch in slices(batches, 256):
            body = batch.column(2).to_pylist()
            words = Words(body)
            shingles = Shingles(words, bands)
            for u in units(body, words, sizes):
                node, at, n = np.unique(u.node, return_index=True, return_counts=True)
                if not len(node):
                    continue
                if u.kind in (PIECE, RUN):
                    key, mark = node, pa.nulls(len(node), pa.int64())
                else:
                    keys, mark = shingles.banded(u)
                    key, node, n = keys[at].reshape(-1), np.repeat(node, bands), np.repeat(n, bands)
                    mark = pa.array(np.repeat(mark[at], bands).view(np.int64))
                cols = [pa.array(key.view(np.int64)), pa.array(node.view(np.int64)), mark, pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "mark", "n"])

    found = texts.mapInArrow(run, "key bigint, node bigint, mark bigint, n int").repartition("key")
    rows = found.groupBy("key", "node").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    w = Window.partitionBy("key")
    shared = F.min("node").over(w) != F.max("node").over(w)
    seen = rows.select("key", "node", "mark", (F.col("n") > 1).alias("again"), shared.alias("shared"), F.sum("n").over(w).alias("total"))
    return seen.filter("total > 1").select("key", "node", "mark", "shared", "again")


def _with_partner(shared: DataFrame, threshold: float, most: int = 256) -> DataFrame:
    """key, node, mark of rows whose mark may be similar to that of another row of the key. Many paragraphs share a common
    run of words and nothing else: they end here. A key of over ``most`` rows goes on whole."""

    def keep(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        fine = np.zeros(len(key), bool)
        two = start[size == 2]
        x, y = mark[two].view(U), mark[two + 1].view(U)
        p, q = (x >> U(BITS)).astype(int), (y >> U(BITS)).astype(int)
        differ = np.bitwise_count((x ^ y) & U((1 << BITS) - 1))
        good = (differ * (1 + threshold) <= (p + q) * (1 - threshold) + 1e-9) | (np.maximum(p, q) == 255)
        fine[two[good]] = fine[two[good] + 1] = True
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > most:
                fine[a : a + n] = True
                continue
            near = possible_matrix(mark[a : a + n], mark[a : a + n], threshold)
            np.fill_diagonal(near, False)
            fine[a : a + n] = near.any(1)
        return fine

    def run(batches):
        rest, hot = None, None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            key = cols[0]
            if not len(key):
                continue
            last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            fine = keep(key[:last], cols[2][:last]) if last else np.zeros(0, bool)
            if hot is not None:
                fine |= key[:last] == hot
            out = [c[:last][fine] for c in cols]
            rest = [c[last:] for c in cols]
            if len(rest[0]) > most:  # a key that goes on whole need not be held
                hot = rest[0][0]
                out = [np.concatenate(x) for x in zip(out, rest, strict=True)]
                rest = None
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["key", "node", "mark"])
        if rest is not None and len(rest[0]):
            fine = keep(rest[0], rest[2]) | (rest[0] == hot if hot is not None else False)
            yield pa.RecordBatch.from_arrays([pa.array(c[fine]) for c in rest], names=["key", "node", "mark"])

    return shared.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, node bigint, mark bigint")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of FILTER_BITS bits of a column of 64-bit hashes, put together on the executors: 8 MB reach the driver,
    however many hashes there are."""
    value = F.col(hashes.columns[0])
    word = F.shiftrightunsigned(value.bitwiseAND(F.lit(FILTER_BITS - 1)), 6).cast("int")
    bit = F.expr("shiftleft(1L, cast(`{}` & 63 AS int))".format(hashes.columns[0]))
    got = hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def in_map(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    low = value.view(U) & U(FILTER_BITS - 1)
    return (bits[(low >> U(6)).astype(np.int64)].view(U) >> (low & U(63))) & U(1) == 1


def _unroll(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Of a column of lists of structs: the row and the struct of each entry."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True for rows, of sorted ones, that differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers 0 to n - 1 of each entry, one after the other, and the entry of each."""
    entry = np.repeat(np.arange(len(n)), n)
    return np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n), entry


def _lists(n: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of n values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def _sets(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Of each of n owners the distinct values, sorted."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = _changes(owner, values)
    return _lists(np.bincount(owner[new], minlength=n), pa.array(values[new]))


SEEN = "doc_id bigint, row bigint, at int, start int, end int, n_words int, kind int, node bigint, content array<int>"


def _seen(texts: DataFrame, sizes: Sizes, wanted: np.ndarray, paired: np.ndarray) -> DataFrame:
    """doc_id, row, at (first word), start, end (bytes, up to the next word), n_words, kind, node of every unit whose node
    is in the map ``wanted``; content of those in ``paired``, once for a batch."""
    sc = texts.sparkSession.sparkContext
    maps = sc.broadcast((wanted, paired))

    def run(batches):
        own, pairs = maps.value
        for batch in slices(batches, 256):
            body = batch.column(2).to_pylist()
            words = Words(body)
            shingles = None
            stop = words.offsets[1:] - 1
            for u in units(body, words, sizes):
                keep = in_map(own, u.node)
                if not keep.any():
                    continue
                u = Units(u.kind, u.first[keep], u.size[keep], u.node[keep])
                owner = words.text[u.first]
                after = u.first + u.size
                inside = np.append(words.text, -1)[after] == owner
                end = np.where(inside, np.append(words.starts, 0)[after], stop[owner]) - words.offsets[owner]
                content: list = [None] * len(owner)
                if u.kind not in (PIECE, RUN):
                    node, first = np.unique(u.node, return_index=True)
                    for i in first[in_map(pairs, node)].tolist():
                        shingles = shingles or Shingles(words, 0)
                        content[i] = shingles.content(u, i)
                ints = [u.first - words.first[owner], words.starts[u.first] - words.offsets[owner], end, u.size]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        batch.column(1).take(pa.array(owner)),
                        *(pa.array(x.astype(np.int32)) for x in ints),
                        pa.array(np.full(len(owner), u.kind, np.int32)),
                        pa.array(u.node.view(np.int64)),
                        pa.array(content, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "row", "at", "start", "end", "n_words", "kind", "node", "content"],
                )

    return texts.mapInArrow(run, SEEN)


def _of_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked: doc_id, row, ask. doc_id, row, asks, text of the texts asked for; others are not shuffled."""
    asks = asked.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("ask").alias("asks"))
    asks = stored(asks, "asks")
    few = texts.sparkSession.sparkContext.broadcast(bit_map(asks.select(F.xxhash64("d", "r").alias("h"))))

    def run(batches):
        for batch in batches:
            keep = in_map(few.value, batch.column(3).to_numpy())
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    some = texts.select("doc_id", "row", "text", F.xxhash64("doc_id", "row").alias("h")).mapInArrow(run, "doc_id bigint, row bigint, text string")
    joined = asks.join(some, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("r").eqNullSafe(F.col("row")))
    return joined.select("doc_id", "row", "asks", "text")


ENDS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("right", pa.bool_()), ("at", pa.int32())]
    + [("kept", pa.int64()), ("kept_row", pa.int64()), ("kept_at", pa.int32()), ("same", pa.bool_()), ("ids", pa.list_(pa.int64()))]
)
BESIDE = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("right", pa.bool_())]
    + [("beside", pa.list_(pa.int32())), ("edges", pa.list_(pa.int32()))]
)


def _passages(runs: DataFrame, firsts: DataFrame, texts: DataFrame, sizes: Sizes) -> DataFrame:
    """runs: doc_id, row, at, node of repeated runs of words; firsts: node, first (doc_id, row, at). doc_id, row, at,
    start, end, n_words, kept (doc_ids): passages all of whose words occur before, of overlapping and touching runs.

    Both ends are extended word by word as far as they equal the first occurrence of a run beside them. A passage of
    ``passage`` words or more has a run within w - 1 words of each of its ends, so one that goes on beyond an end of a
    chain has a run within w - 1 words inside of that end: those runs, a few for each end, are all that is extended, and
    w - 1 words beside each are all that is compared."""
    k, w = sizes.run, sizes.window

    def chains(batches):
        for batch in slices(batches, 256):
            text, hits = _unroll(batch.column(2))
            order = np.lexsort((hits.field(0).to_numpy(), text))
            text, hits = text[order], hits.take(pa.array(order))
            at, row, kept_at = (hits.field(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
            none = hits.field(1).is_null().to_numpy(zero_copy_only=False)
            kept = hits.field(1).fill_null(0).to_numpy()
            new = _changes(text)
            new[1:] |= at[1:] > at[:-1] + k
            chain, start = np.cumsum(new) - 1, np.flatnonzero(new)
            first, last = at[start], at[np.append(start[1:], len(at)) - 1] if len(at) else at
            ids = _sets(chain[~none], kept[~none], len(start))
            for right in (False, True):
                use = np.flatnonzero((last[chain] - at if right else at - first[chain]) < w)
                use = use[::-1] if right else use
                passage = [c[use] for c in (chain, none, kept, row, at - kept_at)]
                order = np.lexsort(passage[::-1])  # stable: the hit next to the end comes first
                # runs of one passage would all be extended to the same word
                use = use[order][_changes(*(c[order] for c in passage))]
                own = pa.array(text[use])
                ends = [first[chain[use]].astype(np.int32), last[chain[use]].astype(np.int32), np.full(len(use), right), at[use].astype(np.int32)]
                kept_of = [c.take(pa.array(use)) for c in hits.flatten()[1:]]
                cols = [batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, ends), *kept_of, ids.take(pa.array(chain[use]))]
                yield pa.RecordBatch.from_arrays(cols, schema=ENDS)

    def besides(batches):
        for batch in slices(batches, 128):
            words = Words(batch.column(3).to_pylist())
            text, asks = _unroll(batch.column(2))
            at, right = asks.field(0).to_numpy().astype(np.int64), asks.field(1).to_numpy(zero_copy_only=False)
            own = (words.hash >> U(32)).astype(np.uint32).view(np.int32)
            # bytes at which words begin, and the end of each text
            number, begin = np.arange(batch.num_rows), np.zeros(len(own) + batch.num_rows, np.int32)
            begin[np.arange(len(own)) + words.text] = words.starts - words.offsets[words.text]
            begin[words.first[1:] + number] = np.diff(words.offsets) - 1
            n = np.minimum(w - 1, np.where(right, np.diff(words.first)[text] - at - k, at))
            from_, step = words.first[text] + np.where(right, at + k, at), np.where(right, 1, -1)
            i, ask = _spread(n)
            beside = own[(from_ - ~right)[ask] + step[ask] * i]
            i, ask = _spread(n + 1)
            edges = begin[(from_ + text)[ask] + step[ask] * i]
            ids = [batch.column(c).take(pa.array(text)) for c in (0, 1)]
            cols = [*ids, asks.field(0), asks.field(1), _lists(n, pa.array(beside)), _lists(n + 1, pa.array(edges))]
            yield pa.RecordBatch.from_arrays(cols, schema=BESIDE)

    found = runs.join(firsts.select("node", F.col("first").alias("kept")), "node")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & F.col("row").eqNullSafe(F.col("kept.row"))
    # in one text the first occurrence itself stays whole
    found = found.filter(~same | (F.col("at") >= F.col("kept.at") + k))
    hit = F.struct("at", "kept.doc_id", "kept.row", F.col("kept.at").alias("kept_at"), same.alias("same"))
    of_text = found.groupBy("doc_id", "row").agg(F.collect_list(hit).alias("hits"))
    kinds = "doc_id bigint, row bigint, first int, last int, right boolean, at int, kept bigint, kept_row bigint, kept_at int, same boolean"
    ends = stored(of_text.mapInArrow(chains, kinds + ", ids array<bigint>"), "ends")
    own = ends.select("doc_id", "row", F.struct("at", "right").alias("ask"))
    other = ends.select(F.col("kept").alias("doc_id"), F.col("kept_row").alias("row"), F.struct(F.col("kept_at").alias("at"), "right").alias("ask"))
    around = _of_texts(own.union(other).distinct(), texts)
    around = around.mapInArrow(besides, "doc_id bigint, row bigint, at int, right boolean, beside array<int>, edges array<int>")
    around = stored(around.dropDuplicates(["doc_id", "row", "at", "right"]), "beside")
    place = F.struct("doc_id", "row", "at", "right")
    side = around.select(place.alias("place"), "beside", "edges")
    kept_side = around.select(place.alias("kept_place"), F.col("beside").alias("beside_kept"))
    kept_place = F.struct(F.col("kept").alias("doc_id"), F.col("kept_row").alias("row"), F.col("kept_at").alias("at"), "right")
    both = ends.withColumn("place", place).join(side, "place").withColumn("kept_place", kept_place).join(kept_side, "kept_place")

    differ = F.array_position(F.zip_with("beside", "beside_kept", lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    equal = F.when(differ == 0, F.size("beside")).otherwise(differ - 1)
    room = F.when(F.col("same") & ~F.col("right"), F.col("at") - F.col("kept_at") - k).otherwise(F.lit(w))
    both = both.withColumn("more", F.least(equal, room)).withColumn("edge", F.get("edges", "more"))
    start = F.when(~F.col("right"), F.col("at") - F.col("more"))
    stop = F.when(F.col("right"), F.col("at") + F.col("more") + k)
    return (
        both.groupBy("doc_id", "row", "first", "last")
        .agg(
            F.min(start).alias("at"),
            F.min_by("edge", start).alias("start"),
            F.max_by("edge", stop).alias("end"),
            F.max(stop).alias("stop"),
            F.first("ids").alias("kept"),
        )
        .select("doc_id", "row", "at", "start", "end", (F.col("stop") - F.col("at")).alias("n_words"), "kept")
    )


def _joined(hit: DataFrame, min_words: int) -> DataFrame:
    """hit: doc_id, row, parts. Overlapping and touching parts of a text become runs; those too short fall out."""
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int64())]
        + [("kept_doc_ids", pa.list_(pa.int64()))]
    )

    def run(batches):
        for batch in slices(batches, 512):
            text, parts = _unroll(batch.column(2))
            at, after = (parts.field(i).to_numpy().astype(np.int64) for i in (0, 3))
            after = at + after
            order = np.lexsort((after, at, text))
            text, parts, at, after = text[order], parts.take(pa.array(order)), at[order], after[order]
            if not len(at):
                continue
            # the last word so far: texts are set apart, so that one running greatest value serves all of them
            apart = text * (after.max() + 2)
            until = np.maximum.accumulate(after + apart)
            new = np.concatenate([[True], (at + apart)[1:] > until[:-1]])
            run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            size = until[last] - apart[last] - at[first]
            far = np.flatnonzero(after + apart == until[last][run])  # parts that reach the end of their run
            far = far[_changes(run[far])]
            start, end = parts.field(1).take(pa.array(first)), parts.field(2).take(pa.array(far))
            of, ids = np.repeat(run, np.diff(parts.field(4).offsets.to_numpy())), parts.field(4).flatten()
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            kept = _sets(of[there], ids.fill_null(0).to_numpy()[there], len(first))
            own = pa.array(text[first])
            cols = [batch.column(0).take(own), batch.column(1).take(own), start, end, pa.array(size), kept]
            yield pa.RecordBatch.from_arrays(cols, schema=kinds).filter(pa.array(size >= min_words))

    return hit.mapInArrow(run, "doc_id bigint, row bigint, start int, end int, n_words bigint, kept_doc_ids array<bigint>")


def repeated_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    half: int = 6,
    bands: int = 3,
    min_words: int = 16,
    passage: int = 50,
) -> DataFrame:
    """doc_id, row, start, end, n_words, kept_doc_ids: the runs of paragraphs that occur before (lesser id, or earlier
    in the same text), with the ids of the documents that keep them."""
    sizes = Sizes(half, min_words, passage)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    keys = stored(_shared_keys(texts, sizes, bands), "keys")
    buckets = stored(_with_partner(keys.filter("shared").select("key", "node", "mark"), threshold), "buckets")
    paired = bit_map(buckets.select("node"))
    seen = stored(_seen(texts, sizes, bit_map(keys.filter("again").select("node")) | paired, paired), "places")
    drop(keys)
    place = F.struct("doc_id", "row", "at")
    nodes = stored(
        seen.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("kind").alias("kind")), "nodes"
    )
    own_keys = stored(buckets.groupBy("node").agg(F.collect_set("key").alias("keys"), F.first("mark").alias("mark")), "own")
    sets = seen.filter("content IS NOT NULL").select("node", "content").dropDuplicates(["node"])
    content = stored(own_keys.join(sets, "node").select("node", "keys", "mark", "content"), "content")

    def verify(pairs: DataFrame) -> DataFrame:
        a = content.select(F.col("node").alias("a"), F.col("content").alias("sa"))
        b = content.select(F.col("node").alias("b"), F.col("content").alias("sb"))
        # |A and B| >= t |A or B|, written so that the intersection is made once, and not where the sizes tell
        t, x, y = threshold - 1e-12, F.size("sa"), F.size("sb")
        enough = F.size(F.array_intersect("sa", "sb")) * (1 + t) >= (x + y) * t
        return pairs.join(a, "a").join(b, "b").filter((F.least(x, y) >= F.greatest(x, y) * t) & enough).select("a", "b")

    def exact(rows: list) -> Callable:
        memo: dict[int, set] = {}

        def own(i: int) -> set:
            if i not in memo:
                column, at = rows[i]
                memo[i] = set(column[at].values.to_numpy().tolist())
            return memo[i]

        def similar(i: int, j: int) -> bool:
            both = len(own(i) & own(j))
            return both >= threshold * (len(own(i)) + len(own(j)) - both) - 1e-9

        return similar

    labels, _ = linked(
        buckets,
        verify,
        content,
        exact,
        lambda marks, a, b: possible_pairs(marks.to_numpy(), a, b, threshold),
        False,
        lambda a, b: possible_columns(a, b, threshold),
        size=F.greatest(F.size("content"), F.lit(1)),
        ratio=threshold,
        closer=lambda contents, a, b: possible_sets(contents, a, b, threshold),
    )
    named = nodes.filter(F.col("kind") != RUN).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "named")
    kept = named.groupBy("label").agg(F.min("first").alias("kept"), F.max("last").alias("last")).filter("kept <> last")
    removal = stored(named.join(kept.select("label", "kept"), "label").select("node", "kept"), "removal")
    for used in (labels, named, content, own_keys, buckets):
        drop(used)
    copies = seen.drop("content").join(removal, "node").filter(~place.eqNullSafe(F.col("kept")))
    again = nodes.filter((F.col("kind") == RUN) & (F.col("first") != F.col("last")))
    passages = _passages(seen.filter(F.col("kind") == RUN).select("doc_id", "row", "at", "node"), stored(again, "again"), texts, sizes)
    parts = copies.select("doc_id", "row", "at", "start", "end", "n_words", F.array("kept.doc_id").alias("kept")).union(passages)
    hit = parts.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "start", "end", "n_words", "kept")).alias("parts"))
    return _joined(hit, min_words)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents with repeated runs cut out of text and n_chars set anew; every column kept. A document of
    which nothing but blanks and marks is left goes; one that had no words before stays."""
    runs = repeated_runs(docs, **options)
    cuts = runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    frame = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("bigint").alias("own"), F.xxhash64("text").alias("digest"))
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("row"))
    joined = frame.join(cuts, same, "left").select("whole", "cuts")
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in slices(batches, 256):
            cols = [batch.column(0).field(i) for i in range(len(names))]
            texts, cuts_of = cols[at].to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, own in enumerate(cuts_of):
                if own:
                    raw, last, left = texts[i].encode("utf-8", "surrogatepass"), 0, []
                    for c in own:
                        left.append(raw[last : c["start"]])
                        last = c["end"]
                    texts[i] = b"".join([*left, raw[last:]]).decode("utf-8", "surrogatepass")
                keep.append(not own or any(c.isalnum() for c in texts[i]))
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                sizes = [len(t) if own else None for t, own in zip(texts, cuts_of, strict=True)]
                old = cols[count].to_pylist()
                cols[count] = pa.array([o if s is None else s for s, o in zip(sizes, old, strict=True)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
