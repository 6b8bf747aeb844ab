"""Phrase collocations by position bitmaps.

A shard holds the texts of one part (language) that a task has read, about ``shard_words`` words: for each of its words the
bitmap of the places where it stands. Words of a piece have neighbouring places, and a place between pieces is left empty,
so no phrase reaches over a border. Shifting the bitmap of a phrase by one place and ANDing it with a word's gives the
phrase that is longer by this word; its popcount is how often it occurs. Every shard extends its phrases depth-first, and
the popcounts of all shards are summed. Sparse bitmaps (under ``DENSE`` places) are lists of places, as compressed bitmaps
keep them; those of one length are shifted and met together.

A phrase is frequent only if all its parts are. So that a shard need not count what is rare everywhere, hashes of its pairs,
then of longer phrases whose pairs are left, are counted first; what may be frequent comes back as a Bloom filter.

Scale: nothing is joined or shuffled by word. Hashes (6 bytes for each different one of a shard) and popcounts travel as sorted
blocks, dealt by ranges of the hash, so a frequent phrase is one entry for each shard; the sums of a range are one task's.
The filter has 16 bits for each hash that may be frequent, up to 2^28 (32 MB): beyond 16 million it lets more pass, which
costs work, not results. A shard is bounded by ``shard_words`` and one piece; long texts are cut between pieces. Words are
identified by 64 bits of a hash of part and word.

Defined results: a null text has no words, a null part is ``und``; repeated rows count each; blanks and tabs are the only
borders of words, all other characters belong to them; an empty table gives no rows. Of further columns none is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, temporary
from .shingles import STEP, mix

#: Lower-cases A-Z; ends of pieces become a line feed, blanks and tabs a blank.
PLAIN = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
END, NOTHING = 0, 1
CHUNK = 1 << 22
#: Places from which on a set of places is a bitmap, not a list.
DENSE = 64
#: Bits of the filter for each hash, its largest size, and its hash functions.
FILTER_BITS, FILTER_MOST = 16, 28
FILTER_SALT = np.arange(1, 4, dtype=np.uint64) * STEP
#: Entries of one range of hashes, about.
RANGE = 1 << 22


class _Numbers(dict):
    """Words of a shard, numbered as they come; the end of a piece is 0, what lies between two blanks 1."""

    def __init__(self):
        super().__init__({b"\n": END, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def chunks(text: bytes, size: int = CHUNK):
    """A text with plain borders, cut at ends of pieces where it is long."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


# ---------------------------------------------------------------- bitmaps


def packed(places: np.ndarray, sizes: np.ndarray) -> bytes:
    """Ascending places of each word, one word after the other -> their differences; the first of a word as it is."""
    gaps = np.diff(places, prepend=np.int64(0))
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[starts] = places[starts]
    return gaps.astype(np.uint32).tobytes()


def unpacked(data, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(np.frombuffer(data, np.uint32).astype(np.int64))
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0) if len(total) else np.zeros(len(sizes), np.int64)
    return total - np.repeat(before, sizes)


class Bitmap:
    """A set of places: numbers of its non-empty blocks of 64, ascending, and their bits."""

    __slots__ = ("bits", "block")

    def __init__(self, block: np.ndarray, bits: np.ndarray):
        self.block, self.bits = block, bits

    @classmethod
    def of(cls, places: np.ndarray) -> Bitmap:
        block = places >> 6
        first = np.flatnonzero(np.diff(block, prepend=np.int64(-1)))
        if not len(first):
            return cls(block, np.zeros(0, np.uint64))
        return cls(block[first], np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first))

    def count(self) -> int:
        return int(np.bitwise_count(self.bits).sum())

    def places(self) -> np.ndarray:
        row, bit = np.nonzero(np.unpackbits(self.bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return (self.block[row] << 6) + bit

    def shifted(self) -> Bitmap:
        """Every place one further."""
        over = self.bits >> np.uint64(63)
        carry = np.flatnonzero(over)
        block, bits = self.block, self.bits << np.uint64(1)
        if len(carry):
            block, bits = np.concatenate([block, self.block[carry] + 1]), np.concatenate([bits, over[carry]])
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            first = np.flatnonzero(np.diff(block, prepend=np.int64(-1)))
            block, bits = block[first], np.bitwise_or.reduceat(bits, first)
        full = bits != 0
        return Bitmap(block[full], bits[full])

    def __and__(self, other: Bitmap) -> Bitmap:
        small, large = (self, other) if len(self.block) <= len(other.block) else (other, self)
        at = np.searchsorted(large.block, small.block)
        at[at == len(large.block)] = 0
        bits = np.where(large.block[at] == small.block, large.bits[at] & small.bits, np.uint64(0)) if len(large.block) else small.bits[:0]
        full = np.flatnonzero(bits)
        return Bitmap(small.block[full], bits[full])


# ---------------------------------------------------------------- shards


def build_shards(docs: DataFrame, text: str, part: str, shard_words: int) -> DataFrame:
    """part, total (words), words, ids (of words), sizes (occurrences of each), bits (places of each, packed)."""

    def run(batches):
        held: dict[str, tuple[_Numbers, list]] = {}
        n = 0

        def flush():
            nonlocal n
            for name, (numbers, found) in held.items():
                every = np.concatenate(found)
                every = every[every != NOTHING]
                places = np.flatnonzero(every != END)
                own = every[places] - 2
                words = list(numbers)[2:]
                seed = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))
                ids = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
                sizes = np.bincount(own, minlength=len(words))
                bits = packed(places[np.argsort(own, kind="stable")], sizes)
                if words:
                    ends = pa.array([0, len(words)], pa.int32())
                    lists = (pa.array(words, pa.binary()).cast(pa.string()), pa.array(ids.view(np.int64)), pa.array(sizes.astype(np.int32)))
                    cols = [pa.array([name]), pa.array([len(own)], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([bits], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "total", "words", "ids", "sizes", "bits"])
            held.clear()
            n = 0

        for batch in slices(batches, 64):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for chunk in chunks(body.encode("utf-8", "surrogatepass").translate(PLAIN)):
                    if name not in held:
                        held[name] = (_Numbers(), [])
                    numbers, found = held[name]
                    tokens = chunk.replace(b"\n", b" \n ").split(b" ")
                    tokens.append(b"\n")
                    found.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                    n += len(tokens)
                    if n >= shard_words:
                        yield from flush()
        yield from flush()

    frame = docs.select(F.coalesce(F.col(part), F.lit("und")).alias("part"), F.col(text).alias("text")).filter("text IS NOT NULL")
    kinds = "part string, total bigint, words array<string>, ids array<bigint>, sizes array<int>, bits binary"
    return frame.mapInArrow(run, kinds)


class Shard:
    """The words of a shard by number: ids, places (word after word; those of w from first[w] to first[w + 1]), and at, the
    number of the word at each place (-1: none)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bits):
        self.ids = ids.view(np.uint64)
        self.places = unpacked(bits, sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.at = np.full(int(self.places.max(initial=-1)) + 2, -1, np.int32)
        self.at[self.places] = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self._bitmaps: dict[int, Bitmap] = {}

    @classmethod
    def each(cls, batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = (batch.column(c)[i].values.to_numpy() for c in (0, 1))
                yield cls(ids, sizes, batch.column(2)[i].as_buffer())

    def bitmap(self, w: int) -> Bitmap:
        if w not in self._bitmaps:
            self._bitmaps[w] = Bitmap.of(self.places[self.first[w] : self.first[w + 1]])
        return self._bitmaps[w]

    def longer(self, starts: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the phrases of ``length`` words at starts, from those of one word fewer."""
        return mix(codes * STEP + self.ids[self.at[starts + length - 1]])

    def followed(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are followed by one, and hashes of these pairs."""
        starts = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
        return starts, self.longer(starts, self.ids[self.at[starts]], 2)

    def left(self, most: int, known: Filter | None, pairs_only: bool = False):
        """(length, starts, hashes) of the phrases of 2 to ``most`` words all of whose parts, or all of whose pairs, are known."""
        starts, codes = self.followed()
        for length in range(2, most + 1):
            if length > 2:
                fine = np.zeros(len(self.at) + 1, bool)
                fine[starts if length == 3 or not pairs_only else pairs] = True
                keep = fine[starts + (length - 2 if pairs_only else 1)]
                starts, codes = starts[keep], codes[keep]
                codes = self.longer(starts, codes, length)
            if known is not None and (length == 2 or not pairs_only):
                keep = known.has(codes)
                starts, codes = starts[keep], codes[keep]
            if length == 2:
                pairs = starts
            yield length, starts, codes


# ---------------------------------------------------------------- what may be frequent


class Filter:
    """A Bloom filter of the leading ``width`` bits of hashes."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        """Bit numbers of keys in a filter of 2^size bits."""
        return [mix(keys + salt) >> np.uint64(64 - size) for salt in FILTER_SALT]

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for at in self.places(codes >> np.uint64(64 - self.width), (8 * len(self.bits)).bit_length() - 1):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return found


def hash_blocks(codes: list[np.ndarray], ranges: int):
    """Blocks of the different hashes of a shard: range, gaps (of the 32 bits after the range's, ascending), n (at most 65,535)."""
    key, n = np.unique(np.concatenate(codes) >> np.uint64(32 - ranges), return_counts=True)
    border = np.searchsorted(key >> np.uint64(32), np.arange((1 << ranges) + 1).astype(np.uint64))
    for r in np.flatnonzero(np.diff(border)).tolist():
        low = key[border[r] : border[r + 1]] & np.uint64(0xFFFFFFFF)
        gaps = np.diff(low, prepend=np.uint64(0)).astype(np.uint32)
        yield r, gaps.tobytes(), np.minimum(n[border[r] : border[r + 1]], 65_535).astype(np.uint16).tobytes()


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def may_be_frequent(shards: DataFrame, phrases, least: int, ranges: int) -> DataFrame:
    """phrases: shard -> hashes. key: the leading 32 + ``ranges`` bits of hashes that occur ``least`` times, of any phrases."""

    def blocks(batches):
        for shard in Shard.each(batches):
            codes = phrases(shard)
            rows = list(hash_blocks(codes, ranges)) if sum(map(len, codes)) else []
            if rows:
                yield _batch(rows, ["range", "gaps", "n"], [pa.int32(), pa.binary(), pa.binary()])

    def summed(key: list, n: list) -> tuple[np.ndarray, np.ndarray]:
        every, inverse = np.unique(np.concatenate(key), return_inverse=True)
        return every, np.bincount(inverse, weights=np.concatenate(n)).astype(np.int64)

    def sums(batches):
        now, key, n, held = None, [], [], 0

        def over():
            every, total = summed(key, n)
            every = every[total >= min(least, 65_535)].astype(np.int64) | now << 32
            return pa.RecordBatch.from_arrays([pa.array(every)], names=["key"])

        for b in batches:
            for r, gaps, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now and key:
                    yield over()
                    key, n, held = [], [], 0
                now = r
                key.append(np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.int64))
                n.append(np.frombuffer(count, np.uint16).astype(np.int64))
                held += len(n[-1])
                if held > 2 * RANGE:
                    one, two = summed(key, n)
                    key, n, held = [one], [two], 0
        if key:
            yield over()

    made = shards.select("ids", "sizes", "bits").mapInArrow(blocks, "range int, gaps binary, n binary")
    return made.repartition("range").sortWithinPartitions("range").mapInArrow(sums, "key bigint")


def build_filter(keys: DataFrame, width: int) -> Filter:
    """The filter of a stored table of keys; its bits come together in blocks of 4 KB, 32 MB at most."""
    count = keys.count()
    size = min(FILTER_MOST, max(15, (FILTER_BITS * max(1, count) - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.concatenate(Filter.places(b.column(0).to_numpy().astype(np.uint64), size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 0x7FFF)], names=["block", "bit"])

    made = keys.mapInArrow(run, "block bigint, bit bigint").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(1 << (size - 3), np.uint8)
    for r in made.collect():  # 8,192 blocks at most
        bits[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits, width)


# ---------------------------------------------------------------- popcounts


def popcounts(shard: Shard, known: Filter, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 2 to ``most`` words: (numbers of the words of each phrase of a shard, how often it occurs), of the phrases that
    the filter leaves."""
    fine = []
    for _, starts, _ in shard.left(most, known):
        fine.append(np.zeros(len(shard.at) + 1, bool))
        fine[-1][starts] = True
    dense: list[list] = [[] for _ in fine]
    sparse: list[list] = [[] for _ in fine]

    def extend(path: tuple, ends: Bitmap) -> None:
        """Phrases longer by one word than ``path``, which ends at ``ends``: a bitmap each, or places kept for later."""
        length = len(path) + 1
        shifted = ends.shifted()
        places = shifted.places()
        places = places[fine[length - 2][places - length + 1]]
        words, at, n = np.unique(shard.at[places], return_inverse=True, return_counts=True)
        rare = (n < DENSE)[at]
        if rare.any():
            sparse[length - 2].append(places[rare] - length + 1)
        for w in words[n >= DENSE].tolist():
            whole, met = (*path, w), shifted & shard.bitmap(w)
            dense[length - 2].append((whole, met.count()))
            if length < most:
                extend(whole, met)

    starts = np.flatnonzero(fine[0])
    words, n = np.unique(shard.at[starts], return_counts=True)
    for w in words[n >= DENSE].tolist():
        extend((w,), shard.bitmap(w))
    few = np.ones(len(shard.ids), bool)
    few[words[n >= DENSE]] = False
    sparse[0].append(starts[few[shard.at[starts]]])
    out, before = [], np.zeros(0, np.int64)
    for i, found in enumerate(sparse):
        length = i + 2
        before = np.concatenate([before, *found]).astype(np.int64)
        before = before[fine[i][before]]
        rows = np.stack([shard.at[before + j] for j in range(length)], axis=1)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
        many = np.array([p for p, _ in dense[i]], np.int64).reshape(-1, length)
        counts = np.concatenate([np.array([c for _, c in dense[i]], np.int64), np.diff(np.append(new, len(rows)))])
        out.append((np.concatenate([many, rows[new]]), counts))
    return out


def count_phrases(shards: DataFrame, known: Filter, least: int, most: int, ranges: int) -> DataFrame:
    """ids (of words), n: the phrases of 2 to ``most`` words that occur ``least`` times."""
    sent = shards.sparkSession.sparkContext.broadcast(known)
    names, kinds = ["range", "k", "ids", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def blocks(batches):
        for shard in Shard.each(batches):
            for words, n in popcounts(shard, sent.value, most):
                ids = shard.ids[words]
                code = ids[:, 0]
                for j in range(1, ids.shape[1]):
                    code = mix(code * STEP + ids[:, j])
                place = (code >> np.uint64(64 - ranges)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                border = np.searchsorted(place[order], np.arange((1 << ranges) + 1))
                rows = []
                for r in np.flatnonzero(np.diff(border)).tolist():
                    own = order[border[r] : border[r + 1]]
                    rows.append((r, ids.shape[1], ids[own].tobytes(), n[own].tobytes()))
                if rows:
                    yield _batch(rows, names, kinds)

    def sums(batches):
        now, ids, n = None, [], []

        def over():
            every, inverse = np.unique(np.concatenate(ids).reshape(-1, now[1]), axis=0, return_inverse=True)
            total = np.bincount(inverse.reshape(-1), weights=np.concatenate(n)).astype(np.int64)
            every, total = every[total >= least], total[total >= least]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, every.size + 1, now[1]), pa.int32()), pa.array(every.reshape(-1)))
            return pa.RecordBatch.from_arrays([flat, pa.array(total)], names=["ids", "n"])

        for b in batches:
            for r, k, own, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, k) != now and ids:
                    yield over()
                    ids, n = [], []
                now = (r, k)
                ids.append(np.frombuffer(own, np.int64))
                n.append(np.frombuffer(count, np.int64))
        if ids:
            yield over()

    made = shards.select("ids", "sizes", "bits").mapInArrow(blocks, "range int, k int, ids binary, n binary")
    return made.repartition("range", "k").sortWithinPartitions("range", "k").mapInArrow(sums, "ids array<bigint>, n bigint")


def frequent_phrases(
    docs: DataFrame, text: str = "text", part: str = "lang", least: int = 100, most: int = 5, shard_words: int = 4_000_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words (id, part, word, n), phrases (ids: array of word ids, n) of 2 to ``most`` words, each at least ``least`` times,
    and totals (part, total: all its words)."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        shards = stored(build_shards(docs, text, part, shard_words), "shards")
        totals = stored(shards.groupBy("part").agg(F.sum("total").alias("total")), "totals")
        every = totals.agg(F.sum("total")).first()[0] or 0
        ranges = min(16, max(4, (every // RANGE).bit_length()))
        slots = shards.select("part", F.explode(F.arrays_zip("words", "ids", "sizes")).alias("w"))
        slots = slots.select("part", F.col("w.words").alias("word"), F.col("w.ids").alias("id"), F.col("w.sizes").alias("n"))
        words = slots.groupBy("part", "word", "id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        words = stored(words, "words")
        pairs = stored(may_be_frequent(shards, lambda s: [s.followed()[1]], least, ranges), "keys")
        sent = spark.sparkContext.broadcast(build_filter(pairs, 32 + ranges))

        def longer(s: Shard) -> list[np.ndarray]:
            return [codes for length, _, codes in s.left(most, sent.value, pairs_only=True) if length > 2]

        keys = stored(may_be_frequent(shards, longer, least, ranges).union(pairs), "keys")
        phrases = stored(count_phrases(shards, build_filter(keys, 32 + ranges), least, most, ranges), "phrases")
        keep(words, phrases, totals)
    return words, phrases, totals


# ---------------------------------------------------------------- scores


def _key(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exactly: decimals of 38 digits, counts below 10^17."""
    a, n, left, right = (c.cast("decimal(17,0)") for c in (a, n, left, right))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), left * right)


def collocations(
    docs: DataFrame, top: int = 2000, absorb_percent: int = 100, most: int = 5, salts: int = 64, **options
) -> DataFrame:
    """The ``top`` phrases of each part: part, rank, phrase, a (occurrences), l, r (of the two sides of its weakest cut), n
    (words of the part), score. A phrase goes if a longer frequent one holds it and occurs ``absorb_percent`` as often."""
    words, phrases, totals = frequent_phrases(docs, most=most, **options)
    with temporary(docs.sparkSession) as keep:
        keyed = stored(phrases.select(_key(F.col("ids")).alias("key"), "ids", F.col("n").alias("a")), "phrases")
        counts = words.select(F.col("id").cast("string").alias("key"), "n").unionByName(keyed.select("key", F.col("a").alias("n")))
        inner = keyed.filter("size(ids) > 2").select("ids", "a", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("k"))
        inner = inner.select("ids", "a", "k", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("k") + 1)).alias("at"))
        inner = inner.select(_key(F.slice("ids", F.col("at"), F.col("k"))).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
        left = keyed.join(inner, "key", "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {absorb_percent} * a"))
        # all words of a phrase are of one part: its first tells which
        named = left.join(words.select(F.col("id"), "part"), F.get("ids", F.lit(0)) == F.col("id")).drop("id").join(totals, "part")
        cuts = named.select("key", "part", "ids", "a", "total", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("cut"))
        cuts = cuts.withColumn("first", _key(F.slice("ids", F.lit(1), F.col("cut"))))
        cuts = cuts.withColumn("rest", _key(F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut"))))
        cuts = cuts.join(counts.select(F.col("key").alias("first"), F.col("n").alias("l")), "first")
        cuts = cuts.join(counts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
        cuts = cuts.withColumn("score", _score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
        weakest = cuts.groupBy("key").agg(
            F.min(F.struct("score", "cut", "l", "r")).alias("w"), *(F.first(c).alias(c) for c in ("part", "ids", "a", "total"))
        )
        spelt = weakest.select("key", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("key")
        spelt = spelt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
        rows = weakest.join(spelt, "key").select("part", "phrase", "a", "w.l", "w.r", F.col("total").alias("n"), "w.score")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
        # the best of each of many slices of a part first, so no task ranks all its phrases
        some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
        out = stored(best.select("part", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        keep(out)
    return out
