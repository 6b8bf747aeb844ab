"""Token-ID output as a content-addressed store.

Every document's id stream is cut where a rolling hash over the last few ids says so (content-defined chunking), so
equal passages give equal chunks wherever they stand. A chunk is stored once under its digest; a document is a recipe,
the list of its chunks' digests; manifests hold Merkle roots over recipes so that a copy can be verified.

Layout under the store's path (all written and read through Spark's file systems):
  chunks/    parquet: digest binary(16), n int, data binary   each distinct chunk once; data: zstd of the ids
  recipes/   parquet: doc_id, start (in its part), n_tokens, digests array<binary>, root binary(32), part; in ascending
             doc_id order, inside the files and from file to file by name: each task writes one part
  parts/     parquet: part, before: the ids in all parts before it; start in all = before + start in the part
  manifest/  parquet: part, n_docs, n_tokens, root            one row for each run of recipes, and part -1 for all

Ids are little-endian, two bytes wide if the vocabulary fits, else four. A chunk's rows carry no order; recipes do.

Scale: texts are encoded once; encoded documents are staged in the shared folder; the one shuffle that carries ids
deals chunks by digest, after each task has dropped its own repeats, so a text with a million copies costs one chunk a
task. Starts are prefix sums in two levels (within range partitions, then over at most a few thousand totals). What
reads back combines the chunks' CRCs by recipe, so ids are not shuffled again. Defined results: a null text counts as
empty and still has the end id; rows of one doc_id stand next to each other in the order of their roots; null ids stand
first; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, new_path, slices, sole
from .token_counts import load_tokenizer

#: Multipliers of the rolling hash over four ids, the share of places where it cuts, and chunk sizes in ids.
ROLL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
CUT_BITS, LEAST, MOST = 10, 128, 8192
#: Of bytes: 1 lower-case ASCII letters, 2 ASCII marks without the apostrophe, 0 the others.
CLASSES = np.array([1 if 97 <= c <= 122 else 2 if 33 <= c <= 126 and c != 39 and not chr(c).isalnum() else 0 for c in range(256)], np.uint8)
#: Runs of lower-case ASCII letters and letters up to U+023F (without U+0130, which falls into two when lowered): NFC leaves
#: them as they are, and each is lowered alone.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+")
#: The characters that byte-level models have for bytes, as UTF-16; the blank stays.
BYTE_CHARS = np.arange(256, dtype="<u2")
BYTE_CHARS[[b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]] = np.arange(256, 324)
BYTE_CHARS[32] = 32


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: where the hash of the last four ids has CUT_BITS zero bits on top, at least
    LEAST ids after the last cut, at most MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    x = ids.astype(np.uint64)
    h = x[3:] * ROLL[0] + x[2:-1] * ROLL[1] + x[1:-2] * ROLL[2] + x[:-3] * ROLL[3]
    h = (h ^ (h >> np.uint64(29))) * ROLL[0]
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 4).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


@lru_cache(maxsize=65_536)
def _shifted(n_bytes: int) -> tuple[int, ...]:
    """What each bit of a CRC-32 becomes when n_bytes zero bytes follow."""
    blank = zlib.crc32(bytes(n_bytes))

    def one(bit: int) -> int:  # crc of (4 bytes whose crc differs in that bit from 4 zero bytes) and the zeros
        return zlib.crc32(bytes(n_bytes), bit) ^ blank

    return tuple(one(1 << b) ^ 0 for b in range(32))


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from their CRCs and the second's length. CRC-32 is affine in its
    start value, so the first CRC's bits move linearly."""
    table, b = _shifted(n_bytes), 0
    while first:
        if first & 1:
            second ^= table[b]
        first >>= 1
        b += 1
    return second


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 tree; an odd node moves up as it is; no leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [
            hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


class WordCache:
    """Encodes texts with the tokenizers library, one call for many new runs of characters between blanks, which are
    remembered in two generations. Exact for tokenizers that lower-case, whose normalizer works on both sides of a blank
    alone, and whose pre-tokenizer drops white space and keeps runs of letters and of ASCII marks apart. PROBES tell
    whether a tokenizer is of that kind; with another one all texts go to the library as they are.

    A new run of Latin letters is one pre-token, so the library's model alone encodes it where the tokenizer is made of
    steps known to leave such runs whole. Other new runs are encoded together with a mark between them: a control
    character that is one id and that no run holds. A text that would hold a special string once it is lower-cased, or the mark, goes to the library as it is."""

    MARK = "\x01"
    PROBES = (
        "It's what THEY'LL say: e.g. Mr. O'Neil (aged 42), isn't it?!",
        "one,two ; three.four ... five!? a_b x-y #tag @me 3.14 1,000",
        " Größe  É\u0301 語言 ﬁ \t tab\nline end. ",
        "don't. 'quoted' \"both\" U.S.A. a.b.c x'. it's, we've; I'd",
    )

    def __init__(self, path: str, width: str, most: int = 450_000):
        self.tokenizer, self.width, self.most = load_tokenizer(path), width, most
        self.mark = self._library([self.MARK])[0]
        self.special = tuple(t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ascii = self._without_normalizer()
        self.model = self.tokenizer.model if self._letters_are_whole() else None
        self.forget()
        self.by_runs = len(self.mark) == 1
        if self.by_runs:
            made = self.encode([p.encode() for p in self.PROBES])
            self.by_runs &= made == [x.tobytes() for x in self._library(list(self.PROBES))]

    def forget(self) -> None:
        self.known = _Known({})

    def _without_normalizer(self):
        """The same tokenizer for lower-case ASCII, if its normalizer leaves that as it is, white space apart."""
        own = json.loads(self.tokenizer.to_str())
        steps = own["normalizer"] or {}
        kinds = {x["type"] for x in steps.get("normalizers", [steps] if steps else [])}
        if not kinds or not kinds <= {"NFC", "Lowercase", "Replace"} or any(
            x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": "\\s+"}, " ") for x in steps.get("normalizers", [steps])
        ):
            return self.tokenizer
        return type(self.tokenizer).from_str(json.dumps(own | {"normalizer": None}))

    def _letters_are_whole(self) -> bool:
        """Whether a run of letters is only lowered, is one pre-token, and goes to the model as characters for bytes."""
        own = json.loads(self.tokenizer.to_str())
        lowers = any(x["type"] == "Lowercase" for x in (own["normalizer"] or {}).get("normalizers", []))
        steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = {k: v for k, v in steps[0].items() if k != "pattern"} if len(steps) == 2 else {}
        return (
            lowers
            and self.ascii is not self.tokenizer
            and own["model"]["type"] == "BPE"
            and not own["model"]["dropout"]
            and split == {"type": "Split", "behavior": "Removed", "invert": True}
            and steps[0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
            and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
        )

    def _library(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: dict[bytes, bytearray]) -> None:
        """Encodes new runs; fills their places in the texts that wait for them, and remembers them."""
        known, size = self.known, int(self.width[2])
        between = f" {self.MARK} ".encode()
        runs: tuple[list, list] = [], []
        letters: list[bytes] = []
        for w in new:
            whole = self.model and (w.isalpha() or LETTERS.fullmatch(w))  # bytes.isalpha() knows ASCII letters only
            (letters if whole else runs[0] if w.isascii() else runs[1]).append(w)
        if letters:
            tokenize, ids, ends = self.model.tokenize, [], []
            low = b" ".join(letters).decode().lower()
            for chars in BYTE_CHARS[np.frombuffer(low.encode(), np.uint8)].tobytes().decode("utf-16-le").split(" "):
                ids += [t.id for t in tokenize(chars)]
                ends.append(len(ids) * size)
            data, last = np.array(ids, self.width).tobytes(), 0
            for w, end in zip(letters, ends, strict=True):
                known[w] = part = data[last:end]
                new[w] += part
                last = end
        for some, tokenizer in ((r[at : at + 2000], t) for r, t in zip(runs, (self.ascii, self.tokenizer), strict=True) for at in range(0, len(r), 2000)):
            (ids,) = self._library([between.join(some).decode("utf-8", "surrogatepass")], tokenizer)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(some) - 1:  # the tokenizer joins text over a blank
                self.by_runs = False
                return
            data, last = ids.tobytes(), 0
            for w, end in zip(some, [*(ends * size).tolist(), len(data)], strict=True):
                known[w] = part = data[last:end]
                new[w] += part
                last = end + size

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        sole(self)
        mark = self.MARK.encode()
        # bytes.lower() lowers A-Z only; the library lowers the rest
        low = [t.lower() for t in texts]
        plain = [self.by_runs and mark not in t and not any(x in t for x in self.special) for t in low]
        known = self.known
        split = trailing_marks_split([t.replace(b"\n", b" ") if p else b"" for t, p in zip(low, plain, strict=True)])
        parts = [list(map(known.__getitem__, ws)) for ws in split]
        if known.new:
            self._learn(known.new)
            known.new = {}
        if not self.by_runs:
            plain = [False] * len(texts)
            self.forget()
        out = [b"".join(p) for p in parts]
        whole = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(whole, self._library([texts[i].decode("utf-8", "surrogatepass") for i in whole]), strict=True):
            out[i] = ids.tobytes()
        if len(known) > self.most:
            self.known = _Known(known)
        return out


class _Known(dict):
    """Runs -> ids as bytes. A missing one comes from the generation before, or gets an empty place to be filled."""

    def __init__(self, old: dict):
        super().__init__({b"": b""})
        self.old, self.new = dict(old), {}

    def __missing__(self, run: bytes) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.new[run] = bytearray()
        self[run] = ids
        return ids


def trailing_marks_split(texts: list[bytes]) -> list[list[bytes]]:
    """The runs between blanks of each text; ASCII marks (but the apostrophe) between an ASCII letter and a blank are a
    pre-token of their own and become a run, so that the word before them is looked up alone. All texts at once."""
    joined = b" ".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    kind = CLASSES[data]
    begin = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    if len(begin):
        other = np.flatnonzero(kind != 2)
        begin = begin[data[other[np.searchsorted(other, begin)]] == 32]
    made = np.insert(data, begin, 32).tobytes()
    ends = np.cumsum([len(t) + 1 for t in texts])
    ends = (ends + np.searchsorted(begin, ends)).tolist()
    return [made[a : b - 1].split(b" ") for a, b in zip([0, *ends], ends, strict=False)]


_CACHES: dict[tuple, WordCache] = {}


def write_store(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encodes the texts, appends ``end_id`` to each, and writes the store at ``path``."""
    spark = docs.sparkSession
    width = "<u2" if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    frame = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunk = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])

    def encoded(batches):
        key = (tokenizer_path, width)
        if key not in _CACHES:
            _CACHES[key] = WordCache(tokenizer_path, width)
        cache = _CACHES[key]
        encode, end, squeeze = cache.encode, np.array([end_id], width).tobytes(), zstandard.ZstdCompressor(1).compress
        sent: set[bytes] = set()
        size = int(width[2])
        for batch in slices(batches, 128, cache):
            lengths, roots, digests, of_doc = [], [], [], [0]
            chunk_digests, chunk_sizes, chunk_data, chunks_of = [], [], [], [0]
            for data in encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                data += end
                own, last = [], 0
                for c in cut_points(np.frombuffer(data, width)):
                    part = data[last * size : c * size]
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    own.append(digest)
                    if digest not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(digest)
                        chunk_digests.append(digest)
                        chunk_sizes.append(c - last)
                        chunk_data.append(squeeze(part))
                    last = c
                lengths.append(len(data) // size)
                roots.append(merkle_root(own))
                digests += own
                of_doc.append(len(digests))
                chunks_of.append(len(chunk_digests))
            made = pa.StructArray.from_arrays(
                [pa.array(chunk_digests, pa.binary()), pa.array(chunk_sizes, pa.int32()), pa.array(chunk_data, pa.binary())], fields=list(chunk)
            )
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), x) for o, x in ((of_doc, pa.array(digests, pa.binary())), (chunks_of, made))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), lists[0], pa.array(roots, pa.binary()), lists[1]],
                names=["doc_id", "n_tokens", "digests", "root", "chunks"],
            )

    staged = new_path(spark, "ids")
    frame.mapInArrow(
        encoded,
        "doc_id bigint, n_tokens bigint, digests array<binary>, root binary, chunks array<struct<digest:binary,n:int,data:binary>>",
    ).write.option("compression", "none").parquet(staged)
    rows = spark.read.parquet(staged)
    chunks = rows.select(F.explode("chunks").alias("c")).select("c.digest", "c.n", "c.data")
    (
        chunks.repartition("digest")
        .dropDuplicates(["digest"])
        .write.option("compression", "none")
        .parquet(f"{path}/chunks")
    )

    def numbered(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - n), batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(len(n), part, np.int32))],
                names=["doc_id", "start", "n_tokens", "digests", "root", "part"],
            )
            start = int(ends[-1]) if len(ends) else start

    (
        rows.select("doc_id", "n_tokens", "digests", "root")
        .repartitionByRange("doc_id", "root")
        .sortWithinPartitions("doc_id", "root")
        .mapInArrow(numbered, "doc_id bigint, start bigint, n_tokens bigint, digests array<binary>, root binary, part int")
        .write.parquet(f"{path}/recipes")
    )
    # one row for each range partition, whatever the number of documents
    totals = spark.read.parquet(f"{path}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in totals], dtype=np.int64).tolist()
    places = [(r.part, end - r.n) for r, end in zip(totals, ends, strict=True)]
    spark.createDataFrame(places, "part int, before bigint").coalesce(1).write.parquet(f"{path}/parts")
    _delete(spark, [staged])
    _write_manifest(spark, path)


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    """The recipes of a store, start counted over all parts."""
    parts = spark.read.parquet(f"{path}/parts")
    start = (F.col("before") + F.col("start")).alias("start")
    own = spark.read.parquet(f"{path}/recipes").join(F.broadcast(parts), "part")
    return own.select("doc_id", start, "n_tokens", "digests", "root", "part")


def _roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens and Merkle root of each run of recipes, in doc_id order."""

    def run(batches):
        leaves: dict[int, list] = {}
        for batch in batches:
            for part, root, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                leaves.setdefault(part, []).append((root, n))
        rows = [{"part": p, "n_docs": len(x), "n_tokens": sum(n for _, n in x), "root": merkle_root([r for r, _ in x])} for p, x in leaves.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    ordered = recipes.select("part", "root", "n_tokens", "start").repartition("part").sortWithinPartitions("part", "start")
    return ordered.select("part", "root", "n_tokens").mapInArrow(run, "part int, n_docs bigint, n_tokens bigint, root binary")


def _write_manifest(spark: SparkSession, path: str) -> None:
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest/runs")
    found = spark.read.parquet(f"{path}/manifest/runs").orderBy("part").collect()
    whole = (-1, sum(r.n_docs for r in found), sum(r.n_tokens for r in found), bytearray(merkle_root([bytes(r.root) for r in found])))
    spark.createDataFrame([whole], "part int, n_docs bigint, n_tokens bigint, root binary").coalesce(1).write.parquet(f"{path}/manifest/all")


def _ids(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc (of the ids as unsigned 32-bit integers) and whether the data has that digest and length, from
    the stored bytes."""

    def run(batches):
        restore = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 1024):
            crc, fine = [], []
            for digest, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = restore(data)
                size = len(raw) // n
                crc.append(zlib.crc32(_ids(raw, size).tobytes()))
                fine.append(hashlib.blake2b(raw, digest_size=16).digest() == digest and len(raw) == n * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(fine)], names=["digest", "n", "crc", "fine"]
            )

    return spark.read.parquet(f"{path}/chunks").select("digest", "n", "data").mapInArrow(run, "digest binary, n int, crc bigint, fine boolean")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens and the CRC-32 of its ids, from chunks read back. A chunk
    that is missing, damaged or of another length fails the read."""
    recipes = recipes_of(spark, path)
    parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("at", "digest"))
    joined = parts.join(chunk_sums(spark, path), "digest", "left")
    grouped = joined.groupBy("doc_id", "start", "n_tokens").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(-1)).alias("n"), "crc", "fine"))).alias("chunks")
    )

    def run(batches):
        for batch in slices(batches, 1024):
            out = []
            for chunks, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if any(not c["fine"] for c in chunks) or sum(c["n"] for c in chunks) != n:
                    raise ValueError("the store lacks a chunk or holds a damaged one")
                crc = 0
                for c in chunks:
                    crc = crc_joined(crc, c["crc"], 4 * c["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return grouped.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, start and ids array<bigint>, put together from the store; ``where`` filters recipes first."""
    recipes = recipes_of(spark, path)
    parts = (recipes.filter(where) if where is not None else recipes).select(
        "doc_id", "start", F.posexplode("digests").alias("at", "digest")
    )
    grouped = (
        parts.join(spark.read.parquet(f"{path}/chunks"), "digest")
        .groupBy("doc_id", "start")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "data"))).alias("chunks"))
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        restore = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 128):
            ids = []
            for chunks in batch.column(2).to_pylist():
                raw = [(restore(c["data"]), c["n"]) for c in chunks]
                ids.append([int(i) for data, n in raw for i in _ids(data, len(data) // n)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return grouped.mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def verify(spark: SparkSession, path: str) -> bool:
    """Roots of the recipes against the manifest, and the manifest's runs against its whole."""
    runs = spark.read.parquet(f"{path}/manifest/runs")
    differ = _roots(spark.read.parquet(f"{path}/recipes")).exceptAll(runs).count() + runs.filter("part < 0").count()
    whole = spark.read.parquet(f"{path}/manifest/all").first()
    return not differ and bytes(whole.root) == merkle_root([bytes(r.root) for r in runs.orderBy("part").collect()])
