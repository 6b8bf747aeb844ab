"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Windows of consecutive benchmark words are the patterns. A text is searched from left to right: the block of words at
the end of the current position looks up how far the search may jump (block shift table); where the jump is zero, the
bucket of that suffix block holds the patterns that may end here, and direct comparison confirms them.

Scale: the benchmark is a stated query set. It is streamed to the driver and packed into blocks of at most
``block_windows`` pairs of a window and an item that has it (a window of many items may be in several blocks); only one
block at a time is broadcast, so what is broadcast has a fixed bound however large the benchmark is. A further block means a further pass over the documents (written to the shared folder between
passes), never a join. No shuffle, no state beyond one batch of texts; tasks can be rerun at will.

Defined results: a null text or one without words has n_words 0 and no spans; an item without words has no windows; an
item with a null id marks words but is not listed; repeated rows each give a row; a repeated item id is listed once.
Columns of ``docs`` other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, words


class WuManber:
    """Patterns: tuples of words -> ids. Those of one length share a shift table and suffix buckets."""

    def __init__(self, patterns: dict[tuple, set], block: int = 3):
        self.tables = []
        by_length: dict[int, dict] = {}
        for p, ids in patterns.items():
            by_length.setdefault(len(p), {})[p] = ids
        for m, own in sorted(by_length.items()):
            b = min(block, m)
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, dict] = {}
            for p, ids in own.items():
                for end in range(b, m + 1):
                    key = p[end - b : end]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket.setdefault(p[m - b :], {})[p] = ids
            self.tables.append((m, b, shift, bucket))

    def search(self, text: list) -> Iterator[tuple[int, int, set]]:
        """(first word, number of words, ids) of every occurrence."""
        n = len(text)
        for m, b, shift, bucket in self.tables:
            free, back, get = m - b + 1, b - 1, shift.get
            i = m - 1
            while i < n:
                jump = get(tuple(text[i - back : i + 1]), free)
                if jump:
                    i += jump
                    continue
                ids = bucket[tuple(text[i - back : i + 1])].get(tuple(text[i - m + 1 : i + 1]))
                if ids is not None:
                    yield i - m + 1, m, ids
                i += 1


def windows(item: list, size: int) -> Iterator[tuple]:
    """All runs of ``size`` words; a shorter item, but not an empty one, is one window."""
    if item:
        for i in range(max(1, len(item) - size + 1)):
            yield tuple(item[i : i + size])


def pattern_blocks(items: DataFrame, item_id: str, text: str, size: int, block_windows: int) -> Iterator[dict]:
    """The benchmark's windows and the ids of their items in blocks of bounded size, streamed from the executors."""
    block: dict[tuple, set] = {}
    n = 0  # windows and ids in the block
    for key, body in items.select(F.col(item_id).cast("bigint"), F.col(text)).toLocalIterator():
        for w in windows(words(body), size):
            if w not in block:
                block[w] = set()
                n += 1
            elif key is not None and key not in block[w]:
                n += 1
            if key is not None:
                block[w].add(key)
            if n >= block_windows:
                yield block
                block, n = {}, 0
    yield block


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


class _Finders(dict):
    """Tables of a block by its name."""

    forget = dict.clear


_FINDERS: dict[str, WuManber] = _Finders()


def _finder(broadcast, name: str) -> WuManber:
    """The tables of a block, built once in a worker; it holds one block at a time."""
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = WuManber(broadcast.value)
    return _FINDERS[name]


FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,item_ids:array<bigint>>"


def _searched(
    rows: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_windows: int
) -> DataFrame:
    """whole (struct of the row) and found (n_words, spans, item_ids) of each row, in one pass for each block. A row
    goes through all passes with what has been found so far, so nothing is joined back."""
    sc = rows.sparkSession.sparkContext
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("item_ids", pa.list_(pa.int64())),
        ]
    )
    at = rows.columns.index(text)

    def searched(broadcast, name: str):
        def run(batches):
            finder = _finder(broadcast, name)
            for batch in slices(batches, owner=_FINDERS):
                out = []
                before = batch.column(1).to_pylist()
                for body, old in zip(batch.column(0).field(at).to_pylist(), before, strict=True):
                    found = words(body)
                    spans = [(s["start"], s["end"]) for s in old["spans"]] if old else []
                    ids = set(old["item_ids"]) if old else set()
                    for start, m, own in finder.search(found):
                        spans.append((start, start + m))
                        ids.update(own)
                    out.append({"n_words": len(found), "spans": _merged(spans), "item_ids": sorted(ids)})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["whole", "found"])

        return run

    out = rows.select(F.struct("*").alias("whole"), F.lit(None).cast(FOUND).alias("found"))
    schema = out.schema
    blocks = pattern_blocks(benchmark, item_id, item_text, window, block_windows)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        out = out.mapInArrow(searched(sc.broadcast(block), uuid.uuid4().hex), schema)
        if after is not None:
            out = stored(out, "decontaminate")
        block = after
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_windows: int = 200_000,
) -> DataFrame:
    """Per document row: doc_id, n_words, spans (word ranges, end exclusive, inside occurrences of benchmark windows)
    and item_ids (items with occurring windows, ascending)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = _searched(rows, "text", benchmark, item_id, item_text, window, block_windows)
    return out.select("whole.doc_id", "found.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.05, **options) -> DataFrame:
    """find_contamination() with the hit words counted; contaminated: some hit, and hit words make up ``min_share``."""
    found = find_contamination(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias(
            "items_sha256"
        ),
        ((hit > 0) & (hit * round(1 / min_share) >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, min_share: float = 0.05, window: int = 13, block_windows: int = 200_000
) -> DataFrame:
    """Rows of documents (doc_id, text, ...) that are not contaminated, every column kept. Each row is judged by its own
    text, whatever its id and however many blocks the benchmark has."""
    out = _searched(docs, "text", benchmark, "item_id", "text", window, block_windows)
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.filter((hit == 0) | (hit * round(1 / min_share) < F.col("found.n_words"))).select("whole.*")
