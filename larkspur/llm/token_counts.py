"""Token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a boundary that both
found in their overlap and that is proven stable:

* the tokenizer first cuts special strings, then pre-tokenizes the rest from left to right, and encodes each pre-token
  on its own; a pre-token's extent depends on the text from its start to ``margin`` characters after its end;
* the left chunk starts at a true boundary, so its pre-tokens that end ``margin`` characters before its cut are true;
* if such a true boundary is a boundary of the right chunk as well, no special string and no pre-token crosses it in
  either, and everything the right chunk has after it is what the whole text has.

Where the overlap has no such boundary (one word or one run of blanks as long as the overlap) it is doubled, and once
it has reached back over the whole left chunk, the left chunk is doubled instead; at worst the text is one chunk.

Scale: one scan, no shuffle; memory is one batch of texts plus two chunks. Texts of at most one chunk go to the
library as they are. Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer, loaded once per process, without threads of its own."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _LOADED[path] = found
    return _LOADED[path]


class Chunked:
    """Encodes a text of any length by chunks that are spliced at proven boundaries."""

    def __init__(self, tokenizer, chunk: int = 16_384, overlap: int = 256):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        longest = max([0, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
        self.margin = longest + 4

    def _encoded(self, text: str, start: int, end: int) -> tuple[list[int], list[int], list[int]]:
        """ids, first character of each token in the whole text, and whether a pre-token starts there."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        first = [start + a for a, _ in e.offsets]
        units = e.word_ids
        starts = [0 if i and units[i] == units[i - 1] and units[i] is not None else 1 for i in range(len(units))]
        return e.ids, first, starts

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of the whole text, in runs."""
        n, start, size = len(text), 0, self.chunk
        ids, first, begins = self._encoded(text, 0, size)
        end = min(size, n)
        while end < n:
            lap = self.overlap
            while True:
                right = max(start + 1, end - lap)
                r_end = min(n, right + max(self.chunk, 2 * lap))
                r_ids, r_first, r_begins = self._encoded(text, right, r_end)
                common = {p for p, b in zip(r_first, r_begins, strict=True) if b and p > right}
                at = max((p for p, b in zip(first, begins, strict=True) if b and p in common and p + self.margin <= end), default=0)
                if at > start:
                    break
                if right == start + 1:  # the overlap has reached back over the whole left chunk
                    size *= 2
                    end = min(n, start + size)
                    ids, first, begins = self._encoded(text, start, end)
                    if end == n:
                        break
                    lap = self.overlap
                else:
                    lap *= 2
            if end == n:
                break
            yield [i for i, p in zip(ids, first, strict=True) if p < at]
            keep = next(k for k, p in enumerate(r_first) if p >= at)
            start, end, size = at, r_end, self.chunk
            ids, first, begins = r_ids[keep:], r_first[keep:], r_begins[keep:]
        yield ids

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text: str = "text", chunk: int = 16_384, overlap: int = 256
) -> DataFrame:
    """The rows of ``docs`` without the text, with n_bytes (UTF-8) and n_tokens. Columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name in ("n_bytes", "n_tokens"):
        schema = schema.add(name, T.LongType())

    def run(batches):
        tokenizer = load_tokenizer(tokenizer_path)
        huge = Chunked(tokenizer, chunk, overlap)
        for batch in slices(batches, 64):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for i, e in zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                counts[i] = len(e)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = huge.count(t)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], sizes, pa.array(counts, pa.int64())], names=[*kept, "n_bytes", "n_tokens"]
            )

    return frame.mapInArrow(run, schema)
