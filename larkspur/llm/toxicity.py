"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, of its pairs of neighbours and of its pairs with one or two words between
them, and of the first letters of its longer words, each hashed to one of 2^22 coordinates. The model is logistic; it is learnt online, one text after the other, by
FTRL-proximal: every coordinate has its own learning rate, which falls with the gradients it has seen, and L1 keeps a
coordinate at exactly zero until enough texts speak for it. What is left are some thousand weights, which are broadcast.

Training uses a bounded sample, of each label at most ``per_label`` ids, those of smallest hash of the id (a documented
bound). Its features are written once to the shared folder and then read as a stream, ordered by hash, ``epochs`` times over,
by one task that holds nothing but the coordinates; only non-zero weights (2^22 at most, 32 MB) reach the driver. Where one label had more
ids than its bound, the intercept is moved by the logarithm of its share, so scores keep the meaning of a
probability among all labelled rows. Scoring is one scan without a shuffle; texts are whole.

Defined results: a null or empty text, and one without words, has the score of the intercept alone; with one label only, or
none, scores are the share of toxic labels, 0.5 without labels; repeated labels count once, contradicting ones not at all;
repeated rows of one id are scored each and learnt from once (the row of least hash); rows without id are scored, not learnt
from; an empty table gives none; of further columns none is read, and ``score`` keeps them, but for one named score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, slices, stored
from .shingles import MIX1, STEP, Words, mix

BITS = 22
#: Words between the two of a pair, plus one: neighbours, one word left out, two left out.
GAPS = (1, 2, 3)
#: Keeps the kinds of features apart.
GAP_SALT = mix(np.arange(8, dtype=np.uint64) + np.uint64(1))


#: Bytes of the beginnings of longer words, which inflected and compounded forms of a word share.
STEMS = (4, 5, 6)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of all words, stems and pairs of a batch, repeats included."""
    words = Words(texts)
    h, t = words.hash, words.text
    where, found = [t], [mix(h)]
    for gap in GAPS:
        same = t[:-gap] == t[gap:]
        where.append(t[:-gap][same])
        found.append(mix((h[:-gap] * STEP + h[gap:] * MIX1 + GAP_SALT[gap])[same]))
    raw = b"\n".join(x.encode("utf-8", "surrogatepass") if x else b"" for x in texts) + b"\n"
    data, size = np.frombuffer(raw.translate(WORD_TABLE), np.uint8), words.ends - words.starts
    for stem in STEMS:
        long = size > stem
        first, sums = words.starts[long], np.zeros(int(long.sum()), np.uint64)
        for i in range(stem):
            sums = (sums << np.uint64(8)) | data[first + i]
        where.append(t[long])
        found.append(mix(sums * STEP + GAP_SALT[stem]))
    return np.concatenate(where), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal: per-coordinate sums of squared gradients (n) and of gradients less the pull to earlier weights (z).
    Coordinate 2^BITS is the intercept, without L1."""

    def __init__(self, rate: float = 1.0, smooth: float = 1.0, l1: float = 4.0, l2: float = 0.5):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        free = np.sign(z) * np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0.0, self.l1), 0.0)
        return -free / ((self.smooth + np.sqrt(self.n[at])) / self.rate + self.l2)

    def learn(self, at: np.ndarray, label: int) -> float:
        """One step on a text with the distinct coordinates ``at``; the probability before it."""
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        p = 1 / (1 + math.exp(-min(40.0, max(-40.0, float(w.sum())))))
        g = p - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.rate * w
        return p

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(np.abs(self.z[:-1]) > self.l1), 1 << BITS)
        return at.astype(np.int32), self.weights(at)


class Toxicity:
    """The coordinates with weights, ascending, and the intercept."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, intercept: float):
        self.at, self.weight, self.intercept = at, weight, intercept
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return self.at, self.weight, self.intercept

    def __setstate__(self, state):
        self.at, self.weight, self.intercept = state
        self._dense = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self._dense is None:  # once in a worker
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.weight
        text, at = hashed(texts)
        heavy = np.flatnonzero(self._dense[at])
        # presence counts once in a text; few coordinates have weights, so little is sorted
        own = np.unique(text[heavy].astype(np.int64) << BITS | at[heavy])
        total = np.bincount(own >> BITS, weights=self._dense[own & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -40, 40)))


def _features(rows: DataFrame) -> DataFrame:
    """rows: label, hash, text -> label, hash, at (distinct coordinates)."""

    def run(batches):
        for batch in slices(batches, 64):
            texts = batch.column(2).to_pylist()
            text, at = hashed(texts)
            own = np.unique(text.astype(np.int64) << BITS | at)
            ends = np.searchsorted(own >> BITS, np.arange(len(texts) + 1))
            flat = pa.array((own & ((1 << BITS) - 1)).astype(np.int32))
            at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at], names=["label", "hash", "at"])

    return rows.mapInArrow(run, "label int, hash bigint, at array<int>")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 6_000, epochs: int = 3, **options: float) -> Toxicity:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; others and nulls ignored, and so are ids with both). Learns from
    at most ``per_label`` ids of each label; options are those of ``Ftrl``."""
    found = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    one = found.agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("other")).filter("label = other")
    counted = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counted.get(0, 0), counted.get(1, 0)
    none = np.zeros(0, np.int32), np.zeros(0)
    if not good or not bad:  # the share of toxic rows
        return Toxicity(*none, 0.0 if good == bad else 40.0 if bad else -40.0)
    order = (F.xxhash64("doc_id"), "doc_id")  # the id only picks the sample
    picked = [one.filter(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    picked = picked[0].union(picked[1]).select("doc_id", "label")
    rows = F.broadcast(picked).join(docs.select("doc_id", "text"), "doc_id")
    # one row of each id, in an order that has nothing to do with it
    rows = rows.withColumn("hash", F.xxhash64("text", "doc_id")).groupBy("doc_id", "label")
    rows = rows.agg(F.min_by("text", "hash").alias("text"), F.min("hash").alias("hash"))
    sample = stored(_features(rows.select("label", "hash", "text")), "toxic-sample")
    kinds = "at int, weight double"

    def run(batches):
        model = Ftrl(**options)
        for batch in batches:
            for i, label in enumerate(batch.column(0).to_pylist()):
                model.learn(batch.column(1)[i].values.to_numpy(), label)
        at, weight = model.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight)], names=["at", "weight"])

    passes = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    stream = passes.repartition(1).sortWithinPartitions("pass", "hash").select("label", "at")
    got = stream.mapInArrow(run, kinds).toArrow()
    if not got.num_rows:  # labels of other documents only
        return Toxicity(*none, math.log(bad / good))
    at, weight = got.column(0).to_numpy(), got.column(1).to_numpy()
    moved = math.log(min(good, per_label) / good) - math.log(min(bad, per_label) / bad)
    return Toxicity(at[:-1], weight[:-1], float(weight[-1]) + moved)


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with score (a column of that name is replaced)."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields]).add("score", T.DoubleType())
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        for batch in slices(batches):
            got = own.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*kept, "score"])

    return frame.mapInArrow(run, schema)
