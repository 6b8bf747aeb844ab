"""Quality by Bradley-Terry pairwise ranking.

Each training pair says that one document is better than another. The model is a linear score of a document's features;
the probability that a beats b is the logistic function of the difference of their scores, so it is fitted by logistic
loss on differences of scores, over all pairs of a document of one label with one of the other. The threshold is a
quantile of the training scores, chosen for the fewest errors with both labels weighing the same; scores are mapped to
0..1 so that the threshold falls on 0.7.

Features are shares and counts of a text alone: classes of characters, lengths and repeats of words and lines. Training
uses every labelled row. Its features (not texts) are written once to the shared folder; means, deviations and second
moments are sums over them. Pairs are not made: the loss and its gradient depend on a row through its score alone, so each
step sums, for each label and narrow bin of scores (a 64th of their deviation), the number of rows and their features, and
what reaches the driver is at most ``2 * BINS`` rows a step, however many rows there are. All pairs of bins then stand
for all pairs of rows, each bin by the mean of its own rows. Steps are L-BFGS from the curvature at zero. Scoring is one
scan without a shuffle.

Defined results: a null text scores as an empty one; without both labels in training every score is 0.7; repeated
labels count once, contradicting ones not at all; repeated rows of one id are scored each and learnt from once; an empty
table gives none; of further columns none is read, and ``score`` keeps them, but for one named score.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, words

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
BLANK = b" \t\r\n"
STOPS = b".,;:?'\"-()"
LOUD = b"!"
MARKS = b"#$%&*+/<=>@\\^_`{|}~[]"
NAMES = 18
#: Bins of scores, of a 64th of their deviation each, round the mean.
BINS = 1024


def features(text: str | None) -> list[float]:
    """NAMES numbers of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    left = [n - len(raw.translate(None, s)) if raw else 0 for s in (UPPER, LOWER, DIGIT, BLANK, STOPS, LOUD, MARKS, b"|")]
    upper, lower, digit, blank, stops, loud, marks, bars = (x / n for x in left)
    found = words(text)
    k = len(found) or 1
    lines = [x for x in raw.split(b"\n") if x]
    m = len(lines) or 1
    same = sum(1 for a, b in zip(found, found[1:], strict=False) if a == b)
    pairs = len({*zip(found, found[1:], strict=False)}) / max(1, len(found) - 1)
    other = max(0.0, 1 - upper - lower - digit - blank - stops - loud - marks)
    return [
        upper / (upper + lower + 1e-3),
        lower,
        digit,
        blank,
        stops,
        loud,
        marks,
        min(1.0, 20 * marks),
        min(1.0, 20 * loud),
        min(1.0, 40 * bars),
        other,
        len(set(found)) / k if found else 0.0,
        pairs if len(found) > 1 else 1.0,
        same / k,
        len(set(lines)) / m if lines else 1.0,
        min(1.0, math.log1p(len(found)) / 10),
        sum(map(len, found)) / k / 20,
        len(zlib.compress(raw, 1)) / n if raw else 1.0,
    ]


class Ranking:
    """score = weights . (features - mean) / scale; probability by the threshold and a slope."""

    def __init__(self, mean, scale, weights, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def scores(self, rows: list[list[float]] | np.ndarray) -> np.ndarray:
        x = (np.array(rows).reshape(-1, NAMES) - self.mean) / self.scale
        z = self.slope * (np.clip(x, -8, 8) @ self.weights - self.threshold) + math.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Of each label (bad, good): number of rows, sums and sums of products of their standardised features."""
    width = 1 + NAMES + NAMES * NAMES

    def run(batches):
        sums = np.zeros((2, width))
        for batch in batches:
            label, x = _standard(batch, mean, scale)
            for q in (0, 1):
                own = x[label == q]
                sums[q] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        at = np.tile(np.arange(width, dtype=np.int32), 2)
        cols = [pa.array(np.repeat(np.arange(2, dtype=np.int32), width)), pa.array(at), pa.array(sums.reshape(-1))]
        yield pa.RecordBatch.from_arrays(cols, names=["quality", "at", "value"])

    got = rows.mapInArrow(run, "quality int, at int, value double").groupBy("quality", "at").agg(F.sum("value")).toArrow()
    out = np.zeros((2, width))
    out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return out


def _standard(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(1).flatten().to_numpy().reshape(-1, NAMES)
    return batch.column(0).to_numpy(), np.clip((x - mean) / scale, -8, 8)


def _binned(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, width: float, bins: int) -> np.ndarray:
    """label x bin of scores x (number of rows, sums of their standardised features); the outer bins have no outer end."""
    names = ["n", *(f"x{i}" for i in range(NAMES))]

    def run(batches):
        sums = np.zeros((2 * bins, 1 + NAMES))
        for batch in batches:
            label, x = _standard(batch, mean, scale)
            cell = np.clip(np.floor(x @ w / width) + bins // 2, 0, bins - 1).astype(np.int64) + bins * label
            for i, weight in enumerate((None, *x.T)):
                sums[:, i] += np.bincount(cell, weight, 2 * bins)
        cell = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(pa.array(c) for c in sums[cell].T)], names=["cell", *names])

    found = rows.mapInArrow(run, "cell int, " + ", ".join(f"{c} double" for c in names))
    got = found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((2 * bins, 1 + NAMES))
    out[got.column(0).to_numpy()] = np.stack([got.column(i + 1).to_numpy() for i in range(1 + NAMES)], 1)
    return out.reshape(2, bins, 1 + NAMES)


def _pair_loss(sums: np.ndarray, w: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of all pairs of a good and a bad row, with decay, and its gradient."""
    bad, good = (s[s[:, 0] > 0] for s in sums)
    xb, xg = bad[:, 1:] / bad[:, :1], good[:, 1:] / good[:, :1]
    weight = np.outer(good[:, 0] / good[:, 0].sum(), bad[:, 0] / bad[:, 0].sum())
    z = np.clip((xg @ w)[:, None] - (xb @ w)[None, :], -500, 500)
    p = weight / (1 + np.exp(z))
    loss = (weight * np.logaddexp(0, -z)).sum() + decay / 2 * w @ w
    return float(loss), p.sum(0) @ xb - p.sum(1) @ xg + decay * w


def _descend(loss, inverse: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS from zero with the inverse curvature there; a step that does not help is halved."""
    w, past = np.zeros(NAMES), []
    value, g = loss(w)
    for _ in range(steps):
        if np.abs(g).max() < 5e-4:
            break
        d, kept = g.copy(), []
        for s, y in reversed(past):
            kept.append(a := (s @ d) / (s @ y))
            d -= a * y
        d = inverse @ d
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        for size in (1.0, 0.5, 0.25, 0.1, 0.01):
            new = w - size * d
            after, slope = loss(new)
            if after <= value - 1e-4 * size * (g @ d):
                break
        else:
            break
        if (new - w) @ (slope - g) > 1e-12:
            past = [*past[-9:], (new - w, slope - g)]
        w, value, g = new, after, slope
    return w


def fit(rows: DataFrame, steps: int = 30, decay: float = 1e-3) -> Ranking:
    """rows: quality (0 or 1), x (features), all to be learnt from. Bradley-Terry over all pairs of both labels."""
    plain = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(NAMES)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(NAMES)]
    got = rows.agg(F.min("quality"), F.max("quality"), *plain).first()
    if got[0] != 0 or got[1] != 1:
        return Ranking(np.zeros(NAMES), np.ones(NAMES), np.zeros(NAMES), 0.0, 1.0)
    mean, scale = np.array(got[2 : 2 + NAMES]), np.array(got[2 + NAMES :]) + 1e-6
    sums = _moments(rows, mean, scale)
    n, m = sums[:, 0], sums[:, 1 : 1 + NAMES] / sums[:, :1]
    second = sums[:, 1 + NAMES :].reshape(2, NAMES, NAMES)
    own = [second[q] / n[q] - np.outer(m[q], m[q]) for q in (0, 1)]
    curved = (own[0] + own[1] + np.outer(m[1] - m[0], m[1] - m[0])) / 4 + decay * np.eye(NAMES)
    whole = second.sum(0) / n.sum() - np.outer(*[sums[:, 1 : 1 + NAMES].sum(0) / n.sum()] * 2)

    def width(w: np.ndarray) -> float:
        return math.sqrt(max(float(w @ whole @ w), 1e-12)) / 64

    w = _descend(lambda w: _pair_loss(_binned(rows, mean, scale, w, width(w), BINS), w, decay), np.linalg.inv(curved), steps)
    # the quantile of all training scores with the fewest errors, labels weighing the same; of equal ones the middle of
    # the longest stretch
    deviation = 64 * width(w)
    fine = _binned(rows, mean, scale, w, deviation / 1024, 16 * BINS)[:, :, 0]
    below = fine.cumsum(1) - fine  # rows of each label under the lower end of a bin
    errors = below[1] / n[1] + 1 - below[0] / n[0]
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    stretch = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    threshold = float((stretch[0] + stretch[-1]) / 2 - 8 * BINS) * deviation / 1024
    return Ranking(mean, scale, w, threshold, 2.0 / max(1e-6, deviation))


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their features, x array<double>, in place of the text (and of a column x)."""
    kept = [c for c in docs.columns if c not in (text, "x")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields]).add("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in slices(batches):
            made = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=[*kept, "x"])

    return frame.mapInArrow(run, schema)


def train_featured(docs: DataFrame, labels: DataFrame, **options) -> Ranking:
    """``train`` on rows of doc_id and x, as ``featured`` makes them."""
    found = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    one = found.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    # rows of one id count once: the least of their features
    rows = docs.select("doc_id", "x").join(one, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    return fit(stored(rows.select("quality", "x"), "quality-rows"), **options)


def train(docs: DataFrame, labels: DataFrame, **options) -> Ranking:
    """docs: doc_id, text; labels: doc_id, quality (1 better than 0; others and nulls ignored, and so are ids with both).
    Learns from every labelled row; options are those of ``fit``."""
    return train_featured(featured(docs.select("doc_id", "text")), labels, **options)


def score_featured(docs: DataFrame, model: Ranking) -> DataFrame:
    """``score`` of rows that ``featured`` made."""
    kept = [c for c in docs.columns if c not in ("x", "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], "x")
    schema = T.StructType([*frame.drop("x").schema.fields]).add("score", T.DoubleType())
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        for batch in batches:
            got = own.scores(batch.column(batch.num_columns - 1).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*kept, "score"])

    return frame.mapInArrow(run, schema)


def score(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with score (a column of that name is replaced)."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields]).add("score", T.DoubleType())
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        for batch in slices(batches):
            got = own.scores([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*kept, "score"])

    return frame.mapInArrow(run, schema)
