"""Testing with concept vectors: does a score rise along a concept, more than along concepts that mean nothing?

A concept is a set of example rows; its vector points from the mean of the other rows to the mean of the examples. The
sensitivity of a row is the change of the score for a small step along the vector, a difference of two evaluations, so the
score may be any function. The share of rows whose score rises is compared with the shares along vectors of random sets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Score = Callable[[Column], Column]


def random_member(key: str, seed: int = 42) -> Callable[[int], Column]:
    """Membership of random set i: half of the rows, by hash of the key."""
    return lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(i), F.lit(seed)), F.lit(2)) == 0


def concept_vectors(df: DataFrame, vector: str, members: list[Column]) -> list[list[float]]:
    """The unit vector of each set, from one aggregation by position."""
    named = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"), *[m.alias(f"m{j}") for j, m in enumerate(members)])
    gap = [(F.avg(F.when(F.col(f"m{j}"), F.col("x"))) - F.avg(F.when(~F.col(f"m{j}"), F.col("x")))).alias(f"g{j}") for j in range(len(members))]
    rows = sorted(named.groupBy("i").agg(*gap).collect(), key=lambda r: r.i)  # a row for each position
    out = []
    for j in range(len(members)):
        g = [r[f"g{j}"] or 0.0 for r in rows]
        size = math.sqrt(sum(x * x for x in g)) or 1.0
        out.append([x / size for x in g])
    return out


def sensitivity(vector: Column, direction: Column, score: Score, step: float) -> Column:
    """Change of the score for a step along the direction, by the step."""
    moved = F.zip_with(vector, direction, lambda x, d: x + d * step)
    return (score(moved) - score(vector)) / step


def concept_test(df: DataFrame, vector: str, member: Column, score: Score, randoms: list[Column], step: float = 1e-2) -> DataFrame:
    """One row: share (of rows whose score rises along the concept), random_mean and random_sd (of the shares along random
    sets), t (how many standard errors of a new random share lie between) and degrees. All shares come from one aggregation."""
    directions = concept_vectors(df, vector, [member, *randoms])
    v = F.col(vector).cast("array<double>")
    rises = [F.avg((sensitivity(v, F.lit(d), score, step) > 0).cast("double")).alias(f"s{j}") for j, d in enumerate(directions)]
    g = df.filter(F.col(vector).isNotNull()).agg(*rises)
    null, n = F.array(*[F.col(f"s{j + 1}") for j in range(len(randoms))]), len(randoms)
    mean = F.aggregate(null, F.lit(0.0), lambda s, x: s + x) / n
    sd = F.sqrt(F.aggregate(null, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / max(1, n - 1))
    t = F.try_divide(F.col("s0") - mean, sd * math.sqrt(1 + 1 / n))
    return g.select(F.col("s0").alias("share"), mean.alias("random_mean"), sd.alias("random_sd"), t.alias("t"), F.lit(n - 1).alias("degrees"))


def concept_drift(before: list[float], after: list[float]) -> float:
    """1 less the cosine of a concept's vectors at two times."""
    dot = sum(a * b for a, b in zip(before, after, strict=True))
    size = math.sqrt(sum(a * a for a in before)) * math.sqrt(sum(b * b for b in after))
    return 1 - dot / size if size else 1.0
