"""k-means over array columns, and what is built on it: medoids as prototypes, cluster centroids instead of a large class, and
synthetic rows inside clusters or along the border of a small class.

Centres are few and go to every row as literals; a round is one aggregation of sums by cluster. The start is k-means||: each
of a few rounds takes rows with a chance that grows with their distance to what has been taken (by hash, so it repeats), and
the bounded set of candidates, weighted by the rows they stand for, is reduced to k on the driver."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.pivots import knn_all
from larkspur.operators.sampling import smote, unit

N = "*"  # what count() counts: rows


def _squares(v: Column, centres: list[list[float]]) -> Column:
    """Squared distances to the centres."""
    square = lambda c: F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.lit(centres), square)


def assign(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """Adds cluster (number of the nearest centre, of equal ones the first) and square (squared distance to it)."""
    d = df.withColumn("__d", _squares(F.col(vector).cast("array<double>"), centres))
    return d.withColumns({"square": F.array_min("__d"), "cluster": F.array_position("__d", F.array_min("__d")).cast("int") - 1}).drop("__d")


def start_centres(df: DataFrame, key: str, vector: str, k: int, rounds: int = 4, seed: int = 42) -> list[list[float]]:
    """k-means||: about 2 k candidates a round."""
    v = F.col(vector).cast("array<double>")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), v.alias("v"))
    first = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").select("v").first()
    if first is None:
        return []
    found = [list(first.v)]
    for i in range(rounds):
        near = assign(rows, "v", found)
        total = near.agg(F.sum("square").alias("s")).first().s
        if not total:
            break
        chance = F.col("square") * (2.0 * k / total)
        taken = near.filter(unit("key", seed + i + 1) < chance).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(8 * k)
        found += [list(r.v) for r in taken.select("v").collect() if list(r.v) not in found]
    weight = {r.cluster: r.n for r in assign(rows, "v", found).groupBy("cluster").agg(F.count(N).alias("n")).collect()}
    return _plus_plus([(c, weight.get(i, 0)) for i, c in enumerate(found)], k, seed)


def _plus_plus(weighed: list[tuple[list[float], int]], k: int, seed: int) -> list[list[float]]:
    r, chosen = random.Random(seed), []
    far = [1.0] * len(weighed)
    while len(chosen) < min(k, len(weighed)):
        w = [n * d for (_, n), d in zip(weighed, far, strict=True)]
        if not any(w):
            break
        c = weighed[r.choices(range(len(weighed)), w)[0]][0]
        chosen.append(c)
        gap = [sum((x - y) ** 2 for x, y in zip(c, o, strict=True)) for o, _ in weighed]
        far = gap if len(chosen) == 1 else [min(a, b) for a, b in zip(far, gap, strict=True)]
    return chosen


class KMeans:
    """centres, and the mean squared distance after each round (it never rises)."""

    def __init__(self, centres: list[list[float]]):
        self.centres, self.costs = centres, []


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10, start: list[list[float]] | None = None, tolerance: float = 1e-9, seed: int = 42) -> KMeans:
    """Lloyd's rounds until the cost stands still. A cluster without rows keeps its centre. Rows with a null vector count nowhere."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    found = KMeans(start or start_centres(df, key, vector, k, seed=seed))
    if not found.centres:
        return found
    wide = len(found.centres[0])
    means = F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(wide)])
    for _ in range(rounds):
        g = assign(rows, "v", found.centres).groupBy("cluster").agg(means.alias("m"), F.count(N).alias("n"), F.sum("square").alias("s")).collect()
        found.costs.append(sum(r.s for r in g) / max(1, sum(r.n for r in g)))
        moved = {r.cluster: list(r.m) for r in g}
        found.centres = [moved.get(i, c) for i, c in enumerate(found.centres)]
        if len(found.costs) > 1 and found.costs[-2] - found.costs[-1] <= tolerance * max(found.costs[-2], 1e-300):
            break
    return found


def medoids(df: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """The row nearest to each centre among its own cluster's (ties: least key): cluster, medoid, distance, size."""
    own = assign(df.filter(F.col(vector).isNotNull()), vector, centres)
    g = own.groupBy("cluster").agg(F.min(F.struct("square", F.col(key).alias("k"))).alias("b"), F.count(N).alias("size"))
    return g.select("cluster", F.col("b.k").alias("medoid"), F.sqrt("b.square").alias("distance"), "size")


def cluster_centroids(df: DataFrame, key: str, vector: str, label: str, majority, k: int, **options) -> DataFrame:
    """The rows of other labels and, for the majority, the centres of its k clusters: key (text; centres are named
    cluster-i), vector, label."""
    many = df.filter(F.col(label) == majority)
    found = kmeans(many, key, vector, k, **options)
    kind = df.schema[label].dataType.simpleString()
    made = df.sparkSession.createDataFrame([(f"cluster-{i}", c, majority) for i, c in enumerate(found.centres)], f"k string, v array<double>, l {kind}")
    few = df.filter(F.col(label) != majority).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l"))
    return few.unionByName(made).select(F.col("k").alias(key), F.col("v").alias(vector), F.col("l").alias(label))


def border_rows(df: DataFrame, key: str, vector: str, label: str, minority, m: int = 10) -> DataFrame:
    """Minority rows by the share of other labels among their m nearest rows: key, others, kind (safe: under a half; danger:
    a half and more; noise: all of them)."""
    names = df.select(F.col(key).alias("neighbour"), F.col(label).alias("nl"))
    near = knn_all(df.filter(F.col(label) == minority), df, key, vector, m).join(names, "neighbour")
    g = near.groupBy(F.col("query").alias(key)).agg(F.count_if(F.col("nl") != minority).alias("others"), F.count(N).alias("n"))
    kind = F.when(F.col("others") == F.col("n"), "noise").when(2 * F.col("others") >= F.col("n"), "danger").otherwise("safe")
    return g.select(key, "others", kind.alias("kind"))


def borderline_smote(df: DataFrame, key: str, vector: str, label: str, minority, m: int = 10, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows from the minority rows in danger only, towards any of their k nearest minority rows: source, neighbour,
    vector."""
    danger = border_rows(df, key, vector, label, minority, m).filter("kind = 'danger'").select(F.col(key).alias("source"))
    return smote(df, key, vector, label, minority, k, seed=seed).join(danger, "source", "left_semi")


def kmeans_smote(df: DataFrame, key: str, vector: str, label: str, minority, clusters: int, share: float = 0.5, k: int = 5, seed: int = 42, **options) -> DataFrame:
    """Synthetic rows inside the clusters of all rows in which the minority has at least ``share`` of the rows: cluster,
    source, neighbour, vector. Neighbours are of the same cluster."""
    found = kmeans(df, key, vector, clusters, seed=seed, **options)
    own = assign(df.filter(F.col(vector).isNotNull()), vector, found.centres)
    rich = own.groupBy("cluster").agg(F.avg((F.col(label) == minority).cast("double")).alias("s")).filter(F.col("s") >= share)
    rows = own.filter(F.col(label) == minority)
    out = None
    for r in rich.orderBy("cluster").collect():  # a row for each cluster
        made = smote(rows.filter(F.col("cluster") == r.cluster), key, vector, label, minority, k, seed=seed).select(F.lit(r.cluster).alias("cluster"), "*")
        out = made if out is None else out.unionByName(made)
    if out is None:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"cluster int, source {kind}, neighbour {kind}, vector array<double>")
    return out


def diverse_rows(df: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """For each cluster its row farthest from the centre, the one that the medoid stands for worst: cluster, key, distance."""
    own = assign(df.filter(F.col(vector).isNotNull()), vector, centres)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("square"), key))
    return own.withColumn("place", place).filter("place = 1").select("cluster", F.col(key), F.sqrt("square").alias("distance"))
