"""Nearest neighbours over array columns, and what is built on them. A query set that is stated and bounded goes to all
rows in blocks (broadcast with a checked size); neighbours of every row come from ``pivots.knn_all``, similar pairs from a
grid."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.operators.nearest import ROWS, Best, Own, names, norms, vectors
from larkspur.operators.pivots import knn_all
from larkspur.operators.quantiles import quantiles

N = "*"  # what count() counts: rows
#: Most query rows, and most bytes of their vectors, in one broadcast block.
BLOCK, BLOCK_BYTES = 20_000, 64 << 20


def distance(a: Column, b: Column) -> Column:
    """Euclidean; arrays of numbers of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def query_blocks(queries: DataFrame, key: str, vector: str) -> list[DataFrame]:
    """A query set of any size as parts by hash, each to be broadcast for a pass of its own: at most about BLOCK rows and
    BLOCK_BYTES of vectors."""
    size = queries.agg(F.count(N).alias("n"), F.sum(F.size(vector) * F.lit(8)).alias("bytes")).first()
    parts = max(1, -(-size.n // BLOCK), -(-(size.bytes or 0) // BLOCK_BYTES))
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) if parts > 1 else queries for i in range(parts)]


def _scanned(part: DataFrame, rows: DataFrame, columns: list[str], scan: Callable, kind: str) -> DataFrame:
    """One pass of all rows for one block of queries (key, vector and more columns of both), sent as a matrix to each task:
    scan(queries' columns, batches of rows' columns) gives the record batches of a task. Vectors of another length than the
    queries', and null ones, take no part."""
    sent, lengths = part.select(*columns).filter(F.col(columns[1]).isNotNull()).toArrow(), {}
    sizes = pc.list_value_length(sent.column(1))
    for n in pc.unique(sizes).to_pylist():
        own = sent.filter(pc.equal(sizes, n))
        lengths[n] = [names(own.column(0).combine_chunks()), vectors(own.column(1), own.num_rows), *[c.to_pylist() for c in own.columns[2:]]]
    shared = part.sparkSession.sparkContext.broadcast(lengths)
    wanted = rows.select(*columns)
    wanted = wanted.filter(F.size(columns[1]).isin(list(lengths))) if lengths else wanted.limit(0)

    def run(batches):
        def pieces(n):
            held = chunks[n]
            return [np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), *[[x for h in held for x in h[i]] for i in range(2, len(columns))]]

        done = {n: scan(*q) for n, q in shared.value.items()}
        chunks: dict[int, list] = {n: [] for n in done}
        for b in batches:
            size = pc.list_value_length(b.column(1))
            for n in pc.unique(size).to_pylist():
                own = b.filter(pc.equal(size, n))
                chunks[n].append((names(own.column(0)), vectors(own.column(1), own.num_rows), *[c.to_pylist() for c in own.columns[2:]]))
                if sum(len(c[0]) for c in chunks[n]) >= ROWS:
                    done[n].add(*pieces(n))
                    chunks[n] = []
        for n, held in chunks.items():
            if held:
                done[n].add(*pieces(n))
            yield from done[n].found()

    return wanted.mapInArrow(run, kind)


class _Nearest:
    """The k best rows of a task for each query."""

    def __init__(self, keys, v, *, k: int, same: bool, farthest: bool, types: list):
        self.keys, self.best, self.same, self.types = keys, Best(v, k, farthest), same, types

    def add(self, keys, v) -> None:
        self.best.add(v, norms(v), keys, Own(keys).pairs(self.keys) if self.same else None)

    def found(self):
        i, key, d = self.best.found()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), t) for c, t in zip((self.keys[i], key, d), self.types, strict=True)], names=["query", "neighbour", "distance"])


class _Trust:
    """The distances to the nearest row of the same and of another label in a task, for each query."""

    def __init__(self, keys, v, labels, *, types: list):
        self.keys, self.types = keys, types
        self.number = {x: i for i, x in enumerate({x: None for x in labels if x is not None})}
        self.labels = np.array([-1 if x is None else self.number[x] for x in labels])
        self.best = {True: Best(v, 1), False: Best(v, 1)}

    def add(self, keys, v, labels) -> None:
        known = np.array([self.number.get(x, len(self.number)) if x is not None else -1 for x in labels])
        for x in np.unique(known[known >= 0]):
            at = np.flatnonzero(known == x)
            own = Own(keys[at]).pairs(self.keys)
            for same, best in self.best.items():
                of = np.flatnonzero((self.labels == x) if same else (self.labels >= 0) & (self.labels != x))
                if len(of):
                    best.add(v[at], norms(v[at]), keys[at], own, of)

    def found(self):
        d = [b.d[:, 0] for b in self.best.values()]
        yield pa.RecordBatch.from_arrays([pa.array(self.keys.tolist(), self.types[0]), *[pa.array(x, mask=np.isnan(x)) for x in d]], names=["query", "same", "other"])


def knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, same: bool = True, farthest: bool = False) -> DataFrame:
    """The k rows nearest to each query (or farthest from it): query, neighbour, distance, place. Ties: least key. ``same``:
    a row is no neighbour of its own key. Queries go in blocks; each task keeps k rows for each query, and only these are
    shuffled."""
    kinds, found = [d.schema[key].dataType for d in (queries, rows)], None
    scan = partial(_Nearest, k=k, same=same, farthest=farthest, types=[*map(to_arrow_type, kinds), pa.float64()])
    for part in query_blocks(queries, key, vector):
        top = _scanned(part, rows, [key, vector], scan, f"query {kinds[0].simpleString()}, neighbour {kinds[1].simpleString()}, distance double")
        found = top if found is None else found.union(top)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("distance") if farthest else F.asc("distance"), "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def trust_scores(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, alpha: float = 1e-8) -> DataFrame:
    """d_other / (d_same + d_other + alpha), with distances to the nearest row of the same and of another label."""
    kind, found = queries.schema[key].dataType, None
    scan = partial(_Trust, types=[to_arrow_type(kind)])
    for part in query_blocks(queries, key, vector):
        d = _scanned(part, rows, [key, vector, label], scan, f"query {kind.simpleString()}, same double, other double")
        found = d if found is None else found.union(d)
    found = found.groupBy("query").agg(F.min("same").alias("same"), F.min("other").alias("other"))
    return found.select("query", "same", "other", (F.col("other") / (F.col("same") + F.col("other") + alpha)).alias("trust"))


def tomek_links(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Pairs of opposite labels that are each other's nearest neighbour."""
    near = knn_all(rows, rows, key, vector, 1).select("query", "neighbour")
    names = rows.select(F.col(key).alias("k"), F.col(label).alias("l"))
    a, b = near.alias("a"), near.alias("b")
    m = a.join(b, (F.col("a.query") == F.col("b.neighbour")) & (F.col("a.neighbour") == F.col("b.query"))).filter("a.query < a.neighbour").select(F.col("a.query").alias("x"), F.col("a.neighbour").alias("y"))
    return m.join(names.select(F.col("k").alias("x"), F.col("l").alias("lx")), "x").join(names.select(F.col("k").alias("y"), F.col("l").alias("ly")), "y").filter("lx <> ly").select("x", "y")


def edited_nearest(rows: DataFrame, key: str, vector: str, label: str, k: int = 3) -> DataFrame:
    """Rows whose label is that of most of their k neighbours (ENN)."""
    names = rows.select(F.col(key).alias("neighbour"), F.col(label).alias("nl"))
    near = knn_all(rows, rows, key, vector, k).join(names, "neighbour")
    own = near.join(rows.select(F.col(key).alias("query"), F.col(label).alias("ql")), "query")
    good = own.groupBy("query").agg(F.avg((F.col("nl") == F.col("ql")).cast("double")).alias("share")).filter("share > 0.5")
    return rows.join(good.select(F.col("query").alias(key)), key, "left_semi")


def near_pairs(df: DataFrame, key: str, columns: list[str], limit: float) -> DataFrame:
    """Pairs at 0 < distance < limit over standardised columns, blocked by a grid of the first two columns' cells of
    that size, so only neighbouring cells are compared: a, b, distance."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev(c).alias(f"s_{c}") for c in columns])
    z = df.crossJoin(F.broadcast(stats)).select(F.col(key).alias("k"), F.array(*[((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))) for c in columns]).alias("z"))
    axes = min(2, len(columns))
    cell = [F.floor(F.col("z")[i] / limit) for i in range(axes)]
    left = z.select(F.col("k").alias("a"), F.col("z").alias("za"), *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    right = z.select(F.col("k").alias("b"), F.col("z").alias("zb"), *[c.alias(f"d{i}") for i, c in enumerate(cell)])
    for i in range(axes):
        right = right.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"d{i}") + s for s in (-1, 0, 1)])))
    pairs = left.join(right, [f"c{i}" for i in range(axes)]).filter("a < b")
    return pairs.select("a", "b", distance(F.col("za"), F.col("zb")).alias("distance")).filter((F.col("distance") > 0) & (F.col("distance") < limit))


def individual_fairness(df: DataFrame, key: str, columns: list[str], outcome: str, limit: float) -> DataFrame:
    """1 / (1 + mean |difference of outcomes|) over similar pairs."""
    p = near_pairs(df, key, columns, limit)
    y = df.select(F.col(key), F.col(outcome).cast("double").alias("y"))
    j = p.join(y.select(F.col(key).alias("a"), F.col("y").alias("ya")), "a").join(y.select(F.col(key).alias("b"), F.col("y").alias("yb")), "b")
    return j.agg(F.count(N).alias("pairs"), (1 / (1 + F.avg(F.abs(F.col("ya") - F.col("yb"))))).alias("consistency"))


def ood_by_distance(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, contamination: float = 0.1) -> DataFrame:
    """Mean distance to k neighbours, and whether it is above the (1 - contamination) percentile."""
    d = knn(queries, rows, key, vector, k).groupBy("query").agg(F.avg("distance").alias("mean_distance"))
    cut = quantiles(d, {"cut": ("mean_distance", 1 - contamination)})
    return d.crossJoin(F.broadcast(cut)).select("query", "mean_distance", (F.col("mean_distance") > F.col("cut")).alias("outlier"))


def mahalanobis(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distance of each row from the mean under the sample covariance: one aggregation, inverted on the driver."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = df.agg(*[F.avg(c).alias(f"m|{c}") for c in columns], *[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    cov = np.array([[r[f"{a}|{b}"] if (a, b) in pairs else r[f"{b}|{a}"] for b in columns] for a in columns])
    inv = np.linalg.pinv(cov)
    gap = [F.col(c) - r[f"m|{c}"] for c in columns]
    total = sum((gap[i] * gap[j] * float(inv[i, j]) for i in range(len(columns)) for j in range(len(columns))), F.lit(0.0))
    return df.select(key, F.sqrt(F.greatest(F.lit(0.0), total)).alias("mahalanobis"))


def knn_impute(df: DataFrame, key: str, column: str, features: list[str], k: int = 5) -> DataFrame:
    """Nulls of ``column`` become the mean of the k nearest rows that have it, over standardised features."""
    from larkspur.operators.prepare import standard_scaler

    z = standard_scaler(df, features).transform(df).select(key, column, F.array(*features).alias("__v"))
    near = knn_all(z.filter(F.col(column).isNull()), z.filter(F.col(column).isNotNull()), key, "__v", k)
    fill = near.join(z.select(F.col(key).alias("neighbour"), F.col(column).alias("__x")), "neighbour").groupBy("query").agg(F.avg("__x").alias("__fill"))
    return df.join(fill.withColumnRenamed("query", key), key, "left").withColumn(column, F.coalesce(column, "__fill")).drop("__fill")
