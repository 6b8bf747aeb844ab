"""Principal components of array columns: sums of products by one aggregation, eigenvectors of the small matrix on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pca:
    """mean, components (rows, by falling variance, the entry of largest size positive), variances (sample) and shares."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, variances: np.ndarray, shares: np.ndarray, n: int):
        self.mean, self.components, self.variances, self.shares, self.n = mean, components, variances, shares, n

    def transform(self, df: DataFrame, vector: str, name: str = "projection") -> DataFrame:
        """Adds the coordinates of each row along the components (null for a null vector)."""
        centred = F.zip_with(F.col(vector).cast("array<double>"), F.lit(self.mean.tolist()), lambda x, m: x - m)
        dot = lambda c: F.aggregate(F.zip_with(centred, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return df.withColumn(name, F.when(F.col(vector).isNotNull(), F.transform(F.lit(self.components.tolist()), dot)))


def pca(df: DataFrame, vector: str, k: int) -> Pca:
    """Each task adds up the products of its rows, in batches, less the first row's values, so large means lose no digits;
    the entries of these sums are added by position. Rows with a null vector count nowhere."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    first = rows.first()
    if first is None:
        return Pca(np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    shift = np.array(first.v)
    d = len(shift)

    def sums(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) - shift
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total += x.T @ x
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

    found = rows.mapInArrow(sums, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # (d + 1)^2 entries
    total = np.zeros((d + 1) ** 2)
    for r in found:
        total[r.i] = r.x
    total = total.reshape(d + 1, d + 1)
    n = int(round(total[0, 0]))
    mean = total[0, 1:] / n
    cov = (total[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    components = vectors[:, order].T
    components *= np.sign(components[np.arange(len(order)), np.abs(components).argmax(1)])[:, None]
    variances = np.maximum(values[order], 0.0)
    whole = np.trace(cov)
    return Pca(mean + shift, components, variances, variances / whole if whole > 0 else variances, n)
