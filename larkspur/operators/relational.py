"""Projection, joins, aggregates and set operations that need more than one call."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Literals and quoted names, which stay as they are, and the operators of configured expressions.
_SIGNS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\|\||&&|[|&]""", re.S)


def configured(expression: str) -> str:
    """``|`` is OR, ``&`` and ``&&`` are AND; ``||`` joins strings; literals and quoted names are left alone."""
    return _SIGNS.sub(lambda m: {"|": " OR ", "&": " AND ", "&&": " AND "}.get(m[0], m[0]), expression)


def derived(df: DataFrame, features: list[dict]) -> DataFrame:
    """Configured features: [{name, expression, type}], expressions as ``configured`` reads them."""
    return df.select("*", *[F.expr(configured(f["expression"])).cast(f.get("type", "double")).alias(f["name"]) for f in features])


def configured_aggregates(df: DataFrame, group: list[str], features: list[dict], back: bool = False) -> DataFrame:
    """features: [{column, agg: [mean, sum, ...]}], as columns column_agg; ``back``: joined to the rows as windows."""
    kinds = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev, "count": F.count, "nunique": F.countDistinct}
    pairs = [(f["column"], a) for f in features for a in f["agg"]]
    if back:
        w = Window.partitionBy(*group)
        return df.select("*", *[kinds[a](c).over(w).alias(f"{c}_{a}") for c, a in pairs])
    return df.groupBy(*group).agg(*[kinds[a](c).alias(f"{c}_{a}") for c, a in pairs])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows less distinct rows; nulls are equal to each other."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def nearest_quantile(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value whose index is nearest to p * (n - 1); a half rounds away from zero."""
    w = Window.partitionBy(group)
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("at", F.row_number().over(w.orderBy(value)) - 1)
        .withColumn("n", F.count(F.lit(1)).over(w))
        .filter(F.col("at") == F.round((F.col("n") - 1) * p))
        .select(group, F.col(value).alias("quantile"))
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over min..max, the last one closed: bin, n. The bounds are a one-row aggregate."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return (
        df.filter(F.col(value).isNotNull())
        .crossJoin(F.broadcast(bounds))
        .groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fixed_bins(value: Column, edges: list[float], labels: list[str]) -> Column:
    """(edge, edge] bins; outside: null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((value > lo) & (value <= hi), label)
    return out


def smallest_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value; of ties the smallest."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: a row for each pair of columns with its Pearson correlation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones each time: those of smallest hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def join_suffixed(left: DataFrame, right: DataFrame, key: str, how: str = "left", suffix: str = "_lookup") -> DataFrame:
    """Columns of the right side that the left has too get the suffix."""
    renamed = right.select(*[F.col(c).alias(c + suffix if c in left.columns and c != key else c) for c in right.columns])
    return left.join(renamed, key, how)


def add_totals(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Sums of two keyed series, a missing one counting as 0: by union, so one shuffle."""
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))
