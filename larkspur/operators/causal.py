"""Treatment effects from sums: everything that grows with the data is one aggregation, systems are solved on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N = "*"  # what count() counts: rows


def normal_equations(df: DataFrame, columns: list[str], target: str) -> tuple[list[list[float]], list[float], float, int]:
    """X'X, X'y, y'y and n with an intercept first, from one aggregation."""
    names = ["1", *columns]
    x = {"1": F.lit(1.0)} | {c: F.col(c).cast("double") for c in columns}
    y = F.col(target).cast("double")
    rows = df.dropna(subset=[*columns, target])
    aggs = [F.sum(x[a] * x[b]).alias(f"{i},{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    r = rows.agg(*aggs, *[F.sum(x[a] * y).alias(f"y{i}") for i, a in enumerate(names)], F.sum(y * y).alias("yy"), F.count(N).alias("n")).first()
    k = len(names)
    return [[r[f"{min(i, j)},{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], [r[f"y{i}"] or 0.0 for i in range(k)], r["yy"] or 0.0, r["n"]


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    import numpy as np

    return np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0].tolist()


def linear_fit(df: DataFrame, columns: list[str], target: str) -> list[float]:
    """Intercept and coefficients of least squares."""
    a, b, _, _ = normal_equations(df, columns, target)
    return solve(a, b)


def ols_summary(df: DataFrame, columns: list[str], target: str) -> list[tuple[str, float, float, float]]:
    """term, coefficient, standard error, t of least squares with an intercept; sums by one aggregation."""
    import numpy as np

    a, b, yy, n = normal_equations(df, columns, target)
    w = np.array(solve(a, b))
    rest = max(yy - float(w @ np.array(b)), 0.0) / max(n - len(w), 1)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(np.array(a))) * rest, 0.0))
    return [(name, float(c), float(e), float(c / e) if e else math.nan) for name, c, e in zip(["intercept", *columns], w, errors, strict=True)]


def ate_regression(df: DataFrame, treatment: str, outcome: str, confounders: list[str]) -> float:
    """The coefficient of the treatment with confounders held."""
    return linear_fit(df, [treatment, *confounders], outcome)[1]


def ate_ipw(df: DataFrame, treatment: str, outcome: str, propensity: str, clip: float = 0.01) -> DataFrame:
    """Hajek ratio: ate from inverse-propensity weights."""
    p = F.least(F.greatest(F.col(propensity), F.lit(clip)), F.lit(1 - clip))
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    g = df.agg(F.sum(t * y / p).alias("a"), F.sum(t / p).alias("b"), F.sum((1 - t) * y / (1 - p)).alias("c"), F.sum((1 - t) / (1 - p)).alias("d"))
    return g.select((F.col("a") / F.col("b") - F.col("c") / F.col("d")).alias("ate"))


def nearest_matches(df: DataFrame, key: str, treatment: str, propensity: str, outcome: str, bins: int = 1000) -> DataFrame:
    """For each treated row the untreated row of nearest propensity (of equally near ones the lower score, then least
    key): key, outcome, match_outcome. Untreated rows are first reduced to one for each score; scores go to bins, and a
    bin's nearest scores below and above come from running extremes over one row a bin."""
    at = F.floor(F.col("p") * bins)
    base = df.select(F.col(key).alias("key"), F.col(treatment).cast("int").alias("t"), F.col(propensity).cast("double").alias("p"), F.col(outcome).cast("double").alias("y")).dropna(subset=["p", "y"])
    control = base.filter("t = 0").groupBy("p").agg(F.min_by("y", "key").alias("cy")).withColumn("bin", at)
    ends = control.groupBy("bin").agg(F.max(F.struct("p", "cy")).alias("top"), F.min(F.struct("p", "cy")).alias("low"))
    grid = df.sparkSession.range(bins + 1).select(F.col("id").alias("bin")).join(F.broadcast(ends), "bin", "left")
    w = Window.orderBy("bin")  # bins + 1 rows
    ends = grid.select("bin", F.last("top", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("under"), F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("over"))
    both = base.filter("t = 1").select("key", "p", "y", F.lit(None).cast("double").alias("cy"), at.alias("bin")).unionByName(control.select(F.lit(None).alias("key"), "p", F.lit(None).cast("double").alias("y"), "cy", "bin"))
    own = Window.partitionBy("bin").orderBy("p")
    here = F.when(F.col("cy").isNotNull(), F.struct("p", "cy"))
    near = both.withColumn("below", F.last(here, True).over(own.rangeBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first(here, True).over(own.rangeBetween(0, Window.unboundedFollowing)))
    j = near.filter("key IS NOT NULL").join(F.broadcast(ends), "bin").select("key", "p", "y", F.coalesce("below", "under").alias("lo"), F.coalesce("above", "over").alias("hi"))
    lower = F.col("hi").isNull() | (F.round(F.col("p") - F.col("lo")["p"], 9) <= F.round(F.col("hi")["p"] - F.col("p"), 9))
    return j.select("key", F.col("y").alias("outcome"), F.when(F.col("lo").isNull(), F.col("hi")["cy"]).when(lower, F.col("lo")["cy"]).otherwise(F.col("hi")["cy"]).alias("match_outcome"))


def structure(df: DataFrame, columns: list[str], least: float = 0.3, alpha: float = 0.05) -> list[tuple[str, str]]:
    """Edges between columns whose correlation is significant or above ``least``, from higher to lower variance."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(F.count(N).alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.variance(c).alias(f"v|{c}") for c in columns]).first()
    edges = []
    for a, b in pairs:
        c = r[f"{a}|{b}"] or 0.0
        t = abs(c) * math.sqrt(max(r["n"] - 2, 1) / max(1e-12, 1 - c * c))
        if abs(c) > least or math.erfc(t / math.sqrt(2)) < alpha:
            edges.append((a, b) if r[f"v|{a}"] >= r[f"v|{b}"] else (b, a))
    return edges


class CausalGraph:
    """A small directed graph of variables."""

    def __init__(self, edges: list[tuple[str, str]]):
        self.edges = list(edges)

    def _reach(self, start: str, step) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for n in step(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def ancestors(self, v: str) -> set[str]:
        return self._reach(v, lambda x: [a for a, b in self.edges if b == x])

    def descendants(self, v: str) -> set[str]:
        return self._reach(v, lambda x: [b for a, b in self.edges if a == x])

    def backdoor_paths(self, treatment: str, outcome: str) -> list[list[str]]:
        """Simple undirected paths from treatment to outcome that begin with an arrow into the treatment."""
        near: dict[str, set[str]] = {}
        for a, b in self.edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found = []

        def walk(path: list[str]) -> None:
            if path[-1] == outcome:
                found.append(path)
                return
            for n in sorted(near.get(path[-1], ())):
                if n not in path:
                    walk([*path, n])

        for a, b in self.edges:
            if b == treatment:
                walk([treatment, a])
        return found
