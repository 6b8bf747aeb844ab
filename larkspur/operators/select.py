"""Choosing features for a least-squares target. All sums come from one aggregation (causal.normal_equations); the steps work
on that small system, so their cost does not grow with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.operators.causal import normal_equations


class Sums:
    """Centred and scaled sums: correlations of the features, and of each with the target."""

    def __init__(self, df: DataFrame, features: list[str], target: str):
        import numpy as np

        a, b, yy, n = (np.array(x, dtype=float) for x in normal_equations(df, features, target))
        mean, my = a[0, 1:] / n, b[0] / n
        cov, cy, vy = a[1:, 1:] / n - np.outer(mean, mean), b[1:] / n - mean * my, yy / n - my * my
        size = np.sqrt(np.maximum(np.diag(cov), 0.0))
        self.spread = np.where(size > 0, size, 1.0)
        self.x, self.y = cov / np.outer(self.spread, self.spread), cy / self.spread / (np.sqrt(vy) or 1.0)
        self.target_spread, self.features, self.n = float(np.sqrt(vy)), list(features), int(n)

    def fit(self, at: list[int]):
        """Standardised coefficients and R² of some features."""
        import numpy as np

        if not at:
            return np.zeros(0), 0.0
        w = np.linalg.lstsq(self.x[np.ix_(at, at)], self.y[at], rcond=None)[0]
        return w, float(w @ self.y[at])


def univariate(df: DataFrame, features: list[str], target: str) -> list[tuple[str, float]]:
    """feature and R² of it alone, best first."""
    s = Sums(df, features, target)
    return sorted(((f, float(r * r)) for f, r in zip(features, s.y, strict=True)), key=lambda x: (-x[1], x[0]))


def forward(df: DataFrame, features: list[str], target: str, most: int, least_gain: float = 0.0) -> list[tuple[str, float]]:
    """Adds the feature that raises R² most, while it gains more than ``least_gain``: feature and R² after it."""
    s, have, steps = Sums(df, features, target), [], []
    while len(have) < min(most, len(features)):
        r2, i = max((s.fit([*have, i])[1], -i) for i in range(len(features)) if i not in have)
        if r2 - (steps[-1][1] if steps else 0.0) <= least_gain:
            break
        have.append(-i)
        steps.append((features[-i], r2))
    return steps


def recursive_elimination(df: DataFrame, features: list[str], target: str, keep: int) -> list[str]:
    """Drops the feature of smallest standardised coefficient until ``keep`` are left."""
    s, at = Sums(df, features, target), list(range(len(features)))
    while len(at) > keep:
        w, _ = s.fit(at)
        at.remove(min(zip(abs(w), at, strict=True))[1])
    return [features[i] for i in at]


def lasso(df: DataFrame, features: list[str], target: str, penalty: float, rounds: int = 1000) -> dict[str, float]:
    """Coefficients, in the columns' units, of least squares with an L1 penalty on standardised columns; by coordinate
    descent on the correlations. Features that are not chosen have 0."""
    s = Sums(df, features, target)
    w = [0.0] * len(features)
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(w)):
            rest = float(s.y[i] - sum(s.x[i, j] * w[j] for j in range(len(w)) if j != i))
            new = max(abs(rest) - penalty, 0.0) * (1 if rest > 0 else -1)
            moved, w[i] = max(moved, abs(new - w[i])), new
        if moved < 1e-12:
            break
    return {f: c * s.target_spread / float(k) for f, c, k in zip(features, w, s.spread, strict=True)}
