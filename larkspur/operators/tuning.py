"""Search for settings that learns from earlier trials, growing budgets, and boosting that stops by a validation set.

Trials run on Spark (each is a fit or an aggregation); what is kept of one is its setting and its score, so proposing the next
is a small calculation on the driver."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import stats
from larkspur.operators.models import TabularModel
from larkspur.operators.sampling import unit

Setting = dict[str, object]
Trial = tuple[float, Setting]


# ---------------------------------------------------------------- Bayesian search


def _draw(values, r: random.Random):
    """A list is chosen from, a pair of whole numbers or of fractions is a range."""
    if isinstance(values, tuple):
        return r.randint(*values) if all(isinstance(v, int) for v in values) else r.uniform(*values)
    return r.choice(values)


def _coded(setting: Setting, space: dict[str, list | tuple]) -> list[float]:
    """A point: ranges as shares of their width, choices as coordinates of their own, two different ones one apart."""
    out: list[float] = []
    for name, values in space.items():
        if isinstance(values, tuple):
            out.append((setting[name] - values[0]) / ((values[1] - values[0]) or 1))
        else:
            out += [(setting[name] == v) / 2**0.5 for v in values]
    return out


def _near(setting: Setting, space: dict[str, list | tuple], width: float, r: random.Random) -> Setting:
    """A setting close by: numbers move, a choice is drawn anew now and then."""
    out = {}
    for name, values in space.items():
        if isinstance(values, tuple):
            x = min(values[1], max(values[0], setting[name] + r.gauss(0, width * (values[1] - values[0]))))
            out[name] = round(x) if all(isinstance(v, int) for v in values) else x
        else:
            out[name] = r.choice(values) if r.random() < 0.2 else setting[name]
    return out


class Surrogate:
    """A Gaussian process over the scores of trials: squared-exponential kernel, the length and the noise of a small grid
    that make the scores likeliest."""

    def __init__(self, points: np.ndarray, scores: np.ndarray):
        self.points, self.mean, self.sd = points, scores.mean(), scores.std() or 1.0
        y, best = (scores - self.mean) / self.sd, None
        for length in (0.1, 0.2, 0.4, 0.8, 1.6):
            for noise in (1e-6, 1e-3, 1e-1):
                root = np.linalg.cholesky(self._kernel(points, points, length) + noise * np.eye(len(y)))
                half = np.linalg.solve(root, y)
                likely = -0.5 * half @ half - np.log(np.diag(root)).sum()
                if best is None or likely > best:
                    best, self.length, self.root, self.half = likely, length, root, half

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * length * length))

    def predict(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations."""
        part = np.linalg.solve(self.root, self._kernel(self.points, points, self.length))
        return self.mean + self.sd * (part.T @ self.half), self.sd * np.sqrt(np.maximum(1e-12, 1 - (part**2).sum(0)))

    def expected_improvement(self, points: np.ndarray, best: float) -> np.ndarray:
        mean, sd = self.predict(points)
        z = (mean - best) / sd
        bell, under = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), 0.5 * (1 + np.array([math.erf(v / 2**0.5) for v in z]))
        return (mean - best) * under + sd * bell


def propose(trials: list[Trial], space: dict[str, list | tuple], start: int = 8, candidates: int = 300, seed: int = 42) -> Setting:
    """The next setting, by the trials so far alone: at first drawn evenly; then, of candidates drawn evenly and near the best
    trials, the one from which a Gaussian process over the trials expects the largest improvement."""
    r = random.Random(f"{seed}|{len(trials)}")
    drawn = lambda: {name: _draw(values, r) for name, values in space.items()}
    if len(trials) < start:
        return drawn()
    ranked = sorted(trials, key=lambda t: -t[0])
    made = [drawn() for _ in range(candidates)]
    made += [_near(p, space, width, r) for _, p in ranked[:3] for width in (0.02, 0.1) for _ in range(candidates // 6)]
    known = [t[1] for t in trials]
    fresh = [m for m in made if m not in known] or made
    model = Surrogate(np.array([_coded(p, space) for p in known]), np.array([t[0] for t in trials], float))
    gain = model.expected_improvement(np.array([_coded(m, space) for m in fresh]), ranked[0][0])
    return fresh[int(gain.argmax())]


def bayesian_search(objective: Callable[[Setting], float], space: dict[str, list | tuple], n: int = 20, seed: int = 42, **options) -> list[Trial]:
    """n trials in their order, each proposed from those before; larger scores are better."""
    trials: list[Trial] = []
    for _ in range(n):
        setting = propose(trials, space, seed=seed, **options)
        trials.append((objective(setting), setting))
    return trials


def confirmed(trials: list[Trial], objective: Callable[[Setting], float], space: dict[str, list | tuple]) -> Trial:
    """The best of a space of choices and whole numbers for certain: settings that the trials have left out are scored too,
    for objectives that cost next to nothing."""
    known = [p for _, p in trials]
    each = [range(v[0], v[1] + 1) if isinstance(v, tuple) else v for v in space.values()]
    rest = [p for p in (dict(zip(space, values, strict=True)) for values in itertools.product(*each)) if p not in known]
    return max([*trials, *[(objective(p), p) for p in rest]], key=lambda t: t[0])


# ---------------------------------------------------------------- growing budgets


def successive_halving(
    df: DataFrame,
    key: str,
    settings: list[Setting],
    evaluate: Callable[[DataFrame, Setting], float],
    eta: int = 3,
    least: float = 0.05,
    seed: int = 42,
) -> list[dict]:
    """Every setting is tried on a small share of the rows; the best 1 / ``eta`` of them go on with ``eta`` times the rows,
    until one is left or all rows are used. Shares are by hash of the key, each inside the next. One record for each trial:
    rung, share, setting (its number), score, kept."""
    out, live, share, rung = [], list(range(len(settings))), float(least), 0
    while live:
        rows = df if share >= 1 else df.filter(unit(key, seed) < share)
        scored = sorted(((evaluate(rows, settings[i]), i) for i in live), key=lambda x: (-x[0], x[1]))
        keep = [i for _, i in scored[: max(1, len(scored) // eta)]]
        last = len(live) == 1 or share >= 1
        out += [{"rung": rung, "share": min(1.0, share), "setting": i, "score": s, "kept": i == keep[0] if last else i in keep} for s, i in scored]
        if last:
            return out
        live, share, rung = keep, share * eta, rung + 1
    return out


# ---------------------------------------------------------------- early stopping


def log_loss(probability: Column, label: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def stop_round(losses: list[float], tolerance: float = 0.01, patience: int = 1) -> int:
    """The round (from 1) of least loss before improvement has stayed under ``tolerance`` (relative) for ``patience`` rounds."""
    best, at, still = losses[0], 1, 0
    for i, x in enumerate(losses[1:], 2):
        still = 0 if best - x >= tolerance * max(abs(x), 1e-9) else still + 1
        if x < best:
            best, at = x, i
        if still >= patience:
            break
    return at


class Boosted:
    """Gradient boosted trees whose number is chosen on validation rows: all ``rounds`` are fitted, their losses on the
    validation rows come from one aggregation, and the trees after the stopping round are left out."""

    def __init__(self, features: list[str], label: str = "label", rounds: int = 20, depth: int = 3, step: float = 0.3, tolerance: float = 0.01, patience: int = 2, seed: int = 1):
        self.features, self.label, self.tolerance, self.patience = features, label, tolerance, patience
        self.model = TabularModel("gradient_boosted_trees", features, label=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
        self.losses: list[float] = []
        self.rounds = rounds

    def fit(self, train: DataFrame, valid: DataFrame) -> Boosted:
        self.model.fit(train)
        parts = self._margins()
        running = [sum(parts[: i + 1], F.lit(0.0)) for i in range(len(parts))]
        y = F.col(self.label).cast("double")
        row = valid.agg(*[F.avg(log_loss(1 / (1 + F.exp(-2 * m)), y)).alias(str(i)) for i, m in enumerate(running)]).first()
        self.losses = list(row)
        self.rounds = stop_round(self.losses, self.tolerance, self.patience)
        return self

    def _margins(self) -> list[Column]:
        """Each tree's weighted prediction as an expression of the features: trees are nested conditions, in the JVM."""
        ensemble = self.model.fitted.stages[-1]
        return [_tree_column(t._java_obj.rootNode(), self.features) * float(w) for t, w in zip(ensemble.trees, ensemble.treeWeights, strict=True)]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds score, the probability of label 1, by the trees up to the stopping round."""
        margin = sum(self._margins()[: self.rounds], F.lit(0.0))
        return df.withColumn("score", 1 / (1 + F.exp(-2 * margin)))


def _tree_column(node, features: list[str]) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    x = F.col(features[split.featureIndex()])
    return F.when(x <= float(split.threshold()), _tree_column(node.leftChild(), features)).otherwise(_tree_column(node.rightChild(), features))


def auc(scored: DataFrame, label: str) -> float:
    return stats.ranking_metrics(scored, "score", label).first().auc
