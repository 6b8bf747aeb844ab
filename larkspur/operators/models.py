"""Models by name over MLlib, cost-sensitive weights and thresholds, search, ensembles, batch prediction."""

from __future__ import annotations

import itertools
import json
import random
import time
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as G
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import stats
from larkspur.operators.sampling import folds

REGISTRY: dict[str, Callable] = {
    "logistic_regression": C.LogisticRegression, "random_forest": C.RandomForestClassifier, "gradient_boosted_trees": C.GBTClassifier, "decision_tree": C.DecisionTreeClassifier, "naive_bayes": C.NaiveBayes,
    "multilayer_perceptron": C.MultilayerPerceptronClassifier, "linear_svc": C.LinearSVC, "linear_regression": G.LinearRegression, "random_forest_regressor": G.RandomForestRegressor,
    "gbt_regressor": G.GBTRegressor, "decision_tree_regressor": G.DecisionTreeRegressor, "generalized_linear": G.GeneralizedLinearRegression,
}


def register_model(name: str, factory: Callable) -> None:
    REGISTRY[name] = factory


class TabularModel:
    """fit, predict, predict_proba, importance, save, load over one algorithm of the registry. Preparation is part of the
    fitted pipeline, so it is saved with it: ``impute`` (mean, median, mode) fills nulls of numbers, categories become
    numbers (one unknown value more), ``one_hot`` makes them indicators, ``scale`` divides by the standard deviation."""

    def __init__(
        self,
        algorithm: str,
        numeric: list[str],
        categorical: list[str] = (),
        label: str = "label",
        weight: str | None = None,
        impute: str | None = None,
        one_hot: bool = False,
        scale: bool = False,
        **params,
    ):
        if algorithm not in REGISTRY:
            raise ValueError(f"unknown algorithm {algorithm}; known: {', '.join(sorted(REGISTRY))}")
        self.numeric, self.categorical, self.label, self.fitted = list(numeric), list(categorical), label, None
        self.impute, self.one_hot, self.scale = impute, one_hot, scale
        self.about = {"algorithm": algorithm, "numeric": self.numeric, "categorical": self.categorical, "label": label, "impute": impute, "one_hot": one_hot, "scale": scale}
        own = params | ({"weightCol": weight} if weight else {})
        self.estimator = REGISTRY[algorithm](featuresCol="__features", labelCol=label, **own)

    def fit(self, df: DataFrame) -> TabularModel:
        index = [StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in self.categorical]
        numbers, names = list(self.numeric), [f"__{c}" for c in self.categorical]
        more: list = []
        if self.impute and numbers:
            more.append(Imputer(strategy=self.impute, inputCols=numbers, outputCols=[f"__n_{c}" for c in numbers]))
            numbers = more[0].getOutputCols()
        if self.one_hot and names:
            more.append(OneHotEncoder(inputCols=names, outputCols=[f"{c}_hot" for c in names], handleInvalid="keep"))
            names = more[-1].getOutputCols()
        whole = "__raw" if self.scale else "__features"
        more.append(VectorAssembler(inputCols=[*numbers, *names], outputCol=whole, handleInvalid="keep"))
        if self.scale:
            more.append(StandardScaler(inputCol=whole, outputCol="__features"))
        self.fitted = Pipeline(stages=[*index, *more, self.estimator]).fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        made = self.fitted.transform(df)
        own = [f"__{c}" for c in self.categorical]
        return made.drop("__features", "__raw", "rawPrediction", *own, *[f"{c}_hot" for c in own], *[f"__n_{c}" for c in self.numeric])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds score, the probability of label 1."""
        return self.predict(df).withColumn("score", vector_to_array("probability")[1]).drop("probability")

    def importance(self) -> dict[str, float]:
        last = self.fitted.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        return dict(zip([*self.numeric, *self.categorical], map(float, values), strict=False))

    def save(self, path: str) -> None:
        """The fitted pipeline, and beside it what it is about, for ``open``."""
        self.fitted.write().overwrite().save(path)
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    def load(self, path: str) -> TabularModel:
        self.fitted = PipelineModel.load(path)
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TabularModel:
        """A saved model by its path alone."""
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        return cls(about.pop("algorithm"), **about).load(path)


def balanced_weights(df: DataFrame, label: str, costs: dict | None = None) -> DataFrame:
    """Adds weight: rows / (labels x rows of the label), or the costs given by label."""
    if costs:
        names = F.create_map(*[F.lit(x) for kv in costs.items() for x in kv])
        return df.withColumn("weight", F.coalesce(F.try_element_at(names, F.col(label)), F.lit(1.0)))
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = g.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return df.join(F.broadcast(g.crossJoin(total)), label).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def best_threshold(scored: DataFrame, score: str, label: str, by: str = "f1") -> float:
    """Of equally good thresholds the least."""
    s = stats.threshold_sweep(scored, score, label)
    return s.agg(F.max_by("threshold", F.struct(by, -F.col("threshold"))).alias("t")).first().t


def cross_validate(df: DataFrame, key: str, label: str, make: Callable[[], TabularModel], k: int = 3) -> list[float]:
    """AUC of each fold."""
    f = folds(df, key, label, k).persist()
    try:
        return [stats.ranking_metrics(make().fit(f.filter(F.col("fold") != i)).predict_proba(f.filter(F.col("fold") == i)), "score", label).first().auc for i in range(k)]
    finally:
        f.unpersist()


def search(df: DataFrame, key: str, label: str, algorithm: str, numeric: list[str], space: dict[str, list], k: int = 3, seconds: float | None = None, most: int | None = None) -> list[tuple[float, dict]]:
    """Grid search by mean AUC within a time budget; ``most``: an evenly spread part of the grid."""
    grid = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    grid = grid[:: max(1, len(grid) // most)][:most] if most else grid
    return _tried(grid, df, key, label, algorithm, numeric, k, seconds)


def random_search(df: DataFrame, key: str, label: str, algorithm: str, numeric: list[str], space: dict[str, list | tuple], n: int = 10, k: int = 3, seed: int = 42, seconds: float | None = None) -> list[tuple[float, dict]]:
    """n settings drawn by a seed, different ones where there are as many: a list is chosen from, a pair of whole numbers or
    of fractions is a range."""
    draw, grid = random.Random(seed), []

    def one(values):
        if isinstance(values, tuple):
            return draw.randint(*values) if all(isinstance(v, int) for v in values) else draw.uniform(*values)
        return draw.choice(values)

    for _ in range(20 * n):
        made = {name: one(values) for name, values in space.items()}
        if made not in grid and len(grid) < n:
            grid.append(made)
    return _tried(grid, df, key, label, algorithm, numeric, k, seconds)


def _tried(grid: list[dict], df: DataFrame, key: str, label: str, algorithm: str, numeric: list[str], k: int, seconds: float | None) -> list[tuple[float, dict]]:
    end, found = time.monotonic() + (seconds or 1e12), []
    for params in grid:
        if found and time.monotonic() > end:
            break
        scores = cross_validate(df, key, label, lambda p=params: TabularModel(algorithm, numeric, label=label, **p), k)
        found.append((sum(scores) / k, params))
    return sorted(found, key=lambda x: -x[0])


def glm_summary(df: DataFrame, features: list[str], label: str, link: str = "logit") -> list[tuple[str, float, float, float, float]]:
    """term, coefficient, standard error, z and p of a binomial model with link "logit" or "probit"; intercept first."""
    rows = VectorAssembler(inputCols=features, outputCol="__features").transform(df.dropna(subset=[*features, label]))
    m = G.GeneralizedLinearRegression(family="binomial", link=link, featuresCol="__features", labelCol=label, maxIter=50, tol=1e-12).fit(rows)
    s = m.summary  # the intercept is last
    found = zip([*features, "intercept"], [*map(float, m.coefficients), m.intercept], s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    return sorted(found, key=lambda x: x[0] != "intercept")


class Stacked:
    """A model over the scores of others: those learn from one half of the rows (by hash within labels), it from their
    scores of the other half, so it never sees scores of rows that were learnt."""

    def __init__(self, bases: list[TabularModel], label: str = "label", algorithm: str = "logistic_regression", **params):
        self.bases, self.label = bases, label
        self.meta = TabularModel(algorithm, [f"__s{i}" for i in range(len(bases))], label=label, **params)

    def fit(self, df: DataFrame, key: str) -> Stacked:
        halves = folds(df, key, self.label, 2).persist()
        try:
            for m in self.bases:
                m.fit(halves.filter("fold = 0").drop("fold"))
            self.meta.fit(scores_of(self.bases, halves.filter("fold = 1").drop("fold"))[0])
        finally:
            halves.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        made, names = scores_of(self.bases, df)
        return self.meta.predict_proba(made).drop(*names)


def scores_of(models: list[TabularModel], df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds a column of scores for each model. One plan, the models' transforms follow each other."""
    names = []
    for i, m in enumerate(models):
        made = m.predict_proba(df)
        names.append(f"__s{i}")
        df = made.withColumnRenamed("score", names[-1]).drop("prediction", "rawPrediction", "probability")
    return df, names


def vote(models: list[TabularModel], df: DataFrame) -> DataFrame:
    """Adds score: the mean of the models' scores."""
    df, names = scores_of(models, df)
    return df.withColumn("score", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)
