"""Training, scoring and whole runs from a configuration: what the command line does."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import stats
from larkspur.operators.models import TabularModel
from larkspur.operators.sampling import random_split
from larkspur.pipeline import Runner, Stage, Tracker, check_config
from larkspur.sources.files import write

#: What a configuration must have.
REQUIRED = {"data.path": str, "data.key": str, "model.algorithm": str, "model.label": str, "model.numeric": list, "output": str}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines or CSV with a header (types inferred), by the extension."""
    kind = (re.search(r"\.(csv|json|parquet)(\.gz)?/?$", path) or [None, "parquet"])[1]
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if kind == "json" else spark.read.parquet(path)


def train(spark: SparkSession, config: dict) -> TabularModel:
    """Fits and saves the model of a configuration."""
    model = _model(config).fit(_labelled(read(spark, config["data"]["path"]), config))
    model.save(f"{config['output']}/model")
    return model


def score(spark: SparkSession, model: str, data: str, out: str, fmt: str = "csv", probabilities: bool = False) -> DataFrame:
    """Scores a file by a saved model in one pass and writes the rows with prediction (and probability: of label 1)."""
    rows = read(spark, data).drop("prediction", "probability", "rawPrediction")  # of an earlier scoring
    made = TabularModel.open(spark, model).predict(rows)
    names = [c for c in made.columns if c != "probability"]
    if probabilities and "probability" in made.columns:
        from pyspark.ml.functions import vector_to_array

        made = made.select(*[F.col(f"`{c}`") for c in names], vector_to_array("probability")[1].alias("probability"))
    else:
        made = made.select(*[F.col(f"`{c}`") for c in names])
    write(made, out, fmt)
    return made


def run(spark: SparkSession, config: dict, run_id: str, resume: bool = True) -> dict[str, float]:
    """Split, fit, score and measure as stages; what a run that broke off has done is not done again. Metrics are logged."""
    problems = check_config(config, REQUIRED)
    if problems:
        raise ValueError("; ".join(problems))
    root, key, label = config["output"], config["data"]["key"], config["model"]["label"]
    path = f"{root}/{run_id}.model"

    def split(s, c, frames):
        return random_split(_labelled(read(s, c["data"]["path"]), c), key, seed=int(c.get("seed", 42)))

    def scores(s, c, frames):
        rows = frames["split"]
        model = _model(c).fit(rows.filter("split = 'train'").drop("split"))
        model.save(path)
        return TabularModel.open(s, path).predict_proba(rows.filter("split <> 'train'")).select(key, label, "split", "prediction", "score")

    def metrics(s, c, frames):
        test = frames["scores"].filter("split = 'test'")
        return stats.ranking_metrics(test, "score", label).select(F.col("auc"), F.col("ks"))

    runner = Runner(spark, f"{root}/artifacts", [Stage("split", split), Stage("scores", scores, ["split"]), Stage("metrics", metrics, ["scores"])], config)
    found = runner.run(run_id, resume)["metrics"].first().asDict()
    Tracker(spark, f"{root}/runs").log(run_id, {"algorithm": config["model"]["algorithm"]} | config["model"].get("params", {}), found)
    return found


def _labelled(df: DataFrame, config: dict) -> DataFrame:
    return df.filter(F.col(config["model"]["label"]).isNotNull())


def _model(config: dict) -> TabularModel:
    m = config["model"]
    more = {k: m[k] for k in ("impute", "scale", "one_hot") if k in m}
    return TabularModel(m["algorithm"], m["numeric"], m.get("categorical", []), m["label"], **more, **m.get("params", {}))


def load_config(path: str) -> dict:
    from larkspur.pipeline import substitute

    with open(path) as f:
        return substitute(json.load(f))
