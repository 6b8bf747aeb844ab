"""Training, scoring and runs from a configuration."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur import batch
from larkspur.__main__ import main
from larkspur.operators.models import TabularModel


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Numbers with gaps, a category with a rare value, a label that follows from them."""
    d = spark.range(600).selectExpr("id", "IF(id % 9 = 0, NULL, CAST(id % 10 AS DOUBLE)) AS x", "IF(id % 4 = 0, 'u', 'v') AS kind", "CAST(id % 10 > 4 AS INT) AS label")
    path = str(tmp_path_factory.mktemp("data") / "rows.parquet")
    d.write.parquet(path)
    return path


def config(rows, out, **model):
    return {"data": {"path": rows, "key": "id"}, "output": str(out), "model": {"algorithm": "logistic_regression", "label": "label", "numeric": ["x"], "categorical": ["kind"], "params": {"maxIter": 5}} | model}


@pytest.mark.parametrize("options", [{"impute": "median", "scale": True, "one_hot": True}, {"impute": "mean", "algorithm": "decision_tree", "params": {"maxDepth": 2}}])
def test_saved_preparation_scores_row_by_row(spark, rows, tmp_path, options):
    made = batch.train(spark, config(rows, tmp_path, **options))
    back = TabularModel.open(spark, f"{tmp_path}/model")
    assert back.about == made.about
    d = spark.read.parquet(rows).withColumn("kind", F.when(F.col("id") == 1, "new").otherwise(F.col("kind")))
    a, b = ({r.id: r.score for r in m.predict_proba(d).collect()} for m in (made, back))
    assert a == b and len(a) == 600 and len(set(a.values())) > 1
    assert made.predict_proba(d).columns == ["id", "x", "kind", "label", "prediction", "score"]


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_batch_scores_in_every_format(spark, rows, tmp_path, fmt):
    batch.train(spark, config(rows, tmp_path, impute="mean"))
    want = {r.id: r.score for r in TabularModel.open(spark, f"{tmp_path}/model").predict_proba(spark.read.parquet(rows)).collect()}
    batch.score(spark, f"{tmp_path}/model", rows, f"{tmp_path}/out.{fmt}", fmt, True)
    got = {r.id: float(r.probability) for r in batch.read(spark, f"{tmp_path}/out.{fmt}").collect()}
    assert got == pytest.approx(want)
    batch.score(spark, f"{tmp_path}/model", f"{tmp_path}/out.{fmt}", f"{tmp_path}/again.{fmt}", fmt) if fmt != "json" else None


def test_a_run_resumes_and_is_logged(spark, rows, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config(rows, "${LARKSPUR_TEST_OUT:" + str(tmp_path / "out") + "}", impute="mean")))
    first = batch.run(spark, batch.load_config(str(path)), "one")
    assert 0.9 < first["auc"] <= 1
    assert batch.run(spark, batch.load_config(str(path)), "one") == first  # all stages are there
    assert main(["run", str(path), "two"]) == 0 and main(["validate", str(path)]) in (0, 1)
    from larkspur.pipeline import Tracker

    assert {r.run for r in Tracker(spark, str(tmp_path / "out" / "runs")).search("metrics['auc'] > 0.9").collect()} == {"one", "two"}
    with pytest.raises(ValueError, match="model.label is missing"):
        batch.run(spark, {"data": {"path": "x", "key": "id"}, "model": {"algorithm": "a", "numeric": []}, "output": "o"}, "three")
    assert main(["predict"]) == 2
