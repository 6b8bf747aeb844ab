"""Operators of plans.further without SQL, and their edges: against numpy, against their definition, on empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import compare, neighbors, prepare, profile, sampling, select, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * x[:, 2] + rng.normal(size=400) * 0.2
    return x, y, spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y double")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    v = np.vstack([rng.normal(0, 1, (12, 3)), rng.normal(0.5, 1, (40, 3))])
    return spark.createDataFrame([(i, [float(x) for x in r], int(i >= 12)) for i, r in enumerate(v)], "id bigint, v array<double>, label int").cache()


def r2(x, y, at):
    a = np.column_stack([np.ones(len(y)), x[:, at]])
    rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    return 1 - rest.var() / y.var()


def test_forward_takes_the_best_at_each_step(table):
    x, y, df = table
    have = []
    for f, got in select.forward(df, list("abcd"), "y", 4, -1.0):
        best = max((r2(x, y, [*have, i]), i) for i in range(4) if i not in have)
        assert "abcd"[best[1]] == f and got == pytest.approx(best[0], abs=1e-9)
        have.append(best[1])


def test_elimination_and_lasso(table):
    x, y, df = table
    assert select.recursive_elimination(df, list("abcd"), "y", 2) == ["a", "b"]
    free = select.lasso(df, list("abcd"), "y", 0.0)
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0][1:]
    assert [free[c] for c in "abcd"] == pytest.approx(list(want), abs=1e-6)
    some = select.lasso(df, list("abcd"), "y", 0.2)
    assert some["a"] > 0 > some["b"] and some["c"] == some["d"] == 0.0
    assert set(select.lasso(df, list("abcd"), "y", 1.0).values()) == {0.0}


def test_adasyn_rows_are_between_minority_rows(points):
    weights = {r.source: r.n_new for r in sampling.adasyn_weights(points, "id", "v", "label", 0).collect()}
    vector = {r.id: np.array(r.v) for r in points.filter("label = 0").collect()}
    made = sampling.adasyn(points, "id", "v", "label", 0).collect()
    assert set(weights) == set(vector) and abs(sum(weights.values()) - 28) <= 6
    counts = {k: 0 for k in weights}
    for r in made:
        a, b, c = vector[r.source], vector[r.neighbour], np.array(r.vector)
        near = sorted((float(np.linalg.norm(a - v)), k) for k, v in vector.items() if k != r.source)[:5]
        assert r.neighbour in [k for _, k in near]
        assert np.linalg.norm(a - c) + np.linalg.norm(c - b) == pytest.approx(np.linalg.norm(a - b))
        counts[r.source] += 1
    assert counts == weights
    assert sampling.adasyn(points.limit(0), "id", "v", "label", 0).count() == 0


def test_cleaned_smote_drops_linked_rows(points):
    made = sampling.smote(points, "id", "v", "label", 0).collect()
    rows = {str(r.id): (np.array(r.v), r.label) for r in points.collect()} | {f"{r.source}>{r.neighbour}": (np.array(r.vector), 0) for r in made}
    near = {k: sorted((float(np.linalg.norm(v - w)), j) for j, (w, _) in rows.items() if j != k) for k, (v, _) in rows.items()}
    linked = {k for k in rows if near[near[k][0][1]][0][1] == k and rows[near[k][0][1]][1] != rows[k][1]}
    assert linked
    assert {r.id for r in sampling.smote_cleaned(points, "id", "v", "label", 0, "tomek").collect()} == set(rows) - linked
    kept = {k for k in rows if sum(rows[j][1] == rows[k][1] for _, j in near[k][:3]) >= 2}
    assert {r.id for r in sampling.smote_cleaned(points, "id", "v", "label", 0, "enn").collect()} == kept


def test_query_blocks_by_bytes_change_nothing(points, monkeypatch):
    found = lambda: sorted((r.query, r.place, r.neighbour) for r in neighbors.knn(points, points, "id", "v", 3).collect())
    whole = found()
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 300)
    assert len(neighbors.query_blocks(points, "id", "v")) > 3
    assert found() == whole


def test_outliers_and_power(spark, table):
    _, _, df = table
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert [r.x for r in prepare.outliers_z(flat, ["x"]).collect()] == [1.0, 1.0, None]
    assert prepare.outliers_z(flat, ["x"], action="remove").count() == 3
    assert prepare.outliers_z(flat.limit(0), ["x"]).count() == 0
    assert prepare.outliers_z(df, ["a"], 1.0, "flag").filter("a_outlier").count() + prepare.outliers_z(df, ["a"], 1.0, "remove").count() == 400
    with pytest.raises(ValueError):
        prepare.power_transformer(df, ["a"], method="box-cox")


def test_expectations_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "x double, k string")
    e = [profile.unique("x"), profile.within_iqr("x"), profile.within_z("x"), profile.has_column("x"), profile.has_column("y"), profile.has_type("y", "int")]
    assert [r.share for r in profile.validate(empty, e).collect()] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def test_drift_report_tells_moved_from_unmoved(spark):
    rng = np.random.default_rng(3)
    old, new = rng.normal(size=(2, 1500))
    a = spark.createDataFrame([(float(x), float(x), 1) for x in old], "same double, moved double, flat int")
    b = spark.createDataFrame([(float(x), float(x) + 1.0, 1) for x in new], "same double, moved double, flat int")
    got = {r.feature: r for r in compare.drift_report(a, b, ["same", "moved", "flat"]).collect()}
    assert got["moved"].severity == "high" and got["moved"].drifted
    assert (got["flat"].psi, got["flat"].ks, got["flat"].js) == (0.0, 0.0, 0.0) and got["flat"].severity == "low"
    assert got["same"].ks < 0.08 and got["same"].ks == pytest.approx(max(abs((old <= x).mean() - (new <= x).mean()) for x in [*old, *new]))


def test_signed_ranks_and_average_ranks(spark):
    d = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (5.0, 5.0), (9.0, 1.0), (None, 1.0)], "a double, b double")
    r = stats.wilcoxon(d, "a", "b").first()
    assert (r.n, r.w_plus, r.w_minus) == (3, 4.5, 1.5)
    assert stats.wilcoxon(d.limit(0), "a", "b").count() == 1
    ranks = {x.value: (x.rank, x.times) for x in stats.average_ranks(d, "b").collect()}
    assert ranks == {1.0: (2.0, 3), 3.0: (4.0, 1), 5.0: (5.0, 1)}
    q = {(x.a, x.a_quantile) for x in prepare.rank_scale(d, "a").collect()}
    assert (None, None) in q and (9.0, 1.0) in q and (1.0, 0.0) in q


def test_probit_of_two_groups_is_the_normal_quantile(spark):
    from statistics import NormalDist

    from larkspur.operators import models

    rows = [(float(x), float(y)) for x, y, n in ((0, 0, 80), (0, 1, 20), (1, 0, 30), (1, 1, 70)) for _ in range(n)]
    found = {r[0]: r for r in models.glm_summary(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", "probit")}
    at = NormalDist().inv_cdf
    assert found["intercept"][1] == pytest.approx(at(0.2), abs=1e-6) and found["x"][1] == pytest.approx(at(0.7) - at(0.2), abs=1e-6)
    assert found["x"][3] == pytest.approx(found["x"][1] / found["x"][2]) and 0 <= found["x"][4] < 1e-6


def test_iterative_imputer_finds_what_depends_on_other_columns(spark):
    from larkspur.operators import prepare

    rows = [(i, None if i % 7 == 0 else 2.0 * i + 1, None if i % 7 == 3 else 5.0 - i, float(i)) for i in range(50)]
    got = prepare.iterative_impute(spark.createDataFrame(rows, "k int, a double, b double, c double"), ["a", "b", "c"], 3).collect()
    assert len(got) == 50 and all(r.a == pytest.approx(2 * r.k + 1) and r.b == pytest.approx(5 - r.k) for r in got)
    whole = spark.createDataFrame([(1, 1.0)], "k int, a double")
    assert prepare.iterative_impute(whole, ["a"]).collect() == whole.collect()
    empty = prepare.iterative_impute(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"])
    assert empty.first().a is None


def test_random_search_draws_different_settings_inside_their_ranges(spark):
    from larkspur.operators import models

    rows = [(i, float(i % 10), float(i % 10 > 4)) for i in range(120)]
    d = spark.createDataFrame(rows, "id int, x double, label double")
    found = models.random_search(d, "id", "label", "decision_tree", ["x"], {"maxDepth": (1, 3), "impurity": ["gini", "entropy"]}, n=2, k=2)
    assert len(found) == 2 and found[0][1] != found[1][1] and all(1 <= p["maxDepth"] <= 3 for _, p in found)
    assert found[0][0] >= found[1][0] > 0.9


def test_criticisms_refuse_unbounded_prototypes_and_psi_takes_empty_periods(spark):
    from larkspur.operators import compare, explain

    d = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "k int, v array<double>")
    assert [(r.k, r.distance) for r in explain.criticisms(d, d.filter("k = 0"), "k", "v", 2).collect()] == [(4, 4.0), (3, 3.0)]
    with pytest.raises(ValueError):
        explain.criticisms(d, d, "k", "v", 2, most=4)
    x = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, 2)], "x double, p int")
    assert [(r.period, r.n, r.psi) for r in compare.psi_by_period(x, x, "x", F.col("p")).collect()] == [(1, 2, 0.0)]


def test_runs_are_searched_by_condition(spark, tmp_path):
    from larkspur.pipeline import Tracker

    t = Tracker(spark, str(tmp_path))
    t.log("a", {"depth": 3}, {"auc": 0.9})
    t.log("b", {"depth": 5}, {"auc": 0.7})
    assert [r.run for r in t.search("metrics['auc'] > 0.8 AND params['depth'] = '3'").collect()] == ["a"]
