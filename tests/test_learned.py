"""Searches, budgets, boosting, concepts and clusters against closed forms and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import clusters, concepts, models, tuning

SPACE = {"x": (-5.0, 5.0), "n": (1, 40), "kind": ["a", "b", "c"]}


def surface(p):
    return -((p["x"] - 2) ** 2) - 0.02 * (p["n"] - 30) ** 2 - {"a": 3, "b": 0, "c": 6}[p["kind"]]


def test_bayesian_search_beats_random_search():
    """Same number of trials, a known surface of one real, one whole and one named parameter."""
    wins = learnt = blind = 0
    for seed in range(12):
        a = max(s for s, _ in tuning.bayesian_search(surface, SPACE, n=40, seed=seed))
        r = random.Random(seed)
        b = max(surface({k: tuning._draw(v, r) for k, v in SPACE.items()}) for _ in range(40))
        wins, learnt, blind = wins + (a > b), learnt + a / 12, blind + b / 12
    assert wins >= 10 and learnt > blind / 3


def test_proposals_follow_from_the_trials():
    trials = tuning.bayesian_search(surface, SPACE, n=15, seed=3)
    assert all(tuning.propose(trials[:i], SPACE, seed=3) == p for i, (_, p) in enumerate(trials))
    assert all(-5 <= p["x"] <= 5 and 1 <= p["n"] <= 40 and isinstance(p["n"], int) and p["kind"] in "abc" for _, p in trials)
    few = tuning.bayesian_search(lambda p: p["k"], {"k": [1, 2, 3, 4, 5, 6, 7]}, n=7)
    assert max(few)[0] >= 6


def test_surrogate_and_expected_improvement():
    """The process meets its points, is unsure far from them, and the improvement is that of a sampled normal."""
    x = np.array([[0.0], [0.3], [0.6], [1.0]])
    m = tuning.Surrogate(x, np.sin(5 * x[:, 0]))
    mean, sd = m.predict(np.array([[0.3], [5.0]]))
    assert mean[0] == pytest.approx(math.sin(1.5), abs=1e-2) and sd[0] < 0.05 < sd[1]
    at = np.array([[0.8]])
    mean, sd = m.predict(at)
    draws = np.random.default_rng(0).normal(mean[0], sd[0], 400_000)
    assert m.expected_improvement(at, 0.5)[0] == pytest.approx(np.maximum(draws - 0.5, 0).mean(), rel=0.05, abs=1e-4)


def test_halving_gives_survivors_more_rows(spark):
    d = spark.range(3000)
    seen = []

    def evaluate(rows, p):
        seen.append((p["v"], rows.count()))
        return -abs(p["v"] - 4)

    found = tuning.successive_halving(d, "id", [{"v": v} for v in range(9)], evaluate, eta=3, least=0.1)
    assert [len([r for r in found if r["rung"] == i]) for i in (0, 1, 2)] == [9, 3, 1]
    assert {r["setting"] for r in found if r["rung"] == 1} == {3, 4, 5} and [r["setting"] for r in found if r["rung"] == 2 and r["kept"]] == [4]
    sizes = dict(seen)
    assert 200 < sizes[0] < 400 and 700 < sizes[3] < 1100 and sizes[4] > 2000


def test_boosting_stops_by_its_losses(spark):
    r = random.Random(1)
    rows = [(i, x := r.random(), float((x > 0.5) != (r.random() < 0.2)), i % 3) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, x double, label double, part int")
    train, valid = d.filter("part > 0"), d.filter("part = 0")
    m = tuning.Boosted(["x"], rounds=8, depth=3, step=0.5, tolerance=0.005, patience=2).fit(train, valid)
    assert len(m.losses) == 8 and m.rounds == tuning.stop_round(m.losses, 0.005, 2) < 8
    # the loss of the kept trees is the one recorded for that round, and all trees together are the model's own scores
    y, got = F.col("label"), m.predict_proba(valid)
    assert got.agg(F.avg(tuning.log_loss(F.col("score"), y))).first()[0] == pytest.approx(m.losses[m.rounds - 1])
    whole = m.model.predict_proba(valid).agg(F.avg(tuning.log_loss(F.col("score"), y))).first()[0]
    assert whole == pytest.approx(m.losses[-1])


def test_stop_round():
    assert tuning.stop_round([5, 4, 3, 2.999, 2.998, 1], 0.01, 2) == 5
    assert tuning.stop_round([5, 4, 3, 3.5, 2], 0.01, 1) == 3
    assert tuning.stop_round([5.0], 0.01, 1) == 1 and tuning.stop_round([3, 2, 1], 0.01, 1) == 3


def test_saved_models_score_alike(spark, tmp_path):
    d = spark.range(200).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "IF(id % 4 = 0, 'u', 'v') AS c", "CAST(id % 10 > 4 AS DOUBLE) AS label")
    for name, params in (("decision_tree", {"maxDepth": 3}), ("gradient_boosted_trees", {"maxIter": 2})):
        m = models.TabularModel(name, ["x"], ["c"], **params).fit(d)
        m.save(str(tmp_path / name))
        back = models.TabularModel(name, ["x"], ["c"]).load(str(tmp_path / name))
        both, (a, b) = models.scores_of([m, back], d)
        assert both.filter(F.col(a) != F.col(b)).count() == 0 and both.select(a).distinct().count() > 1


# ---------------------------------------------------------------- concepts


def test_concepts_of_a_linear_score(spark):
    """A linear score rises along every vector that has a positive product with its weights, or along none."""
    r = random.Random(4)
    rows = [(i, [r.gauss(2.0 if i % 5 == 0 else 0.0, 1), r.gauss(0, 1)], i % 5) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, v array<double>, y int")
    member = concepts.random_member("id")
    got = concepts.concept_test(d, "v", F.col("y") == 0, lambda v: 3 * F.get(v, F.lit(0)), [member(i) for i in range(10)]).first()
    assert got.share == 1.0 and got.degrees == 9 and 0 < got.random_mean < 1
    x, y = concepts.concept_vectors(d, "v", [F.col("y") == 0, F.col("y") != 0])
    assert x[0] > 0.9 and math.hypot(*x) == pytest.approx(1) and y == pytest.approx([-a for a in x])
    assert concepts.concept_drift(x, y) == pytest.approx(2) and concepts.concept_drift(x, x) == pytest.approx(0)


# ---------------------------------------------------------------- clusters


@pytest.fixture(scope="module")
def groups(spark):
    r = random.Random(8)
    centres = [(0, 0), (20, 0), (0, 20), (20, 20)]
    rows = [(i, [r.gauss(c, 1) for c in centres[i % 4]], int(i % 4 == 3)) for i in range(400)] + [(400, None, 1)]
    return rows, spark.createDataFrame(rows, "id int, v array<double>, y int")


def test_kmeans_finds_groups_and_its_cost_falls(groups):
    rows, d = groups
    m = clusters.kmeans(d, "id", "v", 4)
    assert sorted((round(a / 20), round(b / 20)) for a, b in m.centres) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(m.costs, m.costs[1:], strict=False))
    poor = clusters.kmeans(d, "id", "v", 3, start=[[0.0, 0.0], [0.1, 0.0], [0.0, 0.1]])
    assert len(poor.costs) > 2 and all(b <= a * (1 + 1e-9) for a, b in zip(poor.costs, poor.costs[1:], strict=False))
    got = {r.cluster: r for r in clusters.medoids(d, "id", "v", m.centres).collect()}
    for i, c in enumerate(m.centres):
        own = [(math.dist(v, c), k) for k, v, _ in rows if v and min(range(4), key=lambda j: math.dist(v, m.centres[j])) == i]
        assert (got[i].medoid, got[i].size) == (min(own)[1], len(own)) and got[i].distance == pytest.approx(min(own)[0])
    assert clusters.kmeans(d.limit(0), "id", "v", 3).centres == []


def test_cluster_samplers(groups):
    rows, d = groups
    few = clusters.cluster_centroids(d, "id", "v", "y", 0, 3).collect()
    assert sum(r.y == 0 for r in few) == 3 and sum(r.y == 1 for r in few) == 101
    made = clusters.kmeans_smote(d, "id", "v", "y", 1, 4).collect()
    assert len(made) == 100 and all(math.dist(r.vector, (20, 20)) < 6 for r in made)
    assert clusters.kmeans_smote(d, "id", "v", "y", 1, 1).count() == 0  # nowhere do they have half of the rows
    far = clusters.diverse_rows(d, "id", "v", [[0.0, 0.0]]).first()
    assert far.id == max(((math.dist(v, (0, 0)), -k) for k, v, _ in rows if v))[1] * -1


def test_borderline_rows_are_sources(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(0, 1)], 0) for i in range(60)] + [(100 + i, [0.9 + 0.05 * i], 1) for i in range(20)] + [(200, [0.3], 1)]
    d = spark.createDataFrame(rows, "id int, v array<double>, y int")
    kinds = {x.id: x.kind for x in clusters.border_rows(d, "id", "v", "y", 1, 5).collect()}
    for k, v, y in rows:
        if y:
            near = sorted((abs(v[0] - w[0]), i, z) for i, w, z in rows if i != k)[:5]
            others = sum(z == 0 for *_, z in near)
            assert kinds[k] == ("noise" if others == 5 else "danger" if 2 * others >= 5 else "safe")
    made = clusters.borderline_smote(d, "id", "v", "y", 1, 5).collect()
    assert {x.source for x in made} == {k for k, kind in kinds.items() if kind == "danger"} and made


# ---------------------------------------------------------------- components, issues


def test_components_are_eigenvectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (300, 6)) @ r.normal(0, 1, (6, 6)) + 1e6
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "id int, v array<double>").repartition(5)
    from larkspur.operators.components import pca

    m = pca(d, "v", 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert m.n == 300 and m.variances == pytest.approx(values[::-1][:3]) and m.shares.sum() == pytest.approx(values[::-1][:3].sum() / values.sum())
    for c, want in zip(m.components, vectors.T[::-1], strict=False):
        assert abs(c @ want) == pytest.approx(1) and c[np.abs(c).argmax()] > 0
    got = {r.id: r.projection for r in m.transform(d, "v").collect()}
    assert got[300] is None and np.array([got[i] for i in range(300)]) == pytest.approx((x - x.mean(0)) @ m.components.T, abs=1e-6)
    assert pca(d.limit(0), "v", 2).n == 0


def test_issues_and_their_severity(spark):
    from larkspur.operators.profile import issues

    rows = [(float(i), "abc", None) for i in range(20)] + [(900.0, "ABC", None), (901.0, "Abc", "x"), (None, " abc", "x"), (3.0, "abc", None)]
    d = spark.createDataFrame(rows, "a double, `b.c` string, e string")
    got = {(r["column"], r.issue): (r.n, r.severity) for r in issues(d).collect()}
    assert got == {
        (None, "duplicate"): (1, "medium"), ("a", "null"): (1, "low"), ("e", "null"): (22, "high"), ("a", "outlier"): (2, "medium"),
        ("b.c", "case"): (2, "low"), ("b.c", "blank"): (1, "low"),
    }
    assert issues(d.limit(0)).count() == 0
