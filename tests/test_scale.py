"""Local explanations, exact neighbours by pivots and exact quantiles against brute force and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import local, neighbors, pivots, quantiles, sampling


@pytest.fixture(scope="module")
def clustered():
    """Points in tight clusters, one of which holds a third of all; some repeat, two are null."""
    r = random.Random(1)
    centres = [[r.uniform(-50, 50) for _ in range(3)] for _ in range(25)]
    rows = [(i, [c + r.gauss(0, 0.5) for c in centres[0 if i % 3 == 0 else r.randrange(25)]]) for i in range(600)]
    return [*rows, (600, rows[5][1]), (601, rows[5][1]), (602, None), (603, None)]


def brute(queries, rows, k, same=True, farthest=False):
    out = set()
    for q, v in queries:
        if v is None:
            continue
        d = sorted(((-1 if farthest else 1) * math.dist(v, w), n) for n, w in rows if w is not None and (n != q or not same))
        out |= {(q, n, i + 1) for i, (_, n) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize("k,many", [(1, 40), (4, 40), (7, 3), (3, 1)])
def test_all_neighbours_are_exact(spark, clustered, farthest, k, many, monkeypatch):
    monkeypatch.setattr(pivots, "PART", 50)
    monkeypatch.setattr(pivots, "BLOCK", 60)
    d = spark.createDataFrame(clustered, "k bigint, v array<double>")
    found = pivots.knn_all(d, d, "k", "v", k, farthest=farthest, pivots=many)
    assert {(r.query, r.neighbour, r.place) for r in found.collect()} == brute(clustered, clustered, k, farthest=farthest)


def test_all_neighbours_edges(spark, clustered):
    d = spark.createDataFrame(clustered, "k bigint, v array<double>")
    few = d.filter("k < 3")
    want = brute(clustered[:3], clustered[:3], 5)
    assert {(r.query, r.neighbour, r.place) for r in pivots.knn_all(few, few, "k", "v", 5).collect()} == want and len(want) == 6
    assert pivots.knn_all(d.limit(0), d, "k", "v", 2).count() == 0
    assert pivots.knn_all(d, d.limit(0), "k", "v", 2).count() == 0
    one = pivots.knn_all(d.filter("k = 5"), d, "k", "v", 2, same=False).orderBy("place").collect()
    assert [(r.neighbour, r.distance) for r in one] == [(5, 0.0), (600, 0.0)]
    names = spark.createDataFrame([("b", [0.0]), ("a", [1.0]), ("c", [-1.0])], "k string, v array<float>")
    assert [r.neighbour for r in pivots.knn_all(names.filter("k = 'b'"), names, "k", "v", 1).collect()] == ["a"]


def test_pairs_grow_less_than_quadratically(spark):
    """Ten times the rows on clustered data: all pairs would grow 100 times."""
    r = np.random.default_rng(3)

    def made(n):
        centres = np.random.default_rng(7).uniform(-100, 100, (200, 2))
        return spark.createDataFrame([(i, (centres[i % 200] + r.normal(0, 1, 2)).tolist()) for i in range(n)], "k bigint, v array<double>")

    small, large = (pivots.pairs_compared(made(n), made(n), "k", "v", 3) for n in (600, 6000))
    assert small < 600 * 600 / 2 and large < 6000 * 6000 / 20 and large < 40 * small


def test_no_cross_join_of_rows(spark, clustered):
    d = spark.createDataFrame([(k, v, k % 2) for k, v in clustered if v], "k bigint, v array<double>, y int")
    for plan in (neighbors.tomek_links(d, "k", "v", "y"), neighbors.edited_nearest(d, "k", "v", "y"), sampling.smote(d, "k", "v", "y", 1)):
        assert "Cartesian" not in (text := plan._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in text


# ---------------------------------------------------------------- quantiles


@pytest.fixture(scope="module")
def values():
    """Uniform values with nulls, values over a thousand orders of magnitude, five values only, one value, infinities; four
    groups of very different sizes, one without a name."""
    r = np.random.default_rng(0)
    rows = []
    for _ in range(5000):
        g = ["a", "b", None, "c"][r.choice(4, p=[0.7, 0.2, 0.09, 0.01])]
        u = None if r.random() < 0.1 else float(r.random())
        rows.append((g, u, float(np.exp(r.normal(0, 80))), float(r.integers(0, 5)), 7.0))
    return [*rows, ("none", None, 1.0, None, None)]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("bound", [None, 40])
def test_quantiles_are_exact(spark, values, by, bound):
    d = spark.createDataFrame(values, "g string, u double, e double, k double, one double").repartition(5)
    shares = (0, 0.013, 0.5, 0.77, 1)
    wanted = {f"{c}_{p}": (c, p) for c in ("u", "e", "k", "one") for p in shares}
    got = quantiles.quantiles(d, wanted, by, bound).collect()
    assert len(got) == (5 if by else 1)
    for row in got:
        own = [v for v in values if not by or v[0] == row.g]
        for name, (c, p) in wanted.items():
            x = [v[["u", "e", "k", "one"].index(c) + 1] for v in own]
            x = [v for v in x if v is not None]
            assert (row[name] is None) if not x else math.isclose(row[name], np.quantile(x, p), rel_tol=1e-9), (name, row)


def test_quantiles_do_not_rely_on_the_sketch(spark, values, monkeypatch):
    """A sketch far worse than claimed: intervals that miss are widened."""
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    monkeypatch.setattr(quantiles, "GRID", 50)
    d = spark.createDataFrame(values, "g string, u double, e double, k double, one double")
    got = quantiles.quantiles(d, {"a": ("e", 0.31), "b": ("u", 0.9)}, [], 100).first()
    assert math.isclose(got.a, np.quantile([v[2] for v in values], 0.31), rel_tol=1e-9)
    assert math.isclose(got.b, np.quantile([v[1] for v in values if v[1] is not None], 0.9), rel_tol=1e-9)


def test_quantiles_edges(spark):
    none = spark.createDataFrame([], "x double, g int")
    assert quantiles.quantiles(none, {"m": ("x", 0.5)}).first().m is None
    assert quantiles.quantiles(none, {"m": ("x", 0.5)}, ["g"]).count() == 0
    assert quantiles.edges(spark.range(5), "id", [0.0, 0.3, 1.0]).first().e == pytest.approx([0.0, 1.2, 4.0])


# ---------------------------------------------------------------- local explanations


def test_lime_weights_near_rows_and_finds_the_slope(spark):
    """A kinked score: the local model has the slope of the row's own side, fidelity falls at the kink."""
    d = spark.createDataFrame([(1, -5.0, 1.0), (2, 5.0, 1.0), (3, 0.0, 1.0)], "k int, x double, z double")
    score = lambda f: F.when(F.col("x") > 0, 3 * F.col("x")).otherwise(-F.col("x")) + 0 * F.col("z")
    got = {(r.k, r.feature): r for r in local.lime(d, "k", ["x", "z"], score, scale={"x": 0.5, "z": 1.0}).collect()}
    assert got[1, "x"].effect == pytest.approx(-0.5) and got[2, "x"].effect == pytest.approx(1.5) and got[2, "z"].effect == pytest.approx(0, abs=1e-9)
    assert -0.5 < got[3, "x"].effect < 1.5 and got[3, "x"].fidelity < 0.9 < got[1, "x"].fidelity
    one = local.lime(d, "k", ["x", "z"], score, scale={"x": 0.5, "z": 1.0}, top=1).collect()
    assert {(r.k, r.feature) for r in one} == {(1, "x"), (2, "x"), (3, "x")}
    assert local.lime(d.limit(0), "k", ["x", "z"], score).count() == 0


def test_anchor_counts_are_right(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(0, 1), r.uniform(0, 1), r.choice([None, 0.2, 0.8])) for i in range(800)]
    d = spark.createDataFrame(rows, "k int, a double, b double, c double")
    predicted = (F.col("a") > 0.5) & (F.coalesce("c", F.lit(0.0)) > 0.5)
    edges = {"a": [0.5], "b": [0.3, 0.6], "c": [0.5]}
    got = local.anchors(d, "k", edges, predicted, precision=0.9).collect()
    assert sorted(x.k for x in got) == list(range(800))
    place = {"a": 1, "b": 2, "c": 3}
    cell = lambda row, f: -1 if row[place[f]] is None else sum(row[place[f]] > e for e in edges[f])
    truth = [row[1] > 0.5 and (row[3] or 0) > 0.5 for row in rows]
    for x in got:
        meet = [i for i, row in enumerate(rows) if all(cell(row, f) == b for f, b in zip(x.features, x.bins, strict=True))]
        same = sum(truth[i] == truth[x.k] for i in meet)
        assert x.k in meet and x.coverage == pytest.approx(len(meet) / 800) and x.precision == pytest.approx(same / len(meet))
        assert x.anchored == (x.bound >= 0.9) and x.bound < x.precision
    assert all(x.features == ["a", "c"] for x in got if truth[x.k])  # neither alone decides


def test_surrogates_and_shares(spark):
    d = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y")
    step = lambda f: F.when(F.col("x") >= 10, 5.0).otherwise(1.0) + F.when(F.col("y") >= 3, 1.0).otherwise(0.0)
    leaves, r2 = local.surrogate_tree(d, ["x", "y"], step, depth=2)
    assert r2 == pytest.approx(1) and sorted(r.value for r in leaves.collect()) == pytest.approx([1, 2, 5, 6])
    (_, a, b), r2 = local.surrogate_linear(d, ["x", "y"], lambda f: 2 * F.col("x") - F.col("y"))
    assert (a, b, r2) == pytest.approx((2, -1, 1))
    shares = {tuple(r.terms): r.share for r in local.variance_shares(d, {"x": F.col("x") >= 10, "p": F.col("id") % 2}, lambda f: F.col("x") * 0 + F.when(F.col("x") >= 10, 1.0).otherwise(0.0) * (F.col("id") % 2)).collect()}
    assert shares["x",] == pytest.approx(1 / 3, abs=0.02) and shares["x", "p"] == pytest.approx(1 / 3, abs=0.02) and sum(shares.values()) == pytest.approx(1)


# ---------------------------------------------------------------- cycles


def test_cycles_on_a_graph_with_hubs(spark):
    """Lengths 3 to 6 against a search in plain Python, on a graph with two hubs; far fewer rows on the way than its paths."""
    from larkspur.operators import graph

    r = random.Random(9)
    edges = {(0, i) for i in range(1, 90)} | {(1, i) for i in range(60, 90)} | {tuple(sorted(r.sample(range(2, 90), 2))) for _ in range(45)}
    to = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(90)}
    want = set()

    def search(path):
        for b in to[path[-1]]:
            if b == path[0] and len(path) > 2 and path[1] < path[-1]:
                want.add((len(path), tuple(path)))
            if b > path[0] and b not in path and len(path) < 6:
                search([*path, b])

    for i in range(90):
        search([i])
    d = spark.createDataFrame([(a, b, 1.0, 1) for a, b in edges], "u int, v int, weight double, n int")
    got = [(x.length, tuple(x.path)) for x in graph.cycles(d, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    listed = sum(p.count() for p in graph.ranked_paths(d, 2))
    assert listed < sum(len(v) * (len(v) - 1) for v in to.values()) / 2
    assert graph.cycles(d.limit(0), 5).count() == 0
