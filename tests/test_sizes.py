"""What fails only at size: counts whose products pass a bigint, values whose ties pass a bound, and spaces a search leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import explain, neighbors, pivots, quantiles, stats


def test_chi_square_of_counts_whose_products_pass_a_bigint(spark):
    """9e12 x 6e6: three million rows in each of two cells."""
    d = spark.range(6_000_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 2).alias("y"))
    r = stats.bias_test(d, "g", "y").first()
    assert (r.statistic, r.degrees, r.n, r.gap, r.severity) == (6_000_000.0, 1, 6_000_000, 1.0, "high")


def test_mann_whitney_of_counts_whose_products_pass_a_bigint(spark):
    d = spark.range(6_000_000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2 % 100).alias("x"))
    r = stats.mann_whitney(d, "x", "g").first()
    assert (r.u, r.z) == (4.5e12, 0.0)


def test_bayesian_query_has_the_best_of_all_settings(spark, tmp_path):
    """Sums over which 60 trials miss the best of 150 settings."""
    import duckdb

    from larkspur.plans import QUERIES, SQL

    r = np.random.default_rng(7)
    q, f, v = r.integers(1, 51, 60_000), r.integers(0, 3, 60_000), np.round(r.uniform(900, 100_000, 60_000), 2)
    sums = np.zeros((3, 51))
    np.add.at(sums, (f, q), v)
    rows = [("ANR"[i], float(j), float(sums[i, j]), 1.0) for i in range(3) for j in range(1, 51)]
    spark.createDataFrame(rows, "l_returnflag string, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [tuple(x) for x in QUERIES["l08_bayesian"](spark, str(tmp_path)).collect()] == c.sql(SQL["l08_bayesian"]).fetchall()


def test_quantiles_between_values_that_occur_often(spark):
    """A rank at the border of two values, each with more occurrences than one place sorts; before, its interval never closed."""
    values = [0.0] * 300 + [1.0] * 600 + [2.0] * 5 + [3.0] * 600 + [4.0] * 2 + [5.0] * 494
    d = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    shares = [0.1, 299 / 2000, 299.5 / 2000, 300 / 2000, 0.45, 904.2 / 2000, 0.46, 0.6, 1504.6 / 2000, 1506.3 / 2000, 0.8, 0.0, 1.0]
    got = quantiles.quantiles(d, {f"q{i}": ("x", p) for i, p in enumerate(shares)}, (), 50).first()
    assert list(got) == pytest.approx([float(np.quantile(values, p)) for p in shares], abs=1e-9)


def spread(spark, n, dims=24):
    """Vectors without structure, some of them equal; one is null."""
    v = np.random.default_rng(5).normal(size=(n, dims)).astype(np.float32)
    v[7], v[8] = v[3], v[3]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    return spark.createDataFrame([*rows, (n, None, 0)], "k bigint, v array<float>, y int"), v.astype(float)


def test_a_query_travels_once_to_a_part(spark, monkeypatch):
    """Without structure nearly all cells are left; before, a query's vector was shuffled once for each of them."""
    monkeypatch.setattr(pivots, "SMALL", 300)
    sent, plain = [], pivots.compared
    monkeypatch.setattr(pivots, "compared", lambda visits, *a: sent.append(visits.count()) or plain(visits, *a))
    d, v = spread(spark, 1200)
    near = {(r.query, r.neighbour) for r in pivots.knn_all(d, d, "k", "v", 2).collect()}
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    assert near == {(i, int(j)) for i in range(len(v)) for j in np.argsort(gap[i], kind="stable")[:2]}
    assert sent[0] == 1200 and sent[1] <= 1200 * 6


def test_criticisms_of_many_prototypes(spark):
    """Before, more than 1,000 prototypes were refused."""
    d, v = spread(spark, 1500, 3)
    own = v[:1100]
    gap = np.sqrt(((v[:, None] - own[None]) ** 2).sum(2)).min(1)
    want = sorted(range(1500), key=lambda i: (-gap[i], i))[:4]
    assert [r.k for r in explain.criticisms(d, d.filter("k < 1100"), "k", "v", 4).collect()] == want


def test_stated_queries_are_compared_in_blocks(spark):
    """No pair is a row of a plan: a task keeps the best rows of each query. Null vectors and those of other lengths take no part."""
    d, v = spread(spark, 600)
    d = d.unionByName(spark.createDataFrame([(601, [0.0], 0)], d.schema))
    asked = d.filter("k % 50 = 0")
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    found = neighbors.knn(asked, d, "k", "v", 3)
    assert {(r.query, r.place, r.neighbour) for r in found.collect()} == {(i, p + 1, int(j)) for i in range(0, 600, 50) for p, j in enumerate(np.argsort(gap[i], kind="stable")[:3])}
    label = np.arange(600) % 3
    trust = neighbors.trust_scores(asked, d, "k", "v", "y")
    for r in trust.filter("same IS NOT NULL").collect():
        near = [gap[r.query][(label == label[r.query]) == same].min() for same in (True, False)]
        assert [r.same, r.other] == pytest.approx(near)
    assert trust.filter("same IS NOT NULL").count() == 12
    for plan in (found, trust):
        assert "Cartesian" not in (text := plan._jdf.queryExecution().toString()) and "NestedLoop" not in text
