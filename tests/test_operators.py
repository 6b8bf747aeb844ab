"""Closed-form cases."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import causal, explain, graph, neighbors, prepare, profile, sampling, stats
from larkspur.sources import connectors, files


def test_perfect_ranking(spark):
    d = spark.createDataFrame([(0.1 * i, int(i > 5)) for i in range(10)], "s double, y int")
    m = stats.ranking_metrics(d, "s", "y").first()
    assert (m.auc, m.ap, m.ks, m.gini) == (1, 1, 1, 1)


def test_constant_score_has_auc_half(spark):
    d = spark.createDataFrame([(0.5, i % 2) for i in range(10)], "s double, y int")
    assert stats.ranking_metrics(d, "s", "y").first().auc == 0.5


def test_psi_of_equal_samples_is_zero(spark):
    d = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "x double, k string")
    assert stats.psi_equal_width(d, d, "x").first().psi == 0
    assert stats.psi_quantile(d, d, "x").first().psi == 0
    assert stats.psi_categorical(d, d, "k").first().psi == 0
    assert stats.js_distance(d, d, "x").first().js == 0
    assert stats.wasserstein(d, d.withColumn("x", F.col("x") + 3), "x").first().wasserstein == pytest.approx(3)


def test_target_encoding(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 0)], "k string, y int")
    new = spark.createDataFrame([("a",), ("z",)], "k string")
    got = {r.k: r.k_target for r in prepare.target_encode(d, new, "k", "y").collect()}
    assert got == {"a": pytest.approx((2 + 0.5) / 3), "z": 0.5}


def test_iqr_cap(spark):
    d = spark.createDataFrame([(float(i),) for i in [*range(1, 10), 100]], "x double")
    assert prepare.outliers_iqr(d, ["x"]).agg(F.max("x")).first()[0] == pytest.approx(7.75 + 1.5 * 4.5)


def test_scalers_invert_and_constants(spark):
    d = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, c double")
    for f in (prepare.standard_scaler, prepare.minmax_scaler, prepare.robust_scaler):
        m = f(d, ["x", "c"])
        back = m.inverse_transform(m.transform(d)).collect()
        assert [r.c for r in back] == [5.0] * 3 and sorted(r.x for r in back if r.x is not None) == [1.0, 2.0]


def test_components_and_cycles(spark):
    clique = lambda k: [(a, b) for a in range(k, k + 5) for b in range(a + 1, k + 5)]
    e = graph.undirected(spark.createDataFrame(clique(0) + clique(10), "a int, b int"), "a", "b")
    assert {r["size"] for r in graph.component_summary(e).collect()} == {5}
    tri = graph.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int"), "a", "b")
    assert [(r.length, r.path) for r in graph.cycles(tri).collect()] == [(3, [1, 2, 3])]
    assert {r.coefficient for r in graph.clustering(tri).collect()} == {1.0}
    chain = graph.undirected(spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int"), "a", "b")
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_ranked_is_a_total_order(spark):
    d = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("x"))
    got = [r["rank"] for r in stats.ranked(d, F.desc("x"), F.asc("id")).orderBy(F.desc("x"), "id").collect()]
    assert got == list(range(1, 1001))


def test_regression_and_structure(spark):
    d = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z")).withColumn("y", 2 + 3 * F.col("x") - F.col("z"))
    assert causal.linear_fit(d, ["x", "z"], "y") == pytest.approx([2, 3, -1])
    g = causal.CausalGraph([("c", "t"), ("c", "y"), ("t", "y")])
    assert g.backdoor_paths("t", "y") == [["t", "c", "y"]] and g.ancestors("y") == {"c", "t"}


def test_matching_takes_nearest(spark):
    d = spark.createDataFrame([(1, 1, 0.50, 9.0), (2, 0, 0.10, 1.0), (3, 0, 0.48, 2.0), (4, 0, 0.90, 3.0), (5, 1, 0.99, 8.0)], "k int, t int, p double, y double")
    got = {r.key: r.match_outcome for r in causal.nearest_matches(d, "k", "t", "p", "y").collect()}
    assert got == {1: 2.0, 5: 3.0}


def test_knn_ties_and_self(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "k int, v array<double>")
    got = [(r.query, r.neighbour) for r in neighbors.knn(d.filter("k = 1"), d, "k", "v", 1).collect()]
    assert got == [(1, 2)]


def test_sampling_counts(spark):
    d = spark.range(100).select("id", (F.col("id") < 20).cast("int").alias("y"))
    assert {r["count"] for r in sampling.undersample(d, "id", "y").groupBy("y").count().collect()} == {20}
    assert {r["count"] for r in sampling.oversample(d, "id", "y").groupBy("y").count().collect()} == {80}
    s = {(r.y, r.split): r["count"] for r in sampling.stratified_split(d, "id", "y").groupBy("y", "split").count().collect()}
    assert s[1, "train"] == 14 and s[0, "train"] == 56


def test_chi2_survival():
    assert stats.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_survival(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-6)


def test_linear_shap_sums_to_score(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 6.0)], "k int, a double, b double")
    phi = explain.linear_shap(d, "k", {"a": 2.0, "b": 1.0}).groupBy("k").agg(F.sum("phi").alias("s")).orderBy("k").collect()
    assert [r.s for r in phi] == [-4.0, 4.0]


def test_csv_detection_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;ä\n2;b\n", encoding="latin-1")
    (tmp_path / "b.csv").write_text("y;x\nc;3\n", encoding="latin-1")
    assert files.detect_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    assert files.detect_encoding(spark, str(tmp_path / "a.csv")) == "ISO-8859-1"
    d = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.x, r.y) for r in d.collect()) == [(1, "ä"), (2, "b"), (3, "c")]
    (tmp_path / "c.csv").write_text("z\n1\n")
    with pytest.raises(ValueError, match="headers differ"):
        files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])


def test_artifacts(spark, tmp_path):
    a = files.Artifacts(spark, str(tmp_path))
    assert a.save_frame("t", spark.range(3)) == 1 and a.save_frame("t", spark.range(4)) == 2
    a.save_json("p", {"x": 1})
    assert a.load("t").count() == 4 and a.load("t", 1).count() == 3 and a.load("p") == {"x": 1}


def test_sources_contract(spark):
    with pytest.raises(ValueError, match="missing parameters"):
        connectors.create(spark, "postgres", host="h")
    s = connectors.from_environment(spark, "postgres", {"POSTGRES_HOST": "h", "POSTGRES_DATABASE": "d", "POSTGRES_USER": "u"})
    with pytest.raises(ConnectionError):
        s.execute_query("SELECT 1")
    with connectors.create(spark, "hive") as c:
        assert c.execute_query("SELECT :a AS a", {"a": 1}).first().a == 1


def test_expectations_on_empty_table(spark):
    d = spark.createDataFrame([], "x int")
    got = profile.validate(d, [profile.row_count(), profile.not_null("x")]).collect()
    assert [r.success for r in got] == [False, False]


def test_entropy_bounds(spark):
    u = explain.uncertainty(F.col("p"))["entropy"]
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(u.alias("e")).collect()
    assert [r.e for r in got] == [0.0, pytest.approx(math.log(2)), 0.0]


def test_utf8_cut_inside_a_character_is_utf8(spark, tmp_path):
    from larkspur.sources.files import detect_encoding

    for k, text in enumerate(["x\nab中中", "a" + "é" * 6000, "ab中" * 4000, ""]):
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode())
        for head in (5, 6, 7, 8, 10_000):
            assert detect_encoding(spark, str(path), head) == "UTF-8", (k, head)
    (tmp_path / "l.csv").write_bytes("naïve café".encode("latin-1"))
    (tmp_path / "cut.csv").write_bytes("ab中".encode()[:-1])  # the file itself ends inside a character
    assert detect_encoding(spark, str(tmp_path / "l.csv")) == detect_encoding(spark, str(tmp_path / "cut.csv")) == "ISO-8859-1"


def test_configured_operators_stay_out_of_literals(spark):
    from larkspur.operators.relational import configured, derived

    assert configured("a || '|&' || \"x|y\" | `b&c` & d && e") == "a || '|&' || \"x|y\"  OR  `b&c`  AND  d  AND  e"
    d = spark.createDataFrame([(1, 2, "it's"), (0, 0, "z")], "a int, b int, s string")
    got = derived(d, [{"name": "t", "expression": "s || ' & ' || s", "type": "string"}, {"name": "f", "expression": "a > 0 | b > 5", "type": "int"}])
    assert [(r.t, r.f) for r in got.orderBy("a").collect()] == [("z & z", 0), ("it's & it's", 1)]


def test_ranks_within_groups_and_tiles(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from larkspur.operators import stats

    d = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.xxhash64("id").alias("h"))
    w = Window.partitionBy("g")
    want = {(r.id, r.n, r.m) for r in d.select("id", F.row_number().over(w.orderBy("h")).alias("n"), F.count("*").over(w).alias("m")).collect()}
    got = stats.ranked_within(d.repartition(7), "g", F.col("h"))
    assert {(r.id, r["rank"], r.n_group) for r in got.collect()} == want and set(got.columns) == {"id", "g", "h", "rank", "n_group"}
    for n in (4, 5, 13, 1003):
        x = spark.range(n)
        tiles = x.select("id", F.ntile(5).over(Window.orderBy("id")).alias("t"), stats.tile(F.col("id") + 1, F.lit(n), 5).alias("u"))
        assert tiles.filter("t <> u").count() == 0
