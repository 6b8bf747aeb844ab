"""Queries of the wider operators: outliers, expectations, resampling, signed ranks, interventions, selection, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.expr import rnd
from larkspur.operators import causal, compare, explain, fraud, graph, models, prepare, profile, sampling, select, stats

from .flows import labelled
from .modelling import _ATE, _S, DIST, confounded, halves, orders_of, rounded, scored
from .registry import query

N = "*"


@query("p14_derived_tables", """SELECT band, count(*) AS customers, round(avg(total), 4) AS mean_total, max(n) AS most_orders FROM (
  SELECT o_custkey, n, total, CASE WHEN total > m THEN 'above' ELSE 'below' END AS band FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1),
  (SELECT avg(total) AS m FROM (SELECT sum(o_totalprice) AS total FROM orders GROUP BY o_custkey))) GROUP BY 1""")
def _(t):
    inner = t.orders.groupBy("o_custkey").agg(F.count(N).alias("n"), F.sum("o_totalprice").alias("total"))
    banded = inner.crossJoin(F.broadcast(inner.agg(F.avg("total").alias("m")))).withColumn("band", F.when(F.col("total") > F.col("m"), "above").otherwise("below"))
    return banded.groupBy("band").agg(F.count(N).alias("customers"), rnd(F.avg("total"), 4).alias("mean_total"), F.max("n").alias("most_orders"))


# ---------------------------------------------------------------- preparation


@query("c14_z_cap", "WITH q AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, m - 1.5 * s), m + 1.5 * s), 6) AS o_totalprice FROM orders, q")
def _(t):
    return rounded(prepare.outliers_z(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5))


@query("c14_z_remove", "WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id FROM events, q WHERE value IS NULL OR value BETWEEN m - 2 * s AND m + 2 * s")
def _(t):
    return prepare.outliers_z(t.events, ["value"], 2.0, "remove").select("event_id")


def _power_sql(made: str, slope: str) -> str:
    """The exponent of largest likelihood over the grid -2.0, -1.9, ..., 4.0; then standardised."""
    return f"""WITH g AS (SELECT -2.0::DOUBLE + 6.0::DOUBLE * i / 60 AS p FROM range(61) t(i)), r AS (SELECT p_partkey, p_retailprice::DOUBLE AS x FROM part), m AS (SELECT p_partkey, p, x, {made} AS v FROM r, g),
 l AS (SELECT p, -0.5 * ln(var_pop(v)) + (p - 1) * avg({slope}) AS ll, avg(v) AS mean, stddev_pop(v) AS sd FROM m GROUP BY 1), b AS (SELECT p, mean, sd FROM l ORDER BY ll DESC, abs(p - 1) LIMIT 1)
 SELECT p_partkey, round((v - mean) / sd, 4) AS p_retailprice FROM m JOIN b ON m.p = b.p"""


@query("c04_box_cox", _power_sql("CASE WHEN abs(p) < 1e-9 THEN ln(x) ELSE (pow(x, p) - 1) / (CASE WHEN abs(p) < 1e-9 THEN 1 ELSE p END) END", "ln(x)"))
def _(t):
    return rounded(prepare.power_transformer(t.part, ["p_retailprice"], method="box-cox").transform(t.part.select("p_partkey", "p_retailprice")), 4)


@query("d11_quantile", "WITH r AS (SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r, count(*) OVER () AS n FROM part) SELECT p_partkey, round((r - 1) / (n - 1), 8) AS q FROM r")
def _(t):
    return prepare.rank_scale(t.part, "p_retailprice").select("p_partkey", rnd("p_retailprice_quantile", 8).alias("q"))


# ---------------------------------------------------------------- expectations


@query("q06_schema", """SELECT x || ' exists' AS expectation, (count(c.column_name) > 0)::INT::DOUBLE AS share FROM (SELECT unnest(['o_totalprice', 'o_nothing']) AS x) LEFT JOIN (SELECT column_name FROM information_schema.columns WHERE table_name = 'orders') c ON c.column_name = x GROUP BY x
 UNION ALL SELECT x || ' is ' || k, (count(c.column_name) > 0)::INT::DOUBLE FROM (SELECT unnest(['o_totalprice', 'o_orderstatus', 'o_custkey']) AS x, unnest(['double', 'string', 'string']) AS k)
 LEFT JOIN (SELECT column_name, CASE data_type WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' END AS kind FROM information_schema.columns WHERE table_name = 'orders') c ON c.column_name = x AND c.kind = k GROUP BY x, k""")
def _(t):
    e = [profile.has_column("o_totalprice"), profile.has_column("o_nothing"), profile.has_type("o_totalprice", "double"), profile.has_type("o_orderstatus", "string"), profile.has_type("o_custkey", "string")]
    return profile.validate(t.orders, e).select("expectation", "share")


@query("q08_ranges", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m, stddev_samp(value) AS s FROM events)
 SELECT unnest(['value within iqr', 'value within z']) AS expectation, unnest([(SELECT round(avg(coalesce(value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a), false)::INT), 6) FROM events, q), (SELECT round(avg(coalesce(value BETWEEN m - 3 * s AND m + 3 * s, false)::INT), 6) FROM events, q)])::DOUBLE AS share""")
def _(t):
    return rounded(profile.validate(t.events, [profile.within_iqr("value"), profile.within_z("value")]).select("expectation", "share"))


@query("q10_unique", """SELECT 'o_orderkey unique' AS expectation, round(count(DISTINCT o_orderkey) / count(*), 6)::DOUBLE AS share FROM orders UNION ALL SELECT 'o_custkey,o_orderstatus unique', round((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) / count(*), 6)::DOUBLE FROM orders
 UNION ALL SELECT 'row unique', round((SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) / count(*), 6)::DOUBLE FROM orders""")
def _(t):
    return rounded(profile.validate(t.orders, [profile.unique("o_orderkey"), profile.unique("o_custkey", "o_orderstatus"), profile.unique()]).select("expectation", "share"))


# ---------------------------------------------------------------- tests


@query("m19_wilcoxon", """WITH d AS (SELECT l_quantity - l_discount * 500 AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 6)) + (count(*) OVER (PARTITION BY round(abs(d), 6)) - 1) / 2.0 AS r FROM d WHERE abs(d) > 1e-6),
 k AS (SELECT sum(k * k * k - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM d WHERE abs(d) > 1e-6 GROUP BY round(abs(d), 6))), w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus FROM r)
 SELECT n, w_plus, w_minus, round((w_plus - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - t / 48), 6)::DOUBLE AS z FROM w, k""")
def _(t):
    d = F.round(F.col("l_quantity") - F.col("l_discount") * 500, 6)
    return rounded(stats.wilcoxon(t.lineitem.select(d.alias("a"), F.lit(0.0).alias("b")), "a", "b"))


@query("h09_bias_test", """WITH c AS (SELECT l_returnflag AS a, (l_discount > 0.05)::INT AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), e AS (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb, sum(o) OVER () AS n FROM c),
 g AS (SELECT max(r) - min(r) AS gap FROM (SELECT avg((l_discount > 0.05)::INT) AS r FROM lineitem GROUP BY l_returnflag))
 SELECT round(sum(o * 1.0 * o * n / (ra * rb)) - any_value(n), 5)::DOUBLE AS statistic, ((SELECT count(DISTINCT a) - 1 FROM c) * (SELECT count(DISTINCT b) - 1 FROM c)) AS degrees, any_value(n)::BIGINT AS n, round(any_value(gap), 5) AS gap, CASE WHEN any_value(gap) > 0.2 THEN 'high' WHEN any_value(gap) > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM e, g""")
def _(t):
    return rounded(stats.bias_test(t.lineitem.select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("y")), "l_returnflag", "y"), 5)


@query("l06_ols_errors", """WITH s AS (SELECT count(*) AS n, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS m FROM lineitem),
 v AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s) SELECT 'intercept' AS term, round(a, 2) AS coefficient, round(sqrt(s2 * (1.0 / n + m * m / sxx)), 3) AS error, round(a / sqrt(s2 * (1.0 / n + m * m / sxx)), 3) AS t FROM v
 UNION ALL SELECT 'l_quantity', round(b, 2), round(sqrt(s2 / sxx), 3), round(b / sqrt(s2 / sxx), 3) FROM v""")
def _(t):
    rows = causal.ols_summary(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t._spark.createDataFrame([(n, round(c, 2), round(e, 3), round(x, 3)) for n, c, e, x in rows], "term string, coefficient double, error double, t double")


# ---------------------------------------------------------------- effects and explanations


@query("k06_interventions", f"SELECT x::DOUBLE AS value, round(my + {_ATE} * (x - mt), 1) AS mean_score, round({_ATE} * (x - mt), 1) AS effect FROM {_S}, (SELECT unnest([1.0, 10.0, 50.0]) AS x)")
def _(t):
    d = confounded(t)
    w = causal.linear_fit(d, ["t", "a", "b"], "y")
    score = lambda f: w[0] + F.col("t") * w[1] + F.col("a") * w[2] + F.col("b") * w[3]
    return rounded(explain.interventions(d, "t", [1.0, 10.0, 50.0], score), 1)


@query("k06_counterfactuals", """WITH s AS (SELECT p_partkey AS id, p_size::DOUBLE AS q, 2 * p_size + 0.01 * p_retailprice AS s, p_retailprice FROM part), w AS (SELECT id, q, s, x, 2 * x + 0.01 * p_retailprice AS z FROM s, (SELECT unnest([5.0, 20.0, 30.0, 45.0]) AS x)),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(x - q), x) AS r FROM w WHERE (z >= 60) <> (s >= 60)) SELECT id, q AS original, x::DOUBLE AS value, round(s, 6)::DOUBLE AS score, round(z, 6)::DOUBLE AS new_score FROM r WHERE r = 1""")
def _(t):
    d = t.part.select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return rounded(explain.counterfactuals(d, "id", "p_size", [5.0, 20.0, 30.0, 45.0], explain.linear_score({"p_size": 2.0, "p_retailprice": 0.01}), 60.0))


@query("e01_two_features", "SELECT x::DOUBLE AS a, y::DOUBLE AS b, round(avg(2 * x + 0.5 * y + l_tax * x), 5)::DOUBLE AS mean_score FROM lineitem, (SELECT unnest([1.0, 10.0, 50.0]) AS x), (SELECT unnest([0.0, 0.1]) AS y) GROUP BY 1, 2")
def _(t):
    score = lambda d: 2 * F.col("l_quantity") + 0.5 * F.col("l_discount") + F.col("l_tax") * F.col("l_quantity")
    return rounded(explain.partial_dependence_2d(t.lineitem, "l_quantity", "l_discount", score, [1.0, 10.0, 50.0], [0.0, 0.1]), 5)


@query("d14_univariate", "SELECT 'l_quantity' AS feature, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_discount', round(pow(corr(l_discount, l_extendedprice), 2), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(pow(corr(l_tax, l_extendedprice), 2), 6) FROM lineitem")
def _(t):
    found = select.univariate(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return t._spark.createDataFrame([(f, round(r, 6)) for f, r in found], "feature string, r2 double")


@query("d14_forward", """WITH c AS (SELECT corr(q, y) AS a, corr(m, y) AS b, corr(q, m) AS ab FROM (SELECT l_quantity AS q, l_quantity + l_discount * 300 AS m, l_extendedprice AS y FROM lineitem))
 SELECT 1 AS step, CASE WHEN a * a >= b * b THEN 'q' ELSE 'm' END AS feature, round(greatest(a * a, b * b), 6) AS r2 FROM c UNION ALL SELECT 2, CASE WHEN a * a >= b * b THEN 'm' ELSE 'q' END, round((a * a + b * b - 2 * a * b * ab) / (1 - ab * ab), 6) FROM c""")
def _(t):
    d = t.lineitem.select(F.col("l_quantity").alias("q"), (F.col("l_quantity") + F.col("l_discount") * 300).alias("m"), F.col("l_extendedprice").alias("y"))
    steps = select.forward(d, ["q", "m"], "y", 2, -1.0)
    return t._spark.createDataFrame([(i + 1, f, round(r, 6)) for i, (f, r) in enumerate(steps)], "step int, feature string, r2 double")


_SHAP = {"p_size": 0.1, "p_retailprice": 0.01}
_PHI = "(SELECT p_partkey, 'p_size' AS feature, 0.1 * (p_size - s) AS phi FROM part, (SELECT avg(p_size) AS s FROM part) UNION ALL SELECT p_partkey, 'p_retailprice', 0.01 * (p_retailprice - m) FROM part, (SELECT avg(p_retailprice) AS m FROM part))"


@query("e04_local_shap", f"SELECT p_partkey, feature, round(phi, 6)::DOUBLE AS phi FROM {_PHI} QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(phi) DESC, feature) = 1")
def _(t):
    return rounded(explain.top_reasons(explain.linear_shap(t.part, "p_partkey", _SHAP), "p_partkey", 1).drop("place"))


@query("e04_differential_shap", """WITH g AS (SELECT avg(p_size) FILTER (WHERE p_size > 25) - avg(p_size) FILTER (WHERE p_size <= 25) AS s, avg(p_retailprice) FILTER (WHERE p_size > 25) - avg(p_retailprice) FILTER (WHERE p_size <= 25) AS m FROM part)
 SELECT 'p_size' AS feature, round(0.1 * s, 6)::DOUBLE AS difference FROM g UNION ALL SELECT 'p_retailprice', round(0.01 * m, 6) FROM g""")
def _(t):
    return rounded(explain.differential_shap(t.part.filter("p_size > 25"), t.part.filter("p_size <= 25"), "p_partkey", _SHAP))


@query("e12_f_test", """WITH c AS (SELECT corr(q, y) AS qy, corr(d, y) AS dy, corr(q * d, y) AS py, corr(q, d) AS qd, corr(q, q * d) AS qp, corr(d, q * d) AS dp, count(*) AS n FROM (SELECT l_quantity AS q, l_discount AS d, l_extendedprice + 100 * l_quantity * l_discount AS y FROM lineitem)),
 a AS (SELECT n, (dy - qy * qd) / sqrt((1 - qy * qy) * (1 - qd * qd)) AS dy, (py - qy * qp) / sqrt((1 - qy * qy) * (1 - qp * qp)) AS py, (dp - qd * qp) / sqrt((1 - qd * qd) * (1 - qp * qp)) AS dp FROM c),
 b AS (SELECT n, (py - dy * dp) / sqrt((1 - dy * dy) * (1 - dp * dp)) AS r FROM a) SELECT round(r * r / (1 - r * r) * (n - 4), 4) AS f, 1 AS df_product, (n - 4)::BIGINT AS df_rest FROM b""")
def _(t):
    d = t.lineitem.select("l_quantity", "l_discount", (F.col("l_extendedprice") + 100 * F.col("l_quantity") * F.col("l_discount")).alias("y"))
    f, a, b = explain.interaction_f_test(d, "l_quantity", "l_discount", "y")
    return t._spark.createDataFrame([(round(f, 4), a, b)], "f double, df_product int, df_rest bigint")


@query("e08_criticisms", f"SELECT a.vec_id, round(min({DIST}), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 GROUP BY 1 ORDER BY min({DIST}) DESC, a.vec_id LIMIT 10")
def _(t):
    return rounded(explain.criticisms(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10))


@query("l06_logit_errors", """WITH c AS (SELECT count(*) FILTER (WHERE NOT x AND NOT y)::DOUBLE AS a, count(*) FILTER (WHERE NOT x AND y)::DOUBLE AS b, count(*) FILTER (WHERE x AND NOT y)::DOUBLE AS c, count(*) FILTER (WHERE x AND y)::DOUBLE AS d FROM (SELECT l_quantity > 25 AS x, l_returnflag = 'R' AS y FROM lineitem))
 SELECT 'intercept' AS term, round(ln(b / a), 5) AS coefficient, round(sqrt(1 / a + 1 / b), 5) AS error, round(ln(b / a) / sqrt(1 / a + 1 / b), 3) AS z FROM c UNION ALL SELECT 'x', round(ln(a * d / (b * c)), 5), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5), round(ln(a * d / (b * c)) / sqrt(1 / a + 1 / b + 1 / c + 1 / d), 3) FROM c""")
def _(t):
    d = t.lineitem.select((F.col("l_quantity") > 25).cast("double").alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    rows = models.glm_summary(d, ["x"], "y")
    return t._spark.createDataFrame([(n, round(c, 5), round(e, 5), round(z, 3)) for n, c, e, z, _ in rows], "term string, coefficient double, error double, z double")


def _fit_sql(table: str, target: str, other: str, gap: str) -> str:
    """Intercept a and slopes b (of the other column), c (of z) of least squares on the rows that have the target."""
    kept = f"(SELECT * FROM {table} WHERE NOT {gap})"
    return f"""(SELECT my - b * mu - c * mz AS a, b, c FROM (SELECT my, mu, mz, (syu * szz - syz * suz) / (suu * szz - suz * suz) AS b, (syz * suu - syu * suz) / (suu * szz - suz * suz) AS c
  FROM (SELECT avg({target}) AS my, avg({other}) AS mu, avg(z) AS mz, covar_pop({target}, {other}) AS syu, covar_pop({target}, z) AS syz, covar_pop({other}, z) AS suz, var_pop({other}) AS suu, var_pop(z) AS szz FROM {kept})))"""


@query("d13_iterative", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 0 THEN p_size::DOUBLE END AS x, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 3 + p_retailprice / 100 END AS y, p_retailprice / 1000 AS z FROM part),
s AS (SELECT p_partkey, x IS NULL AS gx, y IS NULL AS gy, coalesce(x, avg(x) OVER ()) AS x, coalesce(y, avg(y) OVER ()) AS y, z FROM p),
x1 AS (SELECT p_partkey, gx, gy, CASE WHEN gx THEN a + b * y + c * z ELSE x END AS x, y, z FROM s, __FIT_S__),
y1 AS (SELECT p_partkey, gx, gy, x, CASE WHEN gy THEN a + b * x + c * z ELSE y END AS y, z FROM x1, __FIT_X1__),
x2 AS (SELECT p_partkey, gx, gy, CASE WHEN gx THEN a + b * y + c * z ELSE x END AS x, y, z FROM y1, __FIT_Y1__),
y2 AS (SELECT p_partkey, gx, gy, x, CASE WHEN gy THEN a + b * x + c * z ELSE y END AS y, z FROM x2, __FIT_X2__)
SELECT p_partkey, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, round(z, 5)::DOUBLE AS z FROM y2
""".replace("__FIT_S__", _fit_sql("s", "x", "y", "gx")).replace("__FIT_X1__", _fit_sql("x1", "y", "x", "gy")).replace("__FIT_Y1__", _fit_sql("y1", "x", "y", "gx")).replace("__FIT_X2__", _fit_sql("x2", "y", "x", "gy")))
def _(t):
    """Two columns with gaps take turns twice."""
    x = F.when(F.col("p_partkey") % 50 != 0, F.col("p_size").cast("double"))
    y = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 3 + F.col("p_retailprice") / 100)
    made = prepare.iterative_impute(t.part.select("p_partkey", x.alias("x"), y.alias("y"), (F.col("p_retailprice") / 1000).alias("z")), ["x", "y", "z"], rounds=2)
    return made.select("p_partkey", rnd("x", 4).alias("x"), rnd("y", 4).alias("y"), rnd("z", 5).alias("z"))


_AT = "greatest(0, least(9, floor((x - lo) / (hi - lo) * 10)))"


@query("m05_by_year", f"""WITH r AS (SELECT o_totalprice AS x FROM orders WHERE o_orderkey % 3 <> 0), z AS (SELECT min(x) AS lo, max(x) AS hi FROM r), c AS (SELECT year(o_orderdate) AS period, o_totalprice AS x FROM orders WHERE o_orderkey % 3 = 0),
 p AS (SELECT bin, count(*)::DOUBLE / (SELECT count(*) FROM r) AS p FROM (SELECT {_AT} AS bin FROM r, z) GROUP BY 1), q AS (SELECT period, bin, count(*)::DOUBLE AS k FROM (SELECT period, {_AT} AS bin FROM c, z) GROUP BY ALL), n AS (SELECT period, sum(k) AS n FROM q GROUP BY 1),
 g AS (SELECT n.period, n.n, greatest(coalesce(p.p, 0), 1e-10) AS p, greatest(coalesce(q.k, 0) / n.n, 1e-10) AS q FROM n CROSS JOIN range(10) b(i) LEFT JOIN p ON p.bin = i LEFT JOIN q ON q.period = n.period AND q.bin = i)
 SELECT period::INTEGER AS period, n::BIGINT AS n, round(sum((q - p) * ln(q / p)), 6) AS psi FROM g GROUP BY ALL""")
def _(t):
    return rounded(compare.psi_by_period(*halves(t), "o_totalprice", F.year("o_orderdate")))


@query("m04_psi_class", f"""SELECT period, n, round(psi, 6)::DOUBLE AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'slight' ELSE 'significant' END AS class FROM (
WITH r AS (SELECT o_totalprice AS x FROM orders WHERE o_orderkey % 3 <> 0), z AS (SELECT min(x) AS lo, max(x) AS hi FROM r), c AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS period, o_totalprice AS x FROM orders WHERE o_orderkey % 3 = 0),
 p AS (SELECT bin, count(*)::DOUBLE / (SELECT count(*) FROM r) AS p FROM (SELECT {_AT} AS bin FROM r, z) GROUP BY 1), q AS (SELECT period, bin, count(*)::DOUBLE AS k FROM (SELECT period, {_AT} AS bin FROM c, z) GROUP BY ALL), n AS (SELECT period, sum(k) AS n FROM q GROUP BY 1),
 g AS (SELECT n.period, n.n, greatest(coalesce(p.p, 0), 1e-10) AS p, greatest(coalesce(q.k, 0) / n.n, 1e-10) AS q FROM n CROSS JOIN range(10) b(i) LEFT JOIN p ON p.bin = i LEFT JOIN q ON q.period = n.period AND q.bin = i)
 SELECT period::INTEGER AS period, n::BIGINT AS n, sum((q - p) * ln(q / p)) AS psi FROM g GROUP BY ALL)""")
def _(t):
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    found = compare.psi_by_period(*halves(t), "o_totalprice", month)
    return found.select("period", "n", rnd("psi", 6).alias("psi"), stats.psi_class(F.col("psi")).alias("class"))


@query("g10_component_summary", """SELECT o_custkey AS component, count(*) + 1 AS size, count(*) AS n_edges, count(*)::DOUBLE AS volume FROM orders GROUP BY 1 HAVING count(*) + 1 >= 5""")
def _(t):
    return graph.component_summary(orders_of(t))


@query("l09_stacked")
def _(t):
    d, own = labelled(t), ["l_quantity", "l_extendedprice", "l_discount"]
    bases = [models.TabularModel("logistic_regression", own, maxIter=10), models.TabularModel("decision_tree", own, maxDepth=3)]
    made = models.Stacked(bases).fit(d.filter("split = 'train'"), "id")
    return stats.ranking_metrics(made.predict_proba(d.filter("split = 'test'")), "score", "label").select(rnd("auc", 3).alias("auc"))


# ---------------------------------------------------------------- resampling


def _miss_sql(version: int, keep: int) -> str:
    far = "DESC" if version == 2 else "ASC"
    asked = "SELECT vec_id FROM embeddings WHERE label <> 0"
    if version == 3:
        asked = f"SELECT DISTINCT n AS vec_id FROM (SELECT b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label <> 0) WHERE r <= 3"
    return f"""WITH n AS (SELECT a.vec_id AS q, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST} {far}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label <> 0 AND b.label = 0 WHERE a.vec_id IN ({asked})),
 m AS (SELECT q, row_number() OVER (ORDER BY avg(d) {"DESC" if version == 3 else "ASC"}, q) AS place FROM n WHERE r <= 3 GROUP BY q) SELECT q AS vec_id FROM m WHERE place <= {keep} UNION ALL SELECT vec_id FROM embeddings WHERE label = 0"""


def _near_miss(version: int, keep: int = 30):
    @query(f"b03_near_miss_{version}", _miss_sql(version, keep))
    def _(t):
        return sampling.near_miss(t.embeddings, "vec_id", "embedding", "label", 0, keep, version=version).select("vec_id")


for v in (1, 2, 3):
    _near_miss(v)


@query("b02_adasyn_weights", f"""WITH n AS (SELECT a.vec_id AS q, (b.label <> 0)::INT AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 0),
 h AS (SELECT q, avg(other) AS hardness FROM n WHERE r <= 5 GROUP BY 1), c AS (SELECT count(*) FILTER (WHERE label <> 0) - count(*) FILTER (WHERE label = 0) AS gap FROM embeddings)
 SELECT q AS source, round(hardness, 6)::DOUBLE AS hardness, coalesce(round(hardness / nullif((SELECT sum(hardness) FROM h), 0) * greatest(gap, 0)), 0)::BIGINT AS n_new FROM h, c""")
def _(t):
    return rounded(sampling.adasyn_weights(t.embeddings, "vec_id", "embedding", "label", 0))


@query("b02_adasyn")
def _(t):
    return sampling.adasyn(t.embeddings, "vec_id", "embedding", "label", 0)


@query("b03_smote_tomek")
def _(t):
    return sampling.smote_cleaned(t.embeddings, "vec_id", "embedding", "label", 0, "tomek")


@query("b03_smote_enn")
def _(t):
    return sampling.smote_cleaned(t.embeddings, "vec_id", "embedding", "label", 0, "enn")


# ---------------------------------------------------------------- feature table


def _features_sql() -> str:
    made, names = [], []
    for h in fraud.SPANS:
        w = f"w{h}"
        made += [f"count(*) OVER {w} AS n_{h}h", f"round(sum(value) OVER {w}, 6) AS s_{h}h", f"round(ln(1 + avg(value) OVER {w}), 6) AS log_m_{h}h", f"round(stddev_samp(value) OVER {w}, 6) AS sd_{h}h", f"min(value) OVER {w} AS lo_{h}h", f"max(value) OVER {w} AS hi_{h}h"]
        made += [f"round(ln(1 + value) - ln(1 + avg(value) OVER {w}), 6) AS log_to_m_{h}h", f"round(value / nullif(max(value) OVER {w}, 0), 6) AS to_hi_{h}h"]
        names.append(f"{w} AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND CURRENT ROW)")
    gap = "(epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 3600000000.0"
    return f"""SELECT event_id, {", ".join(made)}, row_number() OVER o AS place, lag(value) OVER o AS last_value, round(value - lag(value) OVER o, 6) AS change, round(ln(1 + avg(value) OVER b), 6) AS log_mean_before, max(value) OVER b AS hi_before, coalesce(value > max(value) OVER b, true) AS new_high,
 round({gap}, 6)::DOUBLE AS gap_hours, coalesce({gap} < 1 / 60, false) AS rapid, extract(hour FROM ts) AS hour, extract(dow FROM ts) AS dow, extract(hour FROM ts) IN (0, 1, 2, 3, 4, 5, 22, 23) AS night
 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {", ".join(names)}"""


@query("n22_window_features", _features_sql())
def _(t):
    return fraud.window_features(t.events)
