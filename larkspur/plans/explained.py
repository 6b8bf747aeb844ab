"""Queries of explanations of single predictions and of models that stand in for others."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.expr import rnd
from larkspur.operators import local

from .modelling import rounded
from .registry import query

# ---------------------------------------------------------------- local linear models

_SD = "(SELECT stddev_samp(p_size) AS s, stddev_samp(p_retailprice) AS m FROM part)"


def _linear(d):
    return 2 * F.col("p_size") + 0.01 * F.col("p_retailprice")


def _product(d):
    return F.col("p_size") * F.col("p_retailprice") / 100


@query("d18_lime_linear", f"""
WITH p AS (SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS feature, unnest([2 * s, 0.01 * m]) AS effect,
    2 * p_size + 0.01 * p_retailprice AS y FROM part, {_SD})
SELECT p_partkey, feature, round(effect, 5)::DOUBLE AS effect, round(y, 4)::DOUBLE AS local_score, 1.0::DOUBLE AS fidelity FROM p
""")
def _(t):
    found = local.lime(t.part, "p_partkey", ["p_size", "p_retailprice"], _linear)
    return found.select("p_partkey", "feature", rnd("effect", 5).alias("effect"), rnd("local_score", 4).alias("local_score"), rnd("fidelity", 6).alias("fidelity"))


@query("d18_lime_interaction", f"""
SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS feature,
  unnest([round(s * p_retailprice / 100, 3), round(m * p_size / 100, 3)])::DOUBLE AS effect FROM part, {_SD}
""")
def _(t):
    found = local.lime(t.part, "p_partkey", ["p_size", "p_retailprice"], _product)
    return found.select("p_partkey", "feature", rnd("effect", 3).alias("effect"))


@query("d18_lime_top", f"""
WITH e AS (SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS feature, unnest([s * p_retailprice / 100, m * p_size / 100]) AS effect FROM part, {_SD})
SELECT p_partkey, feature, round(effect, 3)::DOUBLE AS effect FROM e
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(effect) DESC, feature) = 1
""")
def _(t):
    found = local.lime(t.part, "p_partkey", ["p_size", "p_retailprice"], _product, samples=50, width=3.0, top=1, seed=7)
    return found.select("p_partkey", "feature", rnd("effect", 3).alias("effect"))


# ---------------------------------------------------------------- anchors

_EDGES = {"l_discount": [0.03, 0.07], "l_quantity": [10.0, 25.0, 40.0], "l_tax": [0.04]}
_NAMES = sorted(_EDGES)
_LEAST, _BEAM = 0.9, 2


def _anchor_sql() -> str:
    bins = ", ".join(" + ".join(f"({f} > {e})::INT" for e in _EDGES[f]) for f in _NAMES)
    low = "(good / n + 1.9208 / n - 1.96 * sqrt(good / n * (1 - good / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"
    names = ", ".join(f"'{f}'" for f in _NAMES)
    sql = f"""
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, [{bins}] AS c, (l_extendedprice * (1 - l_discount) > 30000)::INT AS y FROM lineitem),
cells AS (SELECT c, y, count(*)::DOUBLE AS n FROM r GROUP BY c, y), total AS (SELECT sum(n) AS total FROM cells),
sets(rule) AS (VALUES ([1]), ([2]), ([3]), ([1, 2]), ([1, 3]), ([2, 3]), ([1, 2, 3])),
g AS (SELECT rule, list_transform(rule, lambda i: c[i]) AS vals, y, sum(n) AS good FROM cells, sets GROUP BY ALL),
m AS (SELECT rule, vals, y, good, sum(good) OVER (PARTITION BY rule, vals) AS n FROM g),
b AS (SELECT *, {low} AS bound FROM m),
live0 AS (SELECT c, y, CAST([] AS INT[]) AS rule FROM cells)"""
    for k in (1, 2, 3):
        sql += f""",
grown{k} AS (SELECT DISTINCT c, y, list_sort(list_append(rule, f)) AS rule FROM live{k - 1}, (VALUES (1), (2), (3)) x(f) WHERE NOT list_contains(rule, f)),
judged{k} AS (SELECT w.c, w.y, b.rule, b.vals, b.good, b.n, b.bound FROM grown{k} w JOIN b ON b.rule = w.rule AND b.y = w.y AND b.vals = list_transform(w.rule, lambda i: w.c[i])),
best{k} AS (SELECT * FROM judged{k} WHERE bound >= {_LEAST} QUALIFY row_number() OVER (PARTITION BY c, y ORDER BY n DESC, rule) = 1),
left{k} AS (SELECT j.*, row_number() OVER (PARTITION BY j.c, j.y ORDER BY round(j.bound, 12) DESC, j.n DESC, j.rule) AS place
  FROM judged{k} j WHERE NOT EXISTS (SELECT 1 FROM best{k} a WHERE a.c = j.c AND a.y = j.y)),
live{k} AS (SELECT c, y, rule FROM left{k} WHERE place <= {_BEAM})"""
    return sql + f""",
a AS (SELECT *, true AS anchored FROM best1 UNION ALL SELECT *, true FROM best2 UNION ALL SELECT *, true FROM best3
  UNION ALL SELECT c, y, rule, vals, good, n, bound, false FROM left3 WHERE place = 1)
SELECT id, array_to_string(list_transform(rule, lambda i: [{names}][i]), '&') AS features, array_to_string(vals, '&') AS bins,
  round(good / n, 8)::DOUBLE AS precision, round(n / total, 8)::DOUBLE AS coverage, round(bound, 8)::DOUBLE AS bound, anchored
FROM r JOIN a ON a.c = r.c AND a.y = r.y, total
"""


@query("d18_anchors", _anchor_sql())
def _(t):
    rows = t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    predicted = F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000
    found = local.anchors(rows, "id", _EDGES, predicted, precision=_LEAST, beam=_BEAM, longest=3)
    text = [F.array_join("features", "&").alias("features"), F.array_join(F.transform("bins", lambda b: b.cast("string")), "&").alias("bins")]
    return found.select("id", *text, *[rnd(c, 8).alias(c) for c in ("precision", "coverage", "bound")], "anchored")


# ---------------------------------------------------------------- models that stand in

_STEPS = "CASE WHEN p_size > 25 THEN 10 ELSE 0 END + CASE WHEN p_size > 40 THEN 5 ELSE 0 END + p_retailprice / 100000"


@query("d18_surrogate_linear", """
WITH s AS (SELECT p_size AS x, p_size * p_size / 50.0 AS y FROM part)
SELECT round(regr_intercept(y, x), 6)::DOUBLE AS intercept, round(regr_slope(y, x), 6)::DOUBLE AS slope, round(regr_r2(y, x), 6)::DOUBLE AS fidelity FROM s
""")
def _(t):
    (a, b), r2 = local.surrogate_linear(t.part, ["p_size"], lambda d: F.col("p_size") * F.col("p_size") / 50)
    return t._spark.createDataFrame([(round(a, 6), round(b, 6), round(r2, 6))], "intercept double, slope double, fidelity double")


@query("d18_surrogate_tree", f"""
WITH s AS (SELECT p_size, {_STEPS} AS y FROM part),
g AS (SELECT CASE WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS band, y FROM s),
l AS (SELECT band, avg(y) AS value, count(*) AS n, stddev_pop(y) AS error FROM g GROUP BY band)
SELECT round(value, 6)::DOUBLE AS value, n::BIGINT AS n, round(error, 6)::DOUBLE AS error,
  round(1 - (SELECT sum(n * error * error) / sum(n) FROM l) / (SELECT var_pop(y) FROM s), 8)::DOUBLE AS fidelity FROM l
""")
def _(t):
    leaves, r2 = local.surrogate_tree(t.part, ["p_size"], lambda d: F.expr(_STEPS), depth=2)
    # leaves that a level split without need (their values differ by prices alone) are one band
    band = F.when(F.col("value") < 5, 1).when(F.col("value") < 12, 2).otherwise(3)
    total, square = F.sum(F.col("n") * F.col("value")), F.sum(F.col("n") * (F.col("error") ** 2 + F.col("value") ** 2))
    g = leaves.groupBy(band.alias("band")).agg(total.alias("s"), square.alias("q"), F.sum("n").alias("n"))
    value = F.col("s") / F.col("n")
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - value * value))
    whole = g.agg(F.sum("q").alias("qq"), F.sum("s").alias("ss"), F.sum("n").alias("nn"), F.sum(F.col("n") * error * error).alias("ee"))
    rest = F.col("ee") / F.col("nn") / (F.col("qq") / F.col("nn") - (F.col("ss") / F.col("nn")) ** 2)
    return g.crossJoin(F.broadcast(whole)).select(rnd(value, 6).alias("value"), "n", rnd(error, 6).alias("error"), rnd(1 - rest, 8).alias("fidelity"))


@query("d18_anova", """
WITH s AS (SELECT l_quantity > 25 AS q, l_discount > 0.05 AS d, l_returnflag AS f, l_quantity * (1 - l_discount) + CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS y FROM lineitem),
w AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM s),
m AS (SELECT 'q' AS terms, count(*) AS k, avg(y) AS g FROM s GROUP BY q UNION ALL SELECT 'd', count(*), avg(y) FROM s GROUP BY d
  UNION ALL SELECT 'f', count(*), avg(y) FROM s GROUP BY f UNION ALL SELECT 'q&d', count(*), avg(y) FROM s GROUP BY q, d
  UNION ALL SELECT 'q&f', count(*), avg(y) FROM s GROUP BY q, f UNION ALL SELECT 'd&f', count(*), avg(y) FROM s GROUP BY d, f),
v AS (SELECT terms, sum(k * (g - m) * (g - m)) / any_value(n) / any_value(v) AS v FROM m, w GROUP BY terms)
SELECT a.terms, round(a.v - coalesce((SELECT sum(b.v) FROM v b WHERE len(a.terms) = 3 AND len(b.terms) = 1 AND contains(a.terms, b.terms)), 0), 8)::DOUBLE AS share FROM v a
""")
def _(t):
    bins = {"q": F.col("l_quantity") > 25, "d": F.col("l_discount") > 0.05, "f": F.col("l_returnflag")}
    y = F.col("l_quantity") * (1 - F.col("l_discount")) + F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)
    found = local.variance_shares(t.lineitem, bins, lambda d: y)
    return rounded(found.select(F.array_join("terms", "&").alias("terms"), "share"), 8)
