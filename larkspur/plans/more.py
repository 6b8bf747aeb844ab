"""Queries of comparison, further explanation, resampling, models and chunked work."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.expr import rnd
from larkspur.operators import causal, compare, explain, models, neighbors, prepare, profile, sampling, stats

from .flows import labelled
from .modelling import DECILES, DIST, SCORED, _psi_sql, halves, rounded, scored
from .registry import query, type_sql

N = "*"


@query("j11_theta", """WITH z AS (SELECT s_suppkey AS k, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS a FROM supplier) SELECT x.k AS a, y.k AS b FROM z x JOIN z y ON x.k < y.k AND abs(x.a - y.a) < 0.05 AND abs(x.a - y.a) > 0""")
def _(t):
    return neighbors.near_pairs(t.supplier, "s_suppkey", ["s_acctbal"], 0.05).select("a", "b")


@query("s06_chunked_mean", "SELECT round(avg(o_totalprice), 4) AS mean FROM orders")
def _(t):
    import pyarrow as pa
    import pyarrow.compute as pc

    def part(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(b.column(0)).as_py()]), pa.array([b.num_rows])], names=["s", "n"])

    p = t.orders.select("o_totalprice").mapInArrow(part, "s double, n bigint")
    return p.agg(rnd(F.sum("s") / F.sum("n"), 4).alias("mean"))


@query("s17_temp_table", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t):
    return t._spark.sql("SELECT o_orderstatus, count(*) AS n FROM {big} GROUP BY 1", big=t.orders.filter("o_totalprice > 100000"))


@query("c12_drop_null_rows", "SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(t):
    return t.labels.dropna(subset=["quality", "toxic"]).select("doc_id")


@query("c21_narrow_types", type_sql({"l_linenumber": "l_linenumber::VARCHAR", "l_quantity": "l_quantity::INTEGER::VARCHAR", "l_orderkey": "l_orderkey::VARCHAR", "l_extendedprice": "l_extendedprice::VARCHAR"}, "lineitem"))
def _(t):
    text = t.lineitem.select(F.col("l_linenumber").cast("string").alias("l_linenumber"), F.col("l_quantity").cast("int").cast("string").alias("l_quantity"), F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_extendedprice").cast("string").alias("l_extendedprice"))
    return profile.type_plan(text, text.columns)


@query("c23_steps", "WITH m AS (SELECT median(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END) AS m FROM customer), f AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, m) AS x FROM customer, m) SELECT c_custkey, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS x FROM f")
def _(t):
    holes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"))
    steps = prepare.Steps(lambda d: prepare.imputer(d, ["x"], "median"), lambda d: prepare.standard_scaler(d, ["x"]))
    return rounded(steps.fit_transform(holes))


@query("d13_constant", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return prepare.imputer(j, ["quality"], "constant", -1).transform(j)


@query("d02_expected_value", f"SELECT round(count(*) FILTER (WHERE y = 1 AND score >= 0.97) * 50.0 - count(*) FILTER (WHERE y = 0 AND score >= 0.97) * 2.0, 4)::DOUBLE AS expected FROM {SCORED}")
def _(t):
    hit = F.col("score") >= 0.97
    return scored(t).agg((F.count_if(hit & (F.col("y") == 1)) * 50.0 - F.count_if(hit & (F.col("y") == 0)) * 2.0).alias("expected"))


def _drift_sql(columns):
    """Drift of each feature between old and new orders, computed feature by feature."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, (o_orderkey % 3 <> 0)::INT AS side FROM orders WHERE {c} IS NOT NULL" for c in columns)
    return f"""WITH l AS ({long}), e AS (SELECT feature, min(x) FILTER (WHERE side = 1) AS rl, max(x) FILTER (WHERE side = 1) AS rh, min(x) AS lo, max(x) AS hi, sum(side) AS nr, sum(1 - side) AS nc FROM l GROUP BY 1),
 a AS (SELECT feature, greatest(0, least(9, floor((x - rl) / (rh - rl) * 10))) AS b, sum(side) / any_value(nr) AS p, sum(1 - side) / any_value(nc) AS q FROM l JOIN e USING (feature) GROUP BY 1, 2),
 psi AS (SELECT feature, sum((greatest(q, 1e-10) - greatest(p, 1e-10)) * ln(greatest(q, 1e-10) / greatest(p, 1e-10))) AS psi FROM a GROUP BY 1),
 f AS (SELECT feature, least(49, floor((x - lo) / (hi - lo) * 50)) AS b, sum(side) / any_value(nr) AS p, sum(1 - side) / any_value(nc) AS q FROM l JOIN e USING (feature) GROUP BY 1, 2),
 js AS (SELECT feature, sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM f GROUP BY 1),
 g AS (SELECT feature, x, sum(side) AS r, sum(1 - side) AS c FROM l GROUP BY 1, 2),
 h AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS d FROM g WINDOW w AS (PARTITION BY feature ORDER BY x)),
 ks AS (SELECT feature, max(d) AS ks FROM h GROUP BY 1),
 z AS (SELECT feature, psi, ks, js, psi > 0.2 OR js > 0.2 OR ks > 1.628 * sqrt((nr + nc) / (nr * nc)) AS high, psi > 0.1 OR js > 0.1 OR ks > 1.358 * sqrt((nr + nc) / (nr * nc)) AS medium FROM psi JOIN ks USING (feature) JOIN js USING (feature) JOIN e USING (feature))
 SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(js, 6) AS js, high OR medium AS drifted, CASE WHEN high THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS severity FROM z"""


@query("d04_drift_report", _drift_sql(["o_totalprice", "o_custkey", "o_orderkey", "year(o_orderdate) + o_orderkey / 10000"]).replace("'year(o_orderdate) + o_orderkey / 10000'", "'moved'"))
def _(t):
    sides = [h.withColumn("moved", F.year("o_orderdate") + F.col("o_orderkey") / 10000) for h in halves(t)]
    return rounded(compare.drift_report(*sides, ["o_totalprice", "o_custkey", "o_orderkey", "moved"]))


@query("d19_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS rho FROM r")
def _(t):
    ranks = lambda c: stats.average_ranks(t.part, c).select(F.col("value").alias(c), F.col("rank").alias(f"r_{c}"))
    j = t.part.join(ranks("p_size"), "p_size").join(ranks("p_retailprice"), "p_retailprice")
    return j.agg(rnd(F.corr("r_p_size", "r_p_retailprice"), 6).alias("rho"))


@query("d21_generator", """
WITH b AS (SELECT min(o_orderdate::DATE) AS lo, max(o_orderdate::DATE) AS hi FROM orders),
d AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b)
SELECT day, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 4)::DOUBLE AS total FROM d LEFT JOIN orders ON o_orderdate::DATE = day AND o_totalprice > 250000 GROUP BY day
""")
def _(t):
    """Every day from the first order to the last is generated, and large orders are counted on it, on most days none."""
    day = F.to_date("o_orderdate")
    edge = t.orders.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = edge.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    sums = t.orders.filter("o_totalprice > 250000").groupBy(day.alias("day")).agg(F.count(N).alias("n"), F.sum("o_totalprice").alias("total"))
    return days.join(sums, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), rnd(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query("m05_stability_summary", f"""WITH s AS (SELECT user_id % 3 AS part, score, y FROM {SCORED}) SELECT part, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(avg(y), 6) AS rate FROM s GROUP BY 1""")
def _(t):
    s = scored(t).groupBy((F.col("user_id") % 3).alias("part"))
    return rounded(s.agg(F.count(N).alias("n"), F.avg("score").alias("mean"), F.stddev("score").alias("sd"), F.avg("y").alias("rate")))


@query("m10_value_deciles", f"""WITH q AS (SELECT list_distinct(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM {SCORED}), s AS (SELECT len(list_filter(e, lambda x: score > x)) + 1 AS decile, y, value FROM {SCORED}, q)
 SELECT decile::INTEGER AS decile, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate, round(sum(value), 4) AS value, round(sum(value * y), 4) AS positive_value FROM s GROUP BY 1""")
def _(t):
    d = compare.value_deciles(scored(t), "score", "y", "value")
    return d.select("decile", "n", "positives", rnd("rate", 6).alias("rate"), rnd("value", 4).alias("value"), rnd("positive_value", 4).alias("positive_value"))


def _side_sql(name: str, rest: int) -> str:
    """auc and ks of the scores of one half of the events."""
    return f"""s_{name} AS (SELECT y, score FROM {SCORED} WHERE event_id % 2 = {rest}), r_{name} AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s_{name}),
 d_{name} AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM s_{name} GROUP BY 1), c_{name} AS (SELECT sum(p) OVER (ORDER BY score) / sum(p) OVER () AS f, sum(q) OVER (ORDER BY score) / sum(q) OVER () AS g FROM d_{name}),
 m_{name} AS (SELECT (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) FROM r_{name}) AS auc_{name}, (SELECT max(abs(f - g)) FROM c_{name}) AS ks_{name})"""


HALF = "(SELECT score AS x FROM " + SCORED + " WHERE event_id % 2 = {})"


@query("m16_stability", f"""WITH {_side_sql("train", 0)}, {_side_sql("test", 1)}, p AS ({_psi_sql(*DECILES, ref=HALF.format(0), cur=HALF.format(1))}) SELECT round(auc_train, 6) AS auc_train, round(ks_train, 6) AS ks_train, round(auc_test, 6) AS auc_test, round(ks_test, 6) AS ks_test, psi,
 round(auc_train - auc_test, 6) AS auc_fall, round(ks_train - ks_test, 6) AS ks_fall FROM m_train, m_test, p""")
def _(t):
    s = scored(t)
    return rounded(compare.stability(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1"), "score", "y"))


@query("m17_model_ranks", """WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1), s AS (SELECT model, a, b, (3 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 1 - (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) / 4 AS score FROM m)
 SELECT model, dense_rank() OVER (ORDER BY a DESC) AS a_rank, dense_rank() OVER (ORDER BY b) AS b_rank, round(score, 6) AS score FROM s""")
def _(t):
    m = t.part.groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    r = compare.rank_models(m, {"a": 3.0, "b": -1.0})
    return r.select("model", F.col("a_rank").cast("bigint").alias("a_rank"), F.col("b_rank").cast("bigint").alias("b_rank"), rnd("score", 6).alias("score"))


@query("d20_guardrails", "WITH m AS (SELECT c_mktsegment AS model, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT v FROM m WHERE model = 'BUILDING') SELECT model, round(b.v - m.v, 4) AS v_fall, b.v - m.v <= 50 AS passes FROM m, b")
def _(t):
    m = t.customer.groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg("c_acctbal").alias("v"))
    return compare.guardrails(m, "BUILDING", {"v": 50}).select("model", rnd("v_fall", 4).alias("v_fall"), "passes")


@query("e09_nearest_examples", f"""WITH n AS (SELECT query, label FROM (SELECT a.vec_id AS query, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE r <= 5)
 SELECT query, label, count(*) AS n, round(count(*) / 5.0, 6)::DOUBLE AS share FROM n GROUP BY 1, 2""")
def _(t):
    return rounded(explain.nearest_examples(t.embeddings.filter("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", "label"))


@query("e10_tree_rules")
def _(t):
    return rounded(explain.tree_rules(labelled(t), ["l_quantity", "l_extendedprice", "l_discount"], "label", 2))


@query("e13_friedman_h", """WITH q AS (SELECT quantile_cont(l_quantity, [0.05, 0.95]) AS a, quantile_cont(l_discount, [0.05, 0.95]) AS b FROM lineitem), g AS (SELECT i, j, (a[1] + (a[2] - a[1]) * i / 4) * (b[1] + (b[2] - b[1]) * j / 4) AS m FROM q, range(5) s(i), range(5) t(j)),
 c AS (SELECT m, avg(m) OVER () AS mm, avg(m) OVER (PARTITION BY i) AS px, avg(m) OVER (PARTITION BY j) AS py FROM g) SELECT round(sqrt(sum((m - px - py + mm) ** 2) / sum((m - mm) ** 2)), 6) AS h FROM c""")
def _(t):
    h = explain.friedman_h(t.lineitem.select("l_quantity", "l_discount"), "l_quantity", "l_discount", lambda d: F.col("l_quantity") * F.col("l_discount"))
    return t._spark.createDataFrame([(round(h, 6),)], "h double")


@query("e14_concepts", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) FILTER (WHERE label = 0) - avg(x) FILTER (WHERE label <> 0) AS g FROM e GROUP BY 1),
 n AS (SELECT i, g / (SELECT sqrt(sum(g * g)) FROM m) AS g FROM m) SELECT vec_id, round(sum(x * g), 6) AS concept FROM e JOIN n USING (i) GROUP BY 1""")
def _(t):
    d = explain.concept_direction(t.embeddings.filter("label = 0"), t.embeddings.filter("label <> 0"), "embedding")
    return rounded(explain.concept_scores(t.embeddings, "vec_id", "embedding", d))


@query("e16_elimination")
def _(t):
    def loss(columns):
        a, b, yy, n = causal.normal_equations(t.lineitem, columns, "l_extendedprice")
        w = causal.solve(a, b)
        return (yy - sum(x * y for x, y in zip(w, b, strict=True))) / n

    steps = explain.backward_elimination(["l_quantity", "l_discount", "l_tax"], loss, 1, 1e6)
    return t._spark.createDataFrame([(len(f), ",".join(f)) for f, _ in steps], "n int, features string")


@query("g04_isolation")
def _(t):
    s = explain.isolation_scores(t.events.select("event_id", "value", F.hour("ts").alias("hour")), "event_id", ["value", "hour"], 20)
    return s.select("event_id", rnd("score", 6).alias("score"))


@query("g19_ood", f"""WITH n AS (SELECT a.vec_id AS query, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), m AS (SELECT query, avg(d) AS m FROM n WHERE r <= 5 GROUP BY 1)
 SELECT query, round(m, 6) AS mean_distance, m > (SELECT quantile_cont(m, 0.9) FROM m) AS outlier FROM m""")
def _(t):
    return rounded(neighbors.ood_by_distance(t.embeddings.filter("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding"))


@query("b03_near_miss", f"""WITH n AS (SELECT a.vec_id, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label <> 0 AND b.label = 0),
 k AS (SELECT vec_id FROM n WHERE r <= 3 GROUP BY 1 ORDER BY avg(d), vec_id LIMIT 30) SELECT vec_id, label FROM embeddings WHERE label = 0 OR vec_id IN (SELECT vec_id FROM k)""")
def _(t):
    return sampling.near_miss(t.embeddings, "vec_id", "embedding", "label", 0, 30).select("vec_id", "label")


@query("b03_edited", f"""WITH n AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS nl, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT q AS vec_id FROM n WHERE r <= 3 GROUP BY 1 HAVING avg(CASE WHEN ql = nl THEN 1.0 ELSE 0 END) > 0.5""")
def _(t):
    return neighbors.edited_nearest(t.embeddings, "vec_id", "embedding", "label").select("vec_id")


@query("l08_search")
def _(t):
    d = labelled(t).select("id", "l_extendedprice", "l_discount", "label")
    found = models.search(d, "id", "label", "decision_tree", ["l_extendedprice", "l_discount"], {"maxDepth": [2, 3]}, k=2)
    return t._spark.createDataFrame([(round(a, 3), str(p)) for a, p in found], "auc double, params string")


@query("l09_vote")
def _(t):
    d = labelled(t)
    own = ["l_quantity", "l_extendedprice", "l_discount"]
    made = [models.TabularModel(a, own, **p).fit(d.filter("split = 'train'")) for a, p in (("logistic_regression", {"maxIter": 10}), ("decision_tree", {"maxDepth": 3}))]
    return stats.ranking_metrics(models.vote(made, d.filter("split = 'test'")), "score", "label").select(rnd("auc", 3).alias("auc"))


@query("l06_ols", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def _(t):
    w = causal.linear_fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t._spark.createDataFrame([(round(w[0], 3), round(w[1], 4))], "intercept double, slope double")


