"""Queries of the relational core: projection, joins, aggregates, windows, order, sets, functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.functions.expr import rnd
from larkspur.operators import relational as R
from larkspur.operators.quantiles import quantiles

from .registry import query

N = "*"  # what count() counts: rows


def fact(t):
    """Order lines with their order: the transaction table of the corpus."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


# ---------------------------------------------------------------- projection and filters


@query("p01_projection", "SELECT o_orderkey, o_totalprice, round(ln(1 + o_totalprice), 6) AS log_price FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice", rnd(F.log1p("o_totalprice"), 6).alias("log_price"))


@query("p02_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 7) AS net, round(l_extendedprice / nullif(l_quantity, 0), 7) AS unit FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", rnd(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), rnd(X.safe_div("l_extendedprice", "l_quantity")).alias("unit")
    )


@query("p03_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(t):
    return t.orders.filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("p04_conjunction", "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'purchase'")
def _(t):
    return t.events.filter((F.col("value") > 50) & (F.col("event_type") == "purchase")).select("event_id", "value")


@query("p05_above_median", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)")
def _(t):
    cut = quantiles(t.orders, {"cut": ("o_totalprice", 0.5)})
    return t.orders.crossJoin(F.broadcast(cut)).filter("o_totalprice > cut").select("o_orderkey", "o_totalprice")


@query("p06_not_null", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def _(t):
    return t.documents.select("text", "lang").dropna().agg(F.count(N).alias("n"))


@query("p07_in_list", "SELECT event_type, count(*) AS n FROM events WHERE extract(dow FROM ts) IN (0, 6) GROUP BY event_type")
def _(t):
    return t.events.filter(X.dow0("ts").isin(0, 6)).groupBy("event_type").agg(F.count(N).alias("n"))


@query("p08_case", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.groupBy(F.when(p < 50000, "low").when(p < 150000, "mid").otherwise("high").alias("band")).agg(F.count(N).alias("n"))


@query("p09_guarded_division", "SELECT event_id, round(value / nullif(user_id % 7, 0), 6) AS ratio FROM events")
def _(t):
    return t.events.select("event_id", rnd(X.safe_div("value", F.col("user_id") % 7), 6).alias("ratio"))


@query("p10_casts", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS v, CAST(user_id AS VARCHAR) AS u FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.alias("k"), F.to_date("ts").alias("day"), F.floor("value").cast("bigint").alias("v"), F.col("user_id").cast("string").alias("u"))


@query("p11_star", "SELECT *, o_totalprice / 1000 AS thousands FROM orders")
def _(t):
    return t.orders.select("*", (F.col("o_totalprice") / 1000).alias("thousands"))


@query("p12_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(N).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total")).filter("n > 12")


@query("p13_cte_chain", """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
 b AS (SELECT o_custkey, max(s) AS best, count(*) AS months FROM m GROUP BY 1), c AS (SELECT months, round(avg(best), 2) AS avg_best, count(*) AS n FROM b GROUP BY 1)
 SELECT months, avg_best, n FROM c""")
def _(t):
    m = t.orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("mon")).agg(F.sum("o_totalprice").alias("s"))
    b = m.groupBy("o_custkey").agg(F.max("s").alias("best"), F.count(N).alias("months"))
    return b.groupBy("months").agg(rnd(F.avg("best"), 2).alias("avg_best"), F.count(N).alias("n"))


@query("p15_scalar_subquery", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z FROM orders")
def _(t):
    s = t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return t.orders.crossJoin(F.broadcast(s)).select("o_orderkey", rnd((F.col("o_totalprice") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("p16_configured_features", "SELECT o_orderkey, CAST(o_totalprice / 2 AS DOUBLE) AS half, (o_totalprice > 200000 OR o_orderstatus = 'F') AS flag FROM orders")
def _(t):
    features = [{"name": "half", "expression": "o_totalprice / 2"}, {"name": "flag", "expression": "(o_totalprice > 200000) | (o_orderstatus = 'F')", "type": "boolean"}]
    return R.derived(t.orders, features).select("o_orderkey", "half", "flag")


@query("p17_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def _(t):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("p18_duplicate_count", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars FROM documents)) AS BIGINT) AS duplicates FROM documents")
def _(t):
    return R.duplicate_count(t.documents.select("lang", "source", "n_chars"))


@query("p19_sample")
def _(t):
    return R.sample_rows(t.orders, "o_orderkey", 500)


@query("p20_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t):
    return t.orders.orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- joins


@query("j01_inner_dimension", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(N).alias("n"), rnd(F.sum("c_acctbal"), 2).alias("bal"))


@query("j02_left_aggregate", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    # aggregated before the join: one row for each key is joined, not one for each order
    s = t.orders.groupBy("o_custkey").agg(F.count(N).alias("n"), F.sum("o_totalprice").alias("s"))
    return t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n"), rnd(F.coalesce("s", F.lit(0.0)), 2).alias("total")
    )


@query("j03_suffixed", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_lookup FROM nation a LEFT JOIN nation b USING (n_regionkey)")
def _(t):
    other = t.nation.select("n_regionkey", "n_name")
    return R.join_suffixed(t.nation, other, "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "n_name_lookup")


@query("j04_own_aggregate", "SELECT o_orderkey, round(o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS ratio FROM orders")
def _(t):
    return t.orders.select("o_orderkey", rnd(F.col("o_totalprice") / F.avg("o_totalprice").over(W.partitionBy("o_custkey")), 6).alias("ratio"))


@query("j05_join_filter_topk", "SELECT l_orderkey, l_linenumber, p_name, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def _(t):
    j = t.lineitem.join(t.part.filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    return j.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "p_name", "l_extendedprice")


@query("j06_cross_one_row", "SELECT s_suppkey, round(s_acctbal - m, 7) AS gap FROM supplier CROSS JOIN (SELECT avg(s_acctbal) AS m FROM supplier)")
def _(t):
    return t.supplier.crossJoin(F.broadcast(t.supplier.agg(F.avg("s_acctbal").alias("m")))).select("s_suppkey", rnd(F.col("s_acctbal") - F.col("m")).alias("gap"))


@query("j07_three_tables", """SELECT p_brand, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(ps), 0)::BIGINT AS n_suppliers FROM part
 LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey
 LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT s_suppkey) AS ps FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_acctbal > 0 GROUP BY 1) b ON p_partkey = k GROUP BY p_brand""")
def _(t):
    # children are aggregated before the join, so neither multiplies the other's counts
    lines = t.lineitem.groupBy("l_partkey").agg(F.count(N).alias("n"))
    good = t.supplier.filter("s_acctbal > 0").select("s_suppkey")
    sold = t.lineitem.join(good, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("k"))
    return (
        t.part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(sold.agg(F.countDistinct("s_suppkey").alias("ps")), F.col("p_partkey") == F.col("k"), "left")
        .groupBy("p_brand")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "n_lines"), ("ps", "n_suppliers"))])
    )


@query("j08_conditional_count", "SELECT c_mktsegment, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"))


@query("j12_trailing_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events")
def _(t):
    w = W.partitionBy("user_id").orderBy(X.micros("ts")).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count(N).over(w).alias("n"))


@query("j13_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)")
def _(t):
    top = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    return t.orders.join(top, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j14_outer_add", "SELECT k, round(sum(v), 2) AS v FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY k")
def _(t):
    a, b = t.customer.selectExpr("c_nationkey k", "c_acctbal v"), t.supplier.selectExpr("s_nationkey k", "s_acctbal v")
    return R.add_totals(a, b, "k", "v").select("k", rnd("v", 2).alias("v"))


@query("j15_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    large = t.orders.filter("o_totalprice > 300000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---------------------------------------------------------------- aggregates


@query("a01_group", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def _(t):
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.count(N).alias("n"), rnd(F.sum(q), 2).alias("s"), rnd(F.avg(q), 6).alias("m"), F.min(q).alias("lo"), F.max(q).alias("hi"))


@query("a02_global", "SELECT round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 7) AS m, count(*) AS n FROM orders")
def _(t):
    return t.orders.agg(rnd(F.sum("o_totalprice"), 2).alias("s"), rnd(F.avg("o_totalprice")).alias("m"), F.count(N).alias("n"))


@query("a03_multi_key", "SELECT l_returnflag, l_linestatus, round(stddev_samp(l_extendedprice), 7) AS sd, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(rnd(F.stddev("l_extendedprice")).alias("sd"), F.countDistinct("l_partkey").alias("parts"))


@query("a04_counts", "SELECT event_type, count(*) AS n, count(CASE WHEN value > 10 THEN value END) AS non_null FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(N).alias("n"), F.count(F.when(F.col("value") > 10, F.col("value"))).alias("non_null"))


@query("a05_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 7) AS q1, round(quantile_cont(o_totalprice, 0.5), 7) AS q2, round(quantile_cont(o_totalprice, 0.95), 7) AS q95 FROM orders GROUP BY 1")
def _(t):
    p = "o_totalprice"
    found = quantiles(t.orders, {"q1": (p, 0.25), "q2": (p, 0.5), "q95": (p, 0.95)}, ["o_orderpriority"])
    return found.select("o_orderpriority", *[rnd(c).alias(c) for c in ("q1", "q2", "q95")])


@query("a06_nearest_quantile", """SELECT c_mktsegment, quantile FROM (SELECT c_mktsegment, c_acctbal AS quantile, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i,
 count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE i = round((n - 1) * 0.75)""")
def _(t):
    return R.nearest_quantile(t.customer, "c_mktsegment", "c_acctbal", 0.75)


@query("a07_median", "SELECT event_type, round(median(value), 6) AS med FROM events GROUP BY 1")
def _(t):
    return quantiles(t.events, {"med": ("value", 0.5)}, ["event_type"]).select("event_type", rnd("med", 6).alias("med"))


@query("a08_spread", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(var_samp(value), 7) AS v FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(rnd(F.stddev_samp("value"), 6).alias("sd"), rnd(F.stddev_pop("value"), 6).alias("sdp"), rnd(F.var_samp("value")).alias("v"))


@query("a09_conditional", "SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS pos, count(*) FILTER (WHERE c_acctbal < 0) AS neg FROM customer GROUP BY 1")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(rnd(F.sum(F.when(b > 0, b).otherwise(0)), 2).alias("pos"), F.count_if(b < 0).alias("neg"))


@query("a10_shape", "SELECT p_brand, round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS cv, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 7) AS iqr, round(3 * (avg(p_retailprice) - median(p_retailprice)) / stddev_samp(p_retailprice), 6) AS skew FROM part GROUP BY 1")
def _(t):
    x = "p_retailprice"
    q = quantiles(t.part, {"a": (x, 0.25), "m": (x, 0.5), "b": (x, 0.75)}, ["p_brand"])
    g = t.part.groupBy("p_brand").agg(F.avg(x).alias("mean"), F.stddev(x).alias("sd")).join(q, "p_brand")
    skew = 3 * (F.col("mean") - F.col("m")) / F.col("sd")
    return g.select("p_brand", rnd(F.col("sd") / F.col("mean"), 6).alias("cv"), rnd(F.col("b") - F.col("a")).alias("iqr"), rnd(skew, 6).alias("skew"))


@query("a11_distinct_counts", "SELECT count(DISTINCT l_orderkey) AS o, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem")
def _(t):
    return t.lineitem.agg(*[F.countDistinct(f"l_{c}key").alias(c[0]) for c in ("order", "part", "supp")])


@query("a12_moments", "SELECT event_type, round(skewness(value), 7) AS skew, round(kurtosis(value), 7) AS kurt FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(rnd(X.skew_corrected("value")).alias("skew"), rnd(X.kurtosis_corrected("value")).alias("kurt"))


@query("a13_array_agg", "SELECT n_regionkey, list_sort(array_agg(DISTINCT n_name)) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("names"))


@query("a14_date_groups", "SELECT date_trunc('month', o_orderdate) AS mon, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("mon")).agg(F.count(N).alias("n"))


@query("a15_histogram", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
 SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def _(t):
    return R.histogram(t.events, "value", 20)


@query("a16_quantile_bins", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
 SELECT CASE WHEN value <= a THEN 0 WHEN value <= b THEN 1 WHEN value <= c THEN 2 ELSE 3 END AS bin, count(*) AS n FROM events, q GROUP BY 1""")
def _(t):
    q = quantiles(t.events, {"a": ("value", 0.25), "b": ("value", 0.5), "c": ("value", 0.75)})
    at = F.when(F.col("value") <= F.col("a"), 0).when(F.col("value") <= F.col("b"), 1).when(F.col("value") <= F.col("c"), 2).otherwise(3)
    return t.events.crossJoin(F.broadcast(q)).groupBy(at.alias("bin")).agg(F.count(N).alias("n"))


@query("a17_fixed_bins", "SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 AND p_size <= 100 THEN 'large' END AS bin, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(R.fixed_bins(F.col("p_size"), [0, 10, 30, 100], ["small", "medium", "large"]).alias("bin")).agg(F.count(N).alias("n"))


@query("a18_value_counts", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def _(t):
    total = t.part.filter("p_type IS NOT NULL OR p_type IS NULL").agg(F.count(N).alias("all"))
    c = t.part.groupBy("p_type").agg(F.count(N).alias("n")).crossJoin(F.broadcast(total))
    return c.select("p_type", "n", rnd(F.col("n") / F.col("all"), 6).alias("share")).orderBy(F.desc("n"), "p_type").limit(10)


@query("a19_describe", """SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS lo, round(quantile_cont(value, 0.25), 6) AS q1,
 round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS hi FROM events""")
def _(t):
    v = "value"
    made = {"mean": F.avg(v), "sd": F.stddev(v), "lo": F.min(v), "hi": F.max(v)}
    q = quantiles(t.events, {"q1": (v, 0.25), "q2": (v, 0.5), "q3": (v, 0.75)}).select(*[rnd(c, 6).alias(c) for c in ("q1", "q2", "q3")])
    return t.events.agg(F.count(v).alias("n"), *[rnd(c, 6).alias(a) for a, c in made.items()]).crossJoin(F.broadcast(q))


@query("a20_correlations", """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 5) AS corr FROM lineitem UNION ALL
 SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 5) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 5) FROM lineitem""")
def _(t):
    return R.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", rnd("corr", 5).alias("corr"))


@query("a21_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(N).alias("n"))


@query("a22_pivot", "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS \"F\", round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS \"O\" FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(rnd(F.avg("l_quantity"), 6))


@query("a23_configured", "SELECT o_custkey, round(avg(o_totalprice), 7) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max, count(DISTINCT o_orderstatus) AS o_orderstatus_nunique FROM orders GROUP BY 1")
def _(t):
    made = R.configured_aggregates(t.orders, ["o_custkey"], [{"column": "o_totalprice", "agg": ["mean", "max"]}, {"column": "o_orderstatus", "agg": ["nunique"]}])
    return made.withColumn("o_totalprice_mean", rnd("o_totalprice_mean"))


@query("a24_mode", """SELECT c_mktsegment, mode, n FROM (SELECT c_mktsegment, c_nationkey AS mode, count(*) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS r
 FROM customer GROUP BY 1, 2) WHERE r = 1""")
def _(t):
    return R.smallest_mode(t.customer, "c_mktsegment", "c_nationkey")


@query("a26_weighted_merge", "SELECT round(avg(l_extendedprice), 7) AS mean, count(*) AS n FROM lineitem")
def _(t):
    parts = t.lineitem.groupBy(F.pmod("l_orderkey", F.lit(16)).alias("chunk")).agg(F.avg("l_extendedprice").alias("m"), F.count(N).alias("k"))
    return parts.agg(rnd(F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"), F.sum("k").alias("n"))


@query("a27_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(N).alias("n"))


@query("a28_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def _(t):
    return t.nation.rollup("n_regionkey", "n_nationkey").agg(F.count(N).alias("n"))


# ---------------------------------------------------------------- windows

def by_customer():
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("w01_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.row_number().over(by_customer()).cast("bigint").alias("rn"))


@query("w02_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS o FROM part")
def _(t):
    w = W.partitionBy("p_brand").orderBy("p_size")
    o = W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return t.part.select("p_partkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"), F.row_number().over(o).cast("bigint").alias("o"))


@query("w03_ntile", "SELECT c_custkey, ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.ntile(5).over(W.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).cast("bigint").alias("q"))


@query("w04_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t):
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(by_customer()).alias("before"), F.lead("o_totalprice", 2).over(by_customer()).alias("after"))


@query("w05_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run FROM orders")
def _(t):
    return t.orders.select("o_orderkey", rnd(F.sum("o_totalprice").over(by_customer()), 2).alias("run"))


@query("w06_moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 7) AS ma FROM orders")
def _(t):
    return t.orders.select("o_orderkey", rnd(F.avg("o_totalprice").over(by_customer().rowsBetween(-2, 0))).alias("ma"))


@query("w07_partition_mean", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 8) AS gap FROM events")
def _(t):
    return t.events.select("event_id", rnd(F.col("value") - F.avg("value").over(W.partitionBy("user_id")), 8).alias("gap"))


@query("w08_shares", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS of_group, round(s_acctbal / sum(s_acctbal) OVER (), 8) AS of_all FROM supplier")
def _(t):
    total = t.supplier.agg(F.sum("s_acctbal").alias("total"))
    return t.supplier.crossJoin(F.broadcast(total)).select(
        "s_suppkey", rnd(F.col("s_acctbal") / F.sum("s_acctbal").over(W.partitionBy("s_nationkey")), 6).alias("of_group"), rnd(F.col("s_acctbal") / F.col("total"), 8).alias("of_all")
    )


@query("w09_time_range", """SELECT event_id, count(*) OVER d AS n_day, round(sum(value) OVER d, 7) AS s_day, round(avg(value) OVER k, 7) AS m_week FROM events
 WINDOW d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), k AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def _(t):
    w = W.partitionBy("user_id").orderBy(X.micros("ts"))
    day, week = w.rangeBetween(-86_400_000_000, 0), w.rangeBetween(-7 * 86_400_000_000, 0)
    return t.events.select("event_id", F.count(N).over(day).alias("n_day"), rnd(F.sum("value").over(day)).alias("s_day"), rnd(F.avg("value").over(week)).alias("m_week"))


@query("w10_history", "SELECT o_orderkey, count(*) OVER w AS n_before, round(avg(o_totalprice) OVER w, 7) AS mean_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    w = by_customer().rowsBetween(W.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", F.count(N).over(w).alias("n_before"), rnd(F.avg("o_totalprice").over(w)).alias("mean_before"))


@query("w11_gap_hours", "SELECT event_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0, 24), 6) AS hours FROM events")
def _(t):
    us = X.micros("ts")
    return t.events.select("event_id", rnd(F.coalesce((us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 3.6e9, F.lit(24.0)), 6).alias("hours"))


@query("w12_percent_rank", "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part")
def _(t):
    return t.part.select("p_partkey", rnd(X.percent_of_rank("p_brand", "p_size"), 6).alias("pct"))


@query("w13_growth", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS s FROM orders GROUP BY 1)
 SELECT mon, round((s - lag(s) OVER (ORDER BY mon)) / nullif(lag(s) OVER (ORDER BY mon), 0), 6) AS growth FROM m""")
def _(t):
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("mon")).agg(F.sum("o_totalprice").alias("s"))
    before = F.lag("s").over(W.orderBy("mon"))  # one row for each month
    return m.select("mon", rnd(X.safe_div(F.col("s") - before, before), 6).alias("growth"))


@query("w14_top_k", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(t):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", r.cast("bigint").alias("r")).filter("r <= 3")


@query("w15_cumulative_share", """WITH b AS (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1)
 SELECT p_brand, round(sum(s) OVER (ORDER BY s DESC, p_brand) / sum(s) OVER (), 6) AS cum FROM b""")
def _(t):
    b = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    return b.select("p_brand", rnd(F.sum("s").over(W.orderBy(F.desc("s"), "p_brand")) / F.sum("s").over(W.partitionBy()), 6).alias("cum"))


@query("w16_directions", """SELECT user_id, round(avg(CASE WHEN value > p THEN 1.0 ELSE 0 END), 6) AS up FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
 WHERE p IS NOT NULL GROUP BY 1""")
def _(t):
    p = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("p", p).filter("p IS NOT NULL").groupBy("user_id").agg(rnd(F.avg((F.col("value") > F.col("p")).cast("double")), 6).alias("up"))


@query("w17_fill", """SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS forward,
 first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)""")
def _(t):
    v, w = F.when(F.col("event_id") % 3 == 0, F.col("value")), W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("v", v).select(
        "event_id", F.last("v", True).over(w).alias("forward"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("backward")
    )


# ---------------------------------------------------------------- order, sets, functions


@query("o01_mixed_order", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice ASC, p_partkey LIMIT 200")
def _(t):
    return t.part.orderBy(F.desc("p_size"), F.asc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "p_size", "p_retailprice")


@query("o02_order_by_aggregate", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25")
def _(t):
    s = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(25)
    return s.select("o_custkey", rnd("s", 2).alias("total"))


@query("o04_nlargest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("o05_argmax", "SELECT o_custkey, min(o_orderkey) AS best FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("u01_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY kind")
def _(t):
    a, b = t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k")), t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("kind").agg(F.count(N).alias("n"))


@query("u02_intersect_except", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
 SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def _(t):
    both = t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).agg(F.lit("both").alias("kind"), F.count(N).alias("n"))
    return both.union(t.customer.select("c_custkey").subtract(t.orders.select("o_custkey")).agg(F.lit("only"), F.count(N)))


@query("u03_union_of_bins", """WITH a AS (SELECT CAST(floor(c_acctbal / 1000) AS BIGINT) AS b, count(*) * 1.0 / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1),
 s AS (SELECT CAST(floor(s_acctbal / 1000) AS BIGINT) AS b, count(*) * 1.0 / (SELECT count(*) FROM supplier) AS p FROM supplier GROUP BY 1)
 SELECT b, round(coalesce(a.p, 1e-10), 8) AS pa, round(coalesce(s.p, 1e-10), 8) AS ps FROM a FULL JOIN s USING (b)""")
def _(t):
    def share(df, x, name):
        total = F.broadcast(df.agg(F.count(N).alias("total")))
        return df.groupBy(F.floor(F.col(x) / 1000).alias("b")).agg(F.count(N).alias("n")).crossJoin(total).select("b", (F.col("n") / F.col("total")).alias(name))

    j = share(t.customer, "c_acctbal", "pa").join(share(t.supplier, "s_acctbal", "ps"), "b", "full")
    return j.select("b", *[rnd(F.coalesce(c, F.lit(1e-10)), 8).alias(c) for c in ("pa", "ps")])


@query("u04_jaccard", """WITH s AS (SELECT l_suppkey, list(DISTINCT l_returnflag || l_linestatus) AS f FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round(len(list_intersect(f, ['AF', 'NO', 'RX'])) * 1.0 / len(list_distinct(list_concat(f, ['AF', 'NO', 'RX']))), 6) AS jac FROM s""")
def _(t):
    fixed = F.array(*map(F.lit, ("AF", "NO", "RX")))
    s = t.lineitem.groupBy("l_suppkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("f"))
    return s.select("l_suppkey", rnd(F.size(F.array_intersect("f", fixed)) / F.size(F.array_union("f", fixed)), 6).alias("jac"))


@query("f01_math", "SELECT event_id, round(ln(1 + value), 6) AS a, round(abs(value - 50), 6) AS b, round(sin(2 * pi() * extract(hour FROM ts) / 24), 6) AS c, user_id % 10 AS d, round(sqrt(value), 6) AS e, greatest(least(value, 90), 10) AS f FROM events")
def _(t):
    s, _c = X.cyclic(F.hour("ts"), 24)
    v = F.col("value")
    return t.events.select("event_id", rnd(F.log1p("value"), 6).alias("a"), rnd(F.abs(v - 50), 6).alias("b"), rnd(s, 6).alias("c"), (F.col("user_id") % 10).alias("d"), rnd(F.sqrt("value"), 6).alias("e"), X.clip("value", 10.0, 90.0).alias("f"))


@query("f02_dates", """SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, date_diff('month', DATE '1992-01-31', CAST(o_orderdate AS DATE)) AS months,
 extract(dow FROM o_orderdate) AS dow, extract(month FROM o_orderdate) AS mon, extract(quarter FROM o_orderdate) AS q, last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS month_end FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    start = F.lit("1992-01-31").cast("date")
    return t.orders.select(
        "o_orderkey", F.datediff(d, F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"), X.month_diff(d, start).cast("bigint").alias("months"), X.dow0("o_orderdate").cast("bigint").alias("dow"),
        F.month(d).cast("bigint").alias("mon"), F.quarter(d).cast("bigint").alias("q"), (F.last_day(d) == d).alias("month_end"),
    )


@query("f03_strings", "SELECT c_custkey, c_name || '-' || c_mktsegment AS tag, length(c_name) AS n, upper(c_mktsegment) = c_mktsegment AS is_upper, trim(c_name) = c_name AS clean, regexp_extract(c_name, '[0-9]+') AS digits FROM customer")
def _(t):
    return t.customer.select(
        "c_custkey", F.concat_ws("-", "c_name", "c_mktsegment").alias("tag"), F.length("c_name").cast("bigint").alias("n"), (F.upper("c_mktsegment") == F.col("c_mktsegment")).alias("is_upper"),
        (F.trim("c_name") == F.col("c_name")).alias("clean"), F.regexp_extract("c_name", "[0-9]+", 0).alias("digits"),
    )


@query("f04_unnest", "SELECT vec_id, i, round(e, 5) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 4")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "e")).filter("i < 4").select("vec_id", F.col("i").cast("bigint").alias("i"), rnd(F.col("e").cast("double"), 5).alias("x"))


@query("f05_map_lookup", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("F", "finished", "O", "open")])
    return t.orders.groupBy("o_orderstatus", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("other")).alias("label")).agg(F.count(N).alias("n"))


@query("f06_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(N).alias("n"))


@query("f07_hash_bucket")
def _(t):
    return t.customer.groupBy(X.hash_bucket("c_name", 16).alias("bucket")).agg(F.count(N).alias("n"))


@query("f08_nulls", "SELECT doc_id, coalesce(quality, -1) AS q, nullif(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("q"), F.nullif("toxic", F.lit(0)).alias("t"))
