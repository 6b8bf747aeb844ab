"""The composite analyses: growth, segmentation, cohorts, anomalies, baskets, feature tables, streams of days."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.functions.expr import rnd
from larkspur.operators import stats
from larkspur.operators.quantiles import quantiles

from .core import fact
from .registry import query

N = "*"  # what count() counts: rows
def net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


NET_SQL = "l_extendedprice * (1 - l_discount)"


def month(c):
    return F.date_trunc("month", c).cast("timestamp_ntz")


@query("n01_sales_by_category", f"""SELECT p_brand, count(*) AS n, round(sum({NET_SQL}), 6) AS revenue, round(avg(l_quantity), 7) AS avg_qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    j = fact(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return (
        j.groupBy("p_brand")
        .agg(F.count(N).alias("n"), rnd(F.sum(net()), 6).alias("revenue"), rnd(F.avg("l_quantity")).alias("avg_qty"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
        .orderBy(F.desc("revenue"), "p_brand")
    )


@query("n02_monthly_growth", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS s FROM orders GROUP BY 1)
 SELECT mon, round(s, 2) AS s, round((s - lag(s) OVER w) / nullif(lag(s) OVER w, 0), 6) AS growth, round(avg(s) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3 FROM m WINDOW w AS (ORDER BY mon)""")
def _(t):
    m = t.orders.groupBy(month("o_orderdate").alias("mon")).agg(F.sum("o_totalprice").alias("s"))
    w = W.orderBy("mon")  # one row for each month
    return m.select("mon", rnd("s", 2).alias("s"), rnd(X.safe_div(F.col("s") - F.lag("s").over(w), F.lag("s").over(w)), 6).alias("growth"), rnd(F.avg("s").over(w.rowsBetween(-2, 0)), 2).alias("ma3"))


@query("n03_rfm", """WITH c AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') AS rec, count(*) AS freq, sum(o_totalprice) AS mon FROM orders GROUP BY 1),
 q AS (SELECT *, ntile(5) OVER (ORDER BY rec DESC, o_custkey) AS r, ntile(5) OVER (ORDER BY freq, o_custkey) AS f, ntile(5) OVER (ORDER BY mon, o_custkey) AS m FROM c)
 SELECT CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 3 AND f >= 3 THEN 'loyal' WHEN r <= 2 THEN 'at risk' ELSE 'other' END AS segment, count(*) AS n, round(avg(mon), 4) AS mean FROM q GROUP BY 1""")
def _(t):
    # quintile borders over one row for each customer
    c = t.orders.groupBy("o_custkey").agg(F.datediff(F.lit("1999-01-01").cast("date"), F.to_date(F.max("o_orderdate"))).alias("rec"), F.count(N).alias("freq"), F.sum("o_totalprice").alias("mon"))
    q = c
    for name, order in (("r", F.desc("rec")), ("f", F.asc("freq")), ("m", F.asc("mon"))):
        q = stats.ranked(q, order, F.col("o_custkey")).withColumn(name, stats.tile(F.col("rank"), F.col("n_all"), 5)).drop("rank", "n_all")
    label = F.when((F.col("r") >= 4) & (F.col("f") >= 4) & (F.col("m") >= 4), "champion").when((F.col("r") >= 3) & (F.col("f") >= 3), "loyal").when(F.col("r") <= 2, "at risk").otherwise("other")
    return q.groupBy(label.alias("segment")).agg(F.count(N).alias("n"), rnd(F.avg("mon"), 4).alias("mean"))


@query("n04_product_performance", f"""SELECT p_partkey, count(*) AS n, round(sum({NET_SQL}), 6) AS rev, round(stddev_samp(l_quantity), 6) AS sd, round(quantile_cont(l_extendedprice, 0.5), 7) AS med,
 round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 5 ORDER BY sum({NET_SQL}) DESC, p_partkey LIMIT 50""")
def _(t):
    j = t.lineitem.join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_partkey").agg(
        F.count(N).alias("n"), F.sum(net()).alias("s"), rnd(F.stddev("l_quantity"), 6).alias("sd"), rnd(X.percentile("l_extendedprice", 0.5)).alias("med"), rnd(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("returned")
    )
    return g.filter("n >= 5").orderBy(F.desc("s"), "p_partkey").limit(50).select("p_partkey", "n", rnd("s", 6).alias("rev"), "sd", "med", "returned")


@query("n05_quarterly_cube", f"""SELECT date_trunc('quarter', o_orderdate) AS q, r_name, c_mktsegment, l_returnflag, o_orderpriority, count(*) AS n, count(DISTINCT c_custkey) AS customers, round(sum({NET_SQL}), 6) AS rev
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = fact(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("q"), "r_name", "c_mktsegment", "l_returnflag", "o_orderpriority").agg(
        F.count(N).alias("n"), F.countDistinct("c_custkey").alias("customers"), rnd(F.sum(net()), 6).alias("rev")
    )


@query("n06_product_lookup", """WITH p AS (SELECT DISTINCT p_partkey, p_brand, p_retailprice FROM part) SELECT l_orderkey, l_linenumber, l_partkey, p_brand,
 CASE WHEN l_extendedprice / l_quantity > p_retailprice THEN 'above' ELSE 'below' END AS kind FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_quantity > 45 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def _(t):
    j = t.lineitem.filter("l_quantity > 45").join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(X.safe_div("l_extendedprice", "l_quantity") > F.col("p_retailprice"), "above").otherwise("below")
    return j.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", kind.alias("kind"))


@query("n07_daily_running", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY 1)
 SELECT day, n, round(sum(s) OVER (ORDER BY day), 2) AS run, round(avg(s) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7, round((s - lag(s) OVER (ORDER BY day)) / nullif(lag(s) OVER (ORDER BY day), 0), 6) AS growth FROM d""")
def _(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(N).alias("n"), F.sum("value").alias("s"))
    w = W.orderBy("day")  # one row for each day
    return d.select("day", "n", rnd(F.sum("s").over(w), 2).alias("run"), rnd(F.avg("s").over(w.rowsBetween(-6, 0)), 6).alias("ma7"), rnd(X.safe_div(F.col("s") - F.lag("s").over(w), F.lag("s").over(w)), 6).alias("growth"))


@query("n08_customer_windows", """SELECT o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER w, 2) AS run, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 7) AS ma
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), rnd(F.sum("o_totalprice").over(w), 2).alias("run"), rnd(F.avg("o_totalprice").over(w.rowsBetween(-2, 0))).alias("ma"))


@query("n09_against_mean", "SELECT o_orderkey, o_custkey, round(o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS ratio FROM orders ORDER BY 3 DESC, o_orderkey LIMIT 100")
def _(t):
    r = t.orders.select("o_orderkey", "o_custkey", rnd(F.col("o_totalprice") / F.avg("o_totalprice").over(W.partitionBy("o_custkey")), 6).alias("ratio"))
    return r.orderBy(F.desc("ratio"), "o_orderkey").limit(100)


@query("n10_distribution", """SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.9) - quantile_cont(o_totalprice, 0.1), 6) AS spread,
 round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    x = "o_totalprice"
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    q = quantiles(j, {"a": (x, 0.1), "med": (x, 0.5), "b": (x, 0.9)}, ["c_mktsegment"])
    g = j.groupBy("c_mktsegment").agg(F.count(N).alias("n"), rnd(F.avg(x), 6).alias("mean"), rnd(F.stddev(x) / F.avg(x), 6).alias("cv")).join(q, "c_mktsegment")
    return g.select("c_mktsegment", "n", "mean", rnd("med", 6).alias("med"), rnd(F.col("b") - F.col("a"), 6).alias("spread"), "cv")


@query("n11_seasonality", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS s FROM orders GROUP BY 1),
 x AS (SELECT day, s, avg(s) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7, avg(s) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma30, lag(s, 7) OVER (ORDER BY day) AS wk FROM d)
 SELECT day, round(ma7, 4) AS ma7, round(ma30, 4) AS ma30, round((s - wk) / nullif(wk, 0), 6) AS wow, CASE WHEN ma7 > ma30 * 1.05 THEN 'up' WHEN ma7 < ma30 * 0.95 THEN 'down' ELSE 'flat' END AS trend, extract(dow FROM day) AS dow FROM x""")
def _(t):
    d = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("s"))
    w = W.orderBy("day")  # one row for each day
    x = d.select("day", "s", F.avg("s").over(w.rowsBetween(-6, 0)).alias("ma7"), F.avg("s").over(w.rowsBetween(-29, 0)).alias("ma30"), F.lag("s", 7).over(w).alias("wk"))
    trend = F.when(F.col("ma7") > F.col("ma30") * 1.05, "up").when(F.col("ma7") < F.col("ma30") * 0.95, "down").otherwise("flat")
    return x.select("day", rnd("ma7", 4).alias("ma7"), rnd("ma30", 4).alias("ma30"), rnd(X.safe_div(F.col("s") - F.col("wk"), "wk"), 6).alias("wow"), trend.alias("trend"), X.dow0("day").cast("bigint").alias("dow"))


@query("n12_cohorts", """WITH f AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS cohort FROM orders GROUP BY 1),
 a AS (SELECT f.cohort, date_diff('month', f.cohort, date_trunc('month', o.o_orderdate)) AS age, count(DISTINCT o.o_custkey) AS n FROM orders o JOIN f ON o.o_custkey = f.o_custkey GROUP BY 1, 2),
 z AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1) SELECT a.cohort, a.age, a.n, round(a.n * 1.0 / z.size, 6) AS retention FROM a JOIN z USING (cohort)""")
def _(t):
    first = F.min("o_orderdate").over(W.partitionBy("o_custkey"))
    o = t.orders.select("o_custkey", "o_orderdate", month(first).alias("cohort"))
    a = o.groupBy("cohort", X.month_diff("o_orderdate", "cohort").cast("bigint").alias("age")).agg(F.countDistinct("o_custkey").alias("n"))
    size = o.groupBy("cohort").agg(F.countDistinct("o_custkey").alias("size"))
    return a.join(size, "cohort").select("cohort", "age", "n", rnd(F.col("n") / F.col("size"), 6).alias("retention"))


@query("n13_anomalies", """WITH g AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders), c AS (SELECT o_custkey, avg(o_totalprice) AS cm, stddev_samp(o_totalprice) AS cs, count(*) AS n FROM orders GROUP BY 1)
 SELECT count(*) FILTER (WHERE abs(o_totalprice - m) > 3 * s) AS global_n, count(*) FILTER (WHERE n >= 3 AND abs(o_totalprice - cm) > 2 * cs) AS customer_n, count(*) AS n FROM orders JOIN c USING (o_custkey), g""")
def _(t):
    g = t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev("o_totalprice").alias("s"))
    w, x = W.partitionBy("o_custkey"), F.col("o_totalprice")
    o = t.orders.select("o_totalprice", F.avg(x).over(w).alias("cm"), F.stddev(x).over(w).alias("cs"), F.count(N).over(w).alias("k")).crossJoin(F.broadcast(g))
    return o.agg(F.count_if(F.abs(x - F.col("m")) > 3 * F.col("s")).alias("global_n"), F.count_if((F.col("k") >= 3) & (F.abs(x - F.col("cm")) > 2 * F.col("cs"))).alias("customer_n"), F.count(N).alias("n"))


@query("n14_basket", """WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, count(*) AS n, round(count(*) * 1.0 / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 8) AS support FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2""")
def _(t):
    # pairs of brands inside one order: at most (number of brands)^2 a basket
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("s"))
    total = b.agg(F.count(N).alias("total"))
    pairs = b.select(F.explode("s").alias("brand_a"), "s").select("brand_a", F.explode("s").alias("brand_b")).filter("brand_a < brand_b")
    return pairs.groupBy("brand_a", "brand_b").agg(F.count(N).alias("n")).crossJoin(F.broadcast(total)).select("brand_a", "brand_b", "n", rnd(F.col("n") / F.col("total"), 8).alias("support"))


@query("n15_customer_features", """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 7) AS mean, count(DISTINCT o_orderpriority) AS kinds, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span,
 round(count(*) / nullif(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)), 0), 8) AS per_day, CASE WHEN sum(o_totalprice) > 3000000 THEN 'high' ELSE 'normal' END AS class FROM orders GROUP BY 1""")
def _(t):
    span = F.datediff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))).cast("bigint")
    s = F.sum("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(
        F.count(N).alias("n"), rnd(s, 2).alias("total"), rnd(F.avg("o_totalprice")).alias("mean"), F.countDistinct("o_orderpriority").alias("kinds"), span.alias("span"), rnd(X.safe_div(F.count(N), span), 8).alias("per_day"),
        F.when(s > 3000000, "high").otherwise("normal").alias("class"),
    )


@query("n16_ml_table", """WITH f AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
 SELECT c_custkey, n, round(mean, 7) AS mean, round(c_acctbal / mean, 8) AS rel, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS target FROM customer JOIN f ON c_custkey = o_custkey WHERE n IS NOT NULL AND c_acctbal IS NOT NULL""")
def _(t):
    f = t.orders.groupBy("o_custkey").agg(F.count(N).alias("n"), F.avg("o_totalprice").alias("m"))
    j = t.customer.filter("c_acctbal IS NOT NULL").join(f, F.col("c_custkey") == F.col("o_custkey"))
    return j.select("c_custkey", "n", rnd("m").alias("mean"), rnd(F.col("c_acctbal") / F.col("m"), 8).alias("rel"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("target"))


@query("n17_score_by_segment", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal / 10000), 8) AS mean, round(max(c_acctbal / 10000), 6) AS hi FROM customer GROUP BY 1")
def _(t):
    s = F.col("c_acctbal") / 10000
    return t.customer.groupBy("c_mktsegment").agg(F.count(N).alias("n"), rnd(F.avg(s), 8).alias("mean"), rnd(F.max(s), 6).alias("hi"))


@query("n18_filter_group_having", "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 8) AS mean FROM part WHERE p_size > 10 GROUP BY 1, 2 HAVING count(*) > 2")
def _(t):
    return t.part.filter("p_size > 10").groupBy("p_brand", "p_type").agg(F.count(N).alias("n"), rnd(F.avg("p_retailprice"), 8).alias("mean")).filter("n > 2").orderBy("p_brand", F.desc("mean"))


@query("n19_window_top10", """SELECT p_partkey, p_brand, r, round(gap, 6) AS gap, round(share, 8) AS share, before FROM (SELECT p_partkey, p_brand, row_number() OVER w AS r, p_retailprice - avg(p_retailprice) OVER b AS gap,
 p_retailprice / sum(p_retailprice) OVER b AS share, lag(p_retailprice) OVER w AS before FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey), b AS (PARTITION BY p_brand)) WHERE r <= 10""")
def _(t):
    b = W.partitionBy("p_brand")
    w = b.orderBy(F.desc("p_retailprice"), "p_partkey")
    x = F.col("p_retailprice")
    return t.part.select(
        "p_partkey", "p_brand", F.row_number().over(w).cast("bigint").alias("r"), rnd(x - F.avg(x).over(b), 6).alias("gap"), rnd(x / F.sum(x).over(b), 8).alias("share"), F.lag(x).over(w).alias("before")
    ).filter("r <= 10")


@query("n20_conditional_shares", "SELECT n_regionkey, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) / sum(c_acctbal), 8) AS building, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 8) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    b = F.col("c_acctbal")
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_regionkey").agg(rnd(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", b).otherwise(0)) / F.sum(b), 8).alias("building"), rnd(F.avg((b < 0).cast("double")), 8).alias("negative"))


@query("n21_month_above_mean", "SELECT date_trunc('month', o_orderdate) AS mon, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    m = t.orders.agg(F.avg("o_totalprice").alias("m"))
    return t.orders.crossJoin(F.broadcast(m)).groupBy(month("o_orderdate").alias("mon"), (F.col("o_totalprice") > F.col("m")).alias("above")).agg(F.count(N).alias("n"))


@query("n22_risk_features", """SELECT event_id, count(*) OVER h AS n_hour, round(sum(value) OVER d, 6) AS s_day, round(avg(value) OVER d, 7) AS m_day, round(stddev_samp(value) OVER k, 7) AS sd_week, round(coalesce(avg(value) OVER b, 0), 7) AS mean_before,
 round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 3600000000.0, 24), 7) AS gap_hours, extract(hour FROM ts) AS hour, extract(dow FROM ts) IN (0, 6) AS weekend, round(sin(2 * pi() * extract(hour FROM ts) / 24), 7) AS hour_sin,
 CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 50 THEN 'mid' WHEN value > 50 AND value <= 1000000 THEN 'high' END AS band, CAST(floor(value) AS BIGINT) % 10 = 0 AS round_amount
 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW),
 k AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    from larkspur.operators.fraud import risk_features

    return risk_features(t.events)


@query("n23_one_hot_build", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_o, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 7) AS z,
 count(*) OVER (PARTITION BY o_custkey) AS n_customer, CASE WHEN extract(dow FROM o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS weekend FROM orders""")
def _(t):
    g = t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev("o_totalprice").alias("s"))
    one = lambda c: F.when(c, 1).otherwise(0)
    return t.orders.crossJoin(F.broadcast(g)).select(
        "o_orderkey", one(F.col("o_orderstatus") == "F").alias("is_f"), one(F.col("o_orderstatus") == "O").alias("is_o"), rnd((F.col("o_totalprice") - F.col("m")) / F.col("s")).alias("z"),
        F.count(N).over(W.partitionBy("o_custkey")).alias("n_customer"), one(X.dow0("o_orderdate").isin(0, 6)).alias("weekend"),
    )


@query("n24_clean_and_band", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'rich' END AS band, c_mktsegment, count(*) AS n FROM (SELECT DISTINCT * FROM customer WHERE c_custkey IS NOT NULL AND c_acctbal IS NOT NULL) GROUP BY 1, 2")
def _(t):
    b = F.col("c_acctbal")
    c = t.customer.dropna(subset=["c_custkey", "c_acctbal"]).dropDuplicates()
    return c.groupBy(F.when(b < 0, "debt").when(b < 5000, "mid").otherwise("rich").alias("band"), "c_mktsegment").agg(F.count(N).alias("n"))


@query("n25_customer_view", "SELECT c_custkey, c_name, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def _(t):
    s = t.orders.groupBy("o_custkey").agg(F.count(N).alias("k"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", zero("k").alias("n"), zero("f").alias("n_f"), rnd(zero("s"), 2).alias("total"), "last")


@query("n26_rate_by_group", """SELECT extract(hour FROM ts) AS hour, extract(dow FROM ts) IN (0, 6) AS weekend, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 8) AS rate FROM events GROUP BY 1, 2""")
def _(t):
    return t.events.groupBy(F.hour("ts").cast("bigint").alias("hour"), X.dow0("ts").isin(0, 6).alias("weekend")).agg(F.count(N).alias("n"), rnd(F.avg((F.col("event_type") == "error").cast("double")), 8).alias("rate"))


@query("n27_top_decile_lift", """SELECT round((count(*) FILTER (WHERE d = 1 AND y) / count(*) FILTER (WHERE d = 1)) / (count(*) FILTER (WHERE y) / count(*)), 8) AS lift FROM
 (SELECT event_type = 'error' AS y, CASE WHEN row_number() OVER (ORDER BY value DESC, event_id) * 10 <= count(*) OVER () THEN 1 ELSE 2 END AS d FROM events)""")
def _(t):
    from larkspur.operators.stats import ranked

    y, top = F.col("y"), F.col("rank") * 10 <= F.col("n_all")
    r = ranked(t.events.select("event_id", "value", (F.col("event_type") == "error").alias("y")), F.desc("value"), F.asc("event_id"))
    return r.agg(rnd((F.count_if(top & y) / F.count_if(top)) / (F.count_if(y) / F.count(N)), 8).alias("lift"))


@query("n28_day_and_target", "SELECT event_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) AND event_type IS NOT NULL")
def _(t):
    day = t.events.agg(F.to_date(F.min("ts")).alias("day"))
    return t.events.filter("event_type IS NOT NULL").crossJoin(F.broadcast(day)).filter(F.to_date("ts") == F.col("day")).select("event_id", "value")


@query("n29_parameterised", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def _(t):
    return t._spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= CAST(:a AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:b AS TIMESTAMP_NTZ)",
        args={"a": "1995-01-01", "b": "1996-01-01"}, orders=t.orders,
    )
