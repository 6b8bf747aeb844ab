"""Queries of preparation, profiling, drift, metrics, fairness, causal effects, neighbours, explanation and sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.functions.expr import rnd
from larkspur.operators import causal, explain, fairness, fraud, graph, neighbors, prepare, profile, sampling, stats
from larkspur.operators.quantiles import quantiles

from .registry import query, type_sql

N = "*"


def rounded(df, digits=6):
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[rnd(f"`{c}`", digits).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def scored(t):
    """Scores and labels: event_id, user_id, ts, score in [0, 1), y."""
    v = F.col("value")
    return t.events.select("event_id", "user_id", "ts", "value", (v / (1 + v)).alias("score"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))


SCORED = "(SELECT event_id, user_id, ts, value, value / (1 + value) AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"


def halves(t):
    """Two periods of prices: reference and current."""
    early = F.col("o_orderkey") % 3 != 0
    return t.orders.filter(early), t.orders.filter(~early)


REF, CUR = "(SELECT o_totalprice AS x, o_orderpriority AS k FROM orders WHERE o_orderkey % 3 <> 0)", "(SELECT o_totalprice AS x, o_orderpriority AS k FROM orders WHERE o_orderkey % 3 = 0)"

# ---------------------------------------------------------------- preparation


@query("c01_standard", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def _(t):
    return rounded(prepare.standard_scaler(t.part, ["p_retailprice"]).transform(t.part.select("p_partkey", "p_retailprice")))


@query("c02_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def _(t):
    return rounded(prepare.minmax_scaler(t.part, ["p_retailprice"]).transform(t.part.select("p_partkey", "p_retailprice")))


@query("c03_robust", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey, round((c_acctbal - m) / (b - a), 6) AS c_acctbal FROM customer, q")
def _(t):
    return rounded(prepare.robust_scaler(t.customer, ["c_acctbal"]).transform(t.customer.select("c_custkey", "c_acctbal")))


@query("c04_power", """WITH l AS (SELECT -2.0::DOUBLE + 6.0::DOUBLE * i / 60 AS p FROM range(61) t(i)), y AS (SELECT p, p_partkey, p_retailprice AS x, CASE WHEN p = 0 THEN ln(1 + p_retailprice) ELSE ((1 + p_retailprice) ** p - 1) / p END AS y FROM part, l),
 b AS (SELECT p, -0.5 * ln(greatest(var_pop(y), 1e-300)) + (p - 1) * avg(ln(1 + x)) AS likelihood FROM y GROUP BY 1), w AS (SELECT p FROM b ORDER BY likelihood DESC, abs(p - 1), p DESC LIMIT 1)
 SELECT p_partkey, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS p_retailprice FROM y JOIN w USING (p)""")
def _(t):
    return rounded(prepare.power_transformer(t.part, ["p_retailprice"]).transform(t.part.select("p_partkey", "p_retailprice")))


@query("c05_one_hot", "SELECT o_orderkey, 'o_orderpriority_' || s AS dummy, (o_orderpriority = s)::INTEGER AS value FROM orders, (SELECT DISTINCT o_orderpriority AS s FROM orders) WHERE s > (SELECT min(o_orderpriority) FROM orders)")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority")
    made = prepare.OneHot(o, "o_orderpriority", drop_first=True).transform(o).drop("o_orderpriority")
    return made.unpivot("o_orderkey", [f"`{c}`" for c in made.columns[1:]], "dummy", "value")


@query("c06_target", """WITH g AS (SELECT avg(c_acctbal) AS m FROM customer), k AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS a FROM customer GROUP BY 1)
 SELECT c_custkey, round((n * a + m) / (n + 1), 6) AS c_mktsegment_target FROM customer JOIN k USING (c_mktsegment), g""")
def _(t):
    return rounded(prepare.target_encode(t.customer, t.customer, "c_mktsegment", "c_acctbal").select("c_custkey", "c_mktsegment_target"))


@query("c07_frequency", "SELECT c_custkey, round(count(*) OVER (PARTITION BY c_nationkey) * 1.0 / count(*) OVER (), 8) AS c_nationkey_freq FROM customer")
def _(t):
    return rounded(prepare.frequency_encode(t.customer, t.customer, "c_nationkey").select("c_custkey", "c_nationkey_freq"), 8)


@query("c08_label", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type_label FROM part")
def _(t):
    return prepare.label_encode(t.part.select("p_partkey", "p_type"), "p_type").select("p_partkey", F.col("p_type_label").cast("bigint").alias("p_type_label"))


@query("c10_impute", "WITH m AS (SELECT median(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END) AS m FROM customer) SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, m) AS x FROM customer, m")
def _(t):
    holes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"))
    return prepare.imputer(holes, ["x"], "median").transform(holes)


@query("c11_knn_impute", """WITH z AS (SELECT p_partkey AS k, (ln(p_retailprice) - avg(ln(p_retailprice)) OVER ()) / stddev_samp(ln(p_retailprice)) OVER () AS z, CASE WHEN p_partkey % 50 <> 0 THEN p_size::DOUBLE END AS x, ln(p_retailprice) AS log_price FROM part),
 n AS (SELECT a.k, b.x, row_number() OVER (PARTITION BY a.k ORDER BY abs(a.z - b.z), b.k) AS place FROM z a JOIN z b ON a.x IS NULL AND b.x IS NOT NULL), f AS (SELECT k, avg(x) AS fill FROM n WHERE place <= 5 GROUP BY 1)
 SELECT k AS p_partkey, round(log_price, 6) AS log_price, round(coalesce(x, fill), 6) AS x FROM z LEFT JOIN f USING (k)""")
def _(t):
    p = t.part.select("p_partkey", F.log("p_retailprice").alias("log_price"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_size").cast("double")).alias("x"))
    return rounded(neighbors.knn_impute(p, "p_partkey", "x", ["log_price"]))


@query("c13_sparse_columns", "SELECT doc_id FROM labels")
def _(t):
    return prepare.drop_sparse_columns(t.labels.select("doc_id", F.when(F.col("doc_id") < 0, 1).alias("none")), 0.5)


@query("c14_iqr_cap", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) AS o_totalprice FROM orders, q""")
def _(t):
    return rounded(prepare.outliers_iqr(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], 0.5))


@query("c14_iqr_remove", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey FROM customer, q WHERE c_acctbal BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)")
def _(t):
    return prepare.outliers_iqr(t.customer, ["c_acctbal"], 0.2, "remove").select("c_custkey")


@query("c15_clip", "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events) SELECT event_id, round(least(greatest(value, a), b), 6) AS value FROM events, q")
def _(t):
    return rounded(prepare.clip_percentiles(t.events.select("event_id", "value"), ["value"]))


@query("c16_parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return prepare.parse_dates(t.orders.select("o_orderkey", text.alias("day")), ["day"]).select("o_orderkey", F.to_date("day").alias("day"))


@query("c17_correlated", """WITH l AS (SELECT l_quantity AS q, 2 * l_quantity + 1 AS q2, l_discount AS d, l_extendedprice AS e FROM lineitem) SELECT 'q' AS kept UNION ALL SELECT 'q2' FROM l HAVING abs(corr(q, q2)) <= 0.95 UNION ALL SELECT 'd' FROM l HAVING greatest(abs(corr(q, d)), abs(corr(q2, d))) <= 0.95
 UNION ALL SELECT 'e' FROM l HAVING greatest(abs(corr(q, e)), abs(corr(q2, e)), abs(corr(d, e))) <= 0.95""")
def _(t):
    l = t.lineitem.select(F.col("l_quantity").alias("q"), (2 * F.col("l_quantity") + 1).alias("q2"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("e"))
    kept = prepare.drop_correlated(l, ["q", "q2", "d", "e"])
    return t._spark.createDataFrame([(c,) for c in kept], "kept string")


@query("c18_variance", "SELECT 'l_quantity' AS kept FROM lineitem HAVING var_pop(l_quantity) > 0.01 UNION ALL SELECT 'flat' FROM lineitem HAVING var_pop(l_discount * 0.001) > 0.01 UNION ALL SELECT 'l_tax' FROM lineitem HAVING var_pop(l_tax) > 0.01 UNION ALL SELECT 'l_extendedprice' FROM lineitem HAVING var_pop(l_extendedprice) > 0.01")
def _(t):
    l = t.lineitem.select("l_quantity", (F.col("l_discount") * 0.001).alias("flat"), "l_tax", "l_extendedprice")
    return t._spark.createDataFrame([(c,) for c in prepare.variance_threshold(l, l.columns)], "kept string")


@query("c19_polynomial", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) AS qq, round(l_quantity * l_discount, 6) AS qd FROM lineitem")
def _(t):
    p = prepare.polynomial(t.lineitem, ["l_quantity", "l_discount"])
    return p.select("l_orderkey", "l_linenumber", rnd("`l_quantity*l_quantity`", 4).alias("qq"), rnd("`l_quantity*l_discount`", 6).alias("qd"))


@query("c20_mutual_information", """WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS x, l_returnflag AS y FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, l_returnflag FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_returnflag FROM lineitem),
 b AS (SELECT feature, y, least(15, floor((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 16)) AS bin FROM l WINDOW w AS (PARTITION BY feature)), c AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL),
 s AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
 SELECT feature, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nb::DOUBLE * ny))), 6) AS mi FROM s GROUP BY 1""")
def _(t):
    return rounded(prepare.mutual_information(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"))


@query("c22_calendar", """SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS month_end, extract(month FROM o_orderdate) % 3 = 0 AND last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS quarter_end,
 round(sin(2 * pi() * extract(month FROM o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * extract(month FROM o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    sin, cos = X.cyclic(F.month(d), 12)
    return t.orders.select("o_orderkey", (F.last_day(d) == d).alias("month_end"), ((F.month(d) % 3 == 0) & (F.last_day(d) == d)).alias("quarter_end"), rnd(sin, 6).alias("month_sin"), rnd(cos, 6).alias("month_cos"))


@query("c24_customer_z", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_samp(o_totalprice) OVER w, 0), 6) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", rnd(X.safe_div(x - F.avg(x).over(w), F.stddev(x).over(w)), 6).alias("z"))


@query("d11_unit_norm", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS total FROM embeddings")
def _(t):
    u = prepare.unit_norm(t.embeddings, "embedding")
    return u.select("vec_id", rnd(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("d12_ordinal_binary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS rank, (dense_rank() OVER (ORDER BY o_orderpriority) - 1) & 1 AS bit0, ((dense_rank() OVER (ORDER BY o_orderpriority) - 1) >> 1) & 1 AS bit1 FROM orders")
def _(t):
    b = prepare.binary_encode(t.orders, "o_orderpriority", 2)
    return b.select("o_orderkey", prepare.ordinal_encode(F.col("o_orderstatus"), ["O", "P", "F"]).alias("rank"), F.col("o_orderpriority_bit0").cast("bigint").alias("bit0"), F.col("o_orderpriority_bit1").cast("bigint").alias("bit1"))


@query("d16_quantile_bins", """WITH q AS (SELECT [quantile_cont(value, 0.2), quantile_cont(value, 0.4), quantile_cont(value, 0.6), quantile_cont(value, 0.8)] AS e FROM events)
 SELECT len(list_filter(list_distinct(e), lambda x: value > x)) AS bin, count(*) AS n FROM events, q GROUP BY 1""")
def _(t):
    return prepare.quantile_bins(t.events, "value", 5).groupBy(F.col("value_bin").cast("bigint").alias("bin")).agg(F.count(N).alias("n"))


@query("d17_inverse", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    m = prepare.robust_scaler(c, ["c_acctbal"])
    return rounded(m.inverse_transform(m.transform(c)), 4)


# ---------------------------------------------------------------- profiles and expectations


@query("q01_numeric_profile", """SELECT 'c_acctbal' AS "column", count(c_acctbal)::DOUBLE AS n, 0.0::DOUBLE AS null_pct, count(DISTINCT c_acctbal)::DOUBLE AS "unique", round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(stddev_samp(c_acctbal), 6) AS std,
 round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(skewness(c_acctbal), 6) AS skew, round(kurtosis(c_acctbal), 6) AS kurt,
 (SELECT count(*)::DOUBLE FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) WHERE c_acctbal < a - 1.5 * (b - a) OR c_acctbal > b + 1.5 * (b - a)) AS outliers FROM customer""")
def _(t):
    return rounded(profile.numeric_profile(t.customer, ["c_acctbal"]))


@query("q01_text_profile", """SELECT 'c_name' AS "column", count(c_name)::DOUBLE AS n, 0.0::DOUBLE AS null_pct, count(DISTINCT c_name)::DOUBLE AS "unique", min(length(c_name))::DOUBLE AS shortest, max(length(c_name))::DOUBLE AS longest, round(avg(length(c_name)), 6) AS mean_length,
 count(*) FILTER (WHERE trim(c_name) <> c_name)::DOUBLE AS with_blanks, count(*) FILTER (WHERE lower(c_name) <> c_name AND upper(c_name) <> c_name)::DOUBLE AS mixed_case FROM customer""")
def _(t):
    return rounded(profile.text_profile(t.customer, ["c_name"]))


@query("q01_top_values", """SELECT 'p_type' AS "column", p_type AS value, n, place FROM (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1) WHERE place <= 10""")
def _(t):
    return profile.top_values(t.part, ["p_type"])


_TEXTS = {"a": "(o_orderkey % 200)::VARCHAR", "b": "(o_totalprice + 0.5)::VARCHAR", "c": "strftime(o_orderdate, '%Y-%m-%d')", "d": "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END"}
_TEXTS |= {"e": "o_orderpriority", "f": "(o_orderkey * 1000)::VARCHAR", "g": "'order ' || o_orderkey"}


@query("q02_type_plan", type_sql(_TEXTS, "orders"))
def _(t):
    o = t.orders.select(
        (F.col("o_orderkey") % 200).cast("string").alias("a"), (F.col("o_totalprice") + 0.5).cast("string").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("d"),
        F.col("o_orderpriority").alias("e"), (F.col("o_orderkey") * 1000).cast("string").alias("f"), F.concat(F.lit("order "), "o_orderkey").alias("g"),
    )
    return profile.type_plan(o, o.columns)


@query("q04_quality", """WITH o AS (SELECT nullif(o_orderstatus, 'F') AS s, o_orderpriority AS p, CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
 g AS (SELECT count(*) AS rows, (avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN p IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN d IS NULL THEN 1.0 ELSE 0 END)) / 3 * 100 AS null_pct,
  (avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0 END) > 0.1)::INT + (avg(CASE WHEN p IS NULL THEN 1.0 ELSE 0 END) > 0.1)::INT + (avg(CASE WHEN d IS NULL THEN 1.0 ELSE 0 END) > 0.1)::INT AS issues,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT s, p, d FROM o))) * 100.0 / count(*) AS duplicate_pct FROM o)
 SELECT rows, round(null_pct, 6)::DOUBLE AS null_pct, round(duplicate_pct, 6)::DOUBLE AS duplicate_pct, issues,
  round(100 - least(2 * null_pct, 30) - least(3 * duplicate_pct, 20) - least(2 * issues, 30), 6)::DOUBLE AS score FROM g""")
def _(t):
    day = F.when(F.col("o_orderkey") % 20 != 0, F.to_date("o_orderdate"))
    return rounded(profile.table_quality(t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.col("o_orderpriority").alias("p"), day.alias("d"))))


@query("q05_expectations", """SELECT unnest(['row count', 'o_custkey not null', 'o_totalprice between', 'o_orderstatus in set', 'o_orderpriority length']) AS expectation,
 unnest([(SELECT CASE WHEN count(*) >= 1 THEN 1.0 ELSE 0 END FROM orders), (SELECT avg(CASE WHEN o_custkey IS NOT NULL THEN 1.0 ELSE 0 END) FROM orders), (SELECT round(avg(CASE WHEN o_totalprice BETWEEN 1000 AND 300000 THEN 1.0 ELSE 0 END), 6) FROM orders),
 (SELECT round(avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0 END), 6) FROM orders), (SELECT round(avg(CASE WHEN length(o_orderpriority) BETWEEN 1 AND 8 THEN 1.0 ELSE 0 END), 6) FROM orders)])::DOUBLE AS share""")
def _(t):
    e = [profile.row_count(), profile.not_null("o_custkey"), profile.between("o_totalprice", 1000, 300000), profile.in_set("o_orderstatus", ["F", "O"]), profile.length_between("o_orderpriority", 1, 8)]
    return rounded(profile.validate(t.orders, e).select("expectation", "share"))


@query("q11_summary", """WITH e AS (SELECT 'o_orderkey not null' AS e, avg((o_orderkey IS NOT NULL)::INT) AS share, 1.0 AS least FROM orders UNION ALL SELECT 'o_totalprice between', avg((o_totalprice BETWEEN 1000 AND 300000)::INT), 0.95 FROM orders
 UNION ALL SELECT 'o_totalprice between', avg((o_totalprice BETWEEN 0 AND 100000)::INT), 0.5 FROM orders UNION ALL SELECT 'o_orderstatus in set', avg((o_orderstatus IN ('F', 'O'))::INT), 1.0 FROM orders)
 SELECT count(*) AS total, count(*) FILTER (WHERE share < least) AS failed, avg((share >= least)::INT)::DOUBLE AS success_rate, coalesce(list_sort(list(e) FILTER (WHERE share < least)), []) AS failed_list FROM e""")
def _(t):
    e = [profile.not_null("o_orderkey"), profile.between("o_totalprice", 1000, 300000), profile.between("o_totalprice", 0, 100000, 0.5), profile.in_set("o_orderstatus", ["F", "O"])]
    return profile.validation_summary(profile.validate(t.orders, e))


# ---------------------------------------------------------------- drift and metrics


def _psi_sql(bin_of: str, pre: str, floor: str, post: str = "", total: str = "", ref: str = REF, cur: str = CUR) -> str:
    return f"""WITH r AS (SELECT * FROM {ref}), c AS (SELECT * FROM {cur}), {pre}
 a AS (SELECT {bin_of} AS bin, count(*) * 1.0 / (SELECT count(*) FROM r) AS p FROM r{post} GROUP BY 1), b AS (SELECT {bin_of} AS bin, count(*) * 1.0 / (SELECT count(*) FROM c {total}) AS p FROM c{post} {total} GROUP BY 1)
 SELECT round(sum((greatest(coalesce(b.p, 0), {floor}) - greatest(coalesce(a.p, 0), {floor})) * ln(greatest(coalesce(b.p, 0), {floor}) / greatest(coalesce(a.p, 0), {floor}))), 6) AS psi FROM a FULL JOIN b USING (bin) WHERE bin IS NOT NULL"""


@query("m01_psi_categorical", _psi_sql("k", "z AS (SELECT 1),", "1e-10"))
def _(t):
    return rounded(stats.psi_categorical(*halves(t), "o_orderpriority"))


WIDTHS = ("greatest(0, least(9, floor((x - lo) / (hi - lo) * 10)))", "z AS (SELECT min(x) AS lo, max(x) AS hi FROM r),", "1e-10", ", z")
DECILES = (
    "CASE WHEN x >= e[1] AND x <= e[11] THEN least(9, len(list_filter(e[2:11], lambda y: x >= y))) END",
    "z AS (SELECT quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM r),", "1e-6", ", z",
)


@query("m02_psi_equal_width", _psi_sql(*WIDTHS))
def _(t):
    return rounded(stats.psi_equal_width(*halves(t), "o_totalprice"))


@query("m03_psi_quantile", _psi_sql(*DECILES))
def _(t):
    return rounded(stats.psi_quantile(*halves(t), "o_totalprice"))


@query("m06_ks", f"""WITH s AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM {SCORED} GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY score) / sum(p) OVER () AS f, sum(q) OVER (ORDER BY score) / sum(q) OVER () AS g FROM s) SELECT round(max(abs(f - g)), 6) AS ks FROM c""")
def _(t):
    return rounded(stats.ranking_metrics(scored(t), "score", "y").select("ks"))


@query("m07_auc", f"""WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {SCORED}) SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc,
 round(2 * (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) - 1, 6) AS gini FROM r""")
def _(t):
    return rounded(stats.ranking_metrics(scored(t), "score", "y").select("auc", "gini"))


@query("m08_average_precision", f"""WITH s AS (SELECT score, sum(y) AS p, count(*) AS n FROM {SCORED} GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS n, sum(p) OVER () AS t FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * 1.0 / t * tp / n), 6) AS ap FROM c""")
def _(t):
    return rounded(stats.ranking_metrics(scored(t), "score", "y").select("ap"))


@query("m09_lift", f"""WITH r AS (SELECT y, greatest(1, ceil((row_number() OVER (ORDER BY score DESC, event_id) - 1) * 10.0 / (count(*) OVER () - 1)))::BIGINT AS decile FROM {SCORED}), g AS (SELECT decile, count(*) AS rows, sum(y)::BIGINT AS positives FROM r GROUP BY 1)
 SELECT decile, rows, positives, round(positives * 1.0 / rows, 6) AS rate, (sum(rows) OVER w)::BIGINT AS cum_rows, (sum(positives) OVER w)::BIGINT AS cum_positives, round((sum(positives) OVER w / sum(rows) OVER w) / (sum(positives) OVER () / sum(rows) OVER ()), 6) AS lift,
 round(sum(positives) OVER w / sum(positives) OVER (), 6) AS gain FROM g WINDOW w AS (ORDER BY decile)""")
def _(t):
    return rounded(stats.deciles(scored(t), "score", "y", "event_id"))


@query("m11_confusion", f"""WITH g AS (SELECT y, CASE WHEN score >= 0.95 THEN 1 ELSE 0 END AS z FROM {SCORED}), k AS (SELECT k, sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS a, sum(CASE WHEN z = k THEN 1 ELSE 0 END) AS s, sum(CASE WHEN y = k AND z = k THEN 1 ELSE 0 END) AS h FROM g, (SELECT unnest([0, 1]) AS k) GROUP BY 1),
 m AS (SELECT *, coalesce(h / nullif(s, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m)
 SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * a) / sum(a), 6) AS weighted_precision, round(sum(r * a) / sum(a), 6) AS weighted_recall, round(sum(f * a) / sum(a), 6) AS weighted_f1 FROM f""")
def _(t):
    return rounded(stats.confusion_metrics(scored(t).withColumn("z", F.when(F.col("score") >= 0.95, 1).otherwise(0)), "y", "z"))


@query("m12_brier_log_loss", f"SELECT round(avg((score - y) * (score - y)), 6) AS brier, round(avg(-(y * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM {SCORED}")
def _(t):
    return rounded(stats.probability_metrics(scored(t), "score", "y"))


@query("m13_thresholds", f"""WITH h AS (SELECT least(100, floor(round(score * 100, 9)))::INTEGER AS b, y FROM {SCORED}), g AS (SELECT t, count(*) FILTER (WHERE b >= t AND y = 1) AS tp, count(*) FILTER (WHERE b >= t AND y = 0) AS fp, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM h, (SELECT unnest(range(0, 101)) AS t) GROUP BY 1),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(p, 0), 0) AS re FROM g)
 SELECT round(t / 100.0, 6)::DOUBLE AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round((tp + q - fp) / (p + q), 6) AS accuracy, (tp * 100.0 - fp * 10.0)::DOUBLE AS business_value FROM m""")
def _(t):
    return rounded(stats.threshold_sweep(scored(t), "score", "y"))


@query("m14_regression", """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS z FROM lineitem) SELECT round(avg((y - z) * (y - z)), 2) AS mse, round(sqrt(avg((y - z) * (y - z))), 6) AS rmse, round(avg(abs(y - z)), 6) AS mae, round(1 - avg((y - z) * (y - z)) / var_pop(y), 6) AS r2, round(avg(abs((y - z) / (abs(y) + 1e-8))) * 100, 6) AS mape FROM d""")
def _(t):
    m = stats.regression_metrics(t.lineitem.withColumn("z", F.col("l_quantity") * 1500), "l_extendedprice", "z")
    return rounded(m).withColumn("mse", rnd("mse", 2))


@query("m15_calibration", f"""WITH b AS (SELECT ceil(round(score * 10, 9))::INTEGER AS bin, count(*) AS n, avg(score) AS s, avg(y) AS r FROM {SCORED} GROUP BY 1 HAVING bin BETWEEN 1 AND 10), a AS (SELECT count(*) AS n, avg(y) AS base FROM {SCORED})
 SELECT round(sum(abs(r - s) * b.n / a.n), 6) AS ece, round(max(abs(r - s)), 6) AS mce, round(sum(b.n * 1.0 / a.n * (r - s) * (r - s)), 6) AS reliability, round(sum(b.n * 1.0 / a.n * (r - base) * (r - base)), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM b, a""")
def _(t):
    return rounded(stats.calibration_errors(scored(t), "score", "y"))


@query("m18_mcnemar", f"""WITH g AS (SELECT count(*) FILTER (WHERE (score >= 0.9) = (y = 1) AND NOT ((score >= 0.98) = (y = 1))) AS b, count(*) FILTER (WHERE NOT ((score >= 0.9) = (y = 1)) AND (score >= 0.98) = (y = 1)) AS c FROM {SCORED}) SELECT b, c, round((abs(b - c) - 1.0) * (abs(b - c) - 1.0) / nullif(b + c, 0), 6)::DOUBLE AS statistic FROM g""")
def _(t):
    y = F.col("y") == 1
    return rounded(stats.mcnemar(scored(t), (F.col("score") >= 0.9) == y, (F.col("score") >= 0.98) == y))


@query("m19_mann_whitney", f"""WITH r AS (SELECT y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM {SCORED}), u AS (SELECT sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0 AS u, sum(y) AS a, sum(1 - y) AS b FROM r)
 SELECT round(u, 3)::DOUBLE AS u, round((u - a * b / 2.0) / sqrt(a * b * (a + b + 1) / 12.0), 6) AS z FROM u""")
def _(t):
    m = stats.mann_whitney(scored(t), "value", "y")
    return m.select(rnd("u", 3).alias("u"), rnd("z", 6).alias("z"))


@query("m19_paired_t", "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 5) AS t, count(*) - 1 AS degrees FROM lineitem")
def _(t):
    return rounded(stats.paired_t(t.lineitem, "l_discount", "l_tax"), 5)


@query("m20_chi_square", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), y AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1), z AS (SELECT sum(o) AS t FROM c)
 SELECT round(sum((coalesce(o, 0) - ra * rb / t) * (coalesce(o, 0) - ra * rb / t) / (ra * rb / t)), 6) AS statistic, (count(DISTINCT x.a) - 1) * (count(DISTINCT y.b) - 1) AS degrees, max(t)::BIGINT AS n FROM x CROSS JOIN y CROSS JOIN z LEFT JOIN c ON c.a = x.a AND c.b = y.b""")
def _(t):
    return rounded(stats.chi_square(t.orders, "o_orderstatus", "o_orderpriority"))


@query("m21_correlation_test", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice))), 3) AS t FROM lineitem")
def _(t):
    r = F.corr("l_quantity", "l_extendedprice")
    return t.lineitem.agg(rnd(r, 6).alias("r"), rnd(r * F.sqrt((F.count(N) - 2) / (1 - r * r)), 3).alias("t"))


@query("m22_js", f"""WITH r AS (SELECT x FROM {REF}), c AS (SELECT x FROM {CUR}), z AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT x FROM r UNION ALL SELECT x FROM c)), a AS (SELECT least(49, floor((x - lo) / (hi - lo) * 50)) AS b, count(*) * 1.0 / (SELECT count(*) FROM r) AS p FROM r, z GROUP BY 1),
 d AS (SELECT least(49, floor((x - lo) / (hi - lo) * 50)) AS b, count(*) * 1.0 / (SELECT count(*) FROM c) AS q FROM c, z GROUP BY 1), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN d USING (b))
 SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS js FROM j""")
def _(t):
    return rounded(stats.js_distance(*halves(t), "o_totalprice"))


@query("m22_wasserstein", f"""WITH u AS (SELECT x, 1 AS a, 0 AS b FROM {REF} UNION ALL SELECT x, 0, 1 FROM {CUR}), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1), c AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g, lead(x) OVER (ORDER BY x) AS nx FROM g)
 SELECT round(sum(abs(f - g) * (nx - x)), 4) AS wasserstein FROM c""")
def _(t):
    return rounded(stats.wasserstein(*halves(t), "o_totalprice"), 4)


@query("m23_folds", "WITH r AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels) SELECT fold::INTEGER AS fold, quality, count(*) AS n FROM r GROUP BY ALL")
def _(t):
    return sampling.folds(t.labels, "doc_id", "quality").groupBy("fold", "quality").agg(F.count(N).alias("n"))


@query("m24_impact", f"""WITH g AS (SELECT sum(CASE WHEN y = 1 AND score >= 0.95 THEN value ELSE 0 END) AS saved, count(*) FILTER (WHERE y = 0 AND score >= 0.95) * 5.0 AS alarms, sum(CASE WHEN y = 1 AND score < 0.95 THEN value ELSE 0 END) AS missed FROM {SCORED})
 SELECT round(saved, 4) AS saved, alarms::DOUBLE AS alarms, round(missed, 4) AS missed, round(saved - alarms - missed, 4) AS net, round(saved / nullif(alarms, 0) - 1, 6) AS roi FROM g""")
def _(t):
    m = stats.business_impact(scored(t), F.col("y") == 1, F.col("score") >= 0.95, F.col("value"))
    return m.select(*[rnd(c, 4).alias(c) for c in ("saved", "alarms", "missed", "net")], rnd("roi", 6).alias("roi"))


@query("d01_precision_at_k", f"WITH c AS (SELECT quantile_cont(score, 0.99) AS c FROM {SCORED}) SELECT round(avg(y), 6) AS precision_at_1pct, count(*) AS n FROM {SCORED}, c WHERE score >= c")
def _(t):
    s = scored(t)
    return s.crossJoin(F.broadcast(quantiles(s, {"c": ("score", 0.99)}))).filter("score >= c").agg(rnd(F.avg("y"), 6).alias("precision_at_1pct"), F.count(N).alias("n"))


@query("d03_psi_density", f"""WITH r AS (SELECT x FROM {REF}), z AS (SELECT min(x) AS lo, max(x) AS hi FROM r), c AS (SELECT x FROM {CUR}, z WHERE x BETWEEN lo AND hi), a AS (SELECT least(9, floor((x - lo) / (hi - lo) * 10)) AS b, count(*) / ((SELECT count(*) FROM r) * (any_value(hi) - any_value(lo)) / 10) AS p FROM r, z GROUP BY 1),
 d AS (SELECT least(9, floor((x - lo) / (hi - lo) * 10)) AS b, count(*) / ((SELECT count(*) FROM c) * (any_value(hi) - any_value(lo)) / 10) AS q FROM c, z GROUP BY 1), j AS (SELECT greatest(coalesce(p, 0), 1e-4) AS p, greatest(coalesce(q, 0), 1e-4) AS q FROM a FULL JOIN d USING (b)) SELECT round(sum((q - p) * ln(q / p)), 9) AS psi FROM j""")
def _(t):
    return rounded(stats.psi_density(*halves(t), "o_totalprice"), 9)


@query("d05_lags", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS s FROM events GROUP BY 1) SELECT day, round(lag(s, 1) OVER w, 4) AS lag1, round(lag(s, 7) OVER w, 4) AS lag7, round(avg(s) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) AS roll7 FROM d WINDOW w AS (ORDER BY day)""")
def _(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"))
    w = W.orderBy("day")
    return d.select("day", rnd(F.lag("s", 1).over(w), 4).alias("lag1"), rnd(F.lag("s", 7).over(w), 4).alias("lag7"), rnd(F.avg("s").over(w.rowsBetween(-6, 0)), 5).alias("roll7"))


@query("d06_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20)


@query("d19_pareto", """WITH s AS (SELECT p_brand, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1) SELECT p_brand FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.price <= a.price AND b.size >= a.size AND (b.price < a.price OR b.size > a.size))""")
def _(t):
    s = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    a, b = s.alias("a"), s.alias("b")
    better = (F.col("b.price") <= F.col("a.price")) & (F.col("b.size") >= F.col("a.size")) & ((F.col("b.price") < F.col("a.price")) | (F.col("b.size") > F.col("a.size")))
    return a.join(b, better, "left_anti").select("p_brand")


# ---------------------------------------------------------------- risk, graph, fairness, causal, neighbours, explanation

EDGES = "(SELECT o_custkey AS u, 1000000000 + l_suppkey AS v, sum(l_extendedprice) AS weight, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def edges(t):
    """Customers and suppliers as accounts, their trade as transfers."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"), "l_extendedprice")
    return graph.undirected(j, "a", "b", "l_extendedprice")


def nations(t):
    """Nations as accounts: who buys from whom, either way."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.undirected(j, "c_nationkey", "s_nationkey", "l_extendedprice")


NATIONS = "(SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def orders_of(t):
    """Customers and their orders as one graph: a component for each customer."""
    return graph.undirected(t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1_000_000_000).alias("b")), "a", "b")


@query("g01_risk_level", f"SELECT event_id, CAST(floor(score * 100) AS INTEGER) AS points, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'medium' WHEN score < 0.8 THEN 'high' ELSE 'critical' END AS level, CASE WHEN score < 0.3 THEN 'approve' WHEN score < 0.6 THEN 'monitor' WHEN score < 0.8 THEN 'review' ELSE 'block' END AS action FROM {SCORED}")
def _(t):
    return fraud.with_risk(scored(t), "score").select("event_id", "points", "level", "action")


@query("g02_contributions", """WITH f AS (SELECT p_partkey, unnest(['a', 'b', 'c']) AS feature, unnest([p_size / 3.0, p_retailprice / 300.0, -p_size / 6.0]) AS c FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(c) DESC, feature DESC) AS place, feature, round(c, 6)::DOUBLE AS contribution FROM f QUALIFY place <= 2""")
def _(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"), (-F.col("p_size") / 2).alias("c"))
    return rounded(fraud.contributions(p, "p_partkey", ["a", "b", "c"], top=2).drop("impact"))


@query("g03_anomaly_features", "SELECT event_id, extract(hour FROM ts) AS hour, extract(dow FROM ts) AS dow, extract(dow FROM ts) IN (0, 6) AS weekend, round(ln(1 + value), 7) AS log_amount, round(value / nullif(avg(value) OVER (PARTITION BY user_id), 0), 7) AS to_mean FROM events")
def _(t):
    return fraud.anomaly_features(t.events, "event_id", "user_id", "ts", "value")


@query("g05_z_anomalies", "SELECT event_id FROM (SELECT event_id, abs(value - avg(value) OVER (PARTITION BY event_type)) > 2.5 * stddev_samp(value) OVER (PARTITION BY event_type) AS far FROM events) WHERE far")
def _(t):
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"))
    return t.events.join(g, "event_type").filter(F.abs(F.col("value") - F.col("m")) > 2.5 * F.col("s")).select("event_id")


@query("g06_velocity", "SELECT event_id, user_id, n, CASE WHEN n > 3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2")
def _(t):
    return fraud.velocity_alerts(t.events, "event_id", "user_id", "ts", 600, 2, 3)


@query("g07_edges", f"SELECT u, v, round(weight, 4) AS weight, n FROM {EDGES}")
def _(t):
    return rounded(edges(t), 4)


@query("g08_cycles", f"""WITH e AS (SELECT u AS a, v AS b FROM {NATIONS} WHERE u <> v UNION ALL SELECT v, u FROM {NATIONS} WHERE u <> v), t AS (SELECT 3 AS length, count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.b < y.b),
 f AS (SELECT 4 AS length, count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a JOIN e w ON z.b = w.a AND w.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.b < z.b AND x.a <> y.b AND x.b <> z.b),
 h AS (SELECT 5 AS length, count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a JOIN e w ON z.b = w.a JOIN e k ON w.b = k.a AND k.b = x.a
  WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.a < w.b AND x.b < w.b AND x.b <> z.b AND y.b <> w.b)
 SELECT * FROM t WHERE n > 0 UNION ALL SELECT * FROM f WHERE n > 0 UNION ALL SELECT * FROM h WHERE n > 0""")
def _(t):
    return graph.cycles(nations(t), 5).groupBy("length").agg(F.count(N).alias("n"))


@query("g09_high_degree", f"SELECT node, degree, round(volume, 4) AS volume FROM (SELECT node, count(*) AS degree, sum(weight) AS volume FROM (SELECT u AS node, weight FROM {EDGES} UNION ALL SELECT v, weight FROM {EDGES}) GROUP BY 1) WHERE degree > 50")
def _(t):
    return graph.degrees(edges(t)).filter("degree > 50").select("node", "degree", rnd("volume", 4).alias("volume"))


@query("g10_components", "SELECT o_custkey AS node, o_custkey AS component FROM orders GROUP BY 1 UNION ALL SELECT 1000000000 + o_orderkey, o_custkey FROM orders")
def _(t):
    return graph.components(orders_of(t))


@query("g11_rapid_edges", f"SELECT u, v, n FROM {EDGES} WHERE n > 1 ORDER BY n DESC, u, v LIMIT 20")
def _(t):
    return edges(t).filter("n > 1").orderBy(F.desc("n"), "u", "v").limit(20).select("u", "v", "n")


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(f", r{i + 1} AS (SELECT b AS node, 0.15::DOUBLE + 0.85::DOUBLE * sum(rank / d) AS rank FROM o JOIN r{i} ON a = node GROUP BY 1)" for i in range(rounds))
    return f"""WITH s AS (SELECT u AS a, v AS b FROM {EDGES} WHERE u <> v UNION ALL SELECT v, u FROM {EDGES} WHERE u <> v), o AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS d FROM s),
 r0 AS (SELECT DISTINCT a AS node, 1.0::DOUBLE AS rank FROM o){steps} SELECT node, round(rank, 6) AS rank FROM r{rounds}"""


@query("g12_pagerank", _pagerank_sql(5))
def _(t):
    return rounded(graph.pagerank(edges(t), 5))


@query("g12_clustering", f"""WITH s AS (SELECT DISTINCT u, v FROM {NATIONS} WHERE u <> v), e AS (SELECT u AS a, v AS b FROM s UNION ALL SELECT v, u FROM s), d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY 1), t AS (SELECT x.a AS node, count(*) AS k FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a WHERE x.b < y.b GROUP BY 1)
 SELECT node, degree, coalesce(k, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(k, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN t USING (node)""")
def _(t):
    return rounded(graph.clustering(nations(t)))


@query("g13_flow_matrix", """WITH d AS (SELECT o_custkey % 50 AS a, o_orderkey % 50 AS b, o_totalprice AS x FROM orders), v AS (SELECT k FROM (SELECT a AS k, x FROM d UNION ALL SELECT b, x FROM d) GROUP BY k ORDER BY sum(x) DESC, k LIMIT 10)
 SELECT a, b, round(sum(x), 2) AS flow, count(*) AS n FROM d WHERE a IN (SELECT k FROM v) AND b IN (SELECT k FROM v) GROUP BY 1, 2""")
def _(t):
    d = t.orders.select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b"), F.col("o_totalprice").alias("x"))
    return rounded(graph.flow_matrix(d, "a", "b", "x"), 2)


@query("g14_subnetwork", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def _(t):
    bad = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(N).alias("k")).filter("k >= 2")
    return t.orders.join(bad, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(N).alias("n"))


def judged(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id").withColumn("z", F.when(F.col("n_chars") > 1000, 1).otherwise(0))


JUDGED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS z FROM documents d JOIN labels USING (doc_id))"
RATES = f"(SELECT lang, count(*) AS n, avg(z) AS rate, sum(quality * z) / nullif(sum(quality), 0) AS tpr, sum((1 - quality) * z) / nullif(sum(1 - quality), 0) AS fpr, sum((1 - quality) * (1 - z)) / nullif(sum(1 - quality), 0) AS tnr FROM {JUDGED} GROUP BY 1)"


@query("h01_demographic_parity", f"SELECT round(max(rate) - min(rate), 6) AS gap, round(min(rate) / nullif(max(rate), 0), 6) AS ratio, coalesce(min(rate) / nullif(max(rate), 0) >= 0.8, TRUE) AS fair FROM {RATES}")
def _(t):
    return rounded(fairness.demographic_parity(fairness.group_rates(judged(t), "lang", "quality", "z")))


@query("h02_equalized_odds", f"SELECT round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap, round(max(tnr) - min(tnr), 6) AS tnr_gap, round(greatest(max(tpr) - min(tpr), max(tnr) - min(tnr)), 6) AS odds_gap FROM {RATES}")
def _(t):
    return rounded(fairness.equalized_odds(fairness.group_rates(judged(t), "lang", "quality", "z")))


@query("h03_equal_opportunity", f"SELECT round(max(tpr) - min(tpr), 6) AS gap, round(min(tpr) / nullif(max(tpr), 0), 6) AS ratio FROM {RATES}")
def _(t):
    return rounded(fairness.equal_opportunity(fairness.group_rates(judged(t), "lang", "quality", "z")))


@query("h04_group_calibration", f"""WITH s AS (SELECT lang, least(n_chars / 5000.0, 1.0) AS p, quality AS y FROM {JUDGED}), b AS (SELECT lang, ceil(round(p * 10, 9)) AS bin, count(*) AS n, avg(p) AS s, avg(y) AS r FROM s GROUP BY 1, 2 HAVING bin BETWEEN 1 AND 10), a AS (SELECT lang, count(*) AS n FROM s GROUP BY 1)
 SELECT lang, round(sum(abs(r - s) * b.n / a.n), 6) AS ece FROM b JOIN a USING (lang) GROUP BY 1""")
def _(t):
    s = judged(t).select("lang", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("p"), "quality")
    return rounded(stats.calibration_errors(s, "p", "quality", by="lang").select("lang", "ece"))


@query("h05_individual", """WITH z AS (SELECT s_suppkey AS k, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS a, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER () AS b, CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0 END AS y FROM supplier),
 p AS (SELECT abs(x.y - w.y) AS d FROM z x JOIN z w ON x.k < w.k AND sqrt((x.a - w.a) * (x.a - w.a) + (x.b - w.b) * (x.b - w.b)) < 0.3 AND sqrt((x.a - w.a) * (x.a - w.a) + (x.b - w.b) * (x.b - w.b)) > 0) SELECT count(*) AS pairs, round(1 / (1 + avg(d)), 6)::DOUBLE AS consistency FROM p""")
def _(t):
    s = t.supplier.withColumn("y", (F.col("s_acctbal") > 0).cast("double"))
    return rounded(neighbors.individual_fairness(s, "s_suppkey", ["s_acctbal", "s_nationkey"], "y", 0.3))


@query("h07_intersections", f"SELECT lang, toxic, count(*) AS n, round(avg(z), 6) AS rate FROM {JUDGED} GROUP BY 1, 2 HAVING count(*) > 10")
def _(t):
    return rounded(fairness.group_rates(judged(t), ["lang", "toxic"], "quality", "z", 10).select("lang", "toxic", "n", "rate"))


@query("h08_bias_alert", f"WITH r AS (SELECT max(rate) / nullif(min(rate), 0) AS ratio FROM {RATES}) SELECT round(ratio, 6) AS ratio, CASE WHEN ratio >= 3 THEN 'critical' WHEN ratio >= 2 THEN 'high' WHEN ratio >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM r")
def _(t):
    return rounded(fairness.bias_alerts(fairness.group_rates(judged(t), "lang", "quality", "z")))


#: The coefficient of t by Cramer's rule on covariances, with a and b held.
_S = """(SELECT var_pop(t) AS tt, covar_pop(t, a) AS ta, covar_pop(t, b) AS tb, var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb, covar_pop(t, y) AS ty, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(t) AS mt, avg(y) AS my
 FROM (SELECT l_quantity AS t, l_discount + l_quantity / 500 AS a, l_tax + l_extendedprice / 1000000 AS b, l_extendedprice AS y FROM lineitem))"""
_ATE = "((ty * (aa * bb - ab * ab) - ta * (ay * bb - ab * by_) + tb * (ay * ab - aa * by_)) / (tt * (aa * bb - ab * ab) - ta * (ta * bb - ab * tb) + tb * (ta * ab - aa * tb)))"


def confounded(t):
    """Quantity and price, with two columns that hang on both."""
    own = t.lineitem.select(F.col("l_quantity").alias("t"), "l_discount", "l_tax", F.col("l_extendedprice").alias("y"))
    return own.select("t", (F.col("l_discount") + F.col("t") / 500).alias("a"), (F.col("l_tax") + F.col("y") / 1000000).alias("b"), "y")


@query("k01_ate_regression", f"SELECT round({_ATE}, 2) AS ate FROM {_S}")
def _(t):
    return t._spark.createDataFrame([(round(causal.ate_regression(confounded(t), "t", "y", ["a", "b"]), 2),)], "ate double")


@query("k02_matching", f"""WITH s AS (SELECT event_id, y, round(score, 4) AS p, value FROM {SCORED}), c AS (SELECT p, arg_min(value, event_id) AS cy FROM s WHERE y = 0 GROUP BY 1), t AS (SELECT * FROM s WHERE y = 1),
 j AS (SELECT t.event_id, t.value, c.cy, row_number() OVER (PARTITION BY t.event_id ORDER BY round(abs(t.p - c.p), 9), c.p) AS r FROM t, c) SELECT event_id, value AS outcome, cy AS match_outcome FROM j WHERE r = 1""")
def _(t):
    s = scored(t).withColumn("p", F.round("score", 4))
    m = causal.nearest_matches(s, "event_id", "y", "p", "value")
    return m.select(F.col("key").alias("event_id"), "outcome", "match_outcome")


@query("k03_ipw", "WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END AS t, l_extendedprice AS y, least(greatest(0.1 + l_discount * 5, 0.01), 0.99) AS p FROM lineitem) SELECT round(sum(t * y / p) / sum(t / p) - sum((1 - t) * y / (1 - p)) / sum((1 - t) / (1 - p)), 4) AS ate FROM s")
def _(t):
    s = t.lineitem.select((F.col("l_returnflag") == "R").cast("double").alias("t"), F.col("l_extendedprice").alias("y"), (0.1 + F.col("l_discount") * 5).alias("p"))
    return rounded(causal.ate_ipw(s, "t", "y", "p"), 4)


PRICES = {"price": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)", "discount": "l_discount", "tax": "l_extendedprice * (1 - l_discount) * l_tax"}


def _structure_sql(columns: dict[str, str]) -> str:
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c, variance({a}) AS va, variance({b}) AS vb, count(*) AS n FROM x" for a, b in pairs)
    return f"""WITH x AS (SELECT {", ".join(f"{e} AS {c}" for c, e in columns.items())} FROM lineitem), p AS ({each}) SELECT CASE WHEN va >= vb THEN a ELSE b END AS cause, CASE WHEN va >= vb THEN b ELSE a END AS effect FROM p
 WHERE abs(c) > 0.3 OR abs(c) * sqrt((n - 2) / greatest(1e-12, 1 - c * c)) > 1.959963984540054"""


@query("k04_structure", _structure_sql(PRICES))
def _(t):
    x = t.lineitem.select(*[F.expr(e).alias(c) for c, e in PRICES.items()])
    return t._spark.createDataFrame(causal.structure(x, list(PRICES)), "cause string, effect string")


DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"


@query("j10_knn", f"""SELECT query, neighbour, place FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE place <= 5""")
def _(t):
    n = neighbors.knn(t.embeddings.filter("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 5)
    return n.select("query", "neighbour", F.col("place").cast("bigint").alias("place"))


@query("e05_trust", f"""WITH d AS (SELECT a.vec_id AS query, a.label = b.label AS same, {DIST} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), g AS (SELECT query, min(CASE WHEN same THEN d END) AS s, min(CASE WHEN NOT same THEN d END) AS o FROM d GROUP BY 1)
 SELECT query, round(o / (s + o + 1e-8), 5) AS trust FROM g""")
def _(t):
    return rounded(neighbors.trust_scores(t.embeddings.filter("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", "label").select("query", "trust"), 5)


@query("e06_uncertainty", f"SELECT event_id, round(CASE WHEN score > 0 THEN -score * ln(score) ELSE 0 END + CASE WHEN score < 1 THEN -(1 - score) * ln(1 - score) ELSE 0 END, 6)::DOUBLE AS entropy, round(1 - greatest(score, 1 - score), 6) AS doubt FROM {SCORED}")
def _(t):
    u = explain.uncertainty(F.col("score"))
    return rounded(scored(t).select("event_id", *[c.alias(k) for k, c in u.items()]))


@query("e07_confidence_bands", f"SELECT CAST(least(4, floor(round((greatest(score, 1 - score) - 0.5) * 10, 9))) AS INTEGER) AS band, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM {SCORED} GROUP BY 1")
def _(t):
    return rounded(explain.confidence_bands(scored(t), "score", "y"))


@query("e01_partial_dependence", "SELECT x::DOUBLE AS x, round((SELECT avg(0.5 * l_discount) FROM lineitem) + 2 * x, 6) AS mean_score FROM (SELECT unnest([1.0, 10.0, 50.0]) AS x)")
def _(t):
    return rounded(explain.partial_dependence(t.lineitem, "l_quantity", explain.linear_score({"l_quantity": 2.0, "l_discount": 0.5}), [1.0, 10.0, 50.0]))


@query("e02_ice", "SELECT p_partkey, x::DOUBLE AS x, round(p_size * 0.1 + x * 0.01, 6)::DOUBLE AS score FROM part, (SELECT unnest([900.0, 1500.0]) AS x)")
def _(t):
    return rounded(explain.ice(t.part, "p_partkey", "p_retailprice", explain.linear_score({"p_size": 0.1, "p_retailprice": 0.01}), [900.0, 1500.0]))


@query("e03_permutation")
def _(t):
    score = explain.linear_score({"l_quantity": 1500.0, "l_discount": -10.0})
    l = t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(explain.permutation_importance(l, "id", ["l_quantity", "l_discount"], score, lambda s: F.abs(s - F.col("l_extendedprice"))))


@query("e04_linear_shap", "SELECT 'p_size' AS feature, round(avg(abs(0.1 * (p_size - m))), 6)::DOUBLE AS mean_abs FROM part, (SELECT avg(p_size) AS m FROM part) UNION ALL SELECT 'p_retailprice', round(avg(abs(0.01 * (p_retailprice - m))), 6) FROM part, (SELECT avg(p_retailprice) AS m FROM part)")
def _(t):
    return rounded(explain.global_shap(explain.linear_shap(t.part, "p_partkey", {"p_size": 0.1, "p_retailprice": 0.01})))


def _centers_sql(k: int) -> str:
    steps = "".join(f", k{i + 1} AS (SELECT * FROM k{i} UNION ALL (SELECT a.vec_id, a.embedding FROM embeddings a JOIN k{i} b ON true GROUP BY 1, 2 ORDER BY min({DIST}) DESC, a.vec_id LIMIT 1))" for i in range(1, k))
    return f"WITH k1 AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1){steps} SELECT vec_id FROM k{k}"


@query("e08_k_centers", _centers_sql(5))
def _(t):
    return t._spark.createDataFrame([(k,) for k in explain.k_centers(t.embeddings, "vec_id", "embedding", 5)], "vec_id bigint")


@query("e11_rules", "SELECT p_brand AS rule, round(avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS confidence, count(*) AS support, round(avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0 END) * ln(count(*) + 1), 6)::DOUBLE AS weight FROM part GROUP BY 1 HAVING avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0 END) >= 0.7 AND count(*) >= 10")
def _(t):
    r = t.part.groupBy(F.col("p_brand").alias("rule")).agg(F.avg((F.col("p_size") > 10).cast("double")).alias("confidence"), F.count(N).alias("support")).withColumn("conditions", F.array("rule"))
    return rounded(explain.rank_rules(r).drop("conditions"))


@query("e12_interaction", "WITH m AS (SELECT median(l_discount) AS m FROM lineitem) SELECT round((abs(corr(l_quantity * l_discount, l_extendedprice)) + abs(corr(CASE WHEN l_discount > m THEN l_quantity END, CASE WHEN l_discount > m THEN l_extendedprice END) - corr(CASE WHEN l_discount <= m THEN l_quantity END, CASE WHEN l_discount <= m THEN l_extendedprice END))) / 2, 5) AS strength FROM lineitem, m")
def _(t):
    return rounded(explain.interaction_strength(t.lineitem, "l_quantity", "l_discount", "l_extendedprice"), 5)


@query("e15_blind_spots", "SELECT 'o_totalprice' AS feature, count(*) FILTER (WHERE x < lo OR x > hi) AS outside FROM (SELECT o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 1), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice < 200000)")
def _(t):
    return explain.blind_spots(t.orders.filter("o_orderkey % 2 = 0 AND o_totalprice < 200000"), t.orders.filter("o_orderkey % 2 = 1"), ["o_totalprice"])


@query("e17_heat_map", "SELECT CAST((value > 10)::INT + (value > 50)::INT AS INTEGER) AS band, extract(hour FROM ts)::INTEGER AS hour, count(*) AS n, round(avg(value), 7) AS mean FROM events GROUP BY 1, 2")
def _(t):
    return rounded(explain.heat_map(t.events, "value", "ts", [10, 50]), 7)


@query("e18_ale", """WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lineitem), b AS (SELECT e, l_discount, least(4, greatest(0, len(list_filter(e, lambda z: l_quantity > z)) - 1)) AS bin FROM lineitem, q),
 d AS (SELECT bin, avg((2 * e[bin + 2] + l_discount) - (2 * e[bin + 1] + l_discount)) AS d FROM b GROUP BY 1) SELECT bin::INTEGER AS bin, round(sum(d) OVER (ORDER BY bin), 6) AS effect FROM d""")
def _(t):
    return rounded(explain.ale(t.lineitem, "l_quantity", explain.linear_score({"l_quantity": 2.0, "l_discount": 1.0}), 5))


@query("e19_mahalanobis", """WITH m AS (SELECT avg(p_size) AS ms, avg(p_retailprice) AS mp, var_samp(p_size) AS vs, var_samp(p_retailprice) AS vp, covar_samp(p_size, p_retailprice) AS c FROM part)
 SELECT p_partkey, round(sqrt(greatest(0, (vp * (p_size - ms) ** 2 - 2 * c * (p_size - ms) * (p_retailprice - mp) + vs * (p_retailprice - mp) ** 2) / (vs * vp - c * c))), 6) AS mahalanobis FROM part, m""")
def _(t):
    return rounded(neighbors.mahalanobis(t.part.withColumn("size", F.col("p_size").cast("double")), "p_partkey", ["size", "p_retailprice"]))


@query("b01_undersample", "SELECT quality, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY 1")
def _(t):
    return sampling.undersample(t.labels, "doc_id", "quality").groupBy("quality").agg(F.count(N).alias("n"))


@query("b01_oversample", "SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY 1")
def _(t):
    return sampling.oversample(t.labels, "doc_id", "quality").groupBy("quality").agg(F.count(N).alias("n"))


@query("b02_smote")
def _(t):
    return sampling.smote(t.embeddings, "vec_id", "embedding", "label", 0).select("source", "neighbour")


@query("b03_tomek", f"""WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, {DIST} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
 n AS (SELECT a, arg_min(b, d) AS b FROM (SELECT a, b, d FROM d UNION ALL SELECT b, a, d FROM d) GROUP BY a)
 SELECT x.a AS x, x.b AS y FROM n x JOIN n y ON x.a = y.b AND x.b = y.a JOIN embeddings p ON p.vec_id = x.a JOIN embeddings q ON q.vec_id = x.b WHERE x.a < x.b AND p.label <> q.label""")
def _(t):
    return neighbors.tomek_links(t.embeddings, "vec_id", "embedding", "label")


@query("b04_recommend", "WITH g AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT min(n) / max(n) AS ratio, sum(n)::BIGINT AS rows FROM g) SELECT round(ratio, 6) AS ratio, rows, CASE WHEN ratio > 0.3 THEN 'class_weight' WHEN ratio > 0.1 THEN CASE WHEN rows < 10000 THEN 'smote' ELSE 'undersample' END ELSE CASE WHEN rows < 10000 THEN 'adasyn' ELSE 'smote_enn' END END AS strategy FROM s")
def _(t):
    return rounded(sampling.recommend(t.labels, "quality"))


@query("b05_time_split", "WITH e AS (SELECT quantile_cont(epoch_us(ts), 0.7) AS a, quantile_cont(epoch_us(ts), 0.85) AS b FROM events) SELECT CASE WHEN epoch_us(ts) <= a THEN 'train' WHEN epoch_us(ts) <= b THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM events, e GROUP BY 1")
def _(t):
    return sampling.time_split(t.events, "ts").groupBy("split").agg(F.count(N).alias("n"))


@query("b05_stratified_split", """WITH r AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY quality) AS share FROM labels)
 SELECT quality, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    return sampling.stratified_split(t.labels, "doc_id", "quality").groupBy("quality", "split").agg(F.count(N).alias("n"))


@query("a25_bootstrap")
def _(t):
    return sampling.bootstrap_means(t.customer, "c_custkey", "c_acctbal", 100)
