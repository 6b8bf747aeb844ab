"""Queries of sources and sinks, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.expr import rnd
from larkspur.operators import models, sampling, stats
from larkspur.sources import files
from larkspur.streaming import streams

from .modelling import WIDTHS, _psi_sql
from .registry import query, type_sql

N = "*"


@query("s01_csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(t):
    path = streams.shared_path(t._spark, "csv")
    files.write(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "csv")
    back = files.read_csv(t._spark, path, encoding="UTF-8", delimiter=",")
    return back.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query("s04_type_inference", type_sql({c: f"{c}::VARCHAR" for c in ("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")}, "customer"))
def _(t):
    from larkspur.operators.profile import type_plan

    c = t.customer.select(*[F.col(x).cast("string").alias(x) for x in ("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")])
    return type_plan(c, c.columns)


@query("s07_compressed_csv", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier")
def _(t):
    path = streams.shared_path(t._spark, "gz")
    files.write(t.supplier, path, "csv", compression="gzip")
    back = files.read_csv(t._spark, path, encoding="UTF-8", delimiter=",", types={"s_acctbal": "double"}, infer=False)
    return back.agg(F.count(N).alias("n"), rnd(F.sum("s_acctbal"), 2).alias("total"))


@query("s09_row_count", "SELECT count(*) AS rows FROM orders")
def _(t):
    return files.file_info(t._spark, f"{t._folder}/orders.parquet").agg(F.sum("rows").alias("rows"))


@query("s10_sql_on_file", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    return files.sql_on_files(t._spark, f"SELECT n_regionkey, count(*) AS n FROM parquet.`{t._folder}/nation.parquet` GROUP BY 1")


@query("s21_json_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = streams.shared_path(t._spark, "json")
    files.write(t.nation, path, "json")
    return t._spark.read.schema("n_nationkey int, n_name string").json(path)


@query("d08_append_new", "SELECT n_nationkey FROM nation")
def _(t):
    path = streams.shared_path(t._spark, "append")
    files.write(t.nation.filter("n_nationkey < 10"), path)
    files.append_new(t.nation, path, ["n_nationkey"])
    return t._spark.read.parquet(path).select("n_nationkey")


@query("d09_partitioned", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    path = streams.shared_path(t._spark, "parts")
    files.write(t.orders, path, partition_by=["o_orderstatus"])
    return t._spark.read.parquet(path).filter("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(N).alias("n"))


@query("x01_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    r = streams.replay(streams.tumbling(streams.events(t._spark, t._folder)), "complete")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rnd("total", 4).alias("total"))


@query("x02_sliding", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - h * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(0, 6) r(h) GROUP BY 1")
def _(t):
    r = streams.replay(streams.sliding(streams.events(t._spark, t._folder), "6 hours"), "complete")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("x03_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    r = streams.replay(streams.sessions(streams.events(t._spark, t._folder)), "complete")
    return r.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("x04_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(t):
    return streams.replay(streams.deduplicated(streams.events(t._spark, t._folder)), "append").agg(F.count(N).alias("n"))


@query("x05_velocity", "SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2")
def _(t):
    return streams.replay(streams.velocity(streams.events(t._spark, t._folder)), "append")


def _drift_sql() -> str:
    parts = []
    for i in range(3):
        psi = _psi_sql(*WIDTHS, ref="(SELECT value AS x FROM events WHERE event_id % 2 = 0)", cur=f"(SELECT value AS x FROM events WHERE event_id % 3 = {i})")
        parts.append(f"SELECT (SELECT count(*) FROM events WHERE event_id % 3 = {i}) AS n, psi FROM ({psi})")
    return " UNION ALL ".join(parts)


@query("x06_drift", _drift_sql())
def _(t):
    """Three files, three micro-batches; which comes first is the file system's affair."""
    path = streams.shared_path(t._spark, "arrivals")
    for i in range(3):
        t.events.filter(f"event_id % 3 = {i}").coalesce(1).write.parquet(f"{path}/part={i}")
    arrivals = t._spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    r = streams.drift_by_batch(arrivals, t.events.filter("event_id % 2 = 0"), "value")
    return r.select("n", rnd("psi", 6).alias("psi"))


@query("x07_rate_limit", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT event_id, user_id, rn, [us] AS sent, true AS kept FROM o WHERE rn = 1
 UNION ALL SELECT event_id, user_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END, len(live) < 2 FROM (SELECT o.event_id, o.user_id, o.rn, o.us, list_filter(r.sent, lambda s: s > o.us - 86400000000) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
 SELECT event_id, user_id FROM r WHERE kept""")
def _(t):
    return streams.replay(streams.rate_limited(streams.events(t._spark, t._folder), 2, 86_400), "append")


def labelled(t):
    r = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_extendedprice") > 30_000 * (1 + F.col("l_discount")), 1.0).otherwise(0.0).alias("label")
    )
    return sampling.random_split(r, "id")


@query("l03_logistic")
def _(t):
    d = labelled(t)
    m = models.TabularModel("logistic_regression", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], maxIter=20).fit(d.filter("split = 'train'"))
    return stats.ranking_metrics(m.predict_proba(d.filter("split = 'test'")), "score", "label").select(rnd("auc", 3).alias("auc"), rnd("ks", 3).alias("ks"))


@query("l03_forest")
def _(t):
    d = labelled(t)
    m = models.TabularModel("random_forest", ["l_quantity", "l_extendedprice", "l_discount"], numTrees=10, maxDepth=4, seed=1).fit(d.filter("split = 'train'"))
    return stats.ranking_metrics(m.predict_proba(d.filter("split = 'test'")), "score", "label").select(rnd("auc", 3).alias("auc"))


@query("l07_cost_sensitive")
def _(t):
    d = models.balanced_weights(labelled(t), "label")
    m = models.TabularModel("logistic_regression", ["l_quantity", "l_discount"], weight="weight", maxIter=10).fit(d.filter("split = 'train'"))
    return m.predict_proba(d.filter("split = 'test'")).groupBy("label").agg(F.count(N).alias("n"), rnd(F.avg("score"), 3).alias("mean_score"))
