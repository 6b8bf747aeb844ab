"""Risk of single transactions: levels, contributions, features, velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.functions.expr import rnd
from larkspur.operators.relational import fixed_bins

N = "*"  # what count() counts: rows
ACTIONS = {"low": "approve", "medium": "monitor", "high": "review", "critical": "block"}


def risk_level(p: Column) -> Column:
    return F.when(p < 0.3, "low").when(p < 0.6, "medium").when(p < 0.8, "high").otherwise("critical")


def with_risk(df: DataFrame, score: str) -> DataFrame:
    """score 0..1 -> points (int of 100 p), level and action."""
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return df.select("*", (F.col(score) * 100).cast("int").alias("points"), risk_level(F.col(score)).alias("level")).withColumn("action", names[F.col("level")])


def contributions(df: DataFrame, key: str, features: list[str], importance: dict[str, float] | None = None, top: int = 5) -> DataFrame:
    """The ``top`` features by absolute importance x value: key, place, feature, contribution, impact."""
    weight = importance or {f: 1 / len(features) for f in features}
    each = F.array(*[F.struct(F.abs(F.col(f) * weight[f]).alias("size"), F.lit(f).alias("feature"), (F.col(f) * weight[f]).alias("contribution")) for f in features])
    first = F.slice(F.sort_array(each, False), 1, top)
    e = df.select(key, F.posexplode(first).alias("place", "c"))
    impact = F.when(F.col("c.size") > 0.1, "high").when(F.col("c.size") > 0.05, "medium").otherwise("low")
    return e.select(key, (F.col("place") + 1).cast("bigint").alias("place"), "c.feature", "c.contribution", impact.alias("impact"))


def anomaly_features(df: DataFrame, key: str, user: str, ts: str, amount: str) -> DataFrame:
    mean = F.avg(amount).over(Window.partitionBy(user))
    return df.select(
        key, F.hour(ts).cast("bigint").alias("hour"), X.dow0(ts).cast("bigint").alias("dow"), X.dow0(ts).isin(0, 6).alias("weekend"), rnd(F.log1p(amount)).alias("log_amount"), rnd(X.safe_div(amount, mean)).alias("to_mean")
    )


def velocity_alerts(df: DataFrame, key: str, user: str, ts: str, minutes: int = 60, limit: int = 10, high: int = 20) -> DataFrame:
    """Rows with more than ``limit`` of their user's events in the ``minutes`` before, both ends included."""
    w = Window.partitionBy(user).orderBy(X.micros(ts)).rangeBetween(-minutes * 60_000_000, 0)
    n = df.select(key, user, F.count(N).over(w).alias("n"))
    return n.filter(F.col("n") > limit).withColumn("severity", F.when(F.col("n") > high, "high").otherwise("medium"))


def risk_features(events: DataFrame) -> DataFrame:
    """The event feature table: counts and sums over trailing times, history, gaps, cyclic time, bands."""
    w = Window.partitionBy("user_id").orderBy(X.micros("ts"))
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour, day, week = (w.rangeBetween(-h * 3_600_000_000, 0) for h in (1, 24, 168))
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    us, v = X.micros("ts"), F.col("value")
    sin, _ = X.cyclic(F.hour("ts"), 24)
    return events.select(
        "event_id", F.count(N).over(hour).alias("n_hour"), rnd(F.sum(v).over(day), 6).alias("s_day"), rnd(F.avg(v).over(day)).alias("m_day"), rnd(F.stddev(v).over(week)).alias("sd_week"),
        rnd(F.coalesce(F.avg(v).over(before), F.lit(0.0))).alias("mean_before"), rnd(F.coalesce((us - F.lag(us).over(o)) / 3.6e9, F.lit(24.0))).alias("gap_hours"), F.hour("ts").cast("bigint").alias("hour"),
        X.dow0("ts").isin(0, 6).alias("weekend"), rnd(sin).alias("hour_sin"), fixed_bins(v, [0, 10, 50, 1000000], ["low", "mid", "high"]).alias("band"), (F.floor(v).cast("bigint") % 10 == 0).alias("round_amount"),
    )


#: Trailing times of the wide feature table, in hours.
SPANS = (1, 6, 24, 168, 720)


def window_features(events: DataFrame) -> DataFrame:
    """The wide event table: for each trailing time n, s, log_m, sd, lo, hi of the user's values, log of the value over the mean and value
    over the highest of each, then history, order, gaps and cyclic time. One shuffle by user; every window has that key."""
    us, v = X.micros("ts"), F.col("value")
    w = Window.partitionBy("user_id").orderBy(us)
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    made = ["event_id"]
    for h in SPANS:
        t = w.rangeBetween(-h * 3_600_000_000, 0)
        mean, top = F.avg(v).over(t), F.max(v).over(t)
        made += [F.count(N).over(t).alias(f"n_{h}h"), rnd(F.sum(v).over(t), 6).alias(f"s_{h}h"), rnd(F.log1p(mean), 6).alias(f"log_m_{h}h"), rnd(F.stddev(v).over(t), 6).alias(f"sd_{h}h")]
        made += [F.min(v).over(t).alias(f"lo_{h}h"), top.alias(f"hi_{h}h"), rnd(F.log1p(v) - F.log1p(mean), 6).alias(f"log_to_m_{h}h"), rnd(X.safe_div(v, top), 6).alias(f"to_hi_{h}h")]
    gap = (us - F.lag(us).over(o)) / 3.6e9
    return events.select(
        *made, (F.row_number().over(o)).cast("bigint").alias("place"), F.lag(v).over(o).alias("last_value"), rnd(v - F.lag(v).over(o), 6).alias("change"), rnd(F.log1p(F.avg(v).over(before)), 6).alias("log_mean_before"),
        F.max(v).over(before).alias("hi_before"), F.coalesce(v > F.max(v).over(before), F.lit(True)).alias("new_high"), rnd(gap, 6).alias("gap_hours"), F.coalesce(gap < 1 / 60, F.lit(False)).alias("rapid"),
        F.hour("ts").cast("bigint").alias("hour"), X.dow0("ts").cast("bigint").alias("dow"), F.hour("ts").isin(0, 1, 2, 3, 4, 5, 22, 23).alias("night"),
    )
