"""Comparing models, periods and runs: ranks, guardrails, reports over a metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import stats
from larkspur.operators.quantiles import edges


def rank_models(metrics: DataFrame, weights: dict[str, float], model: str = "model") -> DataFrame:
    """metrics: one row a model. Dense rank of each metric and of the weighted mean of min-max scaled metrics; a negative
    weight means less is better."""
    whole = Window.partitionBy()  # one row a model
    scaled = {}
    for m, w in weights.items():
        lo, hi = F.min(m).over(whole), F.max(m).over(whole)
        s = F.coalesce(F.try_divide(F.col(m) - lo, hi - lo), F.lit(1.0))
        scaled[m] = (s if w > 0 else 1 - s) * abs(w)
    total = sum(abs(w) for w in weights.values())
    score = sum(scaled.values(), F.lit(0.0)) / total
    ranks = [F.dense_rank().over(Window.orderBy(F.desc(m) if w > 0 else F.asc(m))).alias(f"{m}_rank") for m, w in weights.items()]
    return metrics.select(model, *weights, *ranks, score.alias("score")).withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("score"))))


def guardrails(metrics: DataFrame, baseline: str, limits: dict[str, float], model: str = "model") -> DataFrame:
    """For each model: the fall of each metric below the baseline's, relative fall, and whether all stay within limits."""
    base = metrics.filter(F.col(model) == baseline).select(*[F.col(m).alias(f"b_{m}") for m in limits])
    j = metrics.crossJoin(F.broadcast(base))
    falls = [(F.col(f"b_{m}") - F.col(m)).alias(f"{m}_fall") for m in limits]
    rel = [F.try_divide(F.col(f"b_{m}") - F.col(m), F.col(f"b_{m}")).alias(f"{m}_relative") for m in limits]
    fine = F.lit(True)
    for m, limit in limits.items():
        fine = fine & (F.col(f"b_{m}") - F.col(m) <= limit)
    return j.select(model, *falls, *rel, fine.alias("passes"))


def value_deciles(df: DataFrame, score: str, label: str, value: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the score, ascending: bin, n, positives, rate, value, value of positives."""
    e = edges(df, score, [i / bins for i in range(1, bins)], "__e").select(F.array_distinct("__e").alias("__e"))
    at = F.size(F.filter("__e", lambda x: F.col(score) > x)) + 1
    y = F.col(label).cast("int")
    return df.crossJoin(F.broadcast(e)).groupBy(at.alias("decile")).agg(
        F.count("*").alias("n"), F.sum(y).alias("positives"), F.avg(y.cast("double")).alias("rate"), F.sum(value).alias("value"), F.sum(F.col(value) * y).alias("positive_value")
    )


def stability(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """auc and ks of both sides, their falls, and the PSI of the scores."""
    a, b = (stats.ranking_metrics(d, score, label).select("auc", "ks") for d in (train, test))
    psi = stats.psi_quantile(train, test, score)
    j = a.select(F.col("auc").alias("auc_train"), F.col("ks").alias("ks_train")).crossJoin(b.select(F.col("auc").alias("auc_test"), F.col("ks").alias("ks_test"))).crossJoin(psi)
    return j.withColumn("auc_fall", F.col("auc_train") - F.col("auc_test")).withColumn("ks_fall", F.col("ks_train") - F.col("ks_test"))


def psi_by_period(reference: DataFrame, current: DataFrame, column: str, period: Column, bins: int = 10, floor: float = 1e-10) -> DataFrame:
    """PSI of every period of ``current`` against the reference, over its equal-width bins: period, n, psi. One aggregation
    by period; the reference is two rows of sums."""
    import math

    x = F.col(column).cast("double")
    e = reference.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = e.lo or 0.0, e.hi or 0.0
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) or 1.0) * bins)))
    counts = [F.count("*").alias("n"), *[F.count_if(at == i).alias(f"b{i}") for i in range(bins)]]
    r = reference.dropna(subset=[column]).agg(*counts).first()
    shares = [max(r[f"b{i}"] / max(r["n"], 1), floor) for i in range(bins)]
    g = current.dropna(subset=[column]).groupBy(period.alias("period")).agg(*counts)
    own = [F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(floor)) for i in range(bins)]
    return g.select("period", "n", sum(((q - p) * (F.log(q) - math.log(p)) for q, p in zip(own, shares, strict=True)), F.lit(0.0)).alias("psi"))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str], width: int = 10, fine: int = 50) -> DataFrame:
    """feature, psi (equal width over the reference), ks, js, drifted, severity. All features share three passes: bounds,
    histograms, and running sums over distinct values, which go in two levels (ranges, then a row for each range).
    psi above 0.1 or 0.2, js above 0.1 or 0.2, or ks above its 5 % or 1 % critical value is medium or high."""
    both = reference.select(F.lit(1).alias("side"), *columns).unionByName(current.select(F.lit(0).alias("side"), *columns))
    ref = F.col("side") == 1
    aggs = [f(F.when(ref, F.col(c).cast("double"))).alias(f"{s}|{c}") for c in columns for s, f in (("rl", F.min), ("rh", F.max))]
    aggs += [f(F.col(c).cast("double")).alias(f"{s}|{c}") for c in columns for s, f in (("lo", F.min), ("hi", F.max))]
    e = both.agg(*aggs).first()

    def bin_of(c: str, low: str, high: str, k: int):
        lo, hi = e[f"{low}|{c}"] or 0.0, e[f"{high}|{c}"] or 0.0
        return F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((F.col(c).cast("double") - lo) / ((hi - lo) or 1.0) * k)))

    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), bin_of(c, "rl", "rh", width).alias("wide"), bin_of(c, "lo", "hi", fine).alias("fine")) for c in columns])
    long = both.select("side", F.explode(each).alias("f")).select("side", "f.*").filter("x IS NOT NULL")

    bins = F.explode(F.array(F.struct(F.lit("psi").alias("kind"), F.col("wide").alias("bin")), F.struct(F.lit("js").alias("kind"), F.col("fine").alias("bin")))).alias("b")
    cells = long.select("feature", "side", bins).groupBy("feature", "b.kind", "b.bin").agg(F.sum("side").alias("r"), F.sum(1 - F.col("side")).alias("c"))
    own = Window.partitionBy("feature", "kind")  # at most ``fine`` rows
    shares = cells.select("feature", "kind", (F.col("r") / F.sum("r").over(own)).alias("p"), (F.col("c") / F.sum("c").over(own)).alias("q"))
    p, q, mid = F.greatest("p", F.lit(1e-10)), F.greatest("q", F.lit(1e-10)), (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    found = shares.groupBy("feature").agg(
        F.sum(F.when(F.col("kind") == "psi", (q - p) * F.log(q / p))).alias("psi"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.when(F.col("kind") == "js", part(F.col("p")) + part(F.col("q")))) / 2)).alias("js"),
    )

    d = found.join(_ks(long), "feature")
    limit = F.sqrt((F.col("nr") + F.col("nc")) / (F.col("nr") * F.col("nc")))
    high = (F.col("psi") > 0.2) | (F.col("js") > 0.2) | (F.col("ks") > 1.628 * limit)
    medium = (F.col("psi") > 0.1) | (F.col("js") > 0.1) | (F.col("ks") > 1.358 * limit)
    severity = F.when(high, "high").when(medium, "medium").otherwise("low")
    return d.select("feature", "psi", "ks", "js", (high | medium).alias("drifted"), severity.alias("severity"))


def _ks(long: DataFrame) -> DataFrame:
    """feature, ks, nr, nc from rows of feature, x, side."""
    from larkspur.operators.graph import cut

    g = long.groupBy("feature", "x").agg(F.sum("side").alias("r"), F.sum(1 - F.col("side")).alias("c"))
    s = cut(g.repartitionByRange("feature", "x").withColumn("__part", F.spark_partition_id()))
    at = Window.partitionBy("__part", "feature").orderBy("x")
    own = s.select("__part", "feature", F.sum("r").over(at).alias("ar"), F.sum("c").over(at).alias("ac"))
    w = Window.partitionBy("feature")  # a row for each range that a feature reaches into
    sizes = s.groupBy("__part", "feature").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    up = w.orderBy("__part")
    before = sizes.select("__part", "feature", (F.sum("r").over(up) - F.col("r")).alias("br"), (F.sum("c").over(up) - F.col("c")).alias("bc"), F.sum("r").over(w).alias("nr"), F.sum("c").over(w).alias("nc"))
    j = own.join(F.broadcast(before), ["__part", "feature"])
    gap = F.abs((F.col("ar") + F.col("br")) / F.col("nr") - (F.col("ac") + F.col("bc")) / F.col("nc"))
    return j.groupBy("feature").agg(F.max(gap).alias("ks"), F.first("nr").alias("nr"), F.first("nc").alias("nc"))
