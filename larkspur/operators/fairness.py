"""Group fairness from one grouped aggregation, its gaps from the few rows it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = "*"  # what count() counts: rows


def group_rates(df: DataFrame, group: str | list[str], label: str, predicted: str, least: int = 0) -> DataFrame:
    """n, rate of positive predictions, tpr, fpr, tnr of each group; more than one column: intersections."""
    y, z = F.col(label) == 1, F.col(predicted) == 1
    keys = [group] if isinstance(group, str) else group
    g = df.groupBy(*keys).agg(
        F.count(N).alias("n"), F.avg(z.cast("double")).alias("rate"), F.try_divide(F.count_if(y & z), F.count_if(y)).alias("tpr"), F.try_divide(F.count_if(~y & z), F.count_if(~y)).alias("fpr"),
        F.try_divide(F.count_if(~y & ~z), F.count_if(~y)).alias("tnr"),
    )
    return g.filter(F.col("n") > least) if least else g


def demographic_parity(rates: DataFrame) -> DataFrame:
    """gap, ratio (least rate over greatest), whether the 80 % rule holds."""
    g = rates.agg((F.max("rate") - F.min("rate")).alias("gap"), F.try_divide(F.min("rate"), F.max("rate")).alias("ratio"))
    return g.withColumn("fair", F.coalesce(F.col("ratio") >= 0.8, F.lit(True)))


def equalized_odds(rates: DataFrame) -> DataFrame:
    span = lambda c: F.max(c) - F.min(c)
    return rates.agg(span("tpr").alias("tpr_gap"), span("fpr").alias("fpr_gap"), span("tnr").alias("tnr_gap"), F.greatest(span("tpr"), span("tnr")).alias("odds_gap"))


def equal_opportunity(rates: DataFrame) -> DataFrame:
    return rates.agg((F.max("tpr") - F.min("tpr")).alias("gap"), F.try_divide(F.min("tpr"), F.max("tpr")).alias("ratio"))


def severity(ratio: Column) -> Column:
    return F.when(ratio >= 3, "critical").when(ratio >= 2, "high").when(ratio >= 1.5, "medium").otherwise("low")


def bias_alerts(rates: DataFrame) -> DataFrame:
    """The ratio of the greatest to the least rate and its severity."""
    g = rates.agg(F.try_divide(F.max("rate"), F.min("rate")).alias("ratio"))
    return g.withColumn("severity", severity(F.col("ratio")))
