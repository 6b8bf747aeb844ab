"""Splits, folds and resampling. Choices are by hash of a key, so they repeat, and exact counts need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N = "*"  # what count() counts: rows


def unit(key: str, seed: int = 42) -> Column:
    """A number in [0, 1) from the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def random_split(df: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, seed: int = 42) -> DataFrame:
    u = unit(key, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def _by_hash(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds rank and n_group: rows of each label in the order of a hash of the key."""
    from larkspur.operators.stats import ranked_within

    return ranked_within(df, label, F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.7, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """Exact shares within each label, by rank of the hash."""
    at = (F.col("rank") - 1) / F.col("n_group")
    split = F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test")
    return _by_hash(df, key, label, seed).withColumn("split", split).drop("rank", "n_group")


def time_split(df: DataFrame, ts: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """By time: borders are exact percentiles of the time, a one-row aggregate."""
    from larkspur.functions.expr import micros

    from larkspur.operators.quantiles import edges

    borders = edges(df, micros(ts), [train, train + valid], "__e")
    at = micros(ts)
    return df.crossJoin(F.broadcast(borders)).withColumn("split", F.when(at <= F.col("__e")[0], "train").when(at <= F.col("__e")[1], "valid").otherwise("test")).drop("__e")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified k folds: rank of the hash within the label, modulo k."""
    return _by_hash(df, key, label, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n_group")


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every label down to the size of the smallest."""
    least = df.groupBy(label).agg(F.count(N).alias("n")).agg(F.min("n").alias("__n"))
    return _by_hash(df, key, label, seed).crossJoin(F.broadcast(least)).filter("rank <= __n").drop("rank", "n_group", "__n")


def oversample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every label up to the size of the largest: whole copies, and one more of the rows of smallest hash."""
    most = df.groupBy(label).agg(F.count(N).alias("n")).agg(F.max("n").alias("__m"))
    j = _by_hash(df, key, label, seed).crossJoin(F.broadcast(most))
    times = F.floor(F.col("__m") / F.col("n_group")) + (F.col("rank") <= F.col("__m") % F.col("n_group")).cast("int")
    return j.withColumn("__k", times).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("rank", "n_group", "__m", "__k")


def smote(df: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, per_row: int = 1, seed: int = 42) -> DataFrame:
    """Synthetic minority rows: each between a row and one of its k neighbours: source, neighbour, vector."""
    from larkspur.operators.pivots import knn_all

    own = df.filter(F.col(label) == minority)
    near = knn_all(own, own, key, vector, k)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.xxhash64("query", "neighbour", F.lit(seed))))
    pick = near.withColumn("__r", order).filter(F.col("__r") <= per_row)
    u = F.pmod(F.xxhash64("query", "neighbour", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    v = own.select(F.col(key), F.col(vector))
    j = pick.join(v.select(F.col(key).alias("query"), F.col(vector).alias("a")), "query").join(v.select(F.col(key).alias("neighbour"), F.col(vector).alias("b")), "neighbour")
    return j.select(F.col("query").alias("source"), "neighbour", F.zip_with("a", "b", lambda x, y: x.cast("double") + u * (y.cast("double") - x.cast("double"))).alias("vector"))


def near_miss(df: DataFrame, key: str, vector: str, label: str, minority, keep: int, k: int = 3, version: int = 1, candidates: int = 3) -> DataFrame:
    """The minority and ``keep`` majority rows. Version 1: those of least mean distance to their k nearest minority rows;
    2: to their k farthest ones; 3: of the ``candidates`` majority rows nearest to each minority row, those of largest
    mean distance to their k nearest minority rows. Ties: least key."""
    from larkspur.operators.pivots import knn_all

    few, many = df.filter(F.col(label) == minority), df.filter(F.col(label) != minority)
    if version == 3:
        close = knn_all(few, many, key, vector, candidates, same=False).select(F.col("neighbour").alias(key)).distinct()
        asked = many.join(close, key, "left_semi")
    else:
        asked = many
    mean = knn_all(asked, few, key, vector, k, same=False, farthest=version == 2).groupBy("query").agg(F.avg("distance").alias("d"))
    best = mean.orderBy(F.desc("d") if version == 3 else F.asc("d"), "query").limit(keep)
    return many.join(best.select(F.col("query").alias(key)), key, "left_semi").unionByName(few)


def adasyn_weights(df: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, balance: float = 1.0) -> DataFrame:
    """For each minority row: source, hardness (share of other labels among its k nearest rows of all) and n_new, the
    synthetic rows that it gets: (majority - minority) * balance dealt by hardness and rounded. All 0 where no minority
    row has a neighbour of another label."""
    from larkspur.operators.pivots import knn_all

    names = df.select(F.col(key).alias("neighbour"), F.col(label).alias("nl"))
    near = knn_all(df.filter(F.col(label) == minority), df, key, vector, k).join(names, "neighbour")
    hard = near.groupBy("query").agg(F.avg((F.col("nl") != minority).cast("double")).alias("hardness"))
    sizes = df.agg(F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many"))
    one = sizes.crossJoin(hard.agg(F.sum("hardness").alias("total")))
    share = F.coalesce(F.try_divide(F.col("hardness"), F.col("total")), F.lit(0.0))
    wanted = F.greatest(F.lit(0.0), (F.col("many") - F.col("few")) * F.lit(float(balance)))
    return hard.crossJoin(F.broadcast(one)).select(F.col("query").alias("source"), "hardness", F.round(share * wanted).cast("bigint").alias("n_new"))


def adasyn(df: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, balance: float = 1.0, seed: int = 42) -> DataFrame:
    """Synthetic minority rows, more of them where other labels are near: source, copy, neighbour (one of the k nearest
    minority rows, by hash), vector between the two."""
    from larkspur.operators.pivots import knn_all

    own = df.filter(F.col(label) == minority)
    v = own.select(F.col(key), F.col(vector))
    each = adasyn_weights(df, key, vector, label, minority, k, balance).filter("n_new > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("n_new").cast("int"))).alias("copy"))
    near = knn_all(own, own, key, vector, k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour"))).alias("near"))
    j = each.join(near, F.col("source") == F.col("query"))
    pick = F.pmod(F.xxhash64("source", "copy", F.lit(seed)), F.size("near")).cast("int")
    j = j.select("source", "copy", F.element_at("near", pick + 1)["neighbour"].alias("neighbour"))
    j = j.join(v.select(F.col(key).alias("source"), F.col(vector).alias("a")), "source").join(v.select(F.col(key).alias("neighbour"), F.col(vector).alias("b")), "neighbour")
    u = F.pmod(F.xxhash64("source", "copy", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    return j.select("source", "copy", "neighbour", F.zip_with("a", "b", lambda x, y: x.cast("double") + u * (y.cast("double") - x.cast("double"))).alias("vector"))


def smote_cleaned(df: DataFrame, key: str, vector: str, label: str, minority, how: str = "tomek", k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE, then cleaning over old and new rows: "tomek" drops both rows of every Tomek link, "enn" keeps the rows whose
    label is that of most of their 3 neighbours. key (text; new rows: source>neighbour), vector, label."""
    from larkspur.operators import neighbors
    from larkspur.operators.graph import cut

    wide = F.col(vector).cast("array<double>").alias(vector)
    new = smote(df, key, vector, label, minority, k, seed=seed)
    new = new.select(F.concat_ws(">", "source", "neighbour").alias(key), F.col("vector").alias(vector), F.lit(minority).cast(df.schema[label].dataType).alias(label))
    rows = cut(df.select(F.col(key).cast("string").alias(key), wide, label).unionByName(new))
    if how == "enn":
        return neighbors.edited_nearest(rows, key, vector, label)
    links = cut(neighbors.tomek_links(rows, key, vector, label))
    return rows.join(links.select(F.col("x").alias(key)).union(links.select("y")), key, "left_anti")


def recommend(df: DataFrame, label: str) -> DataFrame:
    """ratio of the smallest to the largest label and a strategy by ratio and size."""
    g = df.groupBy(label).agg(F.count(N).alias("n")).agg(F.min("n").alias("few"), F.max("n").alias("many"), F.sum("n").alias("rows"))
    r = F.col("few") / F.col("many")
    return g.select(r.alias("ratio"), "rows", F.when(r > 0.3, "class_weight").when(r > 0.1, F.when(F.col("rows") < 10_000, "smote").otherwise("undersample")).otherwise(F.when(F.col("rows") < 10_000, "adasyn").otherwise("smote_enn")).alias("strategy"))


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int = 200, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by Poisson bootstrap: weights of each replicate from a hash of row and replicate,
    summed in one aggregation with one row each replicate."""
    cum = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    u = F.pmod(F.xxhash64(F.col(key), F.col("__b"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    w = sum(((u > c).cast("int") for c in cum), F.lit(0))
    each = df.select(key, value).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    m = each.groupBy("__b").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
