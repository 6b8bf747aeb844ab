"""Cleaning, encoding and scaling as estimators: fit(df) reads statistics in one aggregation and returns a model;
model.transform(df) is a projection. Statistics of categories stay tables (joined), only one-row statistics are literals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expr as X

N = "*"  # what count() counts: rows


class Model:
    """Columns replaced by expressions; ``undo`` gives the inverse where there is one. ``stats`` is what was fitted."""

    def __init__(self, exprs: dict[str, Callable[[Column], Column]], undo: dict[str, Callable[[Column], Column]] | None = None, stats: dict | None = None):
        self.exprs, self.undo, self.stats = exprs, undo or {}, stats or {}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: f(F.col(c)) for c, f in self.exprs.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: f(F.col(c)) for c, f in self.undo.items()})


def _one(df: DataFrame, columns: list[str], stats: dict[str, Callable[[str], Column]]) -> dict:
    row = df.agg(*[f(c).alias(f"{c}|{s}") for c in columns for s, f in stats.items()]).first()
    return {c: {s: row[f"{c}|{s}"] for s in stats} for c in columns}


def _quantiles(df: DataFrame, columns: list[str], shares: dict[str, float]) -> dict:
    """Exact quantiles of columns, as ``_one`` gives its statistics."""
    from larkspur.operators.quantiles import quantiles

    row = quantiles(df, {f"{c}|{s}": (f"`{c}`", p) for c in columns for s, p in shares.items()}).first()
    return {c: {s: row[f"{c}|{s}"] for s in shares} for c in columns}


def _linear(stats: dict, shift: str, scale: Callable[[dict], float]) -> Model:
    fine = {c: (s[shift], scale(s) or 1.0) for c, s in stats.items() if s[shift] is not None}
    return Model(
        {c: lambda x, m=m, k=k: (x - m) / k for c, (m, k) in fine.items()}, {c: lambda x, m=m, k=k: x * k + m for c, (m, k) in fine.items()}, stats
    )


def standard_scaler(df: DataFrame, columns: list[str]) -> Model:
    """(x - mean) / sample deviation; deviation 0 counts as 1."""
    return _linear(_one(df, columns, {"mean": F.avg, "std": F.stddev}), "mean", lambda s: s["std"])


def minmax_scaler(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Model:
    stats = _one(df, columns, {"min": F.min, "max": F.max})
    k = {c: (high - low) / ((s["max"] - s["min"]) or 1.0) for c, s in stats.items()}
    return Model(
        {c: lambda x, c=c: (x - stats[c]["min"]) * k[c] + low for c in columns}, {c: lambda x, c=c: (x - low) / k[c] + stats[c]["min"] for c in columns}, stats
    )


def robust_scaler(df: DataFrame, columns: list[str]) -> Model:
    """(x - median) / (q75 - q25), exact quantiles; a range of 0 counts as 1."""
    q = _quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return _linear(q, "median", lambda s: s["q75"] - s["q25"])


def _yeo_johnson(x: Column, p: float) -> Column:
    up = F.log1p(x) if abs(p) < 1e-9 else (F.pow(x + 1, F.lit(p)) - 1) / p
    down = -F.log1p(-x) if abs(p - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - p)) - 1) / (2 - p)
    return F.when(x >= 0, up).otherwise(down)


def _box_cox(x: Column, p: float) -> Column:
    return F.log(x) if abs(p) < 1e-9 else (F.pow(x, F.lit(p)) - 1) / p


def power_transformer(df: DataFrame, columns: list[str], grid: tuple[float, float, int] = (-2.0, 4.0, 61), method: str = "yeo-johnson") -> Model:
    """Yeo-Johnson, or Box-Cox ("box-cox", positive values only; others raise), with the exponent of largest likelihood on
    a grid, all exponents in one aggregation; then standardised."""
    lo, hi, n = grid
    made_by = {"yeo-johnson": _yeo_johnson, "box-cox": _box_cox}[method]
    if method == "box-cox":
        least = df.agg(*[F.min(c).alias(c) for c in columns]).first()
        if wrong := [c for c in columns if least[c] is not None and least[c] <= 0]:
            raise ValueError(f"Box-Cox needs positive values: {wrong}")
    ps = [lo + (hi - lo) * i / (n - 1) for i in range(n)]
    aggs = [F.var_pop(made_by(F.col(c).cast("double"), p)).alias(f"{c}|{i}") for c in columns for i, p in enumerate(ps)]
    slope = (lambda c: F.log(c)) if method == "box-cox" else (lambda c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))))
    logs = [F.avg(slope(c)).alias(f"{c}|j") for c in columns]
    row = df.agg(*aggs, *logs).first()
    best = {}
    for c in columns:
        like = [(-0.5 * math.log(max(row[f"{c}|{i}"], 1e-300)) + (p - 1) * row[f"{c}|j"], -abs(p - 1), p) for i, p in enumerate(ps)]
        best[c] = max(like)[2]
    made = df.select(*[made_by(F.col(c).cast("double"), best[c]).alias(c) for c in columns])
    stats = _one(made, columns, {"mean": F.avg, "std": F.stddev_pop})
    return Model({c: lambda x, c=c: (made_by(x.cast("double"), best[c]) - stats[c]["mean"]) / (stats[c]["std"] or 1.0) for c in columns}, stats={c: stats[c] | {"lambda": best[c]} for c in columns})


class OneHot:
    """Sorted categories; drop='first'; at most ``max_categories`` of the most frequent; unknown: 'ignore' or 'error'."""

    def __init__(self, df: DataFrame, column: str, drop_first: bool = False, max_categories: int | None = None, unknown: str = "ignore"):
        g = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(N).alias("n"))
        if max_categories is None and g.limit(10_001).count() > 10_000:
            raise ValueError(f"{column} has over 10,000 categories; set max_categories")
        found = g.orderBy(F.desc("n"), column).limit(max_categories or 10_000).collect()
        self.column, self.unknown, self.categories = column, unknown, sorted(r[0] for r in found)[1 if drop_first else 0 :]
        self.all = sorted(r[0] for r in found)

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.column)
        if self.unknown == "error":
            x = F.when(x.isNull() | x.isin(self.all), x).otherwise(F.raise_error(F.lit("unknown category")).cast("string"))
        return df.select("*", *[F.when(x == v, 1).otherwise(0).alias(f"{self.column}_{v}") for v in self.categories])


def target_encode(df: DataFrame, rows: DataFrame, column: str, target: str, smoothing: float = 1.0, least: int = 1) -> DataFrame:
    """(n mean_c + s mean) / (n + s); rare and unseen categories get the mean. Adds column_target."""
    mean = df.agg(F.avg(target).alias("__m"))
    g = df.groupBy(column).agg(F.count(N).alias("__n"), F.avg(target).alias("__c")).filter(F.col("__n") >= least)
    j = rows.join(g, column, "left").crossJoin(F.broadcast(mean))
    made = (F.col("__n") * F.col("__c") + smoothing * F.col("__m")) / (F.col("__n") + smoothing)
    return j.withColumn(f"{column}_target", F.coalesce(made, "__m")).drop("__n", "__c", "__m")


def frequency_encode(df: DataFrame, rows: DataFrame, column: str, normalise: bool = True) -> DataFrame:
    """Count of the category, or its share of all rows (nulls included); unseen: 0. Adds column_freq."""
    total = df.agg(F.count(N).alias("__t"))
    g = df.groupBy(column).agg(F.count(N).alias("__n"))
    j = rows.join(g, column, "left").crossJoin(F.broadcast(total))
    n = F.coalesce("__n", F.lit(0))
    return j.withColumn(f"{column}_freq", n / F.col("__t") if normalise else n).drop("__n", "__t")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Rank of the distinct strings from 0 (null: 'nan'). Adds column_label."""
    s = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    from larkspur.operators.stats import ranked

    names = ranked(df.select(s.alias("__s")).distinct(), F.col("__s"))
    names = names.select("__s", (F.col("rank") - 1).alias(f"{column}_label"))
    return df.withColumn("__s", s).join(names, "__s").drop("__s")


def ordinal_encode(column: Column, order: list) -> Column:
    names = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return F.try_element_at(names, column)


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    coded = label_encode(df, column)
    return coded.select(*df.columns, *[(F.shiftright(f"{column}_label", i).bitwiseAND(1)).cast("int").alias(f"{column}_bit{i}") for i in range(bits)])


def imputer(df: DataFrame, columns: list[str], strategy: str = "mean", value=None) -> Model:
    """mean, median, most_frequent (of ties the least), constant."""
    if strategy == "constant":
        return Model({c: lambda x: F.coalesce(x, F.lit(value)) for c in columns})
    if strategy == "most_frequent":
        fill = {}
        for c in columns:
            r = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(N).alias("n")).orderBy(F.desc("n"), c).first()
            fill[c] = r[0] if r else None
    else:
        found = {"mean": lambda: _one(df, columns, {"v": F.avg}), "median": lambda: _quantiles(df, columns, {"v": 0.5})}[strategy]()
        fill = {c: s["v"] for c, s in found.items()}
    return Model({c: lambda x, c=c: F.coalesce(x, F.lit(fill[c])) for c in columns}, stats=fill)


def drop_sparse_columns(df: DataFrame, most: float) -> DataFrame:
    """Without the columns whose share of nulls is above ``most``."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not (row[c] or 0) > most])


def outliers_iqr(df: DataFrame, columns: list[str], times: float = 1.5, action: str = "cap") -> DataFrame:
    """cap: to the fences of the given frame; remove: column by column, each from what the ones before left."""
    if action == "cap":
        q = _quantiles(df, columns, {"a": 0.25, "b": 0.75})
        return df.withColumns({c: X.clip(c, s["a"] - times * (s["b"] - s["a"]), s["b"] + times * (s["b"] - s["a"])) for c, s in q.items()})
    for c in columns:
        s = _quantiles(df, [c], {"a": 0.25, "b": 0.75})[c]
        if s["a"] is not None:
            df = df.filter(F.col(c).isNull() | F.col(c).between(s["a"] - times * (s["b"] - s["a"]), s["b"] + times * (s["b"] - s["a"])))
    return df


def outliers_z(df: DataFrame, columns: list[str], times: float = 3.0, action: str = "cap") -> DataFrame:
    """mean +- times sample deviations of the given frame, one aggregation. cap: to those borders; remove: rows that are
    outside in any column (nulls stay); flag: adds column_outlier."""
    q = {c: s for c, s in _one(df, columns, {"m": F.avg, "s": F.stddev}).items() if s["s"] is not None}
    border = {c: (s["m"] - times * s["s"], s["m"] + times * s["s"]) for c, s in q.items()}
    if action == "cap":
        return df.withColumns({c: X.clip(c, lo, hi) for c, (lo, hi) in border.items()})
    inside = {c: F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, (lo, hi) in border.items()}
    if action == "flag":
        return df.withColumns({f"{c}_outlier": ~v for c, v in inside.items()})
    for v in inside.values():
        df = df.filter(v)
    return df


def outliers_isolation(df: DataFrame, key: str, columns: list[str], contamination: float = 0.1, action: str = "remove", **forest) -> DataFrame:
    """By an isolation forest over all columns together: the share ``contamination`` of the rows with the highest scores is
    removed, flagged (adds outlier), or has its columns set to the medians of the other rows (cap). Rows with a null in any of
    the columns have no score and stay."""
    from larkspur.operators.explain import isolation_scores
    from larkspur.operators.graph import cut
    from larkspur.operators.quantiles import quantiles

    scores = cut(isolation_scores(df, key, columns, **forest))
    border = quantiles(scores, {"__border": ("score", 1 - contamination)})
    marked = scores.crossJoin(F.broadcast(border)).select(F.col(key), F.coalesce(F.col("score") > F.col("__border"), F.lit(False)).alias("outlier"))
    made = df.join(marked, key, "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))
    if action == "flag":
        return made
    if action == "remove":
        return made.filter("NOT outlier").drop("outlier")
    middle = _quantiles(made.filter("NOT outlier"), columns, {"m": 0.5})
    return made.withColumns({c: F.when(F.col("outlier"), F.lit(s["m"])).otherwise(F.col(c)) for c, s in middle.items()}).drop("outlier")


def rank_scale(df: DataFrame, column: str) -> DataFrame:
    """Quantile scaler to [0, 1]: (average rank - 1) / (n - 1) over the values that are not null. Adds column_quantile."""
    from larkspur.operators.stats import average_ranks

    r = average_ranks(df, column).withColumn("__q", F.coalesce(F.try_divide(F.col("rank") - 1, F.col("n") - 1), F.lit(0.0)))
    return df.join(r.select(F.col("value").alias(column), F.col("__q").alias(f"{column}_quantile")), column, "left")


def clip_percentiles(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = _quantiles(df, columns, {"a": low, "b": high})
    return df.withColumns({c: X.clip(c, s["a"], s["b"]) for c, s in q.items()})


def parse_dates(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """What does not parse is null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(c)) for c in columns})


def drop_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """The columns to keep: one goes if it correlates above ``most`` with an earlier one. One aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    return [b for b in columns if not any((row[f"{a}|{b}"] or 0) > most for a in columns[: columns.index(b)])]


def variance_threshold(df: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0) > least]


def polynomial(df: DataFrame, columns: list[str], interaction_only: bool = False) -> DataFrame:
    made = [(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i + (1 if interaction_only else 0) :]]
    return df.select("*", *made)


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 16) -> DataFrame:
    """feature, mi over equal-frequency-free equal-width bins, all features in one grouped pass."""
    bounds = _one(df, columns, {"lo": F.min, "hi": F.max})
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.least(F.lit(bins - 1), F.floor((F.col(c) - bounds[c]["lo"]) / ((bounds[c]["hi"] - bounds[c]["lo"]) or 1) * bins)).alias("bin")) for c in columns])
    cell = df.select(F.explode(each).alias("e"), F.col(label).alias("y")).groupBy("e.feature", "e.bin", "y").agg(F.count(N).alias("n"))
    w = Window.partitionBy("feature")
    p = cell.select("feature", "n", F.sum("n").over(w).alias("t"), F.sum("n").over(Window.partitionBy("feature", "bin")).alias("nb"), F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"))
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 5) -> DataFrame:
    """Nulls become what least squares on the other columns gives, fitted on the rows that have the value; columns with
    nulls take turns, ``rounds`` times, after a start from the means. One aggregation a fit; each round is checkpointed."""
    from larkspur.operators.causal import linear_fit
    from larkspur.operators.graph import cut

    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns]).first()
    gaps = [c for c in columns if r[f"n_{c}"] and r[f"m_{c}"] is not None]
    out = df.withColumns({f"__gap_{c}": F.col(c).isNull() for c in gaps}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(r[f"m_{c}"])) for c in gaps})
    for _ in range(rounds if gaps and len(columns) > 1 else 0):
        for c in gaps:
            rest = [x for x in columns if x != c]
            w = linear_fit(out.filter(~F.col(f"__gap_{c}")), rest, c)
            guess = sum((F.coalesce(F.col(x).cast("double"), F.lit(0.0)) * k for x, k in zip(rest, w[1:], strict=True)), F.lit(w[0]))
            out = out.withColumn(c, F.when(F.col(f"__gap_{c}"), guess).otherwise(F.col(c)))
        out = cut(out)
        if len(gaps) == 1:
            break  # nothing else moves
    return out.drop(*[f"__gap_{c}" for c in gaps])


def quantile_bins(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """(edge, edge] bins of equal frequency, equal edges merged. Adds column_bin."""
    from larkspur.operators.quantiles import edges

    e = edges(df, column, [i / bins for i in range(1, bins)], "__e").select(F.array_distinct("__e").alias("__e"))
    return df.crossJoin(F.broadcast(e)).withColumn(f"{column}_bin", F.size(F.filter("__e", lambda x: F.col(column) > x))).drop("__e")


def unit_norm(df: DataFrame, array: str) -> DataFrame:
    """Array divided by its Euclidean norm (0 counts as 1). Replaces the column."""
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn(array, F.transform(array, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm)))


REGISTRY = {"standard": standard_scaler, "minmax": minmax_scaler, "robust": robust_scaler, "power": power_transformer, "onehot": OneHot, "target": target_encode, "frequency": frequency_encode}


class Steps:
    """Fits and applies in order: quality, cleaning, scaling, ... Each step: frame -> frame or an estimator."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame | Model]):
        self.steps, self.models = steps, []

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.models = []
        for s in self.steps:
            made = s(df)
            self.models.append(made if isinstance(made, Model) else s)
            df = made.transform(df) if isinstance(made, Model) else made
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.models:
            df = m.transform(df) if isinstance(m, Model) else m(df)
        return df
