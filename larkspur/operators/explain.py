"""Explanations of scores: exact where the model is linear, by grids and permutations where it is any function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.quantiles import edges, quantiles

N = "*"  # what count() counts: rows
Score = Callable[[DataFrame], Column]


def linear_score(weights: dict[str, float], intercept: float = 0.0) -> Callable[[DataFrame], Column]:
    return lambda df: sum((F.col(c) * w for c, w in weights.items()), F.lit(intercept))


def grid_of(df: DataFrame, feature: str, points: int = 20, low: float = 0.05, high: float = 0.95) -> list[float]:
    """Evenly spaced between two percentiles; a bounded list on the driver."""
    r = edges(df, feature, [low, high]).first().e
    return [r[0] + (r[1] - r[0]) * i / (points - 1) for i in range(points)]


def ice(df: DataFrame, key: str, feature: str, score: Score, grid: list[float]) -> DataFrame:
    """key, x, score with the feature set to each grid value."""
    wide = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    return wide.select(key, F.col(feature).alias("x"), score(wide).alias("score"))


def partial_dependence(df: DataFrame, feature: str, score: Score, grid: list[float]) -> DataFrame:
    wide = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    return wide.groupBy(F.col(feature).alias("x")).agg(F.avg(score(wide)).alias("mean_score"))


def partial_dependence_2d(df: DataFrame, a: str, b: str, score: Score, grid_a: list[float], grid_b: list[float]) -> DataFrame:
    """Mean score with both features set, for every pair of the two grids, in one aggregation: a, b, mean_score."""
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("a"), F.lit(float(y)).alias("b")) for x in grid_a for y in grid_b])
    wide = df.drop(a, b).withColumn("__g", F.explode(pairs)).withColumns({a: F.col("__g.a"), b: F.col("__g.b")})
    return wide.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.avg(score(wide)).alias("mean_score"))


def interventions(df: DataFrame, feature: str, values: list[float], score: Score) -> DataFrame:
    """The feature set to each value for all rows: value, mean_score, effect (on the mean score of the rows as they are)."""
    before = df.agg(F.avg(score(df)).alias("__before"))
    done = partial_dependence(df, feature, score, values)
    return done.crossJoin(F.broadcast(before)).select(F.col("x").alias("value"), "mean_score", (F.col("mean_score") - F.col("__before")).alias("effect"))


def counterfactuals(df: DataFrame, key: str, feature: str, values: list[float], score: Score, threshold: float) -> DataFrame:
    """For each row the value of the feature nearest to its own (ties: the lower) that takes its score to the other side of
    the threshold (score >= threshold): key, original, value, score, new_score. Rows that no value turns are left out."""
    now = df.withColumns({"__s": score(df), "__x": F.col(feature).cast("double")})
    wide = now.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in values])))
    wide = wide.withColumn("__n", score(wide)).filter((F.col("__n") >= threshold) != (F.col("__s") >= threshold))
    best = F.struct(F.abs(F.col(feature) - F.col("__x")).alias("d"), F.col(feature).alias("value"), F.col("__n").alias("new_score"), F.col("__s").alias("score"), F.col("__x").alias("original"))
    g = wide.groupBy(key).agg(F.min(best).alias("b"))
    return g.select(key, "b.original", "b.value", "b.score", "b.new_score")


def ale(df: DataFrame, feature: str, score: Score, bins: int = 10) -> DataFrame:
    """Accumulated local effects over quantile bins: bin, effect (running sum of mean differences)."""
    borders = edges(df, feature, [i / bins for i in range(bins + 1)]).first().e
    x = F.col(feature)
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), sum((x > e).cast("int") for e in borders) - 1))
    arr = F.array(*[F.lit(float(e)) for e in borders])
    b = df.withColumn("__b", at)
    hi = b.withColumn(feature, arr[F.col("__b") + 1])
    lo = b.withColumn(feature, arr[F.col("__b")])
    both = hi.select("__b", score(hi).alias("s")).union(lo.select("__b", (-score(lo)).alias("s")))
    n = b.groupBy("__b").agg(F.count(N).alias("n"))
    d = both.groupBy("__b").agg(F.sum("s").alias("s")).join(n, "__b")
    return d.select(F.col("__b").cast("int").alias("bin"), F.sum(F.col("s") / F.col("n")).over(Window.orderBy("__b")).alias("effect"))


def permutation_importance(df: DataFrame, key: str, features: list[str], score: Score, loss: Callable[[Column], Column], seed: int = 42) -> DataFrame:
    """feature, importance: loss with the feature's values moved to other rows, less the loss. Values move by the order
    of a hash within hash buckets of about a thousand rows, so no sort of the whole table is needed."""
    base = df.agg(F.avg(loss(score(df))).alias("base"))
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(max(1, df.count() // 1000)))
    found = None
    for i, f in enumerate(features):
        a = Window.partitionBy("__b").orderBy(F.xxhash64(F.col(key), F.lit(seed + i)), key)
        moved = df.withColumn("__b", bucket)
        moved = moved.withColumn(f, F.coalesce(F.lead(f).over(a), F.first(f).over(a.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        row = moved.agg(F.lit(f).alias("feature"), F.avg(loss(score(moved))).alias("moved"))
        found = row if found is None else found.union(row)
    return found.crossJoin(F.broadcast(base)).select("feature", (F.col("moved") - F.col("base")).alias("importance"))


def linear_shap(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Exact values of a linear model: key, feature, phi = w (x - mean)."""
    mean = df.agg(*[F.avg(c).alias(f"m_{c}") for c in weights])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"m_{c}")) * w).alias("phi")) for c, w in weights.items()])
    return df.crossJoin(F.broadcast(mean)).select(key, F.inline(each))


def global_shap(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def top_reasons(phi: DataFrame, key: str, k: int = 2) -> DataFrame:
    """The k features of largest |phi| of each row (ties: by name): key, feature, phi, place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "feature"))
    return phi.withColumn("place", place).filter(F.col("place") <= k)


def differential_shap(a: DataFrame, b: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """How much more each feature adds to the mean score of ``a`` than to that of ``b``, around their common mean."""
    both = a.select(key, *weights, F.lit(1).alias("__side")).unionByName(b.select(key, *weights, F.lit(0).alias("__side")))
    phi = linear_shap(both.withColumn("__k", F.struct("__side", key)), "__k", weights)
    side = F.col("__k")["__side"]
    return phi.groupBy("feature").agg((F.avg(F.when(side == 1, F.col("phi"))) - F.avg(F.when(side == 0, F.col("phi")))).alias("difference"))


def uncertainty(p: Column) -> dict[str, Column]:
    """entropy (natural) and 1 - max p of a binary probability."""
    part = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    return {"entropy": part(p) + part(1 - p), "doubt": 1 - F.greatest(p, 1 - p)}


def confidence_bands(df: DataFrame, score: str, label: str, bands: int = 5) -> DataFrame:
    """band of max(p, 1-p) over 0.5..1, n and accuracy."""
    p = F.col(score)
    conf = F.greatest(p, 1 - p)
    at = F.least(F.lit(bands - 1), F.floor(F.round((conf - 0.5) * 2 * bands, 9)))
    return df.groupBy(at.cast("int").alias("band")).agg(F.count(N).alias("n"), F.avg(((p >= 0.5).cast("int") == F.col(label).cast("int")).cast("double")).alias("accuracy"))


def interaction_strength(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """(|corr(ab, t)| + |corr(a, t where b is high) - corr(a, t where b is low)|) / 2; high: above b's median."""
    mid = quantiles(df, {"__mid": (b, 0.5)})
    j = df.crossJoin(F.broadcast(mid))
    part = lambda c: F.corr(F.when(c, F.col(a)), F.when(c, F.col(target)))
    hi, lo = part(F.col(b) > F.col("__mid")), part(F.col(b) <= F.col("__mid"))
    return j.agg(((F.abs(F.corr(F.col(a) * F.col(b), F.col(target))) + F.abs(hi - lo)) / 2).alias("strength"))


def interaction_f_test(df: DataFrame, a: str, b: str, target: str) -> tuple[float, int, int]:
    """F, and its degrees of freedom, of the product of two features in a least-squares model that has both already; all
    sums come from one aggregation."""
    from larkspur.operators.select import Sums

    s = Sums(df.withColumn("__ab", F.col(a) * F.col(b)), [a, b, "__ab"], target)
    plain, full = s.fit([0, 1])[1], s.fit([0, 1, 2])[1]
    return (full - plain) / (max(1 - full, 1e-300) / max(s.n - 4, 1)), 1, s.n - 4


def blind_spots(train: DataFrame, new: DataFrame, features: list[str]) -> DataFrame:
    """feature, outside: rows of ``new`` outside the range of ``train``."""
    r = train.agg(*[x for f in features for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))])
    wide = new.crossJoin(F.broadcast(r)).agg(*[F.count_if((F.col(f) < F.col(f"lo_{f}")) | (F.col(f) > F.col(f"hi_{f}"))).alias(f) for f in features])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("outside")) for f in features])))


def rank_rules(rules: DataFrame, confidence: float = 0.7, support: int = 10, longest: int = 5) -> DataFrame:
    """rules: conditions array, confidence, support -> filtered and ranked by confidence x ln(support + 1)."""
    keep = rules.filter((F.col("confidence") >= confidence) & (F.col("support") >= support) & (F.size("conditions") <= longest))
    return keep.withColumn("weight", F.col("confidence") * F.log(F.col("support") + 1))


def heat_map(df: DataFrame, amount: str, ts: str, edges: list[float]) -> DataFrame:
    """n and mean by amount band and hour."""
    x = F.col(amount)
    band = sum(((x > e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(band.alias("band"), F.hour(ts).alias("hour")).agg(F.count(N).alias("n"), F.avg(x).alias("mean"))


def k_centers(df: DataFrame, key: str, vector: str, k: int) -> list:
    """Greedy k-centres: each next prototype is the row farthest from those chosen; k passes of one aggregation."""
    from larkspur.operators.neighbors import distance

    first = df.agg(F.min(F.struct(key, vector)).alias("s")).first().s
    chosen, vectors = [first[0]], [list(first[1])]
    while len(chosen) < k:
        near = F.least(*[distance(F.col(vector), F.array(*[F.lit(float(x)) for x in v])) for v in vectors], F.lit(float("inf")))
        r = df.agg(F.max_by(F.struct(key, vector), F.struct(near, -F.col(key))).alias("s")).first().s
        if r[0] in chosen:
            break
        chosen.append(r[0])
        vectors.append(list(r[1]))
    return chosen


def criticisms(df: DataFrame, prototypes: DataFrame, key: str, vector: str, k: int = 5, most: int | None = None) -> DataFrame:
    """The k rows that the prototypes stand for worst: key, distance to the nearest of them (ties: least key). Raises where
    there are more than ``most`` prototypes, if it is given."""
    from larkspur.operators.pivots import knn_all

    if most is not None and (n := prototypes.count()) > most:
        raise ValueError(f"{n} prototypes; at most {most}")
    near = knn_all(df, prototypes, key, vector, 1, same=False)
    return near.select(F.col("query").alias(key), "distance").orderBy(F.desc("distance"), key).limit(k)


def nearest_examples(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """query, label, n, share: the labels of the k nearest rows."""
    from larkspur.operators.neighbors import knn

    near = knn(queries, rows, key, vector, k).join(rows.select(F.col(key).alias("neighbour"), F.col(label).alias("label")), "neighbour")
    return near.groupBy("query", "label").agg(F.count(N).alias("n")).withColumn("share", F.col("n") / k)


def tree_rules(df: DataFrame, features: list[str], label: str, depth: int = 3) -> DataFrame:
    """Rules of a decision tree: conditions, prediction, confidence, support, measured on the rows in one pass."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="__f").transform(df)
    model = DecisionTreeClassifier(featuresCol="__f", labelCol=label, maxDepth=depth, seed=1).fit(v)
    paths: list[tuple[list[str], float]] = []

    def walk(node, conditions: list[str]) -> None:
        if node.numDescendants() == 0:
            paths.append((conditions, node.prediction()))
            return
        s = node.split()
        name, cut = features[s.featureIndex()], s.threshold()
        walk(node.leftChild(), [*conditions, f"`{name}` <= {cut!r}"])
        walk(node.rightChild(), [*conditions, f"`{name}` > {cut!r}"])

    walk(model._java_obj.rootNode(), [])
    at = F.coalesce(*[F.when(F.expr(" AND ".join(c) or "true"), i) for i, (c, _) in enumerate(paths)])
    g = df.groupBy(at.alias("rule"), F.col(label).cast("double").alias("__y")).agg(F.count(N).alias("n"))
    names = df.sparkSession.createDataFrame([(i, c, p) for i, (c, p) in enumerate(paths)], "rule int, conditions array<string>, prediction double")
    j = g.join(F.broadcast(names), "rule")
    return j.groupBy("rule", "conditions", "prediction").agg(F.sum("n").alias("support"), (F.sum(F.when(F.col("__y") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("confidence"))


def merge_rules(rules: DataFrame, least: float = 0.8) -> DataFrame:
    """Rules of one prediction whose conditions' Jaccard similarity reaches ``least`` go into the one of greatest support:
    a few rules, compared on conditions they share."""
    r = rules.select("rule", "prediction", "support", "conditions")
    a, b = (r.select("prediction", F.col("rule").alias(x), F.col("support").alias(f"s{x}"), F.col("conditions").alias(f"c{x}"), F.explode("conditions").alias("c")) for x in ("a", "b"))
    p = a.join(b, ["prediction", "c"]).filter("a <> b").select("a", "b", "sa", "sb", (F.size(F.array_intersect("ca", "cb")) / F.size(F.array_union("ca", "cb"))).alias("j")).distinct()
    gone = p.filter((F.col("j") >= least) & ((F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") < F.col("a"))))).select(F.col("a").alias("rule")).distinct()
    return rules.join(gone, "rule", "left_anti")


def concept_direction(positive: DataFrame, negative: DataFrame, vector: str) -> list[float]:
    """The unit vector from the mean of the negatives to the mean of the positives: one aggregation by position each."""
    mean = lambda d: {r.i: r.m for r in d.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()}
    p, n = mean(positive), mean(negative)
    gap = [p.get(i, 0.0) - n.get(i, 0.0) for i in range(max([*p, *n], default=-1) + 1)]
    size = sum(g * g for g in gap) ** 0.5 or 1.0
    return [g / size for g in gap]


def concept_scores(df: DataFrame, key: str, vector: str, direction: list[float]) -> DataFrame:
    """Projection of each row on the direction."""
    d = F.array(*[F.lit(x) for x in direction])
    return df.select(key, F.aggregate(F.zip_with(vector, d, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("concept"))


def backward_elimination(features: list[str], loss: Callable[[list[str]], float], least: int = 1, tolerance: float = 0.0) -> list[tuple[list[str], float]]:
    """Drops the feature whose absence costs least while the loss grows by no more than ``tolerance``: steps taken."""
    steps = [(list(features), loss(features))]
    while len(steps[-1][0]) > least:
        now, base = steps[-1]
        options = [([f for f in now if f != gone], gone) for gone in now]
        cost, kept = min((loss(rest), rest) for rest, _ in options)
        if cost > base + tolerance:
            break
        steps.append((kept, cost))
    return steps


def friedman_h(df: DataFrame, a: str, b: str, score: Score, points: int = 5) -> float:
    """Share of the joint partial dependence's variance that is interaction, over a grid of points x points."""
    ga, gb = grid_of(df, a, points), grid_of(df, b, points)
    wide = df.drop(a, b).withColumn(a, F.explode(F.array(*map(F.lit, ga)))).withColumn(b, F.explode(F.array(*map(F.lit, gb))))
    pd = {(r[0], r[1]): r.m for r in wide.groupBy(a, b).agg(F.avg(score(wide)).alias("m")).collect()}
    mean = sum(pd.values()) / len(pd)
    pa = {x: sum(pd[x, y] for y in gb) / len(gb) - mean for x in ga}
    pb = {y: sum(pd[x, y] for x in ga) / len(ga) - mean for y in gb}
    total = sum((v - mean) ** 2 for v in pd.values())
    return (sum((pd[x, y] - mean - pa[x] - pb[y]) ** 2 for x in ga for y in gb) / total) ** 0.5 if total else 0.0


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: trees grown on the driver from samples of at most ``sample`` rows each (smallest hashes under the
    tree's seed), sent to the rows as one bounded list: key, score in 0..1, higher is stranger."""
    import math
    import random

    import pyarrow as pa

    per = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(key, "tree", F.lit(seed)), key))
    n = df.count()
    share = min(1.0, 2 * sample / max(n, 1))
    picked = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    picked = picked.filter(F.pmod(F.xxhash64(key, "tree", F.lit(seed + 1)), F.lit(1_000_000)) < share * 1_000_000).withColumn("r", per).filter(F.col("r") <= sample)
    rows: dict[int, list] = {}
    for r in picked.select("tree", *columns).collect():  # at most trees x sample rows
        rows.setdefault(r[0], []).append(list(r)[1:])
    depth_of = lambda m: 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)

    def grow(x: list, r: random.Random, left: int):
        if left == 0 or len(x) <= 1:
            return depth_of(len(x))
        usable = [i for i in range(len(columns)) if min(v[i] for v in x) < max(v[i] for v in x)]
        if not usable:
            return depth_of(len(x))
        i = r.choice(usable)
        cut = r.uniform(min(v[i] for v in x), max(v[i] for v in x))
        return (i, cut, grow([v for v in x if v[i] < cut], r, left - 1), grow([v for v in x if v[i] >= cut], r, left - 1))

    forest = [grow(sorted(x), random.Random(seed + t), math.ceil(math.log2(sample))) for t, x in sorted(rows.items())]
    usual = depth_of(min(sample, max(map(len, rows.values()), default=2))) or 1.0

    def path(tree, v) -> float:
        d = 0
        while isinstance(tree, tuple):
            tree, d = tree[2] if v[tree[0]] < tree[1] else tree[3], d + 1
        return d + tree

    def run(batches):
        for b in batches:
            values = list(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True))
            score = [None if None in v else 2 ** (-sum(path(t, v) for t in forest) / max(1, len(forest)) / usual) for v in values]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=[key, "score"])

    kind = dict(df.dtypes)[key]
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, f"{key} {kind}, score double")
