"""Explanations of single predictions and models that stand in for others: local linear models, anchors, surrogates, shares of
variance. The score is any function of a DataFrame's columns; all sampling is by hash, so results repeat."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import cut

N = "*"  # what count() counts: rows
Score = Callable[[DataFrame], Column]


def _normal(*parts: Column) -> Column:
    """A standard normal number from a hash of the parts (Box-Muller)."""
    u = (F.pmod(F.xxhash64(*parts, F.lit(1)), F.lit(1 << 40)) + 1) / float(1 << 40)
    v = F.pmod(F.xxhash64(*parts, F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
    return F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * math.pi))


# ---------------------------------------------------------------- local linear models


def perturbed(
    df: DataFrame, key: str, features: list[str], scale: dict[str, float], samples: int = 200, seed: int = 42
) -> DataFrame:
    """Rows around each row: ``samples`` pairs of a step and its opposite, normal in every feature in units of ``scale``. The
    rows with their features moved and the step as an array ``__d``. Opposite steps cancel what is even in them, so curvature
    and products do not leak into the linear part."""
    each = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("__sign", F.explode(F.lit([1.0, -1.0])))
    step = [F.col("__sign") * _normal(F.col(key), F.col("__i"), F.lit(j), F.lit(seed)) for j in range(len(features))]
    each = each.withColumn("__d", F.array(*step))
    moved = {f: F.col(f).cast("double") + F.get("__d", F.lit(j)) * float(scale[f]) for j, f in enumerate(features)}
    return each.withColumns(moved).drop("__i", "__sign")


def lime(
    df: DataFrame,
    key: str,
    features: list[str],
    score: Score,
    samples: int = 200,
    width: float | None = None,
    ridge: float = 0.0,
    top: int | None = None,
    scale: dict[str, float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """For each row a linear model of the score around it: key, feature, effect (of one ``scale`` unit; by default the
    feature's standard deviation), local_score (the model's value at the row) and fidelity (weighted R2). Steps count by a
    Gaussian kernel of ``width`` (0.75 sqrt(features) by default). ``top``: only so many features of largest effect.

    The weighted sums of all rows are one aggregation with a partial one before the shuffle, so of the ``2 samples`` rows
    made of each row only (p + 2)(p + 3) / 2 numbers leave a task; the small systems are solved in Arrow batches."""
    if scale is None:
        found = df.agg(*[F.stddev(f).alias(f"s{j}") for j, f in enumerate(features)]).first()
        scale = {f: float(found[f"s{j}"] or 1.0) for j, f in enumerate(features)}
    near = width or 0.75 * math.sqrt(len(features))
    rows = perturbed(df, key, features, scale, samples, seed)
    square = F.aggregate("__d", F.lit(0.0), lambda s, x: s + x * x)
    weighed = rows.select(F.col(key), "__d", score(rows).cast("double").alias("__y"), F.exp(-square / (near * near)).alias("__w"))
    terms = [F.lit(1.0), *(F.get("__d", F.lit(j)) for j in range(len(features))), F.col("__y")]
    sums = [F.sum(F.col("__w") * terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    totals = weighed.groupBy(key).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    p = len(features) + 1
    kind = totals.schema[key].dataType.simpleString()

    def solve(batches):
        at = np.triu_indices(p + 1)
        for b in batches:
            full = np.zeros((b.num_rows, p + 1, p + 1))
            for c, (i, j) in enumerate(zip(*at, strict=True)):
                full[:, i, j] = full[:, j, i] = b.column(c + 1).to_numpy(zero_copy_only=False)
            a, y, yy = full[:, :p, :p], full[:, :p, p], full[:, p, p]
            w = np.linalg.solve(a + ridge * a[:, :1, :1] * np.diag([0.0] + [1.0] * (p - 1)), y[:, :, None])[:, :, 0] if b.num_rows else y
            rest = yy - 2 * (w * y).sum(1) + np.einsum("ni,nij,nj->n", w, a, w)
            whole = yy - y[:, 0] ** 2 / a[:, 0, 0]
            r2 = np.where(whole > 1e-12 * np.maximum(1.0, yy), 1 - rest / np.where(whole > 0, whole, 1), 1.0)
            effects = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * (p - 1) + 1, p - 1), pa.int32()), pa.array(w[:, 1:].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), effects, pa.array(w[:, 0]), pa.array(r2)], names=[key, "e", "local_score", "fidelity"])

    solved = totals.mapInArrow(solve, f"`{key}` {kind}, e array<double>, local_score double, fidelity double")
    named = F.arrays_zip(F.lit(features).alias("feature"), F.col("e").alias("effect"))
    if top is not None:
        order = lambda x, y: F.when(F.abs(x["effect"]) != F.abs(y["effect"]), F.signum(F.abs(y["effect"]) - F.abs(x["effect"])).cast("int"))
        named = F.slice(F.array_sort(named, lambda x, y: order(x, y).when(x["feature"] < y["feature"], -1).otherwise(1)), 1, top)
    return solved.select(key, F.inline(named), "local_score", "fidelity")


# ---------------------------------------------------------------- anchors


def wilson_low(good: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval of a share."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def anchors(
    df: DataFrame,
    key: str,
    edges: dict[str, list[float]],
    predicted: Column,
    precision: float = 0.95,
    beam: int = 2,
    longest: int = 5,
    z: float = 1.96,
) -> DataFrame:
    """For each row the conditions that hold its prediction: key, features (in order of name), bins (of these features),
    precision (share of the rows that meet the conditions with the same prediction), coverage (share of all rows that meet
    them), bound (lower end of the precision's confidence interval) and anchored (the bound reaches ``precision``).

    Every feature of ``edges`` is cut at its edges (bin i: above i of them; nulls are bin -1). Conditions grow by one feature
    at a time; of those that reach the precision the one of largest coverage is taken (ties: first features by name), else
    the ``beam`` ones of best bound go on, up to ``longest`` features; a row that none holds gets the one of best bound.

    Rows of one cell (their bins and the prediction) have the same anchor, so the search runs over the cells, of which there
    are no more than the bins allow, and the counts of a round are one aggregation of the cells."""
    names = sorted(edges)
    bins = F.array(*[F.coalesce(sum(((F.col(f) > float(e)).cast("int") for e in edges[f]), F.lit(0)), F.lit(-1)) for f in names])
    rows = df.select(F.col(key), bins.alias("cell"), predicted.cast("int").alias("y"))
    cells = cut(rows.groupBy("cell", "y").agg(F.count(N).alias("n")))
    total = cells.agg(F.sum("n").alias("total"))
    values = lambda: F.transform("rule", lambda i: F.get("cell", i))
    live = cells.select("cell", "y", F.array().cast("array<int>").alias("rule"))
    out = None
    for size in range(1, min(longest, len(names)) + 1):
        free = F.filter(F.lit(list(range(len(names)))), lambda i: ~F.array_contains("rule", i))
        grown = live.select("cell", "y", "rule", F.explode(free).alias("f"))
        grown = grown.select("cell", "y", F.array_sort(F.array_append("rule", F.col("f"))).alias("rule")).distinct().withColumn("at", values())
        sets = F.explode(F.lit([list(s) for s in combinations(range(len(names)), size)]))
        counts = cells.select("cell", "y", "n", sets.alias("rule")).select("rule", values().alias("at"), "y", "n").groupBy("rule", "at", "y").agg(F.sum("n").alias("good"))
        every = counts.groupBy("rule", "at").agg(F.sum("good").alias("n"))
        judged = grown.join(counts, ["rule", "at", "y"]).join(every, ["rule", "at"])
        judged = judged.select("cell", "y", "rule", "at", "n", (F.col("good") / F.col("n")).alias("precision"), wilson_low(F.col("good"), F.col("n"), z).alias("bound"))
        judged = cut(judged.withColumn("anchored", F.col("bound") >= precision))
        by = Window.partitionBy("cell", "y")
        best = judged.filter("anchored").withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "rule"))).filter("place = 1").drop("place")
        rest = judged.join(best.select("cell", "y"), ["cell", "y"], "left_anti")
        order = (F.desc(F.round("bound", 12)), F.desc("n"), "rule")
        live = cut(rest.withColumn("place", F.row_number().over(by.orderBy(*order))).filter(F.col("place") <= beam))
        out = best if out is None else out.unionByName(best)
        if size == min(longest, len(names)):
            out = out.unionByName(live.filter("place = 1").drop("place"))
        elif live.isEmpty():
            break
        live = live.select("cell", "y", "rule")
    found = rows.join(out, ["cell", "y"]).crossJoin(F.broadcast(total))
    named = F.transform("rule", lambda i: F.get(F.lit(names), i))
    return found.select(key, named.alias("features"), F.col("at").alias("bins"), "precision", (F.col("n") / F.col("total")).alias("coverage"), "bound", "anchored")


# ---------------------------------------------------------------- models that stand in


def surrogate_linear(df: DataFrame, features: list[str], score: Score) -> tuple[list[float], float]:
    """Intercept and weights of the linear model nearest to the score over the rows, and its fidelity (R2): one aggregation."""
    from larkspur.operators.causal import linear_fit

    own = df.select(*features, score(df).cast("double").alias("__s"))
    w = linear_fit(own, features, "__s")
    guess = sum((F.col(f) * float(x) for f, x in zip(features, w[1:], strict=True)), F.lit(float(w[0])))
    return list(w), fidelity(own, guess, F.col("__s"))


def fidelity(df: DataFrame, guess: Column, score: Column) -> float:
    """1 - squared error of the guess over the score's variance; 1 where the score is constant and met."""
    r = df.agg(F.avg((guess - score) ** 2).alias("e"), F.var_pop(score).alias("v")).first()
    return 1.0 if r.e is not None and r.e <= 1e-18 else 1 - r.e / r.v if r.v else 0.0


def surrogate_tree(df: DataFrame, features: list[str], score: Score, depth: int = 5, splits: int = 64) -> tuple[DataFrame, float]:
    """A regression tree of the score: its leaves (leaf, conditions, value, n, error: root mean square within) and its
    fidelity. Leaf values are measured on the rows in one pass."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    own = df.select(*features, score(df).cast("double").alias("__s"))
    v = VectorAssembler(inputCols=features, outputCol="__f").transform(own)
    model = DecisionTreeRegressor(featuresCol="__f", labelCol="__s", maxDepth=depth, maxBins=splits, seed=1).fit(v)
    leaves: list[list[str]] = []

    def walk(node, conditions: list[str]) -> None:
        if node.numDescendants() == 0:
            leaves.append(conditions)
            return
        name, at = features[node.split().featureIndex()], node.split().threshold()
        walk(node.leftChild(), [*conditions, f"`{name}` <= {at!r}"])
        walk(node.rightChild(), [*conditions, f"`{name}` > {at!r}"])

    walk(model._java_obj.rootNode(), [])
    leaf = F.coalesce(*[F.when(F.expr(" AND ".join(c) or "true"), i) for i, c in enumerate(leaves)])
    g = own.groupBy(leaf.alias("leaf")).agg(F.avg("__s").alias("value"), F.count(N).alias("n"), F.stddev_pop("__s").alias("error"))
    names = df.sparkSession.createDataFrame(list(enumerate(leaves)), "leaf int, conditions array<string>")
    found = cut(g.join(F.broadcast(names), "leaf"))
    r = found.agg(F.sum(F.col("n") * F.col("error") ** 2).alias("e"), F.sum("n").alias("n")).first()
    v = own.agg(F.var_pop("__s").alias("v")).first().v
    return found, 1 - r.e / r.n / v if v else 1.0


def variance_shares(df: DataFrame, features: dict[str, Column], score: Score) -> DataFrame:
    """Functional ANOVA over the rows: terms (one feature or two), share of the score's variance that the means by this
    feature, or by both beyond each alone, explain. Features are columns of few values (bins); sums come from one aggregation
    by their cells, and all means from these."""
    own = df.select(*[c.alias(f) for f, c in features.items()], score(df).cast("double").alias("__s"))
    sums = [F.sum("__s").alias("__sum"), F.count("__s").alias("__n"), F.sum(F.col("__s") ** 2).alias("__square")]
    cells = cut(own.groupBy(*features).agg(*sums))
    add = [F.sum(c).alias(c) for c in ("__sum", "__n", "__square")]
    r = cells.agg(*add).first()
    mean = r["__sum"] / r["__n"] if r["__n"] else 0.0
    spread = max(r["__square"] / r["__n"] - mean * mean, 0.0) if r["__n"] else 0.0
    gap = F.col("__n") * (F.col("__sum") / F.col("__n") - mean) ** 2
    found = None
    for t in [*((f,) for f in features), *combinations(features, 2)]:
        one = cells.groupBy(*t).agg(*add[:2]).agg((F.sum(gap) / (r["__n"] * spread or 1.0)).alias("v"))
        one = one.select(F.lit(list(t)).alias("terms"), "v")
        found = one if found is None else found.unionByName(one)
    found = cut(found)  # a row for each term
    alone = found.filter("size(terms) = 1").select(F.get("terms", F.lit(0)).alias("f"), F.col("v").alias("alone"))
    sides = found.select("terms", "v", F.explode("terms").alias("f")).join(F.broadcast(alone), "f")
    sides = sides.groupBy("terms", "v").agg(F.sum("alone").alias("alone"))
    return sides.select("terms", F.when(F.size("terms") == 1, F.col("v")).otherwise(F.col("v") - F.col("alone")).alias("share"))
