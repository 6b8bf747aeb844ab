"""Profiles, quality scores, type plans and expectations; each a fixed number of passes over the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import expr as X
from larkspur.operators.quantiles import quantiles

N = "*"  # what count() counts: rows


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: n, null_pct, unique, mean, median, std, q1, q3, lo, hi, skew, kurt, outliers (IQR fences):
    the quantiles of all columns together, one aggregation of the other statistics, one of the counts outside the fences."""
    columns = columns or _numeric(df)
    stats = {
        "n": F.count, "null_pct": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100, "unique": F.countDistinct, "mean": F.avg, "std": F.stddev, "lo": F.min, "hi": F.max, "skew": X.skew_corrected, "kurt": X.kurtosis_corrected,
    }
    ranks = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    found = quantiles(df, {f"{c}|{s}": (f"`{c}`", p) for c in columns for s, p in ranks.items()})
    wide = df.agg(*[f(c).cast("double").alias(f"{c}|{s}") for c in columns for s, f in stats.items()]).crossJoin(F.broadcast(found))
    far = []
    for c in columns:
        q1, q3 = F.col(f"{c}|q1"), F.col(f"{c}|q3")
        far.append(F.count_if((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))).cast("double").alias(f"{c}|outliers"))
    out = df.select(*columns).crossJoin(F.broadcast(wide.select(*[F.col(f"`{c}|{s}`").alias(f"{c}|{s}") for c in columns for s in ("q1", "q3")]))).agg(*far)
    both = wide.crossJoin(out)
    names = ["n", "null_pct", "unique", "mean", "median", "std", "q1", "q3", "lo", "hi", "skew", "kurt", "outliers"]
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in names]) for c in columns])))


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: n, null_pct, unique, shortest, longest, mean_length, with_blanks, mixed_case."""
    stats = {
        "n": F.count, "null_pct": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100, "unique": F.countDistinct, "shortest": lambda c: F.min(F.length(c)), "longest": lambda c: F.max(F.length(c)),
        "mean_length": lambda c: F.avg(F.length(c)), "with_blanks": lambda c: F.count_if(F.trim(c) != F.col(c)), "mixed_case": lambda c: F.count_if((F.lower(c) != F.col(c)) & (F.upper(c) != F.col(c))),
    }
    wide = df.agg(*[f(c).cast("double").alias(f"{c}|{s}") for c in columns for s, f in stats.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns])))


def _severity(share: Column, medium: float, high: float) -> Column:
    return F.when(share > high, "high").when(share > medium, "medium").otherwise("low")


def issues(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What is wrong with a table: column (null for the whole row), issue, n, share, severity. Nulls (low, over 10 % medium, over
    50 % high), duplicate rows (1 %, 10 %), numbers outside the quartile fences (of those there are; 5 %, 10 %), text in more
    than one of upper, lower and title case, and text with blanks around it (of the values; always low). Issues without rows are
    left out. One pass for the quartiles, one for all counts, one group-by for duplicates."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    texts = [c for c in columns if isinstance(kinds[c], T.StringType)]
    counts = {"rows": F.count(N)} | {f"null|{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in columns}
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    if numbers:
        shares = {"q1": 0.25, "q3": 0.75}
        q = quantiles(df, {f"{s}|{c}": (f"`{c}`", p) for c in numbers for s, p in shares.items()})
        rows = rows.crossJoin(F.broadcast(q))
        for c in numbers:
            a, b = F.col(f"`q1|{c}`"), F.col(f"`q3|{c}`")
            counts[f"outlier|{c}"] = F.count_if(~F.col(f"`{c}`").between(a - 1.5 * (b - a), b + 1.5 * (b - a)))
    for c in texts:
        x = F.col(f"`{c}`")
        cased = F.upper(x) != F.lower(x)
        for name, form in (("upper", F.upper(x)), ("lower", F.lower(x)), ("title", F.initcap(x))):
            counts[f"{name}|{c}"] = F.count_if(cased & (x == form) & ((F.upper(x) != x) & (F.lower(x) != x) if name == "title" else F.lit(True)))
        counts[f"blank|{c}"] = F.count_if(F.trim(x) != x)
    wide = rows.agg(*[v.alias(k) for k, v in counts.items()])
    distinct = df.select(*[F.col(f"`{c}`") for c in columns]).distinct().agg(F.count(N).alias("distinct"))
    wide = wide.crossJoin(F.broadcast(distinct))
    at = lambda k: F.col(f"`{k}`")
    found = []

    def add(column: str | None, issue: str, n: Column, of: Column, medium: float, high: float) -> None:
        share = n / F.nullif(of, F.lit(0))
        found.append(F.struct(F.lit(column).cast("string").alias("column"), F.lit(issue).alias("issue"), n.cast("bigint").alias("n"), share.alias("share"), _severity(share, medium, high).alias("severity")))

    add(None, "duplicate", at("rows") - F.col("distinct"), at("rows"), 0.01, 0.1)
    for c in columns:
        add(c, "null", at(f"null|{c}"), at("rows"), 0.1, 0.5)
    for c in numbers:
        add(c, "outlier", at(f"outlier|{c}"), at("rows") - at(f"null|{c}"), 0.05, 0.1)
    for c in texts:
        forms = [at(f"{k}|{c}") for k in ("upper", "lower", "title")]
        several = sum(((f > 0).cast("int") for f in forms), F.lit(0)) > 1
        add(c, "case", F.when(several, forms[0] + forms[1] + forms[2] - F.greatest(*forms)).otherwise(0), at("rows") - at(f"null|{c}"), 1.0, 1.0)
        add(c, "blank", at(f"blank|{c}"), at("rows") - at(f"null|{c}"), 1.0, 1.0)
    return wide.select(F.inline(F.array(*found))).filter("n > 0")


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """column, value, n, place of the most frequent values of each column."""
    from pyspark.sql import Window

    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e"))
    g = each.groupBy("e.column", "e.value").agg(F.count(N).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_last()))
    return g.select("column", "value", "n", place.cast("bigint").alias("place")).filter(F.col("place") <= n)


def type_plan(df: DataFrame, columns: list[str]) -> DataFrame:
    """For text columns the narrowest type that all values have: column, type. One aggregation."""
    flags = F.array(*map(F.lit, ("true", "false", "1", "0", "yes", "no", "y", "n", "t", "f")))
    aggs = []
    for c in columns:
        x, full = F.trim(F.col(c)), F.col(c).isNotNull() & (F.trim(c) != "")
        number = x.try_cast("decimal(38,10)")
        aggs += [
            F.count_if(full).alias(f"{c}|n"), F.count_if(full & F.array_contains(flags, F.lower(x))).alias(f"{c}|bool"), F.count_if(full & x.rlike(r"^[+-]?\d+$")).alias(f"{c}|int"), F.count_if(full & number.isNotNull()).alias(f"{c}|num"),
            F.count_if(full & F.try_to_timestamp(x).isNotNull()).alias(f"{c}|time"), F.min(number).alias(f"{c}|lo"), F.max(number).alias(f"{c}|hi"), F.approx_count_distinct(c).alias(f"{c}|k"),
        ]
    wide = df.agg(*aggs)
    rows = []
    for c in columns:
        g = lambda s, c=c: F.col(f"`{c}|{s}`")
        lo, hi, n = g("lo"), g("hi"), g("n")
        whole = (
            F.when((lo >= 0) & (hi < 255), "smallint").when((lo >= -128) & (hi <= 127), "tinyint").when((lo >= -32768) & (hi <= 32767), "smallint")
            .when((lo >= -(1 << 31)) & (hi < (1 << 31)), "int").when((lo >= -(1 << 63)) & (hi <= (1 << 63) - 1), "bigint").otherwise("decimal(38,0)")
        )
        kind = F.when(n == 0, "string").when(g("bool") == n, "boolean").when(g("int") == n, whole).when(g("num") == n, "double").when(g("time") == n, "timestamp")
        kind = kind.when((g("k") < n / 2) & (g("k") < 1000), "category").otherwise("string")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("type")))
    return wide.select(F.inline(F.array(*rows)))


def quality_score(null_pct: Column, duplicate_pct: Column, issues: Column) -> Column:
    return 100 - F.least(2 * null_pct, F.lit(30)) - F.least(3 * duplicate_pct, F.lit(20)) - F.least(2 * issues, F.lit(30))


def table_quality(df: DataFrame) -> DataFrame:
    """rows, null_pct, duplicate_pct, issues, score."""
    nulls = reduce(lambda a, b: a + b, [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]) / len(df.columns) * 100
    issues = reduce(lambda a, b: a + b, [(F.avg(F.col(c).isNull().cast("double")) > 0.1).cast("int") for c in df.columns])
    head = df.agg(F.count(N).alias("rows"), nulls.alias("null_pct"), issues.alias("issues"))
    twice = df.groupBy(*df.columns).agg(F.count(N).alias("n")).agg(F.sum(F.col("n") - 1).alias("d"))
    j = head.crossJoin(twice).withColumn("duplicate_pct", F.try_divide(F.col("d") * 100.0, F.col("rows")))
    return j.select("rows", "null_pct", "duplicate_pct", "issues", quality_score(F.col("null_pct"), F.col("duplicate_pct"), F.col("issues")).alias("score"))


@dataclass
class Expectation:
    """A named share of rows and the least it must be. ``share`` is an aggregate, or makes one from the frame."""

    name: str
    share: Column | Callable[[DataFrame], Column]
    mostly: float = 1.0


def not_null(c: str, mostly: float = 1.0) -> Expectation:
    return Expectation(f"{c} not null", F.avg(F.col(c).isNotNull().cast("double")), mostly)


def between(c: str, low, high, mostly: float = 0.95) -> Expectation:
    return Expectation(f"{c} between", F.avg(F.col(c).between(low, high).cast("double")), mostly)


def in_set(c: str, values: list, mostly: float = 1.0) -> Expectation:
    return Expectation(f"{c} in set", F.avg(F.col(c).isin(values).cast("double")), mostly)


def length_between(c: str, low: int, high: int, mostly: float = 1.0) -> Expectation:
    return Expectation(f"{c} length", F.avg(F.length(c).between(low, high).cast("double")), mostly)


def row_count(least: int = 1) -> Expectation:
    return Expectation("row count", (F.count(N) >= least).cast("double"))


def has_column(c: str) -> Expectation:
    return Expectation(f"{c} exists", lambda df: F.lit(1.0 if c in df.columns else 0.0))


def has_type(c: str, kind: str) -> Expectation:
    """``kind`` as in df.dtypes; a column that is not there has share 0."""
    return Expectation(f"{c} is {kind}", lambda df: F.lit(1.0 if dict(df.dtypes).get(c) == kind else 0.0))


def unique(*columns: str) -> Expectation:
    """Distinct rows over rows (nulls count as a value); no columns: the whole row."""
    def share(df: DataFrame) -> Column:
        row = F.struct(*(columns or df.columns))
        return F.try_divide(F.countDistinct(row), F.count(N).cast("double"))

    return Expectation(f"{','.join(columns) or 'row'} unique", share)


def within_iqr(c: str, times: float = 1.5, mostly: float = 0.95) -> Expectation:
    """Inside the quartile fences of the frame itself, which take one aggregation before; nulls are not inside."""
    def share(df: DataFrame) -> Column:
        q = quantiles(df, {"a": (c, 0.25), "b": (c, 0.75)}).first()
        if q.a is None:
            return F.lit(0.0)
        return F.avg(F.coalesce(F.col(c).between(q.a - times * (q.b - q.a), q.b + times * (q.b - q.a)), F.lit(False)).cast("double"))

    return Expectation(f"{c} within iqr", share, mostly)


def within_z(c: str, times: float = 3.0, mostly: float = 0.95) -> Expectation:
    """Inside mean +- times sample deviations of the frame itself, which take one aggregation before; nulls are not inside."""
    def share(df: DataFrame) -> Column:
        q = df.agg(F.avg(c).alias("m"), F.stddev(c).alias("s")).first()
        if q.s is None:
            return F.lit(0.0)
        return F.avg(F.coalesce(F.col(c).between(q.m - times * q.s, q.m + times * q.s), F.lit(False)).cast("double"))

    return Expectation(f"{c} within z", share, mostly)


def validate(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """expectation, share, mostly, success; all in one aggregation. An empty table has share 0."""
    shares = [e.share(df) if callable(e.share) else e.share for e in expectations]
    wide = df.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"e{i}") for i, s in enumerate(shares)])
    rows = [F.struct(F.lit(e.name).alias("expectation"), F.col(f"e{i}").alias("share"), F.lit(e.mostly).alias("mostly"), (F.col(f"e{i}") >= e.mostly).alias("success")) for i, e in enumerate(expectations)]
    return wide.select(F.inline(F.array(*rows)))


def validation_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(N).alias("total"), F.count_if(~F.col("success")).alias("failed"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("expectation")))).alias("failed_list"))
