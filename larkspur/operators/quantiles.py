"""Exact quantiles in bounded memory, of any number of columns and groups at once.

A quantile is one or two order statistics. Each pass is one aggregation: it counts the values below and inside an interval
that holds the wanted ranks, and takes a sketch of the values inside (``GRID`` cuts of equal rank), between two of whose
cuts the ranks lie; these cuts, or the values next to them where the ranks do not reach the cuts, are the next interval. When
at most ``BOUND`` values are inside, or all of them are equal, they are sorted and the ranks read; ranks in two neighbouring
values are read at once, however often the two occur. A pass narrows an interval some 200 times, whatever the distribution, so a column of 10^12
values takes four; a group of at most ``BOUND`` values needs none. The sketch is twice as fine in each further pass.

Memory of a task: for each quantile a sketch of bounded size in a pass, and at most ``BOUND`` values (512 KB) at the end; never
a map of all distinct values. Every new interval is checked by exact counts, and the old one stays if the sketch has missed,
so the result does not rely on the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.graph import cut

#: Values that one place sorts, cuts of a sketch and its accuracy.
BOUND, GRID, ACCURACY = 65_536, 1_000, 4_000
#: Groups whose intervals are broadcast.
GROUPS = 20_000


class _Wanted:
    """The quantiles asked for: number -> column of ``rows`` and share; and how intervals come to rows."""

    def __init__(self, df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: list[str]):
        inputs: dict[str, tuple[str, Column]] = {}
        self.names, self.by, self.of = list(wanted), by, []
        for column, p in wanted.values():
            c = F.col(column) if isinstance(column, str) else column
            x, _ = inputs.setdefault(str(c), (f"__x{len(inputs)}", c))
            self.of.append((x, float(p)))
        self.inputs = [x for x, _ in inputs.values()]
        self.rows = df.select(*[F.col(f"`{b}`").alias(f"__by{i}") for i, b in enumerate(by)], *[c.cast("double").alias(x) for x, c in inputs.values()])
        self.keys = [f"__by{i}" for i in range(len(by))]
        self.small = True

    def each(self, f) -> Column:
        """An array with f(number, column, share) for every quantile."""
        return F.array(*[f(i, F.col(x), p) for i, (x, p) in enumerate(self.of)])

    def aggregate(self, state: DataFrame, **made) -> DataFrame:
        """state with arrays of aggregates over the rows of its group; f(number, column, share) may use lo, hi and open."""
        right = state.select(*[F.col(k).alias(f"_{k}") for k in self.keys], "lo", "hi", "open")
        right = F.broadcast(right) if self.small else right
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        joined = self.rows.join(right, same) if same else self.rows.crossJoin(right)
        found = joined.groupBy(*self.keys).agg(*[self.each(f).alias(name) for name, f in made.items()])
        found = found.select(*[F.col(k).alias(f"_{k}") for k in self.keys], *made)
        return state.join(found, same).drop(*[f"_{k}" for k in self.keys]) if same else state.crossJoin(F.broadcast(found))


    def held(self, state: DataFrame) -> DataFrame:
        """The intervals, computed: one row comes to the driver, a row for each group is cut off its lineage."""
        if self.keys:
            return cut(state)
        return state.sparkSession.createDataFrame([state.first()], state.schema)


def _at(name: str, i: int) -> Column:
    return F.get(name, F.lit(i))


def _inside(i: int, x: Column) -> Column:
    return x.between(_at("lo", i), _at("hi", i))


def _rank(i: int, p: float) -> Column:
    return F.lit(p) * (_at("n", i) - 1)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: list[str] | tuple = (), bound: int | None = None) -> DataFrame:
    """A row for each group of ``by`` (one row without groups): the group's columns and, for every name of ``wanted``, the
    exact quantile of a column with linear interpolation between neighbours; null where the group has no values."""
    most, w = bound or BOUND, _Wanted(df, wanted, list(by))
    state = w.rows.groupBy(*w.keys).agg(
        w.each(lambda i, x, p: F.count(x)).alias("n"), w.each(lambda i, x, p: F.min(x)).alias("lo"), w.each(lambda i, x, p: F.max(x)).alias("hi")
    )
    state = state.withColumns({"below": w.each(lambda i, x, p: F.lit(0).cast("bigint")), "inside": F.col("n"), "two": w.each(lambda i, x, p: F.lit(False))})

    def closed(i, x, p) -> Column:
        return (_at("inside", i) > most) & (_at("lo", i) < _at("hi", i)) & ~_at("two", i)

    state = w.held(state.withColumn("open", w.each(closed)))
    w.small = not w.keys or state.count() <= GROUPS
    done = 0
    while not state.filter(F.exists("open", lambda o: o)).isEmpty():
        state, done = w.held(_narrowed(w, state, done).withColumn("open", w.each(closed))), done + 1
    return _read(w, state)


def edges(df: DataFrame, column: str | Column, shares: list[float], name: str = "e") -> DataFrame:
    """One row with an array of the exact quantiles of a column."""
    found = quantiles(df, {f"q{i}": (column, p) for i, p in enumerate(shares)})
    return found.select(F.array(*found.columns).alias(name))


def _narrowed(w: _Wanted, state: DataFrame, done: int) -> DataFrame:
    """One pass: every open interval becomes one between two cuts of its values, where exact counts confirm it."""
    cuts, accuracy = F.lit([i / GRID for i in range(GRID + 1)]), min(ACCURACY << done, 1 << 30)
    # in the first pass the intervals of a column are all of its values: one sketch serves all its quantiles
    inner = lambda i, x, p: x if not done else F.when(_at("open", i) & _inside(i, x), x)
    found = w.aggregate(state, grid=lambda i, x, p: F.percentile_approx(inner(i, x, p), cuts, F.lit(accuracy)))

    def cut_of(share: Column, ceil: bool, i: int) -> Column:
        error = 2.0 / accuracy + 1.0 / GRID
        place = F.ceil((share + error) * GRID) if ceil else F.floor((share - error) * GRID)
        inner = F.get(_at("grid", i), F.greatest(F.lit(0), F.least(F.lit(GRID), place)).cast("int"))
        return F.when(_at("open", i) & (place < GRID if ceil else place > 0), inner).otherwise(_at("hi" if ceil else "lo", i))

    def low(i, x, p) -> Column:
        return cut_of((F.floor(_rank(i, p)) - _at("below", i)) / _at("inside", i), False, i)

    def high(i, x, p) -> Column:
        return cut_of((F.ceil(_rank(i, p)) + 1 - _at("below", i)) / _at("inside", i), True, i)

    old = F.struct("lo", "hi", "below", "inside", "two")
    moved = w.held(found.select(*w.keys, "n", "open", old.alias("old"), w.each(low).alias("lo"), w.each(high).alias("hi")))
    counted = w.aggregate(
        moved, below=lambda i, x, p: F.count_if(x < _at("lo", i)), inside=lambda i, x, p: F.count_if(_inside(i, x)),
        first=lambda i, x, p: F.count_if(x == _at("lo", i)), last=lambda i, x, p: F.count_if(x == _at("hi", i)),
        next=lambda i, x, p: F.min(F.when(_inside(i, x) & (x > _at("lo", i)), x)), prev=lambda i, x, p: F.max(F.when(_inside(i, x) & (x < _at("hi", i)), x)),
    )

    def kept(name: str):
        def pick(i, x, p) -> Column:
            right = (_at("below", i) <= F.floor(_rank(i, p))) & (F.ceil(_rank(i, p)) < _at("below", i) + _at("inside", i))
            return F.when(_at("open", i) & right, _stripped(name, i, p)).otherwise(F.get(F.col("old")[name], F.lit(i)))

        return pick

    return counted.select(*w.keys, "n", *[w.each(kept(c)).alias(c) for c in ("lo", "hi", "below", "inside", "two")])


def _stripped(name: str, i: int, p: float) -> Column:
    """A part of a confirmed interval without those of its end values that the ranks do not reach, so that equal values at the
    ends, however many, cannot keep it open. ``two``: the lower rank has lo, the upper one hi, which is the next value."""
    lo, hi, below, inside, a, z = (_at(c, i) for c in ("lo", "hi", "below", "inside", "first", "last"))
    under, over, end = F.floor(_rank(i, p)), F.ceil(_rank(i, p)), below + inside - z
    at_lo, at_hi, up, down = over < below + a, under >= end, under >= below + a, over < end
    from_lo, to_hi = (under < below + a) & (over >= below + a), (under < end) & (over >= end)
    new = {
        "lo": F.when(at_hi, hi).when(at_lo | from_lo, lo).when(to_hi, _at("prev", i)).when(up, _at("next", i)).otherwise(lo),
        "hi": F.when(at_lo, lo).when(at_hi, hi).when(from_lo, _at("next", i)).when(to_hi, hi).when(down, _at("prev", i)).otherwise(hi),
        "below": F.when(at_hi, end).when(up, below + a).otherwise(below),
        "inside": F.when(at_hi, z).when(at_lo, a).otherwise(inside - F.when(up, a).otherwise(0) - F.when(down, z).otherwise(0)),
        "two": from_lo | to_hi,
    }[name]
    same = {"lo": lo, "hi": hi, "below": below, "inside": inside, "two": F.lit(False)}[name]
    return F.when(lo < hi, new).otherwise(same)


def _read(w: _Wanted, state: DataFrame) -> DataFrame:
    """Sorts what is inside the intervals and reads the ranks."""
    state = state.withColumn("open", w.each(lambda i, x, p: (_at("lo", i) < _at("hi", i)) & ~_at("two", i)))
    found = w.aggregate(state, values=lambda i, x, p: F.sort_array(F.collect_list(F.when(_at("open", i) & _inside(i, x), x))))
    out = []
    for i, (name, (_, p)) in enumerate(zip(w.names, w.of, strict=True)):
        rank, first = _rank(i, p), F.floor(_rank(i, p))
        one = lambda r, i=i: F.get(_at("values", i), (r - _at("below", i)).cast("int"))
        a, b = one(first), one(F.ceil(rank))
        lo = _at("lo", i)
        value = F.when(_at("open", i), a + (b - a) * (rank - first)).when(_at("two", i), lo + (_at("hi", i) - lo) * (rank - first)).otherwise(lo)
        out.append(F.when(_at("n", i) > 0, value).alias(name))
    return found.select(*[F.col(k).alias(b) for k, b in zip(w.keys, w.by, strict=True)], *out)
