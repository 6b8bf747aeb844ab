"""Exact nearest (or farthest) neighbours of every row, without comparing all pairs.

Some rows are pivots; every row belongs to the cell of its nearest pivot. A first pass compares each query with one cell that
has enough rows, which gives it a distance that its k-th neighbour does not exceed. A second pass visits only the cells that
the triangle inequality leaves: with d(q, p) the distance to a cell's pivot, r its radius and c the query's nearest pivot, no
row of the cell is nearer than d(q, p) - r, nor nearer than (d(q, p) - d(q, c)) / 2.

Scale: pivots (at most ``PIVOTS`` and ``PIVOT_BYTES``), radii and sizes are all that is broadcast. Cells that lie together form
groups, which are dealt in parts, and the queries of a group in blocks, so a cell that holds a third of all rows is many tasks; a
task holds one part and streams its queries, comparing each with the cells that are left for it; only k rows for each query
and part leave it. A query travels once to each part that has a cell for it, a row once to each block, so what is shuffled
grows with rows x (queries / ``BLOCK`` + rows / ``PART``), however many cells are visited. How many cells are left depends on
the data: few where rows lie in clusters, nearly all in many dimensions without structure.

Defined results: rows and queries whose vector is null are left out, and so are queries without any neighbour; ties go to the
least key; an empty side gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import cut
from larkspur.operators.nearest import QUERIES, ROWS, Best, Own, margins, names, norms, squares, vectors

#: Most pivots, and most bytes of their vectors.
PIVOTS, PIVOT_BYTES = 1_000, 16 << 20
#: Rows of one part, and queries of one block, at most about; where there are few, parts and blocks shrink to SMALL to keep all cores busy.
PART, BLOCK, SMALL = 131_072, 262_144, 4_096
#: Bytes of the vectors of one part.
PART_BYTES = 64 << 20
#: Distances within this share of a bound are looked at, as sums round.
SLACK = 1e-9


class Cells:
    """Pivots, the rows and radius of each cell, and the group of each, of which ``parts`` are held at a time."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms = pivots, norms(pivots) if pivots.size else np.zeros(0)
        self.rows, self.radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
        self.group, self.parts = np.zeros(len(pivots), np.int32), [1]

    def grouped(self, most: int) -> None:
        """Cells that lie together come into groups of at most ``most`` rows, larger cells into one alone."""
        order, at, held, sizes = self._order(np.arange(len(self.pivots))), 0, 0, []
        for c in order:
            if held and held + self.rows[c] > most:
                sizes.append(held)
                at, held = at + 1, 0
            self.group[c], held = at, held + int(self.rows[c])
        self.parts = [max(1, -(-n // most)) for n in [*sizes, held]]

    def _order(self, some: np.ndarray) -> list[int]:
        """Halves along the widest axis, down to single pivots."""
        if len(some) < 2:
            return some.tolist()
        x = self.pivots[some]
        some = some[np.argsort(x[:, (x.max(0) - x.min(0)).argmax()], kind="stable")]
        return self._order(some[: len(some) // 2]) + self._order(some[len(some) // 2 :])

    def to_pivots(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances to all pivots."""
        n = norms(v)
        d, margin = squares(v, n, self.pivots, self.norms), margins(n, self.norms, v.shape[1])
        return np.sqrt(np.maximum(0, d - margin[:, None])), np.sqrt(np.maximum(0, d + margin[:, None]))

    def first(self, low: np.ndarray, k: int, farthest: bool) -> np.ndarray:
        """The best cell of more than k rows of each query, -1 where there is no such cell."""
        enough = self.rows > k
        if not enough.any():
            return np.full(len(low), -1)
        return np.where(enough[None, :], -(low + self.radius[None, :]) if farthest else low, np.inf).argmin(1)

    def visits(self, low: np.ndarray, high: np.ndarray, nearest: np.ndarray, limit: np.ndarray, farthest: bool, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Queries x cells: which may hold a neighbour. low, high: bounds of the distances of the queries to the pivots; nearest:
        an upper bound of that to the nearest one."""
        limit = np.where(np.isnan(limit), -np.inf if farthest else np.inf, limit)
        some, radius = (self.rows > 0)[None, cells], self.radius[None, cells]
        slack = SLACK * (1 + np.where(np.isfinite(limit), limit, 0))[:, None]
        if farthest:
            return some & (high[:, cells] + radius >= limit[:, None] - slack)
        near = low[:, cells] - radius <= limit[:, None] + slack
        return some & near & ((low[:, cells] - nearest[:, None]) / 2 <= limit[:, None] + slack)


def choose_pivots(rows: DataFrame, key: str, vector: str, pivots: int | None = None) -> np.ndarray:
    """Distinct vectors of the rows of least hash: about the square root of their number, within the bounds."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not r.n:
        return np.zeros((0, 0))
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, r.d))))
    want = min(most, pivots or math.ceil(math.sqrt(r.n)))
    got = rows.orderBy(F.xxhash64(key), key).limit(want).select(vector).collect()
    return np.unique(np.array([x[0] for x in got]), axis=0)


def in_cells(rows: DataFrame, vector: str, cells: Cells) -> DataFrame:
    """The rows with cell (the nearest pivot) and to_pivot (the distance to it)."""
    sent = rows.sparkSession.sparkContext.broadcast(cells.pivots)
    columns = [*rows.columns, "cell", "to_pivot"]
    at = rows.columns.index(vector)

    def run(batches):
        pn = norms(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                best = Best(vectors(part.column(at), part.num_rows), 1)
                best.add(sent.value, pn, np.arange(len(pn)))
                cell = best.key[:, 0] if best.key is not None else np.zeros(part.num_rows, int)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(best.d[:, 0])], names=columns)

    schema = rows.withColumns({"cell": F.lit(0), "to_pivot": F.lit(0.0)}).schema
    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def _go(cells: Cells, v: np.ndarray, limit: np.ndarray, k: int, farthest: bool, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries x cells to look at, in the first pass the best cell of more than k rows (all cells where there is none), in the
    second all that are left; and the best cell (-1: none)."""
    low, high = cells.to_pivots(v)
    best = cells.first(low, k, farthest)
    if (best < 0).any():  # the first pass sees all
        return np.broadcast_to((cells.rows > 0) & first, low.shape), best
    if not first:
        return cells.visits(low, high, high.min(1), limit, farthest), best
    go = np.zeros(low.shape, bool)
    go[np.arange(len(v)), best] = True
    return go, best


def visiting(queries: DataFrame, cells: Cells, k: int, farthest: bool, first: bool) -> DataFrame:
    """queries: query, v, limit (null: none yet). query, v, limit, best, group: a row for each group with a cell to look at."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        own: Cells = sent.value
        groups = len(own.parts)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                limit = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                go, best = _go(own, vectors(part.column(1), part.num_rows), limit, k, farthest, first)
                into = np.zeros((len(go), groups), bool)
                q, c = np.nonzero(go)
                into[q, own.group[c]] = True
                q, g = np.nonzero(into)
                taken = part.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best[q].astype(np.int32)), pa.array(g.astype(np.int32))], names=["query", "v", "limit", "best", "group"])

    kind = queries.select("query", "v", "limit").withColumns({"best": F.lit(0), "group": F.lit(0)}).schema
    for f in kind.fields:
        f.nullable = True
    return queries.select("query", "v", "limit").mapInArrow(run, kind)


def compared(visits: DataFrame, rows: DataFrame, cells: Cells, k: int, same: bool, farthest: bool, first: bool, most: int) -> DataFrame:
    """visits: query, v, limit, best, group; rows: key, v, cell. query, neighbour, distance: the k best of each query in each
    part. most: queries of a block."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(cells)
    asked = {r.group: r.n for r in visits.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row for each group
    blocks = [max(1, -(-asked.get(g, 0) // most)) for g in range(len(cells.parts))]
    before = np.concatenate([[0], np.cumsum([p * b for p, b in zip(cells.parts, blocks, strict=True)])]).tolist()
    parts_of, blocks_of, start = F.lit(cells.parts), F.lit(blocks), F.lit(before)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, "group") - 1))
    hashed = lambda key, n: F.pmod(F.xxhash64(key), F.get(n, F.col("group"))).cast("int")
    kinds = {f.name: f.dataType for f in [*visits.schema.fields, *rows.schema.fields]}
    group = F.get(F.lit(cells.group.tolist()), F.col("cell"))
    a = rows.select(group.alias("group"), "cell", F.lit(None).cast("double").alias("limit"), "key", "v").select("*", hashed("key", parts_of).alias("part"), every(blocks_of).alias("block"), F.lit(0).alias("asks"))
    b = visits.select("group", F.col("best").alias("cell"), "limit", F.col("query").alias("key"), "v").select("*", every(parts_of).alias("part"), hashed("key", blocks_of).alias("block"), F.lit(1).alias("asks"))
    slot = (F.get(start, F.col("group")) + F.col("part") * F.get(blocks_of, F.col("group")) + F.col("block")).cast("int")
    placed = a.unionByName(b).select(slot.alias("slot"), "asks", "cell", "limit", "key", "v")
    tasks = min(before[-1], max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartitionById(tasks, F.col("slot") % tasks).sortWithinPartitions("slot", "asks")

    def run(batches):
        own: Cells = sent.value
        now, held, part, waiting = None, [], None, []
        most_waiting = 16 * QUERIES if first else QUERIES  # in the first pass few ask for the same cell

        def load():
            keys, v, cell = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(cell, kind="stable")
            keys, v, cell = keys[order], v[order], cell[order]
            held.clear()
            return keys, v, norms(v), cell, Own(keys) if same else None

        def answer():
            keys, v, cell, limit = (np.concatenate([w[i] for w in waiting]) for i in range(4))
            waiting.clear()
            for s in range(0, len(keys), most_waiting):
                e = s + most_waiting
                i, neighbour, d = _answered(own, part, keys[s:e], v[s:e], cell[s:e], limit[s:e], k, farthest, first).found()
                if len(i):
                    cols = [keys[s:e][i], neighbour, d]
                    yield pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype == object else c, t) for c, t in zip(cols, arrow, strict=True)], names=["query", "neighbour", "distance"])

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in range(2)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)])) if len(group) else []
            for s, e in zip(starts, [*starts[1:], len(group)], strict=True):
                piece, (where, asks) = batch.slice(s, e - s), group[s]
                if where != now:
                    if waiting:
                        yield from answer()
                    now, part = where, None
                    held.clear()
                data = names(piece.column(4)), vectors(piece.column(5), e - s), piece.column(2).to_numpy(), piece.column(3).to_numpy(zero_copy_only=False).astype(float)
                if not asks:
                    held.append(data)
                    continue
                if part is None:
                    if not held:
                        continue
                    part = load()
                waiting.append(data)
                if sum(len(w[0]) for w in waiting) >= most_waiting:
                    yield from answer()
        if waiting:
            yield from answer()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(kinds["query"]), to_arrow_type(kinds["key"]), pa.float64()]
    return placed.mapInArrow(run, f"query {kinds['query'].simpleString()}, neighbour {kinds['key'].simpleString()}, distance double")


def _answered(cells: Cells, part: tuple, keys: np.ndarray, v: np.ndarray, cell: np.ndarray, limit: np.ndarray, k: int, farthest: bool, first: bool) -> Best:
    """The k best of a part for some queries: the cells that each has to look at, one after the other."""
    known, w, wn, of, own = part
    best = Best(v, k, farthest, limit)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ends, all_of = np.append(starts[1:], len(of)), np.arange(len(v))
    low, high = (None, None) if first else cells.to_pivots(v)
    nearest = None if first else high.min(1)
    itself = own.pairs(keys) if own else None

    def look(s: int, e: int, asks: np.ndarray) -> None:
        inside = None
        if itself is not None:
            here = (itself[1] >= s) & (itself[1] < e)
            inside = itself[0][here], itself[1][here] - s
        best.add(w[s:e], wn[s:e], known[s:e], inside, all_of[asks])

    i = 0
    while i < len(starts):
        n = max(1, int(np.searchsorted(ends[i:], starts[i] + ROWS, "right")))  # cells of about ROWS rows together
        s, e, c = starts[i : i + n], ends[i : i + n], of[starts[i : i + n]]
        i += n
        go = (cell[:, None] == c) | (cell < 0)[:, None] if first else cells.visits(low, high, nearest, best.limit, farthest, c)
        asks = go.any(1)
        if 2 * (go * (e - s)).sum() >= asks.sum() * (e[-1] - s[0]):
            if asks.any():
                look(s[0], e[-1], asks)
            continue
        for j in np.flatnonzero(go.any(0)):
            look(s[j], e[j], go[:, j])
    return best


def knn_all(
    queries: DataFrame,
    rows: DataFrame,
    key: str,
    vector: str,
    k: int,
    same: bool = True,
    farthest: bool = False,
    pivots: int | None = None,
) -> DataFrame:
    """The k rows nearest to each query (or farthest from it), both of any size: query, neighbour, distance, place. Ties: least
    key. ``same``: a row is no neighbour of its own key."""
    known, asked = _sides(queries, rows, key, vector)
    cells = Cells(choose_pivots(known, "key", "v", pivots))
    found = _passes(asked, cut(in_cells(known, "v", cells)), cells, k, same, farthest)[0] if len(cells.pivots) else None
    if found is None:
        kind = queries.schema[key].dataType.simpleString(), rows.schema[key].dataType.simpleString()
        found = queries.sparkSession.createDataFrame([], f"query {kind[0]}, neighbour {kind[1]}, distance double")
    by = Window.partitionBy("query").orderBy(F.desc("distance") if farthest else F.asc("distance"), "neighbour")
    return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def _sides(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows as key, v and queries as query, v; vectors stay floats where both are, which halves what is shuffled."""
    kind = "array<float>" if all(d.schema[vector].dataType.simpleString() == "array<float>" for d in (queries, rows)) else "array<double>"
    known = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("v"))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast(kind).alias("v"))
    return known, asked


def _passes(asked: DataFrame, known: DataFrame, cells: Cells, k: int, same: bool, farthest: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates of the second pass, which finds those of the first again (of the first where that has seen all), and the
    queries with their limits."""
    for r in known.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("r")).collect():  # a row for each cell
        cells.rows[r.cell], cells.radius[r.cell] = r.n, r.r
    sides = 2 * math.sqrt(asked.sparkSession.sparkContext.defaultParallelism)  # parts and blocks, so that tasks are some times the cores
    small = lambda n, most: max(1, min(most, max(SMALL, math.ceil(n / sides))))
    cells.grouped(small(int(cells.rows.sum()), max(1, min(PART, PART_BYTES // (8 * max(1, cells.pivots.shape[1]))))))
    block = small(asked.count(), BLOCK)
    none = asked.withColumn("limit", F.lit(None).cast("double"))
    first = cut(compared(visiting(none, cells, k, farthest, True), known, cells, k, same, farthest, True, block))
    enough = F.when(F.count("*") >= k, F.min("distance") if farthest else F.max("distance"))
    by = Window.partitionBy("query").orderBy(F.desc("distance") if farthest else F.asc("distance"), "neighbour")
    best = first.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
    limits = best.groupBy("query").agg(enough.alias("limit"))
    bounded = cut(asked.join(limits, "query", "left"))
    if not (cells.rows > k).any():
        return first, bounded
    return compared(visiting(bounded, cells, k, farthest, False), known, cells, k, same, farthest, False, block), bounded


def pairs_compared(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, pivots: int | None = None) -> int:
    """How many pairs ``knn_all`` compares at most, to measure what the bounds save."""
    known, asked = _sides(queries, rows, key, vector)
    cells = Cells(choose_pivots(known, "key", "v", pivots))
    bounded = _passes(asked, cut(in_cells(known, "v", cells)), cells, k, True, False)[1]
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        own: Cells = sent.value
        for b in batches:
            v, limit = vectors(b.column(0), b.num_rows), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            pairs = sum(int((_go(own, v, limit, k, False, first)[0] * own.rows[None, :]).sum()) for first in (True, False))
            yield pa.RecordBatch.from_arrays([pa.array([pairs])], names=["pairs"])

    return bounded.select("v", "limit").mapInArrow(run, "pairs bigint").agg(F.sum("pairs")).first()[0] or 0
