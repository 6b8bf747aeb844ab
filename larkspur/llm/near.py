"""From band keys to verified links and components, without pairs of whole groups.

Nodes are distinct contents; a bucket holds the nodes that share a band key. A pair of nodes in one bucket is a
candidate. What is looked for is the components of the graph of verified candidates, so of a bucket it is enough to
verify pairs until no two of its components have an unverified pair:

1. every bucket is compared with one leader, the node with the most bucket mates (the centre of a family of copies);
   components are formed; buckets within one component are done. A group of thousands of copies ends here.
2. what is left is dealt in blocks of about ``block`` nodes, every pair of blocks of a bucket to one place, where pairs
   over component borders are compared in memory, each in the first bucket that it shares: by a sketch, then exactly.
   Only links leave that place. A large bucket becomes many small tasks; every bucket goes this way, whatever its size.
   Where sizes of contents are given, a bucket falls into classes of sizes, each 1 / ``ratio`` times as large as the one
   before: similar contents are in one class or in neighbouring ones, so only blocks of these meet.

All tables between steps are written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, temporary


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: node, label for all nodes of the edges; edges: a, b. New labels: the least of each component. In each round
    every label goes over to its least neighbour's and one step further, and edges are drawn anew between the labels left,
    so the edges shrink with every round; a hot node's neighbours are reduced before the shuffle."""

    def moved(e: DataFrame, to: DataFrame) -> DataFrame:
        x = to.select(F.col("node").alias("a"), F.col("label").alias("la"))
        y = to.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        new = e.join(x, "a").join(y, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        return stored(new.distinct(), "edges")

    with temporary(labels.sparkSession) as keep:
        out = _least(moved, edges, labels)
        keep(out)
    return out


def _least(moved: Callable, edges: DataFrame, labels: DataFrame) -> DataFrame:
    over, roots = moved(edges, labels), None
    while not over.isEmpty():
        both = over.union(over.select("b", "a"))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
        jump = hook.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stored(hook.join(jump, "label").select("node", F.col("far").alias("label")), "labels")
        if roots is None:
            roots = step
        else:
            further = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
            roots = stored(roots.join(further, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
        over = moved(over, step)
    if roots is None:
        return labels
    out = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    return stored(out.select("node", F.coalesce("root", "label").alias("label")), "labels")


def linked(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    marks: DataFrame,
    exact: Callable,
    alike: Callable | None = None,
    aligned: bool = True,
    possible: Callable | None = None,
    block: int = 256,
    size: Column | None = None,
    ratio: float = 0.8,
    closer: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """buckets: key bigint, node (all members of buckets of two or more nodes); marks: node, keys array<bigint> (band keys,
    aligned: all of them, in the order of bands), mark (a sketch), content; verify: pairs a, b -> those that are similar;
    exact: (column of contents, index) of the rows of whole places -> whether two of these rows are similar; closer: (column of
    contents, rows, rows) -> false only for pairs of rows that are not; possible: (mark, mark) of ``buckets``, as columns -> false
    only for pairs that are not; alike: (column of sketches, rows, rows) -> false only for pairs of rows that are not; size:
    of ``marks``, at least 1: no pair is similar whose smaller size is less than ``ratio`` of the larger.
    Returns labels (node, label) and links (a, b)."""
    with temporary(buckets.sparkSession) as keep:
        out = _linked(buckets, verify, marks, exact, alike, aligned, possible, block, size, ratio, closer)
        keep(*out)
    return out


def _linked(buckets, verify, marks, exact, alike, aligned, possible, block, size, ratio, closer) -> tuple[DataFrame, DataFrame]:
    # written, so that the join below deals rows of a hot key anew where it must: nothing else needs them by key
    mates = stored(buckets.groupBy("key").agg(F.count("*").alias("n")), "mates")
    degree = buckets.join(mates, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    mark = F.col("mark") if possible else F.lit(None).cast("binary")
    left = stored(buckets.withColumn("mark", mark).join(degree, "node"), "buckets")
    labels = stored(left.select("node").distinct().withColumn("label", F.col("node")), "labels")
    lead = left.groupBy("key").agg(F.max_by(F.struct("node", "mark"), F.struct("degree", "node")).alias("l"))
    lead = stored(lead.select("key", F.col("l.node").alias("b"), F.col("l.mark").alias("b_mark")), "leaders")
    worth = F.col("node") != F.col("b")
    if possible:
        worth = worth & possible(F.col("mark"), F.col("b_mark"))
    pairs = left.join(lead, "key").filter(worth).select(F.col("node").alias("a"), "b")
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(verify(ordered), "links")
    labels = components(links, labels)
    # a leader has been compared with all its bucket: it may go; what is in one component is done
    rest = left.join(lead.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti").select("key", "node")
    left = _open(rest, labels)
    if left.isEmpty():
        return labels, links
    left = left.withColumn("class", F.lit(0))
    if size is not None:
        # a little wider than the ratio, so that no rounding parts a similar pair by two classes
        wide = math.log(1 / ratio) + 1e-6
        own = marks.select("node", F.floor(F.log(size.cast("double")) / wide).cast("int").alias("class"))
        left = stored(left.drop("class").join(own, "node"), "classes")
    more = stored(_blocked(left, labels, marks, exact, alike, aligned, block, closer), "links")
    return components(more, labels), links.unionByName(more)


def _blocked(
    left: DataFrame,
    labels: DataFrame,
    marks: DataFrame,
    exact: Callable,
    alike: Callable | None,
    aligned: bool,
    block: int,
    closer: Callable | None,
) -> DataFrame:
    """Links over component borders that connect what is similar: a, b (some of them twice where a bucket was split)."""
    kind = dict(left.dtypes)["node"]
    # blocks of each class of a bucket; a block's number begins with its class
    parts = left.groupBy("key", "class").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    near = parts.select("key", "class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("to"))
    met = near.join(parts.select("key", F.col("class").alias("to"), F.col("parts").alias("there")), ["key", "to"])
    met = met.groupBy("key", "class").agg(F.collect_list(F.struct("to", "there")).alias("met")).join(parts, ["key", "class"])
    numbered = F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0).cast("bigint"), m["there"] - 1), lambda i: (m["to"] * F.lit(1 << 32)) + i)))
    own = left.join(met.select("key", "class", "parts", numbered.alias("places")), ["key", "class"]).join(labels, "node")
    own = own.join(marks.select("node", "keys", "mark", "content"), "node")
    dealt = own.withColumn("own", F.col("class") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("with", F.explode("places"))
    place = ["key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")]
    placed = dealt.select(*place, "own", "node", "label", "mark", "keys", "content").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def links_of(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Links that connect what is similar in whole places: of each at most one fewer than its nodes."""
        key, lo, hi, own = (rows.column(i).to_numpy() for i in range(4))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        place, start = np.cumsum(new) - 1, np.flatnonzero(new)
        end = np.append(start[1:], len(key))
        label = rows.column(5).dictionary_encode().indices.to_numpy().astype(np.int64)
        # of a place the rows of block lo first: each meets all of block hi, or in a place of one block those after it
        order = np.lexsort((own != lo, place))
        one = lo == hi
        first = np.where(one[order], np.arange(len(key)) + 1, (start + np.bincount(place, own == lo).astype(np.int64))[place])
        count = np.where((own == lo)[order], end[place] - first, 0)
        before = np.cumsum(count) - count
        found: list[tuple] = []
        a, most = 0, 1 << 16  # pairs at a time
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(before, before[a] + most, "right")) - 1) if before[-1] - before[a] > most else len(count)
            i = np.repeat(np.arange(a, b), count[a:b])
            j = order[np.arange(len(i)) + before[a] - before[i] + first[i]]
            i, a = order[i], b
            for fine in checks(rows, key, label):
                if len(i):
                    good = fine(i, j)
                    i, j = i[good], j[good]
            found.append((i, j))
        one, other = (np.concatenate(side) for side in zip(*found, strict=True))
        if not len(one):
            return None
        if closer:
            good = closer(rows.column(8), one, other)
            one, other = one[good], other[good]
        similar, root, out = exact([(rows.column(8), i) for i in range(len(key))]), {}, []

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = v = root.get(up, up)
            return v

        name = place * (label.max() + 1) + label  # components are those of a place
        for i, j, u, v in zip(*(c.tolist() for c in (one, other, name[one], name[other])), strict=True):
            u, v = find(u), find(v)
            if u != v and similar(i, j):
                root[u] = v
                out.append((i, j))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([rows.column(4).take(pa.array(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    def checks(rows: pa.RecordBatch, key: np.ndarray, label: np.ndarray) -> Iterator[Callable]:
        """What a pair must pass to be compared exactly, the cheapest first."""
        yield lambda i, j: label[i] != label[j]
        if aligned:
            keys = rows.column(7).flatten().to_numpy().reshape(len(key), -1)
            band = (keys == key[:, None]).argmax(1)
            yield lambda i, j: (keys[i] == keys[j]).argmax(1) == band[i]
        if alike:
            yield lambda i, j: alike(rows.column(6), i, j)

    def run(batches):
        rest: list[pa.RecordBatch] = []  # rows of the last place so far
        for b in batches:
            if not b.num_rows:
                continue
            places = [b.column(i).to_numpy() for i in range(3)]
            tail = np.logical_and.reduce([c == c[-1] for c in places])
            cut = b.num_rows - int(tail[::-1].argmin()) if not tail.all() else 0
            if cut or (rest and any(rest[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(places))):
                whole = pa.concat_batches([*rest, b.slice(0, cut)])
                rest = []
                if whole.num_rows and (out := links_of(whole)) is not None:
                    yield out
            rest.append(b.slice(cut))
        if rest and (out := links_of(pa.concat_batches(rest))) is not None:
            yield out

    return placed.mapInArrow(run, f"a {kind}, b {kind}")


def _open(left: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still span more than one component."""
    named = left.join(labels, "node")
    spans = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return stored(left.join(spans.select("key"), "key", "left_semi").select("key", "node"), "buckets")
