"""Graphs of transfers: edges, degrees, components, bounded cycles, PageRank; and lineage cuts for iterations."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N = "*"  # what count() counts: rows


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder ``spark.checkpoint.dir``; only where that is unset (one machine) to our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return df.checkpoint()


def new_folder(spark, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    cut(spark.range(1))  # there is a checkpoint folder now
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return str(path.toString())


def undirected(df: DataFrame, a: str, b: str, amount: str | None = None) -> DataFrame:
    """Edges u < v (or equal) with weight (sum) and n."""
    weight = F.sum(amount) if amount else F.count(N).cast("double")
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(weight.alias("weight"), F.count(N).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (neighbours), volume (weights), n."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "weight", "n", (F.col("u") == F.col("v")).alias("loop"))
    return ends.filter("NOT loop").groupBy("node").agg(F.count(N).alias("degree"), F.sum("weight").alias("volume"), F.sum("n").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node): least labels move along edges, then jump to their label's label; the number of
    rounds grows with the logarithm of the longest path."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    label = cut(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("m"))
        moved = cut(label.join(near, label.node == near.u, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was")))
        far = moved.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(moved.join(far, "component").select("node", F.col("far").alias("component"), "was"))
        label = new.select("node", "component")
        if not new.filter("component <> was").limit(1).count():
            return label


def component_summary(edges: DataFrame, least: int = 5) -> DataFrame:
    """component, size, n_edges, volume of components of at least ``least`` nodes."""
    label = cut(components(edges))
    size = label.groupBy("component").agg(F.count(N).alias("size")).filter(F.col("size") >= least)
    inside = edges.join(label, edges.u == label.node).groupBy("component").agg(F.count(N).alias("n_edges"), F.sum("weight").alias("volume"))
    return size.join(inside, "component")


def ranked_paths(edges: DataFrame, longest: int) -> list[DataFrame]:
    """For 1 to ``longest`` edges the simple paths all of whose nodes rank below their first one, by degree, then by name:
    top (the first node's rank), path, last. No path runs through a node of more neighbours than its first has, so of a hub's
    pairs only those are listed that start there: for two edges at most m sqrt(m) rows, whatever the hubs."""
    simple = edges.filter("u <> v").select("u", "v").distinct()
    both = simple.select(F.col("u").alias("a"), F.col("v").alias("b")).union(simple.select("v", "u"))
    rank = both.groupBy("a").agg(F.count(N).alias("d")).select(F.col("a").alias("n"), F.struct("d", "a").alias("r"))
    ends = both.join(rank.select(F.col("n").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("n").alias("b"), F.col("r").alias("rb")), "b")
    step = cut(ends.select("a", "b", "ra", "rb"))
    paths = [step.filter("rb < ra").select(F.col("ra").alias("top"), F.array("a", "b").alias("path"), F.col("b").alias("last"))]
    while len(paths) < longest:
        grown = paths[-1].join(step, F.col("last") == F.col("a")).filter((F.col("rb") < F.col("top")) & ~F.array_contains("path", F.col("b")))
        paths.append(cut(grown.select("top", F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("last"))))
    return paths


def cycles(edges: DataFrame, longest: int = 5, max_degree: int | None = None) -> DataFrame:
    """Simple cycles of 3..longest nodes, each once: length and path, from their least node in the direction of the lesser
    neighbour. A cycle is found at its node of highest rank (see ``ranked_paths``), where two paths of half its length meet;
    longer ones are never listed. ``max_degree`` leaves out hubs, and says so by being given."""
    if max_degree is not None:
        hubs = degrees(edges.filter("u <> v")).filter(F.col("degree") > max_degree).select("node")
        edges = edges.join(hubs, edges.u == hubs.node, "left_anti").join(hubs, edges.v == hubs.node, "left_anti")
    paths, found = ranked_paths(edges, (longest + 1) // 2), None
    for size in range(3, longest + 1):
        there, back = paths[(size + 1) // 2 - 1], paths[size // 2 - 1].withColumnRenamed("path", "other")
        met = there.join(back, ["top", "last"]).filter(F.col("path")[1] < F.col("other")[1])
        inner = F.slice("other", 2, size // 2 - 1)
        met = met.filter(F.size(F.array_intersect("path", inner)) == 0) if size // 2 > 1 else met
        ring = met.select(F.concat("path", F.reverse(inner)).alias("c"))
        first = F.array_position("c", F.array_min("c")).cast("int")
        ring = ring.select(F.concat(F.slice("c", first, size), F.slice("c", 1, first - 1)).alias("c"))
        turned = F.concat(F.slice("c", 1, 1), F.reverse(F.slice("c", 2, size - 1)))
        closed = ring.select(F.lit(size).alias("length"), F.when(F.col("c")[1] < F.col("c")[size - 1], F.col("c")).otherwise(turned).alias("path"))
        found = closed if found is None else found.union(closed)
    return found


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank over undirected edges; ranks sum to the number of nodes."""
    step = edges.filter("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.filter("u <> v").select("v", "u"))
    out = cut(step.join(step.groupBy("a").agg(F.count(N).alias("d")), "a"))
    rank = out.select(F.col("a").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = out.join(rank, out.a == rank.node).groupBy("b").agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        rank = cut(given.select(F.col("b").alias("node"), (1 - damping + damping * F.col("got")).alias("rank")))
    return rank


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles, coefficient: triangles counted from the lower-degree end, so a hub's pairs are not listed."""
    simple = cut(edges.filter("u <> v").select("u", "v").distinct())
    deg = cut(simple.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(N).alias("degree")))
    d = lambda x: deg.select(F.col("node").alias(x), F.col("degree").alias(f"d{x}"))
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    to = cut(simple.join(d("u"), "u").join(d("v"), "v").select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b")))
    wedge = to.alias("x").join(to.alias("y"), F.col("x.a") == F.col("y.a")).filter("x.b < y.b").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    ends = to.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    tri = wedge.join(ends, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(N).alias("triangles"))
    k = F.col("degree")
    full = deg.join(tri, "node", "left").select("node", k, F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return full.withColumn("coefficient", F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def flow_matrix(df: DataFrame, a: str, b: str, amount: str, top: int = 10) -> DataFrame:
    """Flows among the ``top`` accounts by volume on either side."""
    each = df.select(F.col(a).alias("k"), F.col(amount).alias("x")).union(df.select(b, amount))
    most = each.groupBy("k").agg(F.sum("x").alias("s")).orderBy(F.desc("s"), "k").limit(top).select("k")
    inside = df.join(F.broadcast(most), df[a] == most.k, "left_semi").join(F.broadcast(most), df[b] == most.k, "left_semi")
    return inside.groupBy(a, b).agg(F.sum(amount).alias("flow"), F.count(N).alias("n"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order`` (of equal ones the greatest by all columns, in their order)."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in df.columns])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
