"""Near-duplicate documents by BagMinHash over counted word shingles.

Every document's five-word shingles with their counts get a BagMinHash signature (``shingles.bag_minhash``), cut in
bands. Documents of one sequence of words are one node, whatever their number. Nodes that share a band are candidates;
the exact weighted Jaccard similarity of a candidate pair's counted shingles, from the texts, must reach the threshold;
classes are the components of these links (``near.linked``).

Scale: one scan makes signatures (bands x 8 bytes a document, far less than the text), copies are grouped by partial
aggregation, band keys shuffle as 24-byte rows; only texts of candidates are shuffled, to be verified. With ``rows`` 5
and ``bands`` 32 a pair at the threshold is missed with probability 3e-6; at larger scale raise both.

Defined results: one row for each input row; class_id is the least doc_id of the class; a text without words (null,
empty) is in no class with others: class_id is its own doc_id, class_size 1; repeated rows are one class; null ids count
as members but name a class only if it has no other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .near import linked
from .shingles import Words, bag_minhash, band_keys, counted_shingles, weighted_jaccard


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, rows: int = 5, bands: int = 32) -> DataFrame:
    """Per row: doc_id, row (hash of the text), node (16 bytes for the sequence of words; null without words), keys (one
    for each band), mark (one byte of each component, a sketch)."""

    def run(batches):
        for batch in slices(batches, 128):
            texts = batch.column(2).to_pylist()
            words = Words(texts)
            sizes = np.diff(words.first)
            full = bag_minhash(*counted_shingles(words, len(texts), k), len(texts), rows * bands)
            keys = band_keys(full, rows)
            marks = [m.tobytes() for m in (full & np.uint64(255)).astype(np.uint8)]
            nodes = [words.digest(i) if sizes[i] else None for i in range(len(texts))]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
            cols = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), flat, pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "node", "keys", "mark"])

    frame = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return frame.mapInArrow(run, "doc_id bigint, row bigint, node binary, keys array<bigint>, mark binary")


def verifier(content: DataFrame, threshold: float, k: int = 5):
    """content: node, text. Pairs a, b -> those whose weighted Jaccard similarity reaches the threshold."""

    def run(batches):
        for batch in slices(batches, 128):
            texts = [*batch.column(2).to_pylist(), *batch.column(3).to_pylist()]
            t, e, c = counted_shingles(Words(texts), len(texts), k)
            at = np.searchsorted(t, np.arange(len(texts) + 1))
            own = [(e[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in range(len(texts))]
            n = len(texts) // 2
            good = [weighted_jaccard(own[i], own[n + i]) >= threshold - 1e-12 for i in range(n)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        a = content.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        b = content.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        kind = dict(pairs.dtypes)["a"]
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")

    return verify


def similar(threshold: float, k: int):
    """Whether two of the texts of one place reach the threshold exactly."""

    def exact(rows: list):
        memo: dict[int, tuple] = {}

        def own(i: int) -> tuple:
            if i not in memo:
                column, at = rows[i]
                memo[i] = counted_shingles(Words([column[at].as_py()]), 1, k)[1:]
            return memo[i]

        return lambda i, j: weighted_jaccard(own(i), own(j)) >= threshold - 1e-12

    return exact


def alike(threshold: float, m: int):
    """Whether sketches agree often enough to be of similar sets: at least six deviations below the threshold, so a
    similar pair is let through but for a chance of 1e-9."""
    least = threshold - 6 * (threshold * (1 - threshold) / m) ** 0.5

    def compare(sketches: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), m)
        return (x[a] == x[b]).mean(1) >= least

    return compare


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """nodes: node, keys. key, node of all buckets of two or more nodes."""
    members = nodes.select("node", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return members.join(several, "key").select("key", "node")


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float, k: int, rows: int, bands: int) -> DataFrame:
    """For each row: doc_id, row, node, label (of the class), copies (rows of the node), class_id, class_size, n_links;
    all but the first two null without words."""
    marks = stored(signatures(docs, doc_id, text, k, rows, bands), "signatures")
    node = [F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("mark").alias("mark")]
    nodes = stored(marks.filter("node IS NOT NULL").groupBy("node").agg(*node), "nodes")
    buckets = stored(shared_buckets(nodes), "buckets")
    involved = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    wanted = marks.join(involved.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("w"))
    wanted = wanted.select("node", F.col("w.doc_id").alias("of"), F.col("w.row").alias("hash"))
    content = _content(texts, wanted)
    whole = involved.select("node", "keys", "mark").join(content.withColumnRenamed("text", "content"), "node")
    labels, links = linked(buckets, verifier(content, threshold, k), whole, similar(threshold, k), alike(threshold, rows * bands))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    of_node = named.join(classes, "label").join(degree, "node", "left").na.fill(0, ["n_links"])
    return marks.select("doc_id", "row", "node").join(stored(of_node.drop("first"), "classes"), "node", "left")


def near_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    k: int = 5,
    rows: int = 5,
    bands: int = 32,
) -> DataFrame:
    """One row for each input row: doc_id, class_id, class_size (rows of the class), n_copies (rows with the same
    words), n_links (verified links of those words to different ones: enough to hold the class together, not all pairs),
    is_first (doc_id is the class's least)."""
    class_id = F.coalesce("class_id", "doc_id")
    return _classes(docs, doc_id, text, threshold, k, rows, bands).select(
        "doc_id",
        class_id.alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(False)).alias("is_first"),
    )


def _content(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, of, hash: id and hash of the text of one row of each)."""

    def run(batches):
        for batch in slices(batches, 256):
            words = Words(batch.column(1).to_pylist())
            keep = [words.digest(i) == node for i, node in enumerate(batch.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # rows of one id may differ and ids may be null: the hash of the text tells which row is meant, the digest proves it
    found = wanted.join(texts, (F.col("hash") == F.col("row")) & F.col("of").eqNullSafe(F.col("doc_id"))).select("node", "text")
    return stored(found.mapInArrow(run, "node binary, text string").dropDuplicates(["node"]), "content")


def keep_first(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, k: int = 5, rows: int = 5, bands: int = 32
) -> DataFrame:
    """One row of each class, every column kept: of least doc_id, then of least hash of the text (null ids last). Rows
    are judged one by one: a text that is no near-duplicate stays, whatever else has its id. Of rows with the same id and
    the same text one stays, whichever; rows without words all stay."""
    found = stored(_classes(docs, doc_id, text, threshold, k, rows, bands).filter("class_size > 1"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    best = stored(found.groupBy("label").agg(F.min(order).alias("best")), "best")
    judged = found.join(best, "label").withColumn("stays", order.eqNullSafe(F.col("best")))
    # one row for each id and text: to go (0), to stay once (2, if it is there several times)
    fate = judged.groupBy("doc_id", "row").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    fate = stored(fate.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("own"), F.col("row").alias("digest"), "stays"), "fates")
    frame = docs.select(F.struct("*").alias("whole"), F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("digest"))
    kept = frame.join(fate.filter("NOT stays"), same, "left_anti")
    several = fate.filter("stays")
    if several.isEmpty():
        return kept.select("whole.*")
    once = kept.join(several, same, "left_semi").dropDuplicates(["id", "hash"])
    return kept.join(several, same, "left_anti").union(once).select("whole.*")
