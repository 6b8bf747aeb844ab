"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections, in DataFrame functions only.

A paragraph is a line, its leaves are its sentences. A section is a run of paragraphs that ends after a paragraph whose
digest begins with 0-3, so sections end at the same paragraphs again after an edit. All digests of the tree are whole
SHA-256: of a sentence, of a section's sentence digests, of the sections' digests; 12 digits of each are shown below the
root, which is shown whole. The fingerprint's text is

    root  section,section,...  leaves: "." within a paragraph, "," between paragraphs, ";" between sections

separated by blanks, so equal roots prove equal texts, and unequal ones are compared branch by branch without the texts
(``differing_sections``). Likeness is 1 for equal roots, else the Jaccard similarity of the sets of leaves, or
u / (u + 1) where all u leaves are the same in another order or number: only equal texts are wholly alike.

Scale: fingerprints are a projection. The edited text of the query needs each document's neighbour by id: neighbours
come from (id, length) alone, by range partitions and their ends; then one text shuffle by id (shared by both uses of
the documents) and one of the neighbour's head and fingerprint. Defined results: a null text counts as empty; rows of one id
stand in the order of their texts' hashes; null ids (and -2^63, which counts as null) come last; a single document is its own neighbour; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DIGITS = 12


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _shown(x: Column) -> Column:
    """Every digest in x cut to its first digits."""
    return F.regexp_replace(x, f"([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{64 - DIGITS}}}", "$1")


def _bound(x: Column, then) -> Column:
    """then(x), with x computed once: a one-element array names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as text."""
    paragraphs = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda p: F.array_join(F.transform(F.split(p, r"(?<=[.!?]) "), _digest), "."),
    )
    ended = F.transform(paragraphs, lambda p: F.concat(p, F.when(F.substring(_digest(p), 1, 1) < "4", ";").otherwise(",")))
    joined = F.regexp_replace(F.array_join(ended, ""), "[;,]$", "")
    return _bound(
        joined,
        lambda leaves: _bound(
            F.array_join(F.transform(F.split(leaves, ";"), _digest), ","),
            lambda sections: F.concat_ws(" ", _digest(sections), _shown(sections), _shown(leaves)),
        ),
    )


def leaves(mark: Column) -> Column:
    return F.split(F.substring_index(mark, " ", -1), "[.,;]")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints."""
    x, y = leaves(a), leaves(b)
    every = F.size(F.array_union(x, y)).cast("double")
    share = F.size(F.array_intersect(x, y)) / every
    equal = F.substring_index(a, " ", 1) == F.substring_index(b, " ", 1)
    return F.when(equal, F.lit(1.0)).otherwise(F.least(share, every / (every + 1)))


def differing_sections(a: Column, b: Column) -> Column:
    """Digests of a's sections that b lacks: where a was edited."""
    part = lambda m: F.split(F.element_at(F.split(m, " "), 2), ",")
    return F.array_except(part(a), part(b))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_chars and fingerprint (columns of those names are replaced)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_chars", "fingerprint")]
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*kept, F.char_length(body).cast("bigint").alias("n_chars"), fingerprint(body).alias("fingerprint"))


def _before(ids: DataFrame) -> DataFrame:
    """ids: key, h, n. Adds to each row the key, number and third of the length of the row before it in descending order
    of the key, then by h; before the first stands the last."""
    dealt = stored(ids.repartitionByRange(F.col("key").desc()).withColumn("part", F.spark_partition_id()), "ids")
    placed = (
        dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", "key").orderBy("h")))
        .withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.col("key").desc(), "nth")))
        .withColumn("row", F.struct("key", "nth", F.floor(F.col("n") / 3).alias("k")))
        .withColumn("left", F.lag("row").over(Window.partitionBy("part").orderBy("at")))
    )
    # one row for each range partition: its last row, moved to the partition after it, round the end
    ends = placed.groupBy("part").agg(F.max_by("row", "at").alias("end"))
    ring = ends.withColumn("end", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.max_by("end", "part").over(Window.partitionBy())))
    left = F.coalesce("left", "end")
    return placed.join(F.broadcast(ring), "part").select(
        "key", "nth", left["key"].alias("left_key"), left["nth"].alias("left_nth"), left["k"].alias("left_k")
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. The fingerprint of every text and of its edited text: its last third replaced by as many
    characters from the head of the next document in descending order of doc_id."""
    # plain equality on a key that is never null keeps rows dealt as the window has dealt them, and both uses of the
    # documents read the same columns, so they share one shuffle
    none = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), none).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.select("key", "h", F.char_length("text").cast("bigint").alias("n"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("h"))).drop("h")
    left = _before(ids).select(F.col("key").alias("own"), F.col("nth").alias("n"), "left_key", "left_nth", "left_k")
    # nth is compared by its difference so that rows stay dealt by the key alone
    heads = numbered.join(left, (F.col("key") == F.col("own")) & (F.col("nth") - F.col("n") == 0)).select(
        "left_key",
        "left_nth",
        F.expr("substring(text, 1, cast(left_k AS int))").alias("head"),
        fingerprint(F.col("text")).alias("next_fingerprint"),
    )
    n = F.char_length("text").cast("bigint")
    joined = (
        numbered.join(heads, (F.col("key") == F.col("left_key")) & (F.col("nth") - F.col("left_nth") == 0))
        .withColumn("n_chars", n)
        .withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) AS int)), head)"))
        .select(
            F.nullif("key", none).alias("doc_id"),
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
            "next_fingerprint",
        )
    )
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
