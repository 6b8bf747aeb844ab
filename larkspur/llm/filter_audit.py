"""How filters of a corpus act together: for every order of them, what each step removes, what it would have removed but for
earlier ones, and the labelled rows that it costs.

Each row gets a mask of the filters that it fails. Of every part (language) only the counts of the masks matter, 2^n of
them: a subset-zeta transform turns them into the survivors of every set of filters, all sets at once (a row survives a set
if its mask lies inside the complement). A step of an order is the difference between two neighbouring sets, and so for
labelled rows.

Scale: one scan gives a row of some 60 bytes for each text; the text itself is never shuffled. Identical texts are found by
their SHA-256: the least id of each digest by partial aggregation, then a join on digest and id together, so that a text
with millions of copies is no hot key. Everything after that is 2^n rows for a part.

Defined results: a null text is the empty one, a null part the empty string; a row without id is a copy of none, and none of
it; of repeated rows of the least id none is a copy; rows of ``labels`` for one id count once, if any of them has the label;
an empty table gives no rows. Of further columns none is read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Letters of the filters; the bit of each in a mask is its place.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")


def failed_by_text(text: Column, least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3) -> Column:
    """Mask of the filters that a text alone decides: few words (A), few distinct words (B), many capitals (C), marks (D)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [
        F.size(words) < least_words,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct_percent,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * upper_percent,
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: rows of each mask of failed filters, and those labelled so."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        failed_by_text(body).alias("mask"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    rows = stored(own, "masks").groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    known = rows.filter("id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    fate = F.when(F.col("first").isNull(), COPY).otherwise(0)
    judged = known.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + fate).alias("mask"), "n")
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    both = judged.join(said, "id", "left").na.fill(0, ["good", "toxic"])
    both = both.unionByName(rows.filter("id IS NULL").select("id", "part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    total = [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")]
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *total)


def zeta(counts: Column, n: int) -> Column:
    """Array of 2^n values by mask -> for each mask the sum over all its subsets, one bit at a time."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def with_bit(sums: Column, bit: Column) -> Column:
        return F.transform(every, lambda m: F.get(sums, m) + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m - bit)).otherwise(0))

    return F.aggregate(F.lit([1 << i for i in range(n)]), counts, with_bit)


def _orders() -> Column:
    """All orders of the filters: filter_order and, for each step, the set of filters before it and its own bit."""
    out = []
    for order in map("".join, permutations(LETTERS)):
        bits = [1 << LETTERS.index(x) for x in order]
        out.append({"filter_order": order, "steps": [{"before": sum(bits[:i]), "bit": b} for i, b in enumerate(bits)]})
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order:string,steps:array<struct<before:int,bit:int>>>>")


def interactions(counts: DataFrame) -> DataFrame:
    """counts: part, mask, n, good, toxic. One row for each part, order and step."""
    size = 1 << len(LETTERS)
    found = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 2^n rows at most
    by_mask = counts.groupBy("part").agg(found.alias("at"))

    def dense(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at("at", m)[c], F.lit(0)))

    for c in ("n", "good", "toxic"):
        by_mask = by_mask.withColumn(f"{c}_own", dense(c)).withColumn(c, zeta(F.col(f"{c}_own"), len(LETTERS)))
    rows = by_mask.select("part", "n_own", "n", "good", "toxic", F.explode(_orders()).alias("o"))
    rows = rows.select("*", F.posexplode("o.steps").alias("at", "s"))

    def surviving(c: str, removed_by: Column) -> Column:
        return F.get(F.col(c), F.lit(size - 1) - removed_by)

    def lost(c: str) -> Column:
        return surviving(c, F.col("s.before")) - surviving(c, F.col("s.before") + F.col("s.bit"))

    fails = surviving("n", F.lit(0)) - surviving("n", F.col("s.bit"))
    steps = rows.select(
        "part",
        "o.filter_order",
        (F.col("at") + 1).alias("step"),
        surviving("n", F.col("s.before") + F.col("s.bit")).alias("kept"),
        lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"),
        F.get("n_own", F.col("s.bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("s.bit").alias("bit"),
    )
    every_order = Window.partitionBy("part", "bit")
    return steps.withColumn("shapley", F.sum("removed").over(every_order)).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The filters A to E (see ``failed_by_text``; E: a copy of a smaller id's text) in all their orders: part, filter_order,
    step, kept, removed, redundant (failing, but removed before), unique_fails, good_lost, toxic_lost, shapley (removed by
    the step's filter, over all orders)."""
    return interactions(masks(docs, labels, **columns))
