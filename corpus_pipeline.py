"""A corpus pipeline of five stages over ``documents``: language ID, near-duplicates, repeated passages, benchmark
decontamination, byte-level BPE. ``run`` applies them; every stage's rows are written to the shared folder as Parquet
and read again for the next, so a lost executor costs one stage's tasks at most.

Every stage works on all rows its predecessor kept and returns the columns of documents, the last one ids and digests.
Nulls, empty texts, repeated rows and further columns: as the operators define them. Language ID drops texts without a
letter; of near-duplicates the row of least doc_id stays; repeated passages are cut out of all but their first document
(a document of which nothing is left goes); contaminated documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, language, near_dup, substring_dedup
from larkspur.llm.common import crc32_mod, drop, stored, table, temporary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = language.train(docs.filter(crc32_mod("doc_id", 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    return language.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoding_digests(bpe.encode_documents(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate_benchmark),
    ("byte_bpe", encode),
]

#: Signatures, segmentation sums and merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as keep:  # a stage's own tables go when its rows are written, the rows when they are used up
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        if before is not None:
            drop(before)
        before = docs
    return docs
