"""A training corpus in five stages: toxicity, near copies, repeated passages, benchmark passages, packing.

Each stage takes all that the one before it kept. The first four return the columns of ``documents``; the last
one returns the pieces of each kept document with their place in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import decontamination, jaccard_join, packing, suffix_dedup, toxicity
from oreline.llm.common import back, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model does not reject; it learns from the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard of at least 0.75 on five-word shingles."""
    return jaccard_join.keep_one(docs, k=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus."""
    return suffix_dedup.rewrite(docs, size=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    import public_tokenizers

    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return got.select(back().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained and iterative stages; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
