"""The queries ``opN_<name>``: each applies one operator to its whole table and returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import common as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def held_out(n: int, rest: int) -> F.Column:
    """Whether the row is left out of training; null for a null id, which belongs to no fold."""
    return (F.crc32(C.back().cast("string").cast("binary")) % n == rest).alias("held_out")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), exclude_fold=1, folds=3)
    return toxicity.score(docs, model, threshold=0.7).select(
        C.back().alias("doc_id"), held_out(3, 1), "score", "predicted"
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import media

    stored = media.store(table(spark, sf_dir, "documents"))
    known = media.catalogue(stored)
    # every document as a page that refers to its payload; the caption carries its length
    page = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>"))
    pages = stored.select("__id", page.alias("html"))
    got = media.resolve(media.parse(pages, "__id", "html"), known)
    return got.select(
        C.back("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256",
        "tail_crc32", "media_bytes", "media_sha256", "feature",
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import url_filter

    rules = url_filter.parse_rules(["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"])
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every licence-like paragraph of ``documents``."""
    from oreline.llm import licenses

    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(licenses.sample_lines(docs)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), exclude_fold=2, folds=4)
    return quality.score(docs, model, threshold=0.7).select(
        C.back().alias("doc_id"), held_out(4, 2), "score", "predicted"
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import language_model

    got = language_model.score(table(spark, sf_dir, "documents"), (F.col("__id") != C.NULL_ID) & (fold("__id", 5) != 1))
    return got.select(
        C.back().alias("doc_id"), held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import suffix_dedup

    got = suffix_dedup.digest(table(spark, sf_dir, "documents"), size=100)
    return got.select(C.back("__doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oreline.llm import jaccard_join

    got = jaccard_join.components(table(spark, sf_dir, "documents"), k=5)
    return got.select(C.back().alias("doc_id"), "n_shingles", "component_id")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item of which it holds at least half the words in tiles."""
    from oreline.llm import decontamination

    got = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(C.back().alias("doc_id"), "item_id", "coverage", "matched_words", "item_words", "n_tiles")


def op8_packing(spark: SparkSession, sf_dir: str, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    from oreline.llm import packing

    got = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity)
    return got.select(C.back().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from oreline.llm.oracle import SQL

    return dict(SQL)
