"""Append-only record logs as streams.

:func:`replay` keeps the last record of each key in a table, batch by batch: a log can be stopped and resumed from its
checkpoint, and a batch that is delivered twice changes nothing. :func:`windowed` counts events in event-time windows
behind a watermark (an addition; record logs have no windows of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oreline import steps
from oreline.operators import relational as R


def upsert(table_path: str, key: str, order: str, buckets: int = 16):
    """A ``foreachBatch`` function that merges a batch into the table at ``table_path``: the last record of a key wins.
    The merged table is written beside the old one under the batch's number, so readers never see half of it; versions older
    than the one before are removed. Keys are dealt over ``buckets`` folders, and only those a batch touches are written
    again (:func:`current` reads the newest of each)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = R.dedup(batch, [key], [F.col(order)], "last").withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        for b in sorted(r["__bucket"] for r in now.select("__bucket").distinct().collect()):  # <= buckets rows
            at = f"{table_path}/b={b:04d}"
            mine = now.where(F.col("__bucket") == b).drop("__bucket")
            known = [v for v in _whole(spark, at) if int(v[2:]) < number]
            if known:
                mine = R.dedup(spark.read.parquet(f"{at}/{known[-1]}").unionByName(mine), [key], [F.col(order)], "last")
            mine.write.mode("overwrite").parquet(f"{at}/v={number:012d}")
            for old in known[:-1]:
                steps.delete(spark, f"{at}/{old}")

    return merge


def _whole(spark, path: str) -> list[str]:
    """Versions whose write has ended."""
    return [v for v in steps.children(spark, path) if v.startswith("v=") and "_SUCCESS" in steps.children(spark, f"{path}/{v}")]


def current(spark, table_path: str) -> DataFrame | None:
    """The newest merged rows of all keys."""
    paths = []
    for b in steps.children(spark, table_path):
        found = _whole(spark, f"{table_path}/{b}")
        paths += [f"{table_path}/{b}/{found[-1]}"] if found else []
    return spark.read.parquet(*paths) if paths else None


def replay(log: DataFrame, table_path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Drain what the log holds now into the table."""
    return log.writeStream.foreachBatch(upsert(table_path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their total value in each window and key; late ones count until the watermark has passed."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
