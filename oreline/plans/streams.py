"""Record logs as streams, run to the end of what is there, and records written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oreline import steps
from oreline.functions import report
from oreline.plans.catalogue import register, table
from oreline.sources import records
from oreline.streaming import logs


def _events(spark, sf_dir):
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parq*t")


@register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_replay(spark, sf_dir):
    at = f"{steps.shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    logs.replay(_events(spark, sf_dir), f"{at}/table", f"{at}/progress", "user_id", "event_id").awaitTermination()
    return logs.current(spark, f"{at}/table").select("user_id", "event_id", "event_type", "value")


@register("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    at = f"{steps.shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    counts = logs.windowed(_events(spark, sf_dir), "ts", "event_type", late="10 minutes", size="1 hour")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{at}/table")
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@register("SELECT o_custkey AS id, o_orderkey AS votes, o_orderpriority AS title FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def written_records(spark, sf_dir):
    """Records written as sorted lines of JSON, the last of a key, and read back through the reader."""
    at = f"{steps.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("votes"), F.col("o_orderpriority").alias("title"))
    records.write_jsonl(o, at, "id", [F.col("votes")])
    good, bad = records.read_jsonl(spark, at, records.FILE)
    return good.select("id", "votes", "title").join(bad.select(F.lit(1)).limit(1).agg(F.count(F.lit(1)).alias("b")).where("b = 0")).select("id", "votes", "title")


@register("SELECT p_partkey, p_name || '\"a, b' AS name, p_size FROM part")
def written_tables(spark, sf_dir):
    """A table written as CSV with quotes and commas in it, and as lines of JSON; rows that both give back."""
    at = f"{steps.shared_dir(spark)}/report-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('"a, b')).alias("name"), "p_size")
    report.write_csv(p, f"{at}/csv")
    report.write_ndjson(p, f"{at}/json")
    ddl = "p_partkey long, name string, p_size int"
    return spark.read.schema(ddl).option("header", True).option("escape", '"').csv(f"{at}/csv").intersect(spark.read.schema(ddl).json(f"{at}/json").select("p_partkey", "name", "p_size"))
