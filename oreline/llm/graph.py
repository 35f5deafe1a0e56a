"""Connected components of an edge table, by repeated hooking to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node of its component) for every node of ``edges`` (a, b: long).

    Alternates between linking all neighbours above a node to its least neighbour and linking
    all neighbours at most the node to it, until the edges are stars. Edges are written after
    each pair of steps, so lost executors cost one round at most. A node with very many neighbours
    only ever takes part in hash aggregation and in a join that adaptive execution can split."""
    e = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # every neighbour above the node goes to the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.materialize(large, "cc-large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = C.materialize(small.where("a <> b").distinct(), "cc-edges")
        C.release(large)
        if _mark(nxt) == _mark(e):
            C.release(nxt)
            break
        C.release(e)
        e = nxt
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
