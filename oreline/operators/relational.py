"""Order-aware operators on tables of named blobs and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreline import steps


def diff(first: DataFrame, second: DataFrame, name: str, order: str, digest: str) -> DataFrame:
    """Names whose ordered lists of payload digests differ: ``status`` is only_in_first, only_in_second or
    changed; ``ordinal`` follows first appearance in ``first``, then in ``second``."""

    def lists(df: DataFrame, side: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))))
        return df.groupBy(F.col(name).alias("name")).agg(F.transform(pairs, lambda p: p["d"]).alias(side), F.min(order).alias(f"{side}_at"))

    j = lists(first, "a").join(lists(second, "b"), "name", "full")
    status = F.when(F.col("b").isNull(), "only_in_first").when(F.col("a").isNull(), "only_in_second").when(F.col("a") != F.col("b"), "changed")
    return j.select("name", status.alias("status"), F.struct(F.col("a_at").isNull().alias("s"), F.coalesce("a_at", "b_at").alias("o")).alias("ordinal")).where("status is not null")


def first_match(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key, the values of the row that comes first."""
    best = F.min_by(F.struct(*values), order)
    return df.groupBy(key).agg(best.alias("__b"), F.min(order).alias(order)).select(key, order, "__b.*")


def dedup(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row of each key: the first or last in the order."""
    by = [o.desc() if keep == "last" else o.asc() for o in order]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def concat(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, duplicates kept; ``input`` tells which one a row is from."""
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("input", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def offsets(df: DataFrame, container: str, order: str, size: str, start: int = 12) -> DataFrame:
    """Position of each blob when all are written one after another behind a header of ``start`` bytes."""
    w = W.partitionBy(container).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("filepos", F.lit(start) + F.coalesce(F.sum(size).over(w), F.lit(0)))


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def next_where(df: DataFrame, by: list[str], order: str, condition: Column, name: str) -> DataFrame:
    """The order value of the next row, the row itself included, for which the condition holds."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn(name, F.min(F.when(condition, F.col(order))).over(w))


def runs(df: DataFrame, by: list[str], order: str, inside: Column) -> DataFrame:
    """Maximal runs of rows inside a group that directly follow a row outside: ``marker`` (order of the row before),
    ``first``, ``last``, ``n``. A run without a row before it has no marker."""
    w = W.partitionBy(*by).orderBy(order)
    d = df.withColumn("__in", inside).withColumn("__pos", F.row_number().over(w)).withColumn("marker", F.lag(order).over(w))
    d = d.withColumn("__run", F.col("__pos") - F.sum(F.col("__in").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("__in")
    return d.groupBy(*by, "__run").agg(F.min_by("marker", "__pos").alias("marker"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def resolve(df: DataFrame, ref: str, target: DataFrame, key: str, name: str, sentinel: int | None = None, required: bool = False) -> DataFrame:
    """Look ``ref`` up among the keys of ``target``: ``name`` is the key, or null, or 0 if it is required; ``name_miss``
    says that a reference other than the sentinel was not found."""
    t = target.select(F.col(key).alias("__k")).distinct()
    wanted = F.nullif(F.col(ref), F.lit(sentinel)) if sentinel is not None else F.col(ref)
    j = df.withColumn("__want", wanted).join(t, F.col("__want") == F.col("__k"), "left")
    got = F.coalesce("__k", F.lit(0)) if required else F.col("__k")
    return j.withColumn(name, got).withColumn(f"{name}_miss", F.col("__want").isNotNull() & F.col("__k").isNull()).drop("__want", "__k")


def changed_groups(now: DataFrame, before: DataFrame, group: str, *members: str) -> DataFrame:
    """Groups whose sets of members differ, or that are on one side only."""
    sets = lambda df, n: df.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(*members))).alias(n))
    return sets(now, "a").join(sets(before, "b"), group, "full").where("not (a <=> b)").select(group)


def merge_ranges(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Union of half-open ranges of each group; touching ranges are one."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    d = df.withColumn("__reach", F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("__new", (F.col("__reach").isNull() | (F.col(lo) > F.col("__reach"))).cast("int"))
    d = d.withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*by, "__g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__g")


def reach(edges: DataFrame, roots: DataFrame, limit: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Breadth-first levels over an edge table (src, dst) from ``roots`` (node): ``node``, ``level``. Nodes seen are never
    looked at again, so cycles end. Each level is a written table; with ``checkpoint``, a folder, a run that was broken off goes
    on after its last whole level, unless it began from other roots."""
    spark = edges.sparkSession
    first = roots.select("node").distinct().withColumn("level", F.lit(0))
    base = None
    if checkpoint is not None:
        mark = first.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h")).first()
        base = f"{checkpoint.rstrip('/')}/roots-{mark['n']}-{mark['h']}"

    def level(df: DataFrame, n: int) -> DataFrame:
        path = f"{base}/level={n:06d}" if base else None
        if base and steps.children(spark, path)[:1] == ["_SUCCESS"]:
            return spark.read.schema(first.schema).parquet(path)
        return steps.written(df, f"reach-{n}", path)

    front = seen = level(first, 0)
    n = 0
    while limit is None or n < limit:
        n += 1
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = level(new.withColumn("level", F.lit(n)), n)
        if front.isEmpty():
            break
        seen = seen.union(front)
        if n % 16 == 0 and not base:  # keep the plan short
            seen = steps.written(seen, "reach-seen")
    return seen
