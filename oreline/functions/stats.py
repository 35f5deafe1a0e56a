"""Exact statistics: nearest-rank percentiles, weighted percentiles, integer means and deviations, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Percentiles of a distribution, in tenths of a percent.
TENTHS = {"p50": 500, "p75": 750, "p90": 900, "p95": 950, "p99": 990, "p99_5": 995, "p99_9": 999}


def rank(tenths: int, total: Column | str) -> Column:
    """Nearest rank of a percentile among ``total``: a whole-number ceiling, 1 at least."""
    return F.expr(f"greatest(1L, ({tenths}L * {total} + 999L) div 1000L)")


def _spot(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises, the same for values within about one hundredth of each other."""
    size = F.floor(F.log2(F.abs(v.cast("double"))) * 64).cast("long") + 80_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def ranked(df: DataFrame, value: str, tenths: dict[str, int], *keys: str, weight: str | None = None, moments: bool = True) -> DataFrame:
    """For each key: n (rows with a value), total (their weight, or n), least, most, each percentile in ``tenths`` (null for
    no rows), and exact sums __s1 and __s2 of values and squares.

    Values are counted, then the counts summed by spot, of which a key has a few thousand at most: running sums over
    those tell which spots hold the ranks, and only their values are put in order. So no key's values meet in one task."""
    v = F.col(value)
    one = F.when(v.isNotNull(), F.col(weight) if weight else F.lit(1)).otherwise(0)
    by = df.groupBy(*keys, value).agg(F.sum(one).cast("long").alias("__c"), F.count(value).alias("__m")).withColumn("__spot", _spot(v))
    d, c = v.cast("decimal(38,0)"), F.col("__c").cast("decimal(38,0)")
    sums = [F.sum(d * c).alias("__s1"), F.sum(d * d * c).alias("__s2")] if moments else []
    spots = by.groupBy(*keys, "__spot").agg(F.sum("__c").alias("__c"), F.sum("__m").alias("__m"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), *sums)
    w = W.partitionBy(*keys)
    spots = spots.withColumn("__before", F.sum("__c").over(w.orderBy("__spot").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")).withColumn("__total", F.sum("__c").over(w))
    inside = [(rank(t, "__total") > F.col("__before")) & (rank(t, "__total") <= F.col("__before") + F.col("__c")) for t in tenths.values()]
    ends = spots.where(F.array_contains(F.array(*inside), True)).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__spot").alias("__at"), "__before", "__total")
    same = F.col("__spot") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    few = by.join(ends, same)
    few = few.withColumn("__cum", F.col("__before") + F.sum("__c").over(W.partitionBy(*keys, "__spot").orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    at = few.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[F.min(F.when(F.col("__cum") >= rank(t, "__total"), v)).alias(k) for k, t in tenths.items()])
    whole = spots.groupBy(*keys).agg(
        F.coalesce(F.sum("__m"), F.lit(0)).alias("n"), F.coalesce(F.sum("__c"), F.lit(0)).alias("total"), F.min("__lo").alias("least"), F.max("__hi").alias("most"),
        *([F.sum("__s1").alias("__s1"), F.sum("__s2").alias("__s2")] if moments else []),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return whole.join(at, same, "left").drop(*[f"__k_{k}" for k in keys])


def _whole(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(c)


def mean_and_stddev(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and population deviation from exact sums of values and squares."""
    safe = F.when(n > 0, n).cast("double")
    mean = F.coalesce(s1.cast("double") / safe, F.lit(0.0))
    var = F.coalesce(s2.cast("double") / safe, F.lit(0.0)) - mean * mean
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def distribution(df: DataFrame, value: str, *keys: str, times: str | None = None) -> DataFrame:
    """n, min, the seven percentiles, max, mean, stddev of a whole-number column, for each key; one row of zeros
    for no rows and no keys. With ``times``, a row stands for so many."""
    got = ranked(df, value, TENTHS, *keys, weight=times).withColumn("n", F.col("total"))
    mean, dev = mean_and_stddev(F.col("n"), F.col("__s1"), F.col("__s2"))
    least, most = F.coalesce("least", F.lit(0)).cast("long").alias("min"), F.coalesce("most", F.lit(0)).cast("long").alias("max")
    return got.select(*keys, "n", least, *map(_whole, TENTHS), most, mean.alias("mean"), dev.alias("stddev"))


def weighted_distribution(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """n (pairs of positive weight), total_weight, excluded (pairs without), weighted percentiles, mean and stddev."""
    kept = df.where(F.col(weight) > 0)
    got = ranked(kept, value, TENTHS, *keys, weight=weight)
    mean, dev = mean_and_stddev(F.col("total"), F.col("__s1"), F.col("__s2"))
    got = got.select(*keys, "n", F.col("total").alias("total_weight"), *map(_whole, TENTHS), mean.alias("mean"), dev.alias("stddev"))
    left = df.where(~F.coalesce(F.col(weight) > 0, F.lit(False))).groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("excluded"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return got.join(left, same, "left").drop(*[f"__k_{k}" for k in keys]).withColumn("excluded", F.coalesce("excluded", F.lit(0)))


def ratio_distribution(df: DataFrame, num: str, den: str, *keys: str) -> DataFrame:
    """n, min, p50, p90, p99, max of num / den over rows with a positive denominator."""
    r = df.where(F.col(den) > 0).withColumn("__r", F.col(num).cast("double") / F.nullif(F.col(den), F.lit(0)).cast("double"))
    at = {k: TENTHS[k] for k in ("p50", "p90", "p99")}
    got = ranked(r, "__r", at, *keys, moments=False)
    return got.select(*keys, "n", F.col("least").alias("min"), *at, F.col("most").alias("max"))


def ratio_key(num: Column, den: Column) -> Column:
    """An array whose order is the exact order of ``num / den`` (whole numbers, the second one positive): the terms of the
    continued fraction with alternating signs. Equal ratios have equal arrays."""
    most = 2**63 - 1
    start = F.struct(num.cast("long").alias("a"), den.cast("long").alias("b"), F.array().cast("array<bigint>").alias("q"))

    def step(s: Column, i: Column) -> Column:
        q = F.call_function("div", s["a"], F.nullif(s["b"], F.lit(0).cast("long")))
        more = F.concat(s["q"], F.array(F.when(i % 2 == 0, q).otherwise(-q)))
        rest = F.coalesce(s["a"] % F.nullif(s["b"], F.lit(0).cast("long")), F.lit(0).cast("long"))
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), rest.alias("b"), more.alias("q")))

    end = lambda s: F.concat(s["q"], F.array(F.when(F.size(s["q"]) % 2 == 0, F.lit(most)).otherwise(F.lit(-most))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(91)), start, step, end)


def ratio_order(df: DataFrame, num: str, den: str, *keys: str) -> DataFrame:
    """``place`` (from 0) of each pair by its exact ratio within each key; equal ratios share a place."""
    w = W.partitionBy(*keys).orderBy("__q")
    return df.withColumn("__q", ratio_key(F.col(num), F.col(den))).withColumn("place", (F.dense_rank().over(w) - 1).cast("long")).drop("__q")


def log2_histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count of each occupied power-of-two bucket, ascending by ``k`` (-1 for zero)."""
    from oreline.functions.scalars import log2_bucket, log2_floor

    return df.groupBy(*keys, log2_floor(F.col(value)).alias("k"), log2_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def splitmix(state: int) -> tuple[int, int]:
    """(next state, output) of the 64-bit mixer."""
    m = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & m
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return state, z ^ (z >> 31)


def sample_positions(n: int, count: int, seed: int) -> list[int]:
    """Positions drawn without replacement, in drawing order; keeps moved positions only, not the whole range."""
    moved: dict[int, int] = {}
    out, state = [], seed
    for i in range(min(n, count)):
        state, x = splitmix(state)
        j = i + x % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def rows_at(df: DataFrame, key: str, positions: list[int]) -> DataFrame:
    """Rows of ``df`` at some positions (from 0) of the order by ``key``, a whole number (nulls last), with ``position`` and ``draw``,
    the place in ``positions``.

    Spans of keys that hold a position are divided, by exact counts, until they are short; only their rows are put in order. Bounds
    of spans are values, so both passes over the data agree on them however its rows are dealt."""
    k, few, most = F.col(key), 1_024, 50_000
    one = df.agg(F.count(key), F.min(key), F.max(key), F.count(F.lit(1))).first()
    spans, ready = [(one[1], one[2], 0, one[0])], []  # least key, greatest key, rows before, rows
    if any(one[0] <= p < one[3] for p in positions):
        ready.append((None, None, one[0], one[3] - one[0]))
    while spans := [s for s in spans if any(s[2] <= p < s[2] + s[3] for p in positions)]:
        long = [s for s in spans if s[3] > most and s[0] < s[1]]
        ready += [s for s in spans if s not in long]
        spans = []
        if not long:
            break
        which, width = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi, _, _) in enumerate(long):
            inside = k.between(lo, hi)
            which, width = F.when(inside, i).otherwise(which), F.when(inside, max(1, (hi - lo) // few)).otherwise(width)
        parts = df.select(k, which.alias("__i"), width.alias("__w")).where("__i is not null").groupBy("__i", F.expr(f"`{key}` div __w").alias("__p")).agg(F.min(key), F.max(key), F.count(F.lit(1)))
        ahead = [s[2] for s in long]
        for i, _, lo, hi, n in sorted(map(tuple, parts.collect())):  # at most some thousand for each position
            spans.append((lo, hi, ahead[i], n))
            ahead[i] += n
    span, before = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (lo, hi, ahead, _) in enumerate(ready):
        inside = k.isNull() if lo is None else k.between(lo, hi)
        span, before = F.when(inside, i).otherwise(span), F.when(inside, F.lit(ahead)).otherwise(before)
    rest = [c for c in df.columns if c != key]
    rows = df.withColumns({"__i": span, "__before": before}).where("__i is not null")
    rows = rows.withColumn("position", F.col("__before") + F.row_number().over(W.partitionBy("__i").orderBy(k.asc_nulls_last(), *rest)) - 1)
    at = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(positions)], "position long, draw int")
    return rows.join(F.broadcast(at), "position").drop("__i", "__before")
