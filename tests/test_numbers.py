"""Numeric facts of the statistics."""

from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as _settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.functions import stats as X


def one(spark, values, schema="v long"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_percentiles(spark):
    r = X.distribution(one(spark, range(1, 11)), "v").first()
    assert (r.n, r.min, r.p50, r.p75, r.p99_9, r.max) == (10, 1, 5, 8, 10, 10)
    r = X.distribution(one(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "v").first()
    assert (r.mean, r.stddev) == (5.0, 2.0)
    r = X.distribution(one(spark, []), "v").first()
    assert (r.n, r.p50, r.mean, r.stddev) == (0, 0, 0.0, 0.0)


def test_weighted(spark):
    r = X.weighted_distribution(one(spark, [(10, 1), (20, 1), (30, 98)], "v long, w long"), "v", "w").first()
    assert (r.n, r.total_weight, r.p50) == (3, 100, 30)


@_settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**6), 10**18) | st.integers(-5, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_ranks_equal_sorted_values(spark, pairs):
    r = X.ranked(one(spark, pairs, "v long, w long"), "v", X.TENTHS, moments=False).first()
    values = sorted(v for v, _ in pairs)
    assert [r[k] for k in X.TENTHS] == [values[max(1, -(-t * len(values) // 1000)) - 1] for t in X.TENTHS.values()]
    r = X.weighted_distribution(one(spark, pairs, "v long, w long"), "v", "w").first()
    many = sorted(v for v, w in pairs for _ in range(w))
    assert (r.n, r.excluded, r.total_weight) == (sum(w > 0 for _, w in pairs), sum(w == 0 for _, w in pairs), len(many))
    assert [r[k] for k in X.TENTHS] == [many[max(1, -(-t * len(many) // 1000)) - 1] if many else 0 for t in X.TENTHS.values()]


def test_ratio_order_is_exact(spark):
    big = 2**62
    pairs = [(big, big - 1), (big - 1, big - 2), (big - 2, big - 3), (1, 3), (2, 6), (0, 5), (7, 1), (333, 1000), (3333, 10000), (10, 3), (3, 1)]
    got = X.ratio_order(one(spark, pairs, "u long, c long"), "u", "c").collect()
    order = sorted({Fraction(u, c) for u, c in pairs})
    assert all(r.place == order.index(Fraction(r.u, r.c)) for r in got)


def test_histogram_and_ratio(spark):
    h = {r.bucket: r.n for r in X.log2_histogram(one(spark, [0, 1, 1, 2, 3, 4, 1024]), "v").collect()}
    assert h == {"0": 1, "2^0-2^1": 2, "2^1-2^2": 2, "2^2-2^3": 1, "2^10-2^11": 1}
    r = X.ratio_distribution(one(spark, [(150, 100), (149, 100), (151, 100), (5, 0)], "u long, c long"), "u", "c").first()
    assert (r.n, r.p50, r.max) == (3, 1.5, 1.51)


def test_scalars(spark):
    r = spark.range(1).select(
        S.pow2_ceil(F.lit(45_414_309)).alias("a"), S.pow2_ceil(F.lit(0)).alias("b"), S.pow2_ceil(F.lit(4096)).alias("c"), S.pow2_ceil(F.lit(2**62 + 1)).alias("d"),
        F.crc32(F.lit(b"123456789")).alias("crc"), S.year_of(F.lit("1999-1-2")).alias("y"), S.year_of(F.lit("99-01-01")).alias("y2"), S.top_bucket(F.lit("levels/a/b/Ports/x/")).alias("t"),
        S.sanitize(F.lit("a b/c")).alias("s"), S.sanitize(F.lit("con")).alias("s2"), S.sanitize(F.lit("")).alias("s3"), S.flatten_control(F.lit("a\x1b[1m\nb")).alias("f"),
        S.map_of(F.lit("Maps/e1m1.WAD")).alias("m"), S.map_of(F.lit("maps/x/e.wad")).alias("m2"), S.normalize_dir(F.lit("a/b//")).alias("n"),
        S.is_embedded(F.lit("x.wad"), F.lit("q")).alias("e"), S.is_embedded(F.lit("Q/x.WAD"), F.lit("q")).alias("e2"), S.is_embedded(F.lit("q/r/x.wad"), F.lit("q")).alias("e3"),
        S.method_label(F.lit("unsupported(6)")).alias("l"), S.bam_angle(F.lit(0.0), F.lit(1.0)).alias("g"), F.round(F.lit(-0.5)).alias("r"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == (67_108_864, 1, 4096, 2**63 - 1)
    assert r.crc == 0xCBF43926 and (r.y, r.y2, r.t) == ("1999", "unknown", "levels/a/Ports")
    assert (r.s, r.s2, r.s3, r.f, r.m, r.m2, r.n) == ("A_B_C", "_CON", "UNNAMED", "a[1m b", "E1M1", None, "a/b/")
    assert (r.e, r.e2, r.e3, r.l, r.g, r.r) == (True, True, False, "Implode(6)", 16384, -1)


def test_sample_is_without_replacement():
    got = X.sample_positions(100, 30, 7)
    assert len(set(got)) == 30 and got == X.sample_positions(100, 30, 7) and sorted(X.sample_positions(5, 9, 1)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("text", "value", "error"), [(" 12 ", 12, False), (None, 0, False), ("x", 0, True)])
def test_lenient(spark, text, value, error):
    v, e = S.lenient_long(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), e.alias("e")).first()
    assert (r.v, bool(r.e)) == (value, error)


def test_seeded_sample_of_dealt_rows(spark, tmp_path):
    """Many files with keys in no order: every draw has its row, the one at its position."""
    from oreline.plans.statistics import seeded_sample

    k = F.col("id") * 3 - 1_000_000
    o = spark.range(0, 600_000, 1, 12).select(k.alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") / 4).alias("o_totalprice"))
    o.repartition(12, F.hash("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    want = [(i, 3 * p - 1_000_000, p / 4) for i, p in enumerate(X.sample_positions(600_000, 50, 20260812))]
    assert sorted(map(tuple, seeded_sample(spark, str(tmp_path)).collect())) == want


def test_rows_at_positions(spark):
    """Keys far apart, the least and greatest whole numbers, and nulls at the end."""
    keys = [-(2**63), 2**63 - 1, *range(-70_000, 70_000), 2**40, 2**40 + 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").union(spark.createDataFrame([(None,)] * 3, "k long")).repartition(5)
    at = [0, 1, 70_001, 140_000, 140_001, 140_002, 140_003, 140_004, 140_006, 999_999]
    want = [(i, p, [*sorted(keys), None, None, None][p]) for i, p in enumerate(at[:-1])]
    assert sorted(map(tuple, X.rows_at(df, "k", at).select("draw", "position", "k").collect())) == want
    assert X.rows_at(df.where("k is null and k > 0"), "k", [0]).count() == 0 and X.rows_at(df, "k", []).count() == 0
