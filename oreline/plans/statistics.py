"""Corpus statistics over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.functions import stats as X
from oreline.plans.catalogue import register, table

CENTS = lambda c: F.round(F.col(c) * 100).cast("long")


def _dist_sql(value: str, source: str, keys: str = "") -> str:
    ps = ", ".join(f"CAST(coalesce(quantile_disc(v, {t / 1000}), 0) AS BIGINT) AS {k}" for k, t in X.TENTHS.items())
    sel, grp = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""WITH s AS (SELECT {sel}CAST({value} AS BIGINT) AS v FROM {source}),
    a AS (SELECT {sel}count(v) AS n, coalesce(min(v), 0) AS min, {ps}, coalesce(max(v), 0) AS max,
      sum(CAST(v AS HUGEINT)) AS s1, sum(CAST(v AS HUGEINT) * v) AS s2 FROM s {grp})
    SELECT {sel}n, min, {", ".join(X.TENTHS)}, max, CASE WHEN n = 0 THEN 0.0 ELSE CAST(s1 AS DOUBLE) / n END AS mean,
      CASE WHEN n = 0 THEN 0.0 ELSE sqrt(greatest(CAST(s2 AS DOUBLE) / n - (CAST(s1 AS DOUBLE) / n) * (CAST(s1 AS DOUBLE) / n), 0.0)) END AS stddev FROM a"""


@register(_dist_sql("round(l_extendedprice * 100)", "lineitem", "l_returnflag"))
def dist_by_flag(spark, sf_dir):
    return X.distribution(table(spark, sf_dir, "lineitem").select("l_returnflag", CENTS("l_extendedprice").alias("v")), "v", "l_returnflag")


@register(_dist_sql("round(o_totalprice * 100)", "orders"))
def dist_overall(spark, sf_dir):
    return X.distribution(table(spark, sf_dir, "orders").select(CENTS("o_totalprice").alias("v")), "v")


@register(_dist_sql("round(o_totalprice * 100)", "(SELECT strftime(o_orderdate, '%Y') AS year, * FROM orders)", "year"))
def dist_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(S.year_of(F.col("o_orderdate").cast("string")).alias("year"), CENTS("o_totalprice").alias("v"))
    return X.distribution(o, "v", "year")


@register("""WITH b AS (SELECT CASE WHEN v = 0 THEN -1 ELSE length(bin(v)) - 1 END AS k FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders))
  SELECT CAST(k AS INTEGER) AS k, CASE WHEN k < 0 THEN '0' ELSE '2^' || k || '-2^' || (k + 1) END AS bucket, count(*) AS n FROM b GROUP BY k""")
def log2_hist_price(spark, sf_dir):
    return X.log2_histogram(table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("v")), "v")


_WPS = ", ".join(f"CAST(coalesce(min(CASE WHEN cum * 1000 >= {t} * total THEN v END), 0) AS BIGINT) AS {k}" for k, t in X.TENTHS.items())


@register(f"""WITH p AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE l_linenumber <> 3),
  z AS (SELECT l_returnflag, count(*) AS excluded FROM lineitem WHERE l_linenumber = 3 GROUP BY 1),
  b AS (SELECT l_returnflag, v, sum(w) AS w, count(*) AS m FROM p GROUP BY ALL),
  c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM b),
  a AS (SELECT l_returnflag, CAST(sum(m) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS total_weight, {_WPS}, sum(CAST(v AS HUGEINT) * w) AS s1, sum(CAST(v AS HUGEINT) * v * w) AS s2 FROM c GROUP BY l_returnflag)
  SELECT l_returnflag, n, total_weight, coalesce(excluded, 0) AS excluded, {", ".join(X.TENTHS)}, CAST(s1 AS DOUBLE) / total_weight AS mean,
    sqrt(greatest(CAST(s2 AS DOUBLE) / total_weight - (CAST(s1 AS DOUBLE) / total_weight) * (CAST(s1 AS DOUBLE) / total_weight), 0.0)) AS stddev FROM a LEFT JOIN z USING (l_returnflag)""")
def weighted_p_price_by_qty(spark, sf_dir):
    w = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_quantity").cast("long"))
    return X.weighted_distribution(table(spark, sf_dir, "lineitem").select("l_returnflag", CENTS("l_extendedprice").alias("v"), w.alias("w")), "v", "w", "l_returnflag")


@register("""SELECT l_linestatus, count(r) AS n, min(r) AS min, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.9) AS p90, quantile_disc(r, 0.99) AS p99, max(r) AS max
  FROM (SELECT l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT)::DOUBLE / CAST(l_quantity AS BIGINT)::DOUBLE AS r FROM lineitem WHERE l_quantity > 0) GROUP BY l_linestatus""")
def ratio_dist(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_linestatus", CENTS("l_extendedprice").alias("u"), F.col("l_quantity").cast("long").alias("c"))
    return X.ratio_distribution(p, "u", "c", "l_linestatus")


@register("""SELECT l_returnflag, count(*) FILTER (WHERE d = 0 AND p > 0) AS anomalies, count(*) FILTER (WHERE d > 0) AS used,
    coalesce(max(p::DOUBLE / d) FILTER (WHERE d > 0), 0.0) AS max_ratio FROM
  (SELECT l_returnflag, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem) GROUP BY l_returnflag""")
def ratio_anomalies(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", CENTS("l_discount").alias("d"), CENTS("l_extendedprice").alias("p"))
    return p.groupBy("l_returnflag").agg(
        F.count_if((F.col("d") == 0) & (F.col("p") > 0)).alias("anomalies"), F.count_if(F.col("d") > 0).alias("used"),
        F.coalesce(F.max(F.when(F.col("d") > 0, S.safe_ratio(F.col("p"), F.col("d")))), F.lit(0.0)).alias("max_ratio"),
    )


@register("""WITH m AS (SELECT l_orderkey, count(*) AS k, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
  e AS (SELECT o_orderstatus, coalesce(k, 0) AS k, coalesce(q, 0) AS q, coalesce(r, 0) AS r FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)
  SELECT o_orderstatus, count(*) AS entries, count(*) FILTER (WHERE k = 0) AS zero_member, count(*) FILTER (WHERE k > 1) AS multi_member,
    CAST(sum(k) AS BIGINT) AS members, CAST(max(k) AS BIGINT) AS max_members, CAST(max(q) AS BIGINT) AS max_total, CAST(sum(r) AS BIGINT) AS returned FROM e GROUP BY 1""")
def entry_stats(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    e = o.join(m, o["o_orderkey"] == m["l_orderkey"], "left").fillna(0, ["k", "q", "r"])
    return e.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("k") == 0).alias("zero_member"), F.count_if(F.col("k") > 1).alias("multi_member"),
        F.sum("k").alias("members"), F.max("k").alias("max_members"), F.max("q").alias("max_total"), F.sum("r").alias("returned"),
    )


@register("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS misses, count(*) FILTER (WHERE quality IS NOT NULL AND quality * 1000 <> n_chars) AS mismatches,
    CAST(coalesce(max(abs(quality * 1000 - n_chars)) FILTER (WHERE quality * 1000 <> n_chars), 0) AS BIGINT) AS max_delta,
    CAST(coalesce(quantile_disc(abs(quality * 1000 - n_chars), 0.5) FILTER (WHERE quality * 1000 <> n_chars), 0) AS BIGINT) AS p50_delta
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def listing_join_misses(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality").cast("long") * 1000).alias("listed"))
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(lab, "doc_id", "left")
    j = j.withColumn("delta", F.when(F.col("listed") != F.col("n_chars"), F.abs(F.col("listed") - F.col("n_chars"))))
    counts = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("listed").isNull()).alias("misses"))
    deltas = X.ranked(j, "delta", {"p50": 500}, "lang", moments=False)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.join(deltas.select("lang", F.col("n").alias("mismatches"), zero("most").alias("max_delta"), zero("p50").alias("p50_delta")), "lang")


@register("SELECT doc_id, CAST(coalesce(quality * 1000, n_chars) AS BIGINT) AS size, quality IS NOT NULL AS listed FROM documents LEFT JOIN labels USING (doc_id)")
def size_fallback(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality").cast("long") * 1000).alias("s"))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(lab, "doc_id", "left").select("doc_id", F.coalesce("s", "n_chars").cast("long").alias("size"), F.col("s").isNotNull().alias("listed"))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unaccounted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(li, "o_orderkey", "left_anti")


@register("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


_CAP = "CASE WHEN {x} <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(CAST({x} AS BIGINT) - 1)) END"


@register(f"""WITH a AS (SELECT CAST(quantile_disc(CAST(round(l_extendedprice * 100) AS BIGINT), 0.995) AS BIGINT) AS p FROM lineitem),
  b AS (SELECT CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS m FROM orders), k AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)),
  r AS (SELECT max(l_extendedprice / l_quantity) AS m FROM lineitem)
  SELECT 'wire_cap' AS key, {_CAP.format(x="greatest(a.p, b.m)")} AS value FROM a, b UNION ALL
  SELECT 'item_cap', {_CAP.format(x="a.p")} FROM a UNION ALL SELECT 'max_members', {_CAP.format(x="2 * k.m")} FROM k UNION ALL
  SELECT 'max_ratio', CAST(10 * ceil(2 * r.m / 10) AS BIGINT) FROM r""")
def recommendation_caps(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a = li.select(CENTS("l_extendedprice").alias("v"), S.safe_ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("r"))
    a = X.ranked(a, "v", {"p": 995}, moments=False).select("p").join(a.agg(F.max("r").alias("r")))
    m = o.agg(F.max(CENTS("o_totalprice")).alias("m"))
    k = li.groupBy("l_orderkey").count().agg(F.max("count").alias("k"))
    one = a.join(m).join(k)  # single rows
    rows = F.array(
        F.struct(F.lit("wire_cap").alias("key"), S.pow2_ceil(F.greatest("p", "m")).alias("value")), F.struct(F.lit("item_cap").alias("key"), S.pow2_ceil(F.col("p")).alias("value")),
        F.struct(F.lit("max_members").alias("key"), S.pow2_ceil(F.col("k") * 2).alias("value")), F.struct(F.lit("max_ratio").alias("key"), (F.ceil(F.col("r") * 2 / 10) * 10).alias("value")),
    )
    return one.select(F.inline(rows))


@register("""SELECT o_orderpriority AS method, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share, o_orderpriority IN ('1-URGENT', '2-HIGH') AS allowed FROM orders GROUP BY 1""")
def method_allowlist(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    total = o.agg(F.sum("n").alias("t"))
    return o.join(total).select("method", "n", S.safe_ratio(F.col("n"), F.col("t")).alias("share"), F.col("method").isin("1-URGENT", "2-HIGH").alias("allowed"))


@register("""SELECT coalesce(o_orderstatus, 'ALL') AS bucket, coalesce(strftime(o_orderdate, '%Y'), 'ALL') AS year, count(*) AS n,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (strftime(o_orderdate, '%Y')))""")
def size_stats(spark, sf_dir):
    """Core, by bucket and by year in one pass."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", S.year_of(F.col("o_orderdate").cast("string")).alias("y"), CENTS("o_totalprice").alias("v"))
    g = o.groupingSets([[], ["o_orderstatus"], ["y"]], "o_orderstatus", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return g.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("bucket"), F.coalesce("y", F.lit("ALL")).alias("year"), "n", "total")


_M64 = "18446744073709551616"


@register(f"""WITH RECURSIVE n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT count(*) AS n FROM n),
  f AS (SELECT CAST(-1 AS BIGINT) AS i, CAST(20260812 AS UBIGINT) AS state, MAP([CAST(-1 AS BIGINT)], [CAST(-1 AS BIGINT)]) AS moved, CAST(-1 AS BIGINT) AS pos UNION ALL
    SELECT i, state, map_concat(moved, MAP([j], [coalesce(map_extract(moved, i)[1], i)])), coalesce(map_extract(moved, j)[1], j) FROM (
    SELECT i, state, moved, i + CAST(xor(z2, z2 >> 31) % CAST(n - i AS UBIGINT) AS BIGINT) AS j FROM (
    SELECT i, state, moved, n, CAST((CAST(xor(z1, z1 >> 27) AS UHUGEINT) * 10723151780598845931) % {_M64} AS UBIGINT) AS z2 FROM (
    SELECT i, state, moved, n, CAST((CAST(xor(state, state >> 30) AS UHUGEINT) * 13787848793156543929) % {_M64} AS UBIGINT) AS z1 FROM (
    SELECT f.i + 1 AS i, CAST((CAST(f.state AS UHUGEINT) + 11400714819323198485) % {_M64} AS UBIGINT) AS state, f.moved, c.n FROM f, c WHERE f.i + 1 < least(50, c.n))))))
  SELECT CAST(i AS INTEGER) AS draw, o_orderkey, o_totalprice FROM f JOIN n ON n.position = f.pos WHERE i >= 0""")
def seeded_sample(spark, sf_dir, seed: int = 20260812, count: int = 50):
    """A drawing without replacement; positions are few, and only the spans of keys that hold one are put in order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return X.rows_at(o, "o_orderkey", X.sample_positions(o.count(), count, seed)).select("draw", "o_orderkey", "o_totalprice")
