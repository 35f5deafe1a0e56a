"""The statistics of a harvested archive, over records made of orders (entries) and their lines (members)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.functions import stats as X
from oreline.operators import corpus
from oreline.plans.catalogue import register, table

CENTS = lambda c: F.round(F.col(c) * 100).cast("long")

# the same records as views: e (entries), m (members of entries), p and pm (those with trusted sizes)
_BASE = """e AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'levels/doom/a/' WHEN 1 THEN 'levels/doom2/Ports/m/' WHEN 2 THEN 'levels/' || lower(o_orderstatus) || '/x/' ELSE 'music/' END AS dir,
    CAST(round(o_totalprice * 100) AS BIGINT) AS zip_size, strftime(o_orderdate, '%Y') AS year, o_orderkey % 5 AS votes, o_orderkey % 17 = 0 AS zip64,
    CASE o_orderkey % 10 WHEN 0 THEN 'not_zip' WHEN 1 THEN 'fetch_error' WHEN 2 THEN 'full_download' ELSE 'ok' END AS status FROM orders),
  l AS (SELECT l_orderkey AS id, l_linenumber <= 3 AS wad, l_returnflag = 'R' AS r, CAST(round(l_extendedprice * 100) AS BIGINT) AS u,
    CASE WHEN l_linenumber = 2 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) // (1 + CAST(l_suppkey % 9 AS BIGINT)) END AS c,
    CASE l_returnflag WHEN 'A' THEN 'stored' WHEN 'N' THEN 'deflate' ELSE 'unsupported(6)' END AS method, l_tax > 0.07 AS encrypted FROM lineitem),
  p AS (SELECT * FROM e WHERE status IN ('ok', 'full_download')), pm AS (SELECT p.*, l.u, l.c, l.method, l.encrypted FROM p JOIN l USING (id) WHERE wad),
  g AS (SELECT p.id, any_value(zip_size) AS zip_size, any_value(dir) AS dir, any_value(zip64) AS zip64, count(l.id) AS k, count(l.id) FILTER (WHERE wad) AS w, coalesce(sum(u) FILTER (WHERE wad), 0) AS t,
    count(l.id) FILTER (WHERE NOT wad AND r) AS stray, count(l.id) FILTER (WHERE wad AND encrypted) AS enc, coalesce(sum(u) FILTER (WHERE wad AND NOT (c = 0 AND u > 0)), 0) AS ru, coalesce(sum(c) FILTER (WHERE wad), 0) AS rc FROM p LEFT JOIN l USING (id) GROUP BY p.id)"""

_BUCKET = "CASE WHEN id % 4 = 0 THEN 'levels/doom' WHEN id % 4 = 1 THEN 'levels/doom2/Ports' WHEN id % 4 = 2 THEN rtrim(dir, '/x') ELSE 'music' END"


def _dist(source: str, value: str, keys: str = "") -> str:
    ps = ", ".join(f"CAST(coalesce(quantile_disc(v, {t / 1000}), 0) AS BIGINT) AS {k}" for k, t in X.TENTHS.items())
    sel, grp = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {sel}count(v) AS n, CAST(coalesce(min(v), 0) AS BIGINT) AS min, {ps}, CAST(coalesce(max(v), 0) AS BIGINT) AS max,
      CASE WHEN count(v) = 0 THEN 0.0 ELSE CAST(sum(CAST(v AS HUGEINT)) AS DOUBLE) / count(v) END AS mean,
      CASE WHEN count(v) = 0 THEN 0.0 ELSE sqrt(greatest(CAST(sum(CAST(v AS HUGEINT) * v) AS DOUBLE) / count(v) - (CAST(sum(CAST(v AS HUGEINT)) AS DOUBLE) / count(v)) * (CAST(sum(CAST(v AS HUGEINT)) AS DOUBLE) / count(v)), 0.0)) END AS stddev
      FROM (SELECT {sel}CAST({value} AS BIGINT) AS v FROM {source}) {grp}"""


def entries(spark, sf_dir):
    """Records of the shape of ``sources.records.ENTRY``."""
    li = table(spark, sf_dir, "lineitem")
    size = CENTS("l_extendedprice")
    member = F.struct(
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit(".wad")).alias("name"), F.when(F.col("l_linenumber") == 2, 0).otherwise(F.call_function("div", size, 1 + F.col("l_suppkey") % 9)).cast("long").alias("compressed"),
        size.alias("uncompressed"), F.when(F.col("l_returnflag") == "A", "stored").when(F.col("l_returnflag") == "N", "deflate").otherwise("unsupported(6)").alias("method"), (F.col("l_tax") > 0.07).alias("encrypted"),
    )
    other = F.concat(F.lit("x"), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", ".WAD").otherwise(".txt"))
    m = li.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") <= 3, member)).alias("wads"), F.collect_list(F.when(F.col("l_linenumber") > 3, other)).alias("other_members"))
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, "levels/doom/a/").when(k % 4 == 1, "levels/doom2/Ports/m/").when(k % 4 == 2, F.concat(F.lit("levels/"), F.lower("o_orderstatus"), F.lit("/x/"))).otherwise("music/").alias("dir"),
        F.concat(F.lit("F"), k.cast("string"), F.lit(".zip")).alias("filename"), CENTS("o_totalprice").alias("zip_size"), F.col("o_orderdate").cast("string").alias("date"), (k % 5).alias("votes"),
        (k % 17 == 0).alias("zip64"), F.when(k % 10 == 0, "not_zip").when(k % 10 == 1, "fetch_error").when(k % 10 == 2, "full_download").otherwise("ok").alias("fetch_status"),
    )
    j = o.join(m, o["id"] == m["l_orderkey"], "left").drop("l_orderkey")
    kind = "array<struct<name:string,compressed:bigint,uncompressed:bigint,method:string,encrypted:boolean>>"
    j = j.withColumns({"wads": F.coalesce("wads", F.array().cast(kind)), "other_members": F.coalesce("other_members", F.array().cast("array<string>"))})
    return j.withColumn("member_count", (F.size("wads") + F.size("other_members")).cast("long"))


def listed(spark, sf_dir):
    """A listing that lacks every sixth entry and gives another size for every seventh; names in lower case, some twice."""
    e = entries(spark, sf_dir).where("id % 6 <> 0").select("id", "dir", F.lower("filename").alias("name"), (F.col("zip_size") + F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(0)).alias("size"), F.lit(1).alias("n"))
    return e.drop("id").union(e.where("id % 9 = 0").select("dir", "name", (F.col("size") + 5).alias("size"), F.lit(2)))


_LISTED = "CASE WHEN id % 6 <> 0 THEN zip_size + CASE WHEN id % 7 = 0 THEN id ELSE 0 END END"


@register(f"WITH {_BASE}, s AS (SELECT 'core' AS segment, '' AS key, u FROM pm UNION ALL SELECT 'bucket', {_BUCKET}, u FROM pm UNION ALL SELECT 'year', year, u FROM pm) {_dist('s', 'u', 'segment, key')}")
def corpus_size_stats(spark, sf_dir):
    return corpus.size_stats(entries(spark, sf_dir))


@register(f"""WITH {_BASE}, b AS (SELECT CASE WHEN u = 0 THEN -1 ELSE length(bin(u)) - 1 END AS k FROM pm)
  SELECT CAST(k AS INTEGER) AS k, CASE WHEN k < 0 THEN '0' ELSE '2^' || k || '-2^' || (k + 1) END AS bucket, count(*) AS n FROM b GROUP BY k""")
def corpus_size_histogram(spark, sf_dir):
    return corpus.size_histogram(entries(spark, sf_dir))


_WPS = ", ".join(f"CAST(coalesce(min(CASE WHEN cum * 1000 >= {t} * total THEN u END), 0) AS BIGINT) AS {k}" for k, t in X.TENTHS.items())


@register(f"""WITH {_BASE}, b AS (SELECT u, sum(votes) AS w, count(*) AS k FROM pm WHERE votes > 0 GROUP BY u),
  c AS (SELECT *, sum(w) OVER (ORDER BY u ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS total FROM b),
  a AS (SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS total_weight, {_WPS}, sum(CAST(u AS HUGEINT) * w) AS s1, sum(CAST(u AS HUGEINT) * u * w) AS s2 FROM c)
  SELECT n, total_weight, (SELECT count(*) FROM pm WHERE votes = 0) AS excluded, {", ".join(X.TENTHS)}, CAST(s1 AS DOUBLE) / total_weight AS mean,
    sqrt(greatest(CAST(s2 AS DOUBLE) / total_weight - (CAST(s1 AS DOUBLE) / total_weight) * (CAST(s1 AS DOUBLE) / total_weight), 0.0)) AS stddev FROM a""")
def corpus_weighted_sizes(spark, sf_dir):
    return corpus.weighted_size_stats(entries(spark, sf_dir))


@register(f"""WITH {_BASE}, z AS (SELECT zip_size, {_LISTED} AS listed FROM g WHERE w > 0), d AS (SELECT *, coalesce(listed, zip_size) AS size, CASE WHEN listed <> zip_size THEN abs(listed - zip_size) END AS delta FROM z)
  SELECT * FROM ({_dist('d', 'size')}), (SELECT count(listed) AS entries_compared, count(delta) AS mismatched, count(*) - count(listed) AS listing_misses, coalesce(max(delta::DOUBLE / listed) FILTER (WHERE listed > 0), 0.0) AS max_relative,
    CAST(coalesce(max(delta), 0) AS BIGINT) AS max_abs_delta, CAST(coalesce(quantile_disc(delta, 0.5), 0) AS BIGINT) AS p50_abs_delta, CAST(coalesce(quantile_disc(delta, 0.99), 0) AS BIGINT) AS p99_abs_delta FROM d)""")
def corpus_zip_sizes(spark, sf_dir):
    return corpus.zip_size_stats(entries(spark, sf_dir), listed(spark, sf_dir))


@register(f"""WITH {_BASE} SELECT count(*) AS zip_entries, count(*) FILTER (WHERE w = 0) AS zero_wad, count(*) FILTER (WHERE w > 1) AS multi_wad, count(*) FILTER (WHERE zip64) AS zip64_entries, CAST(sum(enc) AS BIGINT) AS encrypted_members,
    CAST(sum(stray) AS BIGINT) AS wad_named_other_members, count(*) FILTER (WHERE w = 0)::DOUBLE / count(*) AS zero_wad_share, count(*) FILTER (WHERE w > 1)::DOUBLE / count(*) AS multi_wad_share FROM g""")
def corpus_entry_stats(spark, sf_dir):
    return corpus.entry_stats(entries(spark, sf_dir))


@register(f"WITH {_BASE}, s AS (SELECT 'member_count' AS what, k AS x FROM g UNION ALL SELECT 'wad_total', t FROM g) {_dist('s', 'x', 'what')}")
def corpus_entry_distributions(spark, sf_dir):
    return corpus.entry_distributions(entries(spark, sf_dir))


@register(f"""WITH {_BASE} SELECT method, count(*) AS n, method IN ('stored', 'deflate') AS allowed, CASE method WHEN 'unsupported(6)' THEN 'Implode(6)' ELSE method END AS label FROM pm GROUP BY method""")
def corpus_methods(spark, sf_dir):
    return corpus.method_counts(entries(spark, sf_dir))


@register(f"WITH {_BASE} SELECT count(*) FILTER (WHERE method NOT IN ('stored', 'deflate')) AS rejected, count(*) AS members FROM pm")
def corpus_allowlist_cost(spark, sf_dir):
    return corpus.allowlist_cost(entries(spark, sf_dir))


@register(f"""WITH {_BASE}, s AS (SELECT 'member_deflate' AS population, u::DOUBLE / c AS r FROM pm WHERE method = 'deflate' AND c > 0 UNION ALL SELECT 'per_entry', ru::DOUBLE / rc FROM g WHERE rc > 0)
  SELECT population, count(*) AS n, min(r) AS min, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.9) AS p90, quantile_disc(r, 0.99) AS p99, max(r) AS max,
    (SELECT count(*) FROM pm WHERE c = 0 AND u > 0) AS zero_compressed_anomalies FROM s GROUP BY 1""")
def corpus_ratios(spark, sf_dir):
    return corpus.ratio_stats(entries(spark, sf_dir))


@register(f"WITH {_BASE} SELECT status AS fetch_status, count(*) AS n FROM e GROUP BY 1")
def corpus_statuses(spark, sf_dir):
    return corpus.status_counts(entries(spark, sf_dir))


@register(f"WITH {_BASE} SELECT id, w FROM g JOIN (SELECT id FROM e WHERE status = 'ok') USING (id) WHERE w > 0")
def corpus_sample_frame(spark, sf_dir):
    return corpus.sample_frame(entries(spark, sf_dir)).select("id", F.size("wads").cast("long").alias("w"))


_OUT = """o AS (SELECT 'slug' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS slug, CASE WHEN o_orderkey % 10 IN (0, 1, 2) THEN 'skipped' ELSE 'analyzed' END AS state, o_orderkey AS id FROM orders),
  c AS (SELECT l_orderkey AS id, count(*) AS k, count(*) FILTER (WHERE l_linenumber <= 3) AS w, coalesce(max(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_linenumber <= 3), 0) AS m, coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_linenumber <= 3), 0) AS t FROM lineitem GROUP BY 1)"""


def _outliers(spark, sf_dir):
    return entries(spark, sf_dir).withColumn("slug", F.concat(F.lit("slug"), F.lpad(F.col("id").cast("string"), 9, "0")))


@register(f"""WITH {_BASE}, {_OUT} SELECT slug, state, CASE WHEN state = 'skipped' THEN status END AS fetch_status, CASE WHEN state = 'analyzed' THEN zip_size END AS zip_size, CASE WHEN state = 'analyzed' THEN coalesce(k, 0) END AS member_count,
    CASE WHEN state = 'analyzed' THEN coalesce(w, 0) END AS wad_count, CASE WHEN state = 'analyzed' THEN coalesce(m, 0) END AS max_wad_uncompressed, CAST(CASE WHEN state = 'analyzed' THEN coalesce(t, 0) END AS BIGINT) AS total_wad_uncompressed
  FROM o JOIN e USING (id) LEFT JOIN c USING (id)""")
def corpus_outliers(spark, sf_dir):
    return corpus.outlier_rows(_outliers(spark, sf_dir))


_CAP = "CASE WHEN {x} <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(CAST({x} AS BIGINT) - 1)) END"
_FMT = "CASE WHEN v % 1099511627776 = 0 THEN v || ' (' || v // 1099511627776 || ' TiB)' WHEN v % 1073741824 = 0 THEN v || ' (' || v // 1073741824 || ' GiB)' WHEN v % 1048576 = 0 THEN v || ' (' || v // 1048576 || ' MiB)' WHEN v % 1024 = 0 THEN v || ' (' || v // 1024 || ' KiB)' ELSE v || '' END"


@register(f"""WITH {_BASE}, {_OUT}, a AS (SELECT quantile_disc(size, 0.995) AS zp FROM (SELECT coalesce({_LISTED}, zip_size) AS size FROM g WHERE w > 0)), b AS (SELECT quantile_disc(u, 0.995) AS wp FROM pm),
  k AS (SELECT max(k) AS mk, max(t) AS mt, count(*) FILTER (WHERE zip64) AS z FROM g), r AS (SELECT max(u::DOUBLE / c) AS mr FROM pm WHERE method = 'deflate' AND c > 0),
  x AS (SELECT max(zip_size) AS oz, max(coalesce(c.m, 0)) AS ow, max(coalesce(c.k, 0)) AS ok, max(coalesce(c.t, 0)) AS ot FROM o JOIN e USING (id) LEFT JOIN c USING (id) WHERE state = 'analyzed' AND id % 2 = 1),
  s AS (SELECT string_agg(method || ' = ' || n, ', ' ORDER BY method) || CASE WHEN bool_or(method NOT IN ('stored', 'deflate')) THEN ' (unexpected)' ELSE '' END AS methods FROM (SELECT method, count(*) AS n FROM pm GROUP BY 1)),
  t AS (SELECT 0 AS ordinal, 'wire_cap_zip' AS key, {_CAP.format(x="greatest(zp, oz)")} AS v, NULL AS note FROM a, x UNION ALL SELECT 1, 'wire_cap_wad', {_CAP.format(x="greatest(wp, ow)")}, NULL FROM b, x
    UNION ALL SELECT 2, 'decoded_cap', {_CAP.format(x="greatest(wp, ow)")}, 'as wire_cap_wad' FROM b, x UNION ALL SELECT 3, 'max_member_count', {_CAP.format(x="2 * greatest(mk, ok)")}, NULL FROM k, x
    UNION ALL SELECT 4, 'max_entry_uncompressed_bytes', {_CAP.format(x="2 * greatest(mt, ot)")}, NULL FROM k, x UNION ALL SELECT 5, 'max_member_compression_ratio', CAST(10 * ceil(2 * mr / 10) AS BIGINT), NULL FROM r
    UNION ALL SELECT 6, 'compression_method_allowlist', NULL, methods FROM s UNION ALL SELECT 7, 'zip64_statement', NULL, CASE WHEN z = 7 THEN 'manifest agrees' ELSE 'manifest has 7' END FROM k)
  SELECT CAST(ordinal AS INTEGER) AS ordinal, key, CASE WHEN ordinal IN (3, 5) THEN v || '' WHEN ordinal = 6 THEN 'stored, deflate' WHEN ordinal = 7 THEN 'zip64 handled' ELSE {_FMT} END AS recommended, CAST(v AS BIGINT) AS value, note FROM t""")
def corpus_recommendations(spark, sf_dir):
    return corpus.recommendations(entries(spark, sf_dir), listed(spark, sf_dir), _outliers(spark, sf_dir).where("id % 2 = 1"), 7)


@register(f"""WITH {_BASE} SELECT id, CAST(dense_rank() OVER (PARTITION BY method ORDER BY CAST(u AS HUGEINT) * 1000000000000000 // c, (CAST(u AS HUGEINT) * 1000000000000000 % c)::DOUBLE / c) - 1 AS BIGINT) AS place, u, c FROM pm WHERE c > 0""")
def corpus_ratio_order(spark, sf_dir):
    m = corpus.members(corpus.population(entries(spark, sf_dir))).where("compressed > 0")
    return X.ratio_order(m, "uncompressed", "compressed", "method").select("id", "place", F.col("uncompressed").alias("u"), F.col("compressed").alias("c"))
