"""Names, paths and flags."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.plans.catalogue import register, table

_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^/+', '')"
_NS = "CASE WHEN NOT contains(p, '/') THEN 'Global' " + " ".join(f"WHEN lower(split_part(p, '/', 1)) = '{k}' THEN '{v}'" for k, v in S.NAMESPACES.items()) + " ELSE 'Hidden' END"


def _paths(spark, sf_dir):
    u = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", S.archive_path(u).alias("p"))


@register(f"SELECT ns, count(*) AS n FROM (SELECT {_NS} AS ns FROM (SELECT {_PATH} AS p FROM pages UNION ALL SELECT 'sprites/' || page_id || '^x.lmp' FROM pages)) GROUP BY ns")
def namespace_tally(spark, sf_dir):
    p = _paths(spark, sf_dir)
    more = p.select("page_id", F.concat(F.lit("sprites/"), F.col("page_id").cast("string"), F.lit("^x.lmp")).alias("p"))
    return p.union(more).groupBy(S.namespace_of(F.col("p")).alias("ns")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT page_id, p AS path, upper(replace(left(regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', ''), 8), '^', chr(92))) AS short FROM
  (SELECT page_id, 'sprites/' || split_part(p, '/', 2) || '^a.' || split_part(p, '/', 1) AS p FROM (SELECT page_id, """ + _PATH + """ AS p FROM pages))""")
def short_names(spark, sf_dir):
    seg = F.split("p", "/")
    p = _paths(spark, sf_dir).select("page_id", F.concat(F.lit("sprites/"), F.coalesce(F.try_element_at(seg, F.lit(2)), F.lit("")), F.lit("^a."), seg[0]).alias("path"))
    return p.select("page_id", "path", S.short_name(F.col("path"), S.namespace_of(F.col("path"))).alias("short"))


_BUCKET = """CASE WHEN len(s) = 0 THEN '' WHEN s[1] <> 'levels' OR len(s) = 1 THEN s[1] WHEN list_contains(s[3:], 'Ports') THEN s[1] || '/' || s[2] || '/Ports' ELSE s[1] || '/' || s[2] END"""


@register(f"""SELECT bucket, count(*) AS n FROM (SELECT {_BUCKET} AS bucket FROM (SELECT list_filter(string_split(d, '/'), lambda x: x <> '') AS s FROM
  (SELECT CASE WHEN page_id % 3 = 0 THEN 'levels/' || split_part(p, '/', 2) || '/Ports/a/' WHEN page_id % 3 = 1 THEN 'levels/' || split_part(p, '/', 2) ELSE p END AS d FROM (SELECT page_id, {_PATH} AS p FROM pages)))) GROUP BY bucket""")
def top_bucket(spark, sf_dir):
    two = F.coalesce(F.try_element_at(F.split("p", "/"), F.lit(2)), F.lit(""))
    d = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("levels/"), two, F.lit("/Ports/a/"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("levels/"), two)).otherwise(F.col("p"))
    return _paths(spark, sf_dir).groupBy(S.top_bucket(d).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN d = '' THEN 'skip' WHEN starts_with(d, 'levels/reviews/') OR starts_with(d, 'music/') THEN 'skip' WHEN starts_with(d, 'levels/') OR starts_with(d, 'themes/') THEN 'include' ELSE 'triage' END AS decision
  FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'levels/' || source || '/' WHEN 1 THEN 'levels/reviews/' || lang || '/' WHEN 2 THEN 'music/' || lang || '/' WHEN 3 THEN '' WHEN 4 THEN source || '/' ELSE 'themes/' END AS d FROM documents)) GROUP BY 1""")
def scope_triage(spark, sf_dir):
    k = F.col("doc_id") % 6
    d = (F.when(k == 0, F.concat(F.lit("levels/"), "source", F.lit("/"))).when(k == 1, F.concat(F.lit("levels/reviews/"), "lang", F.lit("/"))).when(k == 2, F.concat(F.lit("music/"), "lang", F.lit("/")))
         .when(k == 3, "").when(k == 4, F.concat("source", F.lit("/"))).otherwise("themes/"))
    return table(spark, sf_dir, "documents").groupBy(S.triage(d).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_SAFE = "upper(regexp_replace(p_name || '.' || p_brand, '[^A-Za-z0-9_-]', '_', 'g'))"


@register(f"""SELECT p_partkey, CASE WHEN k > 0 THEN safe || '_' || k ELSE safe END AS file FROM (SELECT p_partkey, safe, row_number() OVER (PARTITION BY safe ORDER BY p_partkey) - 1 AS k FROM (SELECT p_partkey, {_SAFE} AS safe FROM part))""")
def sanitize_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.sanitize(F.concat("p_name", F.lit("."), "p_brand")).alias("safe"))
    seen = F.row_number().over(W.partitionBy("safe").orderBy("p_partkey")) - 1
    return p.select("p_partkey", S.dup_suffix(F.col("safe"), seen).alias("file"))


@register("""SELECT n_name, CAST(list_reduce(list_prepend(CAST(1315423911 AS BIGINT), list_transform(string_split(left(upper(n_name), 8), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, c: xor(h, ((h * 32) & 4294967295) + c + (h >> 2) & 4294967295)) & 65535 AS BIGINT) AS hash FROM nation""")
def name_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", S.name_hash(F.col("n_name")).alias("hash"))


@register("""SELECT p_partkey, CAST((f & 15) + CASE WHEN f & 256 = 0 THEN 16 ELSE 0 END + CASE WHEN f & 1024 = 0 THEN 32 ELSE 0 END + CASE WHEN f & 512 = 0 THEN 64 ELSE 0 END AS INTEGER) AS hexen,
    CAST((f & 31) + CASE WHEN f & 1024 <> 0 THEN 32 ELSE 0 END + CASE WHEN f & 2048 <> 0 THEN 64 ELSE 0 END AS INTEGER) AS doom64 FROM (SELECT p_partkey, CAST(p_size * 97 + p_partkey AS INTEGER) & 65535 AS f FROM part)""")
def flag_remap(spark, sf_dir):
    f = (F.col("p_size") * 97 + F.col("p_partkey")).cast("int").bitwiseAND(0xFFFF)
    return table(spark, sf_dir, "part").select("p_partkey", S.hexen_thing_flags(f).alias("hexen"), S.doom64_thing_flags(f).alias("doom64"))


@register("""SELECT l_orderkey, l_linenumber, CAST(least(greatest(round(x), -32768), 32767) AS INTEGER) AS coord,
    CASE WHEN round(x) < -32768 OR round(x) > 32767 THEN 'out_of_range' WHEN round(x) <> x THEN 'fractional' END AS lost
  FROM (SELECT l_orderkey, l_linenumber, l_extendedprice - 20000 AS x FROM lineitem)""")
def narrow_coords(spark, sf_dir):
    v, lost = S.narrow_coord(F.col("l_extendedprice") - 20000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("coord"), lost.alias("lost"))


@register("""SELECT o_orderkey, CASE WHEN n <> 0 AND n % 1099511627776 = 0 THEN n || ' (' || n // 1099511627776 || ' TiB)' WHEN n <> 0 AND n % 1073741824 = 0 THEN n || ' (' || n // 1073741824 || ' GiB)'
    WHEN n <> 0 AND n % 1048576 = 0 THEN n || ' (' || n // 1048576 || ' MiB)' WHEN n <> 0 AND n % 1024 = 0 THEN n || ' (' || n // 1024 || ' KiB)' ELSE n || '' END AS text FROM (SELECT o_orderkey, o_orderkey * 256 AS n FROM orders)""")
def byte_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.format_bytes(F.col("o_orderkey") * 256).alias("text"))


@register("""SELECT event_id, coalesce(TRY_CAST(trim(raw) AS BIGINT), 0) AS value, raw IS NOT NULL AND TRY_CAST(trim(raw) AS BIGINT) IS NULL AS error
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || user_id || ' ' WHEN 2 THEN 'x' || user_id ELSE user_id || '' END AS raw FROM events)""")
def lenient_numbers(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = F.when(k == 1, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 2, F.concat(F.lit("x"), u)).when(k == 3, u)
    v, e = S.lenient_long(raw)
    return table(spark, sf_dir, "events").select("event_id", v.alias("value"), e.alias("error"))
