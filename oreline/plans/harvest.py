"""Worklists, outcomes, caches, budgets and byte ranges of a harvest, over made-up answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import harvest as H
from oreline.plans.catalogue import register, table

_DIRS = "CASE doc_id % 6 WHEN 0 THEN 'levels/' || source || '/' WHEN 1 THEN 'levels/reviews/' || lang || '/' WHEN 2 THEN 'music/' || lang || '/' WHEN 3 THEN '' WHEN 4 THEN source || '/' || lang || '/' ELSE 'themes/' || lang || '/' END"


def _dirs(spark, sf_dir):
    k = F.col("doc_id") % 6
    part = lambda *xs: F.concat(*[F.lit(x) if x.endswith("/") else F.col(x) for x in xs])
    d = (F.when(k == 0, part("levels/", "source", "/")).when(k == 1, part("levels/reviews/", "lang", "/")).when(k == 2, part("music/", "lang", "/")).when(k == 3, "").when(k == 4, part("source", "/", "lang", "/")).otherwise(part("themes/", "lang", "/")))
    return table(spark, sf_dir, "documents").select(d.alias("dir"))


@register(f"""WITH d AS (SELECT DISTINCT {_DIRS} AS dir FROM documents)
  SELECT 'work' AS list, dir FROM d WHERE (starts_with(dir, 'levels/') AND NOT starts_with(dir, 'levels/reviews/')) OR starts_with(dir, 'themes/')
  UNION ALL SELECT DISTINCT 'triage', split_part(dir, '/', 1) || '/' FROM d WHERE starts_with(dir, 'src') UNION ALL SELECT 'root', dir FROM d WHERE starts_with(dir, 'levels/reviews/')""")
def worklist_scopes(spark, sf_dir):
    work, triage = H.worklist(_dirs(spark, sf_dir))
    root, _ = H.worklist(_dirs(spark, sf_dir), "levels/reviews")
    return work.select(F.lit("work").alias("list"), "dir").union(triage.select(F.lit("triage"), "top")).union(root.select(F.lit("root"), "dir"))


@register("""WITH o AS (SELECT 'c' || o_custkey || '/' AS dir, o_custkey AS c, 'f' || o_orderkey || '.zip' AS filename, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderkey AS k FROM orders)
  SELECT dir || filename AS path, 'record' AS kind, CAST(size AS VARCHAR) AS detail, 0 AS attempts FROM o WHERE c % 7 <> 0 AND c % 5 <> 0
  UNION ALL SELECT dir || filename, 'size_mismatch', 'api size ' || size || ' vs ls-laR size ' || (size + 1), 1 FROM o WHERE c % 7 <> 0 AND c % 5 <> 0 AND k % 11 = 0 AND k % 3 <> 0
  UNION ALL SELECT DISTINCT dir, 'http_error', 'boom', 3 FROM o WHERE c % 7 = 0 UNION ALL SELECT DISTINCT dir, 'suspect_path', 'content.file and content.dir both null', 1 FROM o WHERE c % 7 <> 0 AND c % 5 = 0""")
def enrich_ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/")).alias("dir"), F.col("o_custkey").alias("c"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".zip")).alias("filename"), F.round("o_totalprice").cast("long").alias("size"), F.col("o_orderkey").alias("k"))
    a = o.groupBy("dir").agg(F.first("c").alias("c"), F.collect_list(F.struct("filename", "size")).alias("files"))
    ok = (F.col("c") % 7 != 0) & (F.col("c") % 5 != 0)
    answers = a.select("dir", F.when(F.col("c") % 7 == 0, "boom").alias("error"), F.lit(3).alias("attempts"), F.when(ok, F.col("files")).alias("files"), F.lit(None).cast("array<string>").alias("dirs"))
    listed = o.where("k % 3 <> 0").select("dir", F.upper("filename").alias("name"), (F.col("size") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("size"), F.lit(0).alias("n"))
    recs, bad = H.enrich(o.select("dir").distinct(), answers, listed)
    return recs.select(F.concat("dir", "filename").alias("path"), F.lit("record").alias("kind"), F.col("size").cast("string").alias("detail"), F.lit(0).alias("attempts")).union(bad.select("path", "kind", "detail", "attempts"))


_WHAT = "CASE o_orderkey % 9 WHEN 0 THEN 'inspected' WHEN 1 THEN 'full_download' WHEN 2 THEN 'mirror_404_all' WHEN 3 THEN 'budget_refused' WHEN 4 THEN 'entry_too_large' WHEN 5 THEN 'zip_parse' WHEN 6 THEN 'fetch' WHEN 7 THEN 'inspected' END"


def _outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    what = F.element_at(F.array(*[F.lit(x) for x in ("inspected", "full_download", "mirror_404_all", "budget_refused", "entry_too_large", "zip_parse", "fetch", "inspected")], F.lit(None)), (k % 9 + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    entries = o.select(k.alias("id"), F.lit("levels/").alias("dir"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 13 == 0, ".txt").otherwise(".ZIP")).alias("filename"), F.round("o_totalprice").cast("long").alias("size"))
    wad = F.array(F.struct(F.lit("a.wad").alias("name"), F.lit(1).cast("long").alias("compressed"), k.alias("uncompressed"), F.lit("deflate").alias("method"), F.lit(False).alias("encrypted")))
    out = o.where("o_orderkey % 9 <> 8").select(k.alias("id"), what.alias("outcome"), F.col("o_orderstatus").alias("detail"), F.when(k % 2 == 0, "m1").alias("mirror"), (k % 4 == 0).alias("zip64"), (k % 7).alias("member_count"), wad.alias("wads"), F.array(F.lit("r.txt")).alias("other_members"))
    return H.to_records(entries, out)


@register(f"""SELECT id, dir || filename AS path, zip_size, is_zip, is_zip AND seen AND id % 4 = 0 AS zip64, CASE WHEN is_zip AND seen THEN id % 7 ELSE 0 END AS member_count, CAST(CASE WHEN is_zip AND seen THEN 1 ELSE 0 END AS INTEGER) AS wads,
    CASE WHEN is_zip AND id % 2 = 0 THEN 'm1' ELSE '' END AS mirror, CASE WHEN NOT is_zip THEN 'not_zip' WHEN what = 'inspected' THEN 'ok' WHEN what = 'full_download' THEN what WHEN what = 'mirror_404_all' THEN 'mirror404_all'
      WHEN what IN ('budget_refused', 'entry_too_large') THEN 'no_range_support' WHEN what = 'zip_parse' THEN 'zip_parse_error' ELSE 'fetch_error' END AS fetch_status
  FROM (SELECT o_orderkey AS id, 'levels/' AS dir, 'f' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN '.txt' ELSE '.ZIP' END AS filename, CAST(round(o_totalprice) AS BIGINT) AS zip_size, o_orderkey % 13 <> 0 AS is_zip, {_WHAT} AS what, coalesce({_WHAT} IN ('inspected', 'full_download'), false) AS seen FROM orders)
  WHERE NOT is_zip OR what IS NOT NULL""")
def outcome_records(spark, sf_dir):
    r = _outcomes(spark, sf_dir)[0]
    return r.select("id", F.concat("dir", "filename").alias("path"), "zip_size", "is_zip", "zip64", "member_count", F.size("wads").alias("wads"), "mirror", "fetch_status")


@register(f"""SELECT path, 'harvest-zips' AS action, CASE WHEN what = 'zip_parse' THEN 'parse_error' ELSE 'http_error' END AS kind, 1 AS attempts,
    CASE what WHEN 'mirror_404_all' THEN '404 on all mirrors' WHEN 'budget_refused' THEN 'no-range fallback refused: budget exhausted or breaker tripped' WHEN 'entry_too_large' THEN 'entry exceeds per-entry fallback cap' ELSE o_orderstatus END
      || CASE WHEN o_orderkey % 2 = 0 THEN ': last mirror m1' ELSE '' END AS detail
  FROM (SELECT *, 'levels/f' || o_orderkey || '.ZIP' AS path, {_WHAT} AS what FROM orders WHERE o_orderkey % 13 <> 0) WHERE what NOT IN ('inspected', 'full_download')""")
def outcome_ledger(spark, sf_dir):
    return _outcomes(spark, sf_dir)[1]


@register("""WITH s AS (SELECT p_partkey AS n, 's' || p_partkey AS slug, p_partkey % 10 = 0 AS skip, CASE p_partkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'range_unsupported' WHEN 2 THEN 'not_found' WHEN 3 THEN 'http' WHEN 4 THEN 'directory_too_large' WHEN 5 THEN 'too_chatty' WHEN 6 THEN 'parse' END AS what, p_size, p_brand FROM part ORDER BY p_partkey LIMIT 150)
  SELECT slug, CAST(CASE WHEN skip THEN 0 ELSE p_size END AS BIGINT) AS zip_size, CAST(CASE WHEN NOT skip AND what = 'ok' THEN 3 ELSE 0 END AS BIGINT) AS member_count, CASE WHEN skip THEN 'skipped_known_dead' WHEN what = 'ok' THEN 'ok' WHEN what = 'range_unsupported' THEN 'no_range_support' WHEN what IN ('not_found', 'http') THEN 'fetch_error' ELSE 'zip_parse_error' END AS fetch_status,
    CASE WHEN skip THEN 'skipped' WHEN what = 'ok' THEN NULL WHEN what IN ('range_unsupported', 'not_found', 'http') THEN 'http_error' ELSE 'parse_error' END AS kind,
    CASE WHEN skip THEN 'skipped: outliers.toml marks the host known-dead (skip = true)' WHEN what = 'ok' THEN NULL WHEN what = 'range_unsupported' THEN 'host refuses range requests' WHEN what = 'not_found' THEN '404 not found' ELSE p_brand END AS detail,
    CASE WHEN skip THEN 0 WHEN what = 'ok' THEN NULL ELSE CAST(n % 6 AS INTEGER) END AS attempts
  FROM s WHERE skip OR what IS NOT NULL""")
def outlier_outcomes(spark, sf_dir):
    """A curated list is cut to its first entries, which is what its limit is for."""
    k = F.col("p_partkey")
    slug = F.concat(F.lit("s"), k.cast("string")).alias("slug")
    p = table(spark, sf_dir, "part")
    specs = p.select(k.alias("n"), slug, F.lit("http://x").alias("url"), (k % 10 == 0).alias("skip"))
    what = F.element_at(F.array(*[F.lit(x) for x in ("ok", "range_unsupported", "not_found", "http", "directory_too_large", "too_chatty", "parse")], F.lit(None)), (k % 8 + 1).cast("int"))
    out = p.select(slug, what.alias("outcome"), F.col("p_brand").alias("detail"), (k % 6).alias("attempts"), F.col("p_size").cast("long").alias("zip_size"), F.lit(3).alias("member_count"))
    recs, bad = H.outlier_records(specs, out, limit=150)
    return recs.drop("url").join(bad.select(F.col("path").alias("slug"), "kind", "detail", "attempts"), "slug", "left")


@register("""SELECT o_orderkey, coalesce(TRY_CAST(t AS TIMESTAMP) <= TIMESTAMP '1996-06-01 12:00:00' AND TRY_CAST(t AS TIMESTAMP) > TIMESTAMP '1996-06-01 12:00:00' - INTERVAL 7 DAY, false) AS fresh
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'soon' WHEN o_orderkey % 3 = 0 THEN '1996-05-' || lpad(CAST(20 + o_orderkey % 12 AS VARCHAR), 2, '0') || ' 12:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS t FROM orders)""")
def cache_freshness(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 10 == 0, "soon").when(k % 3 == 0, F.concat(F.lit("1996-05-"), F.lpad((20 + k % 12).cast("string"), 2, "0"), F.lit(" 12:00:00"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.is_fresh(t, F.lit("1996-06-01 12:00:00"), 7 * 86_400).alias("fresh"))


@register(f"""SELECT dir, md5(dir) AS body_hash FROM (SELECT DISTINCT {_DIRS} AS dir FROM documents) WHERE dir IN (SELECT {_DIRS} FROM documents WHERE doc_id % 6 IN (0, 4))""")
def dir_hashes(spark, sf_dir):
    d = _dirs(spark, sf_dir)
    known = d.where("startswith(dir, 'src') or (startswith(dir, 'levels/') and not startswith(dir, 'levels/reviews/'))").distinct().select("dir")
    cache = known.select(F.lit("getcontents").alias("action"), F.col("dir").alias("path"), F.md5("dir").alias("body_hash")).union(d.distinct().select(F.lit("other"), "dir", F.lit("x")))
    return H.dir_hashes(d, cache)


@register("""WITH RECURSIVE n AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS s, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), m AS (SELECT greatest(2, count(*) * 2 // 100) AS most FROM orders),
  f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS k, CAST(3000000 AS BIGINT) AS room, 'x' AS decision UNION ALL SELECT n.i, n.k, CASE WHEN n.s <= f.room THEN f.room - n.s ELSE f.room END, CASE WHEN n.s <= f.room THEN 'download' ELSE 'skip' END FROM f JOIN n ON n.i = f.i + 1, m WHERE n.i <= m.most)
  SELECT n.k AS o_orderkey, coalesce(f.decision, 'abort') AS decision FROM n LEFT JOIN f ON f.k = n.k""")
def fallback_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    return H.admit(o, "o_orderkey", "size", o.count(), 3_000_000).select("o_orderkey", "decision")


_RANGE = "CASE event_id % 7 WHEN 0 THEN 'bytes 0-0/' || user_id WHEN 1 THEN 'BYTES ' || user_id || '-' || (user_id + 9) || '/*' WHEN 2 THEN 'bytes 9-3/10' WHEN 3 THEN 'items 0-1/2' WHEN 4 THEN 'bytes */100' WHEN 5 THEN 'bytes ' || user_id || '-' || (user_id + 9) || '/' || (user_id + 100) END"


@register(f"""WITH r AS (SELECT event_id, user_id, regexp_extract(h, '^(?i:bytes) *([0-9]+) *- *([0-9]+) */ *(\\*|[0-9]+) *$', ['a', 'b', 't']) AS x FROM (SELECT event_id, user_id, {_RANGE} AS h FROM events)),
  p AS (SELECT event_id, user_id, TRY_CAST(x.a AS BIGINT) AS a, TRY_CAST(x.b AS BIGINT) AS b, TRY_CAST(x.t AS BIGINT) AS t, coalesce(TRY_CAST(x.a AS BIGINT) <= TRY_CAST(x.b AS BIGINT), false) AS ok FROM r)
  SELECT event_id, CASE WHEN ok THEN a END AS start, CASE WHEN ok THEN b END AS "end", CASE WHEN ok THEN t END AS total, CASE WHEN ok AND a = 0 AND b = 0 AND t <> 0 THEN t END AS probe,
    CASE WHEN NOT ok THEN '206 with a missing, unparseable, or malformed Content-Range' WHEN a <> user_id OR b <> user_id + 9 THEN 'Content-Range mismatch: got ' || a || '-' || b || ', wanted ' || user_id || '-' || (user_id + 9)
      WHEN t <> 150 THEN 'Content-Range mismatch: got total ' || t || ', wanted 150' END AS fault FROM p""")
def content_ranges(spark, sf_dir):
    u, k = F.col("user_id"), F.col("event_id") % 7
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    h = (F.when(k == 0, s("bytes 0-0/", u)).when(k == 1, s("BYTES ", u, "-", u + 9, "/*")).when(k == 2, "bytes 9-3/10").when(k == 3, "items 0-1/2").when(k == 4, "bytes */100").when(k == 5, s("bytes ", u, "-", u + 9, "/", u + 100)))
    r = H.content_range(F.col("h"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", h.alias("h"))
    fault = H.range_fault(F.col("h"), F.col("user_id"), F.col("user_id") + 9, F.lit(150))
    return e.select("event_id", r["start"].alias("start"), r["end"].alias("end"), r["total"].alias("total"), H.probe_total(F.col("h")).alias("probe"), fault.alias("fault"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.' WHEN 2 THEN 'a/' || p_brand WHEN 3 THEN p_brand || ' ' ELSE p_brand || '?' || p_size END"


@register(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || '-' || p_name END AS file, 'harvest-' || strftime(TIMESTAMP '1998-01-02 03:04:05' + INTERVAL (p_size) SECOND, '%Y%m%dT%H%M%SZ') AS manifest,
    CASE WHEN p_partkey % 5 <> 2 AND p_partkey % 3 <> 0 THEN 'http://m/x/' || replace(p_brand, '#', '%23') || '/b/' || replace(replace(replace({_NAME}, '#', '%23'), ' ', '%20'), '?', '%3F') END AS url FROM part""")
def harvest_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, F.concat("p_name", F.lit("."))).when(k % 5 == 2, F.concat(F.lit("a/"), "p_brand")).when(k % 5 == 3, F.concat("p_brand", F.lit(" "))).otherwise(F.concat("p_brand", F.lit("?"), F.col("p_size").cast("string")))
    folder = F.when(k % 3 == 0, F.concat("p_brand", F.lit("/../b/"))).otherwise(F.concat("p_brand", F.lit("//b/")))
    started = F.timestamp_seconds(F.unix_timestamp(F.lit("1998-01-02 03:04:05")) + F.col("p_size"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"), folder.alias("folder"))
    return p.select("p_partkey", H.sample_file(k, F.col("name")).alias("file"), H.manifest_id(started).alias("manifest"), H.mirror_url(F.lit("http://m/x"), F.col("folder"), F.col("name")).alias("url"))
