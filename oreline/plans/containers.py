"""Containers of named blobs and record logs as relations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreline.operators import relational as R
from oreline.plans.catalogue import register, table
from oreline.sources import records as S


def _blobs(spark, sf_dir, mine):
    """The documents of the sources whose last character's code fits, as blobs."""
    return table(spark, sf_dir, "documents").where(mine(F.ascii(F.substring("source", -1, 1)))).select(F.concat(F.lit("D"), (F.col("doc_id") % 60).cast("string")).alias("name"), F.col("doc_id").alias("idx"), F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))


_SIDE = "SELECT 'D' || (doc_id % 60) AS name, list(sha256(text) ORDER BY doc_id) AS l, min(doc_id) AS at FROM documents WHERE ascii(right(source, 1)) % 2 = {} GROUP BY 1"


@register(f"""WITH a AS ({_SIDE.format(0)}), b AS ({_SIDE.format(1)}), j AS (SELECT coalesce(a.name, b.name) AS name,
    CASE WHEN b.l IS NULL THEN 'only_in_first' WHEN a.l IS NULL THEN 'only_in_second' WHEN a.l <> b.l THEN 'changed' END AS status, a.at IS NULL AS s, coalesce(a.at, b.at) AS o FROM a FULL JOIN b ON a.name = b.name)
  SELECT name, status, row_number() OVER (ORDER BY s, o) AS rank FROM j WHERE status IS NOT NULL""")
def diff_lists(spark, sf_dir):
    d = R.diff(_blobs(spark, sf_dir, lambda c: c % 2 == 0), _blobs(spark, sf_dir, lambda c: c % 2 == 1), "name", "idx", "digest")
    return d.select("name", "status", F.row_number().over(W.orderBy("ordinal")).cast("long").alias("rank"))


@register("""SELECT input, CAST(row_number() OVER (PARTITION BY input ORDER BY doc_id) - 1 AS BIGINT) AS idx, 'D' || (doc_id % 60) AS name, CAST(strlen(text) AS INTEGER) AS size
  FROM (SELECT *, ascii(right(source, 1)) % 8 AS input FROM documents)""")
def merge_union_all(spark, sf_dir):
    both = R.concat(*[_blobs(spark, sf_dir, lambda c, i=i: c % 8 == i) for i in range(8)])
    return both.select("input", (F.row_number().over(W.partitionBy("input").orderBy("idx")) - 1).cast("long").alias("idx"), "name", "size")


@register("SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value FROM events GROUP BY 1")
def first_match(spark, sf_dir):
    return R.first_match(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id", "value")


_DEDUP = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) AS n FROM events) WHERE n = 1"


@register(_DEDUP.format("DESC"))
def dedup_last(spark, sf_dir):
    return R.dedup(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")], "last").select("user_id", "event_type", "event_id", "value")


@register(_DEDUP.format("ASC"))
def dedup_first(spark, sf_dir):
    return R.dedup(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")], "first").select("user_id", "event_type", "event_id", "value")


@register("""SELECT source, doc_id, strlen(text) AS size, CAST(12 + coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filepos FROM documents""")
def layout_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return R.offsets(d, "source", "doc_id", "size").select("source", "doc_id", "size", "filepos")


@register("""SELECT source, count(*) AS blobs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(strlen(text)) AS largest, count(DISTINCT lang) AS kinds, count(*) FILTER (WHERE strlen(text) = 0) AS empty FROM documents GROUP BY source""")
def container_info(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.octet_length("text").cast("long").alias("size"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.countDistinct("lang").alias("kinds"), F.count_if(F.col("size") == 0).alias("empty"))


@register("""WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 97 <> 0),
  a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey || ':' || o_orderstatus)) AS l FROM orders GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey || ':' || s)) AS l FROM n GROUP BY 1)
  SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.l IS DISTINCT FROM b.l""")
def tree_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    now = o.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return R.changed_groups(o, now, "o_custkey", "o_orderkey", "o_orderstatus")


@register("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'not_archive' WHEN quality IS NOT NULL AND toxic = 0 THEN 'cached' ELSE 'live' END AS route FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def cache_partition(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    route = F.when(F.col("lang") == "en", "not_archive").when(F.col("quality").isNotNull() & (F.col("toxic") == 0), "cached").otherwise("live")
    return d.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.forward_fill(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@register("""SELECT event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_error FROM events""")
def suffix_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return R.next_where(e, ["user_id"], "event_id", F.col("event_type") == "error", "next_error").select("event_id", "next_error")


@register("""WITH e AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS inside, row_number() OVER w AS pos, lag(event_id) OVER w AS marker FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  g AS (SELECT *, pos - sum(CAST(inside AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
  SELECT user_id, arg_min_null(marker, pos) AS marker, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE inside GROUP BY user_id, run""")
def run_detection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.runs(e, ["user_id"], "event_id", F.col("event_type").isin("view", "click"))


@register("""SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ticks FROM events""")
def running_ticks(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(F.floor("value")).over(w).alias("ticks"))


@register("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS p, CASE WHEN l_orderkey % 7 = 0 THEN 65535 WHEN l_orderkey % 11 = 0 THEN 70000 ELSE l_suppkey END AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, coalesce(p_partkey, 0) AS part, p_partkey IS NULL AS part_miss, s_suppkey AS supp, s <> 65535 AND s_suppkey IS NULL AS supp_miss
  FROM l LEFT JOIN part ON p = p_partkey LEFT JOIN supplier ON s = s_suppkey AND s <> 65535""")
def fk_resolve_lenient(spark, sf_dir):
    k = F.col("l_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.when(k % 10 == 0, 1_000_000).otherwise(0)).alias("p"), F.when(k % 7 == 0, 65535).when(k % 11 == 0, 70000).otherwise(F.col("l_suppkey")).alias("s"))
    li = R.resolve(li, "p", table(spark, sf_dir, "part"), "p_partkey", "part", required=True)
    return R.resolve(li, "s", table(spark, sf_dir, "supplier"), "s_suppkey", "supp", sentinel=65535).drop("p", "s")


@register("""SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT user_id, lo, hi, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) AS hi FROM events))) GROUP BY user_id, g""")
def merge_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value")).alias("hi"))
    return R.merge_ranges(e, ["user_id"], "lo", "hi")


@register("""SELECT 'c' || c_custkey AS node, 2 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL
  SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 0""")
def bfs_reach(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    tag = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    edges = n.select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst")).union(c.select(tag("n", "c_nationkey"), tag("c", "c_custkey")))
    return R.reach(edges, spark.range(1).select(F.lit("r1").alias("node")))


@register("SELECT role, count(*) AS n FROM conversations WHERE starts_with(role, 'u') GROUP BY role")
def prefix_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.startswith("role", F.lit("u"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE starts_with(o_orderpriority, '1-') ORDER BY o_orderkey LIMIT 100")
def scoped_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1-"))).orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@register("""SELECT coalesce(k, -1) AS k, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 10 <> 0) GROUP BY ALL""")
def json_records(spark, sf_dir):
    """Lines of JSON with empty and broken ones among them; broken lines are counted under -1."""
    line = F.when(F.col("event_id") % 10 == 0, " ").when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    good, bad = S.parse_jsonl(table(spark, sf_dir, "events").select(line.alias("value")), "k long")
    return good.select("k").union(bad.select(F.lit(-1))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
