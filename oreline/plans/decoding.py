"""Readers of malformed and well-formed bytes, made from table columns, against what SQL says must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline import steps
from oreline.functions import scalars as S
from oreline.operators import archives, assemble, bsp, directory, gl, grid, maps, oneshot, verbs
from oreline.options import Options
from oreline.plans.catalogue import register, table
from oreline.sources import archive, audio, decoders, graphics, nodes, records, scripts, textmap, wad

LENIENT = Options(strict=False)


def le(c: F.Column, n: int) -> F.Column:
    """Hex of a whole number, least byte first."""
    return F.lpad(F.hex(S.swap_bytes(c.cast("long").bitwiseAND((1 << (8 * n)) - 1), n)), 2 * n, "0")


def raw(*parts) -> F.Column:
    """Bytes of hex columns and literals."""
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


# ---------------------------------------------------------------- containers
@register("""WITH k AS (SELECT p_partkey AS id, p_partkey % 8 AS f, CAST(p_size AS BIGINT) AS s FROM part)
  SELECT id, CASE f WHEN 0 THEN 1 WHEN 3 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS lumps, CASE WHEN f = 7 THEN NULL WHEN f IN (3) THEN NULL WHEN f = 5 THEN 0 WHEN f = 6 THEN 0 WHEN f = 2 THEN CAST(s AS BIGINT) ELSE s END AS size,
    CASE f WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS warnings, f = 7 AS error FROM k""")
def malformed_containers(spark, sf_dir):
    """One blob a file, and one fault by key: none, bad magic, one entry too many, negative count, blob beyond the end, negative
    size, blob inside the directory, cut header."""
    k, s = F.col("p_partkey") % 8, F.col("p_size").cast("long")
    head = F.concat(F.when(k == 1, F.lit("58574144")).otherwise(F.lit("50574144")), le(F.when(k == 2, 2).when(k == 3, -1).otherwise(1), 4), le(s + 12, 4))
    size = F.when(k == 4, s + 1_000).when(k == 5, -1).otherwise(s)
    entry = F.concat(le(F.when(k == 4, 12).when(k == 6, s + 12).otherwise(12), 4), le(size, 4), F.lit("4C554D5000000000"))
    body = F.repeat(F.lit("AB"), s.cast("int"))
    content = F.when(k == 7, raw("50574144")).otherwise(F.unhex(F.concat(head, body, entry)))
    got = wad.scan(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")), LENIENT)
    return got.groupBy(F.col("path").cast("long").alias("id")).agg(F.count("lump_idx").cast("int").alias("lumps"), F.max("size").alias("size"), F.max(F.size("warnings")).alias("warnings"), F.max(F.col("error").isNotNull()).alias("error"))


@register("""SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS lump_idx, o_orderstatus || '_' || (o_orderkey % 3) AS name, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS size,
    'unknown' AS audio FROM orders""")
def lump_listing(spark, sf_dir):
    return verbs.listing(wad.scan(_order_containers(spark, sf_dir))).select("path", "lump_idx", "name", "size", "audio")


def _order_containers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat("o_orderstatus", F.lit("_"), (F.col("o_orderkey") % 3).cast("string"))
    lumps = o.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("lump_idx"), name.alias("name"), F.col("o_orderpriority").cast("binary").alias("data"))
    return verbs.build(lumps)


@register("""WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS i FROM l)
  SELECT path, CASE WHEN i > 0 THEN 'F_1_' || i ELSE 'F_1' END || '.bin' AS file, p AS data FROM n""")
def lump_extract(spark, sf_dir):
    return verbs.extract(wad.scan(_order_containers(spark, sf_dir)), "F_1").select("path", "file", F.decode("data", "UTF-8").alias("data"))


@register("""WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderstatus || '_' || (o_orderkey % 3) AS name, o_orderpriority AS p FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 1))
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS lump_idx, name, p AS data FROM l""")
def lump_pruning(spark, sf_dir):
    """Read, pruned, written again and read again."""
    kept = verbs.without(wad.scan(_order_containers(spark, sf_dir)), ["F_1"])
    return wad.scan(verbs.build(kept)).select("path", "lump_idx", "name", F.decode("data", "UTF-8").alias("data"))


@register("""SELECT CAST(o_custkey AS VARCHAR) AS path, count(*) AS lumps, CAST(sum(octet_length(encode(o_orderpriority))) AS BIGINT) AS bytes, 'doom' AS game FROM orders GROUP BY 1""")
def lump_info(spark, sf_dir):
    return verbs.info(wad.scan(_order_containers(spark, sf_dir))).select("path", "lumps", "bytes", "game")


# ---------------------------------------------------------------- archives
def _members(spark, sf_dir):
    """An archive for each of 16 parts of customers: texts, a container of one map, a container at the root, and one cut short."""

    def zipped(pdf):
        import io
        import zipfile

        import pandas as pd

        out = io.BytesIO()
        a = int(pdf["a"].iloc[0])
        inner = wad.build([("E1M1", b""), ("THINGS", bytes(10)), ("MAP02", b""), ("THINGS", b"")])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in zip(pdf["c_custkey"].tolist(), pdf["c_mktsegment"].tolist(), strict=True):
                z.writestr(f"{'sounds' if k % 2 else 'Flats'}/{name.lower()}{k}.txt", name)
            z.writestr("maps/MAP07.wad", inner)
            z.writestr("root.wad", inner if a % 2 else b"PWAD")
            z.writestr("maps/e1m1.map", "text")
        return pd.DataFrame({"path": [f"z{a}"], "content": [out.getvalue()]})

    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 16).alias("a"), "c_custkey", "c_mktsegment")
    return archive.scan(c.groupBy("a").applyInPandas(zipped, "path string, content binary"), Options())


_PARTS = "p AS (SELECT c_custkey % 16 AS a, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 1) AS odd, sum(length(c_mktsegment)) AS b FROM customer GROUP BY 1)"


@register(f"""WITH {_PARTS}, s AS (SELECT a, 12 + 10 + 64 + CASE WHEN a % 2 = 1 THEN 86 ELSE 4 END + 4 AS x FROM p)
  SELECT 'z' || p.a AS path, n + 3 AS members, CAST(b + x AS BIGINT) AS bytes, 'MAP07,E1M1' AS maps, 'Global ' || 1 || CASE WHEN n > odd THEN ',Flats ' || (n - odd) ELSE '' END || CASE WHEN odd > 0 THEN ',Sounds ' || odd ELSE '' END || ',Hidden 2' AS namespaces FROM p JOIN s USING (a)""")
def archive_info(spark, sf_dir):
    text = F.array_join(F.transform("namespaces", lambda t: F.concat(t["namespace"], F.lit(" "), t["n"].cast("string"))), ",")
    return archives.info(_members(spark, sf_dir)).select("path", "members", "bytes", F.array_join("maps", ",").alias("maps"), text.alias("namespaces"))


@register("""SELECT 'z' || (c_custkey % 16) AS path, CASE WHEN c_custkey % 2 = 1 THEN 'sounds/' ELSE 'Flats/' END || lower(c_mktsegment) || c_custkey || '.txt' AS member, CASE WHEN c_custkey % 2 = 1 THEN 'Sounds' ELSE 'Flats' END AS namespace,
    upper(left(c_mktsegment || c_custkey, 8)) AS short_name, 'deflate' AS method, CAST(length(c_mktsegment) AS BIGINT) AS size, false AS encrypted FROM customer""")
def archive_listing(spark, sf_dir):
    return archives.listing(_members(spark, sf_dir)).where("namespace in ('Flats', 'Sounds')").select("path", "member", "namespace", "short_name", "method", "size", "encrypted")


@register("SELECT DISTINCT 'z' || (c_custkey % 16) AS path, 'root.wad' AS member, CASE WHEN c_custkey % 16 % 2 = 1 THEN 'E1M1,MAP02' ELSE '' END AS maps FROM customer")
def archive_embedded_maps(spark, sf_dir):
    return archives.embedded_map_names(_members(spark, sf_dir)).select("path", "member", F.array_join("maps", ",").alias("maps"))


@register("SELECT DISTINCT 'z' || (c_custkey % 16) AS path, 'MAP07' AS map, 'wad' AS kind FROM customer UNION SELECT DISTINCT 'z' || (c_custkey % 16), 'E1M1', 'text' FROM customer")
def archive_maps(spark, sf_dir):
    return archives.maps_of(_members(spark, sf_dir)).select("path", "map", "kind")


@register("SELECT DISTINCT 'z' || (c_custkey % 16) AS archive, 'root.wad' AS member, true AS bad FROM customer WHERE c_custkey % 16 % 2 = 0")
def archive_validate(spark, sf_dir):
    return archives.deep_validate(_members(spark, sf_dir)).select("archive", "member", F.col("error").isNotNull().alias("bad"))


@register("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'pk3 (zip)' WHEN 1 THEN 'pk3 (zip)' WHEN 2 THEN 'pk3 (zip)' WHEN 3 THEN 'pk7 (7z)' END AS label, CASE c_custkey % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'empty' WHEN 2 THEN 'spanned' WHEN 3 THEN '7z' WHEN 4 THEN 'wad' ELSE 'unknown' END AS kind FROM customer")
def archive_sniff(spark, sf_dir):
    heads = ["504B0304", "504B0506", "504B0708", "377ABCAF271C", "49574144", "00"]
    c = F.unhex(F.element_at(F.array(*[F.lit(h + "0000") for h in heads]), (F.col("c_custkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", archives.label(c).alias("label"), archive.kind_column(c).alias("kind"))


# ---------------------------------------------------------------- record files
@register("""WITH e AS (SELECT o_custkey AS c, o_orderkey AS k, 'f' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN ' x' ELSE '' END || '.zip' AS name, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders)
  SELECT CASE WHEN c % 10 = 0 THEN '' ELSE 'd' || c || '/' END AS dir, name, size, 'file' AS row FROM e WHERE k % 7 <> 0 AND k % 11 <> 0
  UNION ALL SELECT '', 'broken line ' || k, NULL, 'malformed' FROM e WHERE k % 7 = 0""")
def listing_scan(spark, sf_dir):
    """A listing for each customer: a section header, file lines, folder lines, broken lines and a total."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("size"))
    name = F.concat(F.lit("f"), F.col("k").cast("string"), F.when(F.col("k") % 5 == 0, " x").otherwise(""), F.lit(".zip"))
    line = F.when(F.col("k") % 7 == 0, F.concat(F.lit("broken line "), F.col("k").cast("string"))).when(F.col("k") % 11 == 0, F.concat(F.lit("drwxr-xr-x 2 a b 7 Jan 1 2000 sub"), F.col("k").cast("string")))
    line = F.coalesce(line, F.concat(F.lit("-rw-r--r-- 1 a b "), F.col("size").cast("string"), F.lit(" Jan 1 2000 "), name, F.when(F.col("k") % 3 == 0, "\r").otherwise("")))
    head = F.when(F.col("c") % 10 == 0, ".:").otherwise(F.concat(F.lit("./d"), F.col("c").cast("string"), F.lit(":")))
    rows = o.select(F.col("c").alias("file"), F.col("k").alias("n"), line.alias("line"))
    rows = rows.union(o.select("c", F.lit(-2), head).distinct()).union(o.select("c", F.lit(-1), F.lit("total 99")).distinct())
    files, bad = records.parse_listing(rows)
    return files.select("dir", "name", "size", F.lit("file").alias("row")).union(bad.select(F.lit(""), "line", F.lit(None).cast("long"), F.lit("malformed")))


@register("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS items, CASE o_orderkey % 4 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey + 1 END AS last FROM orders""")
def envelope_items(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"id": '), k, F.lit("}"))
    body = (F.when(F.col("o_orderkey") % 4 == 0, '{"error": "x"}').when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"content": {"file": '), one, F.lit("}}")))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('{"content": {"file": ['), one, F.lit(', {"id": '), (F.col("o_orderkey") + 1).cast("string"), F.lit("}]}}"))).otherwise('{"content": {"file": null}}'))
    items = records.envelope(body, "file", "id:long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(items).alias("items"), F.try_element_at(items, F.lit(-1))["id"].alias("last"))


@register("SELECT conv_id, turn, '{\"a\":[{\"b\":{\"c\":' || turn || '}}],\"role\":\"' || role || '\"}' AS body, role AS kept FROM conversations")
def scrubbed_bodies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit('{"a": [{"Email": 1, "b": {"textfile": "t", "c": '), F.col("turn").cast("string"), F.lit('}}], "reviews": [], "role": "'), F.col("role"), F.lit('"}'))
    nested = c.select("conv_id", "turn", body.alias("body"), F.struct(F.struct("role", F.col("role").alias("author_email")).alias("x"), F.lit(1).alias("reviews")).alias("s"), F.col("role").alias("EMAIL"))
    clean = records.scrub(nested)
    assert clean.columns == ["conv_id", "turn", "body", "s"] and clean.schema["s"].dataType.simpleString() == "struct<x:struct<role:string>>"
    return clean.select("conv_id", "turn", records.scrub_json(F.col("body")).alias("body"), F.col("s.x.role").alias("kept"))


# ---------------------------------------------------------------- scalars
@register("""SELECT o_orderkey, d, CASE WHEN d = '' THEN '' ELSE rtrim(d, '/') || '/' END AS dir, upper(nullif(regexp_extract(p, '(?i)^maps/([^/]+)\\.(?:wad|map)$', 1), '')) AS map, lower(p) LIKE '%.wad' AND NOT contains(p, '/') AS embedded,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Implode(6)' WHEN o_orderkey % 3 = 1 THEN 'deflate' ELSE 'unsupported(77)' END AS method, o_orderstatus IN ('F', 'P') AS conclusive, greatest(-32768, least(32767, n)) AS narrow, n & 65535 AS flags, greatest(0, least(65535, n)) AS u16, n < 0 OR n > 65535 AS lost,
    left(o_orderpriority, 8) AS name8, length(o_orderpriority) > 8 AS cut, CASE WHEN o_orderkey % 100 < 50 THEN 'SCRIPT' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS script, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 0 END AS unset, CASE WHEN o_orderkey % 2 = 0 THEN 'gl' ELSE 'xnod' END AS dialect,
    'ax b' || o_orderkey AS flat
  FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a/b/' ELSE 'c//' END AS d, CASE o_orderkey % 5 WHEN 0 THEN 'Maps/e' || o_orderkey || '.WAD' WHEN 1 THEN 'maps/x/y.wad' WHEN 2 THEN 'maps/q.map' WHEN 3 THEN 'root' || o_orderkey || '.wad' ELSE 'a.txt' END AS p, CAST((o_orderkey * 7919) % 200000 - 70000 AS INTEGER) AS n FROM orders)""")
def scalar_names(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.when(k % 4 == 0, "").when(k % 4 == 1, "a/b").when(k % 4 == 2, "a/b/").otherwise("c//")
    s = k.cast("string")
    p = F.when(k % 5 == 0, F.concat(F.lit("Maps/e"), s, F.lit(".WAD"))).when(k % 5 == 1, "maps/x/y.wad").when(k % 5 == 2, "maps/q.map").when(k % 5 == 3, F.concat(F.lit("root"), s, F.lit(".wad"))).otherwise("a.txt")
    n = ((k * 7919) % 200_000 - 70_000).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "not_zip").otherwise("fetch_error")
    method = F.when(k % 3 == 0, "unsupported(6)").when(k % 3 == 1, "deflate").otherwise("unsupported(77)")
    u, lost = S.coerce_u16(F.col("n"))
    name, cut = S.name8(F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", d.alias("d"), p.alias("p"), n.alias("n"), status.alias("st"), method.alias("m"))
    return o.select(
        "o_orderkey", "d", S.normalize_dir(F.col("d")).alias("dir"), S.map_of(F.col("p")).alias("map"), S.is_embedded(F.col("p"), F.lit("other")).alias("embedded"), S.method_label(F.col("m")).alias("method"), records.conclusive(F.col("st")).alias("conclusive"),
        S.narrow_int(F.col("n")).alias("narrow"), S.flags16(F.col("n")).alias("flags"), u.alias("u16"), lost.alias("lost"), F.decode(name, "UTF-8").alias("name8"), cut.alias("cut"), S.script_lump(F.when(k % 100 < 50, k % 100).otherwise(-1)).alias("script"),
        S.linedef_id_unset(F.when(k % 2 == 0, "udmf").otherwise("doom")).alias("unset"), S.text_node_dialect(F.when(k % 2 == 0, "classic").otherwise("xnod")).alias("dialect"), S.flatten_control(F.concat(F.lit("a\x1bx\n"), F.lit("b"), k.cast("string"))).alias("flat"),
    )


@register("""SELECT l_orderkey, l_linenumber, round(sqrt((x - u) * (x - u) + (y - v) * (y - v)), 6) AS distance, array_to_string(list_value(greatest(x, u), least(y, v), least(x, u), greatest(y, v)), ',') AS box,
    CASE WHEN abs(round(c) * 65536) < 2147483648 THEN CAST(round(c) * 65536 AS BIGINT) END AS whole, CAST(round(c * 65536) AS BIGINT) AS exact, x * v - y * u AS area, CAST((x * v - y * u) AS HUGEINT) * (x * v - y * u) * 4 < u * u + v * v AS near,
    greatest(x, 0) AS size, x < 0 AS negative, (flags & 1) <> 0 AS fixed, (flags & 4) <> 0 AS double, CAST((round(atan2(v, u) / (2 * pi()) * 65536) + 65536) % 65536 AS INTEGER) AS angle
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 41 - 20 AS BIGINT) AS x, CAST(l_suppkey % 37 - 18 AS BIGINT) AS y, CAST(l_quantity AS BIGINT) - 25 AS u, CAST(l_linenumber AS BIGINT) AS v, l_discount * 1000 - 40 AS c, CAST(l_orderkey % 8 AS BIGINT) AS flags FROM lineitem)""")
def scalar_geometry(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 41 - 20).alias("x"), (F.col("l_suppkey") % 37 - 18).cast("long").alias("y"), (F.col("l_quantity").cast("long") - 25).alias("u"), F.col("l_linenumber").cast("long").alias("v"), (F.col("l_discount") * 1000 - 40).alias("c"), (F.col("l_orderkey") % 8).alias("flags"))
    x, y, u, v = (F.col(c) for c in "xyuv")
    area = S.cross_from_start(x, y, u, v)
    size, negative = S.clamp_dimension(x)
    flags = S.instrument_flags(F.col("flags"))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(S.distance(x, y, u, v), 6).alias("distance"), F.array_join(S.bbox_union(F.array(x, y, x, y), F.array(u, v, u, v)).cast("array<string>"), ",").alias("box"), S.fixed_16_16(F.col("c")).alias("whole"), S.fixed_16_16_exact(F.col("c")).alias("exact"),
        area.alias("area"), S.within_half_unit(area, u * u + v * v).alias("near"), size.alias("size"), negative.alias("negative"), flags["fixed_pitch"].alias("fixed"), flags["double_voice"].alias("double"), S.bam_angle(u.cast("double"), v.cast("double")).alias("angle"),
    )


@register("""WITH d AS (SELECT n_nationkey AS k, CAST(n_nationkey * 7 % 11 - 5 AS BIGINT) AS x, CAST(n_nationkey * 3 % 7 - 3 AS BIGINT) AS y FROM nation WHERE n_nationkey * 7 % 11 <> 5 OR n_nationkey * 3 % 7 <> 3),
  a AS (SELECT k, x, y, (atan2(x * 0 + y, x * 1) + 2 * pi()) AS t FROM d), b AS (SELECT *, CASE WHEN t >= 2 * pi() THEN t - 2 * pi() ELSE t END AS ccw FROM a)
  SELECT p.k AS a, q.k AS b, CASE WHEN p.x * q.y = p.y * q.x AND p.x * q.x + p.y * q.y > 0 THEN 0 WHEN p.ccw = 0 THEN -1 WHEN q.ccw = 0 THEN 1 WHEN p.ccw > q.ccw THEN -1 ELSE 1 END AS clockwise,
    CASE WHEN p.x * q.y = p.y * q.x AND p.x * q.x + p.y * q.y > 0 THEN 0 WHEN p.ccw < q.ccw THEN -1 ELSE 1 END AS counter FROM b p, b q""")
def turn_orders(spark, sf_dir):
    """Exact comparisons of directions around the one to the east."""
    k = F.col("n_nationkey").cast("long")
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (k * 7 % 11 - 5).alias("x"), (k * 3 % 7 - 3).alias("y")).where("x <> 0 or y <> 0")
    other = F.broadcast(d.select(F.col("k").alias("b"), F.col("x").alias("u"), F.col("y").alias("v")))  # 25 nations
    j = d.withColumnRenamed("k", "a").join(other)
    east = F.lit(1), F.lit(0)
    key = lambda f, x, y: f(*east, F.col(x), F.col(y))
    return j.select("a", "b", S.turns_before(key(S.clockwise_key, "x", "y"), key(S.clockwise_key, "u", "v")).alias("clockwise"), S.turns_before(key(S.counter_clockwise_key, "x", "y"), key(S.counter_clockwise_key, "u", "v"), clockwise=False).alias("counter"))


# ---------------------------------------------------------------- records of every layout
@register("""WITH l AS (SELECT *, CAST(l_quantity AS BIGINT) - 25 AS q FROM lineitem), r AS (
  SELECT 'linedef' AS record, l_orderkey AS key, list_value(l_partkey % 65536, l_suppkey % 65536, l_orderkey % 65536, l_linenumber, q + 25, l_orderkey % 1000, 65535) AS v FROM l
  UNION ALL SELECT 'hexen_linedef', l_orderkey, list_value(l_partkey % 65536, 7, 8, 9, (l_linenumber + 300) & 255, 1, 2, 3, 255, 0, 65535) FROM l
  UNION ALL SELECT 'hexen_thing', l_orderkey, list_value(1, q, -q, 3, 90, 3001, 7, 80, 1, 2, 3, 4, (l_linenumber + 300) & 255) FROM l
  UNION ALL SELECT 'seg', l_orderkey, list_value(0, 1, 2, 3, l_linenumber % 2, q) FROM l UNION ALL SELECT 'subsector', l_orderkey, list_value(l_linenumber, l_orderkey % 65536) FROM l
  UNION ALL SELECT 'node', l_orderkey, list_value(q, -q, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 32768 + l_linenumber, l_linenumber) FROM l
  UNION ALL SELECT 'd64_vertex', l_orderkey, list_value(q * 2 + 1, l_linenumber * 2) FROM l UNION ALL SELECT 'd64_thing', l_orderkey, list_value(q, -q, 5, 90, 3001, 1031, l_linenumber) FROM l
  UNION ALL SELECT 'd64_linedef', l_orderkey, list_value(1, 2, (l_orderkey * 65537) % 4294967296, 256, 3, 0, 65535) FROM l
  UNION ALL SELECT 'd64_sidedef', l_orderkey, list_value(q, -q, 60000, 1, 2, l_linenumber) FROM l UNION ALL SELECT 'd64_light', l_orderkey, list_value(255, 128, l_linenumber, 0, l_orderkey % 65536) FROM l)
  SELECT record, key, array_to_string(CAST(v AS BIGINT[]), ',') AS v, count(*) AS n FROM r GROUP BY ALL""")
def record_layouts(spark, sf_dir):
    """Records of every layout of whole numbers, packed and read back; coordinates of Doom 64 points are shown doubled."""
    li = table(spark, sf_dir, "lineitem")
    q, k, ln = F.col("l_quantity").cast("long") - 25, F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    values = {
        "linedef": [F.col("l_partkey") % 65536, F.col("l_suppkey") % 65536, k % 65536, ln, q + 25, k % 1000, 65535], "hexen_linedef": [F.col("l_partkey") % 65536, 7, 8, 9, ln + 300, 1, 2, 3, 255, 0, 65535],
        "hexen_thing": [1, q, -q, 3, 90, 3001, 7, 80, 1, 2, 3, 4, ln + 300], "seg": [0, 1, 2, 3, ln % 2, q], "subsector": [ln, k % 65536], "node": [q, -q, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 32768 + ln, ln],
        "d64_vertex": [q * 65536 + 32768, ln * 65536], "d64_thing": [q, -q, 5, 90, 3001, 1031, ln], "d64_linedef": [1, 2, (k * 65537) % 2**32, 256, 3, 0, 65535], "d64_sidedef": [q, -q, 60000, 1, 2, ln], "d64_light": [255, 128, ln, 0, k % 65536],
    }
    out = None
    for record, cols in values.items():
        names = [n for n, _ in decoders.fields(record)]
        rows = li.select(k.alias("key"), ln.alias("__n"), *[(c if isinstance(c, F.Column) else F.lit(c)).alias(n) for n, c in zip(names, cols, strict=True)])
        got = decoders.records(decoders.pack_native(rows, record, ["key"], "__n"), record, ["key"], options=Options())
        scale = 2 if record == "d64_vertex" else 1
        got = got.select(F.lit(record).alias("record"), "key", F.concat_ws(",", *[(F.col(n) * scale).cast("long").cast("string") for n in names]).alias("v"))
        out = got if out is None else out.union(got)
    return out.groupBy("record", "key", "v").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT p_partkey, CAST(p_size % 9 + 3 AS INTEGER) AS width, (p_partkey % 256) || ',' || ((p_partkey + 1) % 256) || ',' || ((p_partkey + 2) % 256) AS rgb, CAST(p_size AS BIGINT) * 64 * 64 AS flat_total, CAST(p_size % 40 AS INTEGER) AS samples,
    CASE p_partkey % 3 WHEN 0 THEN 11025 ELSE 22050 END AS rate, CAST(p_size % 5 AS INTEGER) AS tones FROM part""")
def resource_decoders(spark, sf_dir):
    """Palettes, flats, pictures, sounds and tones made from each part and decoded in one pass."""
    k, size = F.col("p_partkey"), F.col("p_size")
    width = (size % 9 + 3).cast("int")
    palette = raw(le(k % 256, 1), le((k + 1) % 256, 1), le((k + 2) % 256, 1), F.repeat(F.lit("00"), 765))
    flat = F.unhex(F.repeat(le(size, 1), 4096))
    column = "0002AA0102AAFF"  # one post of two pixels
    columns = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: le(8 + width * 4 + i * 7, 4)), "")
    picture = raw(le(width, 2), le(F.lit(4), 2), "00000000", columns, F.repeat(F.lit(column), width))
    samples = (size % 40).cast("int")
    sound = raw("0300", le(F.when(k % 3 == 0, 11025).otherwise(22050), 2), le(samples + 32, 4), F.repeat(F.lit("80"), samples + 32))
    tones = raw("0000", le(size % 5, 2), F.repeat(F.lit("11"), (size % 5).cast("int")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, pal, fl, pic, snd, tone in zip(*(pdf[c] for c in ("k", "pal", "flat", "pic", "snd", "tone")), strict=True):
                image = graphics.picture(bytes(pic))
                rate, body = audio.sample_sound(bytes(snd))
                out.append((key, image.pixels.shape[1] if image.pixels.ndim == 2 else 0, ",".join(map(str, graphics.palettes(bytes(pal))[0, 0].tolist())), int(graphics.flat(bytes(fl)).pixels.sum()), len(body), rate, len(audio.speaker_tones(bytes(tone)))))
            yield pd.DataFrame(out, columns=["p_partkey", "width", "rgb", "flat_total", "samples", "rate", "tones"])

    p = table(spark, sf_dir, "part").select(k.alias("k"), palette.alias("pal"), flat.alias("flat"), picture.alias("pic"), sound.alias("snd"), tones.alias("tone"))
    return p.mapInPandas(run, "p_partkey long, width int, rgb string, flat_total long, samples int, rate int, tones int")


@register("""SELECT p_partkey, lower(hex(p_size)) AS b, sha256(unhex('52494646' || '2C000000' || '57415645666D7420' || '10000000' || '01000100' || '112B0000' || '112B0000' || '01000800' || '64617461' || '08000000' || repeat(lpad(hex(p_size), 2, '0'), 8))) AS wav,
    sha256(unhex('4D546864000000060000000100464D54726B' || '00000011' || '00B07B00' || '0090' || lpad(hex(p_size), 2, '0') || '64' || '8C2080' || lpad(hex(p_size), 2, '0') || '00' || '00FF2F00')) AS midi FROM part""")
def sound_conversions(spark, sf_dir):
    """Sounds as WAV and scores as MIDI, byte for byte."""
    size = F.col("p_size")
    sound = raw("0300112B28000000", F.repeat(F.lit("00"), 16), F.repeat(le(size, 1), 8), F.repeat(F.lit("00"), 16))
    score = raw("4D55531A", "0900", "1000", "0100", "0000", "0000", "0000", "90", F.lpad(F.hex(size + 128), 2, "0"), "648C20", "00", le(size, 1), "60", "00")

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            wavs = [hashlib.sha256(audio.wav(*audio.sample_sound(bytes(s)))).hexdigest() for s in pdf["s"]]
            midi = [hashlib.sha256(audio.to_midi(audio.score(bytes(m))[1])).hexdigest() for m in pdf["m"]]
            yield pd.DataFrame({"p_partkey": pdf["k"], "b": [f"{x:x}" for x in pdf["z"]], "wav": wavs, "midi": midi})

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), size.alias("z"), sound.alias("s"), score.alias("m"))
    return p.mapInPandas(run, "p_partkey long, b string, wav string, midi string")


# ---------------------------------------------------------------- grids
@register("""SELECT p_partkey, c AS col, r AS row, CASE WHEN (c + r) % 2 = 0 THEN p_size || ',7' ELSE '' END AS lines FROM part, (SELECT unnest(generate_series(0, 1)) AS c), (SELECT unnest(generate_series(0, 2)) AS r)""")
def blockmap_roundtrip(spark, sf_dir):
    """Grids of two by three cells, written with shared lists and read back."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                cells = [[size, 7] if (c + r) % 2 == 0 else [] for r in range(3) for c in range(2)]
                got = maps.blockmap(maps.blockmap_bytes((-5, 9), 2, 3, cells), 70)
                assert got["origin"] == (-5, 9)
                out += [(k, i % 2, i // 2, ",".join(map(str, ids))) for i, ids in enumerate(got["cells"])]
            yield pd.DataFrame(out, columns=["p_partkey", "col", "row", "lines"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, col long, row long, lines string")


@register("SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 THEN CAST(floor(x / 128) AS BIGINT) END AS col, CASE WHEN y >= 0 THEN CAST(floor(y / 128) AS BIGINT) END AS row FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 - 50 AS x, l_quantity * 30 - 100 AS y FROM lineitem)")
def cell_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 30).cast("double").alias("y"))
    col, row = grid.cell_of(F.col("x"), F.col("y"), F.lit(50.0), F.lit(100.0))
    return li.select("l_orderkey", "l_linenumber", col.alias("col"), row.alias("row"))


# ---------------------------------------------------------------- directories
_MAPS = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"""


def _map_containers(spark, sf_dir):
    """A container for each region with a map for each nation: classic, Hexen and text maps, some with GL blobs behind."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    kind = k % 3
    part = lambda *names: F.array(*[F.lit(x) for x in names])
    body = F.when(kind == 0, part("THINGS", "LINEDEFS", "VERTEXES")).when(kind == 1, part("THINGS", "BEHAVIOR")).otherwise(part("TEXTMAP", "ZNODES", "ENDMAP"))
    name = F.concat(F.lit("MAP"), F.lpad(k.cast("string"), 2, "0"))
    gl = F.when((kind == 0) & (k % 2 == 0), F.array(F.concat(F.lit("GL_"), name), F.lit("GL_VERT"), F.lit("GL_SEGS"), F.lit("GL_SSECT"), F.lit("GL_NODES"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), r.cast("string")).alias("path"), k.alias("k"), F.posexplode(F.concat(F.array(name), body, gl)).alias("j", "name"))
    from pyspark.sql import Window as W

    lumps = rows.withColumn("lump_idx", F.row_number().over(W.partitionBy("path").orderBy("k", "j")) - 1)
    return lumps.select("path", "lump_idx", "name", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("data"))


@register(f"""WITH {_MAPS} SELECT 'r' || r AS path, 'MAP' || lpad(CAST(k AS VARCHAR), 2, '0') AS map, CASE k % 3 WHEN 0 THEN 'doom' WHEN 1 THEN 'hexen' ELSE 'udmf' END AS format, CASE k % 3 WHEN 0 THEN 'THINGS,LINEDEFS,VERTEXES' WHEN 1 THEN 'THINGS,BEHAVIOR' ELSE 'TEXTMAP,ZNODES,ENDMAP' END AS lumps FROM n""")
def map_groups(spark, sf_dir):
    g = directory.group_rows(_map_containers(spark, sf_dir))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda p: p["name"]), ",")
    return g.groupBy("path", "map", "format").agg(names.alias("lumps"))


@register(f"""WITH {_MAPS} SELECT 'r' || r AS path, 'MAP' || lpad(CAST(k AS VARCHAR), 2, '0') AS map, x AS name FROM n, (SELECT unnest(['GL_VERT', 'GL_SEGS', 'GL_SSECT', 'GL_NODES']) AS x) WHERE k % 3 = 0 AND k % 2 = 0""")
def gl_groups(spark, sf_dir):
    lumps = _map_containers(spark, sf_dir)
    return directory.gl_groups(lumps, directory.group_rows(lumps)).where("name in ('GL_VERT', 'GL_SEGS', 'GL_SSECT', 'GL_NODES')").select("path", "map", "name")


@register("""SELECT s_suppkey, s_suppkey % 3 = 0 AS fits FROM supplier""")
def gl_level_match(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("MAP"), k.cast("string"))
    text = F.when(k % 3 == 0, F.concat(F.lit("TIME=1\nLEVEL="), name, F.lit(" \r\nX=2"))).when(k % 3 == 1, F.concat(F.lit("LEVEL="), name, F.lit("9"))).otherwise(F.concat(F.lit("level="), name))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.gl_level_matches(text, name).alias("fits"))


@register("""SELECT source AS path, CASE lang WHEN 'en' THEN 'sprites' WHEN 'de' THEN 'flats' WHEN 'fr' THEN 'patches' ELSE 'textures' END AS kind, count(*) AS n, 'L' || min(doc_id) % 9999999 AS first_name FROM documents GROUP BY source, lang""")
def section_names(spark, sf_dir):
    from oreline.plans.binary import section_lumps

    s = directory.section_rows(section_lumps(spark, sf_dir))
    return s.select("path", "kind", F.size("names").cast("long").alias("n"), F.element_at("names", 1).alias("first_name"))


@register(f"""WITH {_MAPS}, l AS (SELECT 'r' || r AS path, k, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 3 END + 1 + CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 5 ELSE 0 END AS m FROM n),
  w AS (SELECT path, k, CASE k % 3 WHEN 2 THEN m ELSE m + 1 END AS m2 FROM l) SELECT path, CAST(sum(m2) AS BIGINT) AS lumps, count(*) FILTER (WHERE k % 3 = 2) AS replaced, count(*) FILTER (WHERE k % 3 <> 2) AS inserted FROM w GROUP BY path""")
def patched_nodes(spark, sf_dir):
    """A ZNODES blob put into every map group: in place where there is one, else at the group's end."""
    lumps = _map_containers(spark, sf_dir).select("path", "lump_idx", "name", "data")
    groups = directory.group_rows(lumps)
    new = groups.select("path", "map", "format").distinct().select("path", "map", F.lit("ZNODES").alias("name"), F.when(F.col("format") == "udmf", F.lit(b"old")).otherwise(F.lit(b"new")).alias("data"))
    got = archives.patch_nodes(lumps, groups, new, text=True)
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("lumps"), F.count_if(F.col("data") == F.lit(b"old")).alias("replaced"), F.count_if(F.col("data") == F.lit(b"new")).alias("inserted"))


# ---------------------------------------------------------------- text maps
def _text_maps(spark, sf_dir, place: F.Column | None = None):
    """A text map for each customer: a point for each order, a line from each to the next, one side and one sector; with ``place``, a
    column of ``o_custkey``, as a column of that name."""
    o = steps.dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    o = o.select("o_custkey", "ks", (F.lit(0) if place is None else place).cast("long").alias("place"))
    o = o if place is None else steps.dealt(o, "o_custkey")

    block = lambda kind, *parts: F.concat(F.lit(f"{kind}\n{{\n"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("}\n"))
    each = lambda of, ks="ks": F.array_join(F.transform(ks, of), "")
    n = F.size("ks")

    def vertex(k: F.Column) -> F.Column:
        quarters = F.array(*[F.lit(x) for x in ("", ".25", ".5", ".75")])[F.abs(k).bitwiseAND(3)]
        return block("vertex", "  x = ", k, ";\n  y = ", F.when(k < 0, "-").otherwise(""), F.shiftright(F.abs(k), 2), quarters, ";\n")

    def line(k: F.Column, i: F.Column) -> F.Column:
        side, back = F.when(k % 3 != 0, "0").otherwise("9"), F.when(k % 5 == 0, "  sideback = 0;\n").otherwise("")
        blocking, special = F.when(k % 2 == 0, "true").otherwise("false"), F.when(k % 7 != 0, F.concat(F.lit("  special = "), (k % 7).cast("string"), F.lit(";\n"))).otherwise("")
        return block("linedef", "  v1 = ", i, ";\n  v2 = ", i + 1, ";\n  sidefront = ", side, ";\n", back, "  blocking = ", blocking, ";\n", special)

    side, sector = block("sidedef", '  sector = 0;\n  texturemiddle = "W\\"', n, '";\n'), block("sector", '  texturefloor = "F";\n  textureceiling = "LONGNAME9";\n  heightfloor = -40000;\n')
    things = each(lambda k: block("thing", "  x = 1.5;\n  y = -2.5;\n  type = ", F.when(k % 2 == 1, k % 70_000).otherwise(70_000), ";\n  angle = -90;\n"), F.slice("ks", 1, 2))
    text = F.concat(F.lit('namespace = "doom";\n'), each(vertex), each(line), side, sector, things)
    m = o.select(F.lit("t").alias("path"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("map"), text.cast("binary").alias("data"), "place")
    return m.drop("place") if place is None else m


_ORD = "o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@register(f"""WITH {_ORD} SELECT 'C' || c AS map, CAST(i AS INTEGER) AS idx, CAST(i AS INTEGER) AS start, CAST(CASE WHEN i + 1 < n THEN i + 1 ELSE 0 END AS INTEGER) AS "end", CASE WHEN k % 3 <> 0 THEN 0 END AS "right", CASE WHEN k % 5 = 0 THEN 0 END AS "left", CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS flags, CAST(k % 7 AS INTEGER) AS special,
    CASE WHEN i + 1 < n THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS warnings FROM o""")
def textmap_lines(spark, sf_dir):
    t = assemble.text_tables(_text_maps(spark, sf_dir), Options())
    return t["linedefs"].select("map", "idx", "start", "end", "right", "left", "flags", "special", F.size("warnings").alias("warnings"))


@register(f"""WITH {_ORD} SELECT 'C' || c AS map, CAST(i AS INTEGER) AS idx, CAST(least(k, 32767) AS INTEGER) AS x, CAST(least(round(k / 4.0), 32767) AS INTEGER) AS y, CASE WHEN k > 32767 THEN 1 ELSE 0 END + CASE WHEN round(k / 4.0) > 32767 OR k % 4 <> 0 THEN 1 ELSE 0 END AS losses, 'vertex' AS record FROM o
  UNION ALL SELECT 'C' || c, CAST(i AS INTEGER), CASE WHEN k % 2 = 1 THEN CAST(least(k % 70000, 65535) AS INTEGER) ELSE 65535 END, 270, 2, 'thing' FROM o WHERE i < 2
  UNION ALL SELECT 'C' || c, 0, -32768, 0, 2, 'sector' FROM o WHERE i = 0""")
def textmap_narrowed(spark, sf_dir):
    """Text maps narrowed to classic records, with what was lost."""
    t = assemble.text_tables(_text_maps(spark, sf_dir), Options())
    v, th, s = (assemble.narrow(r, t[r + "s"]) for r in ("vertex", "thing", "sector"))
    n = F.size("losses").alias("losses")
    return v.select("map", "idx", "x", "y", n, F.lit("vertex").alias("record")).union(th.select("map", "idx", "type", "angle", n, F.lit("thing"))).union(s.select("map", "idx", "floor", F.lit(0), n, F.lit("sector")))


@register(f"""WITH {_ORD}, m AS (SELECT DISTINCT c, n FROM o) SELECT 'C' || c AS map, x AS name, CAST(CASE x WHEN 'VERTEXES' THEN 4 * n WHEN 'LINEDEFS' THEN 14 * n WHEN 'SIDEDEFS' THEN 30 WHEN 'SECTORS' THEN 26 WHEN 'THINGS' THEN 10 * least(n, 2) ELSE 0 END AS BIGINT) AS size
  FROM m, (SELECT unnest(['THINGS', 'LINEDEFS', 'SIDEDEFS', 'VERTEXES', 'SEGS', 'SSECTORS', 'NODES', 'SECTORS', 'REJECT', 'BLOCKMAP']) AS x)""")
def textmap_to_classic(spark, sf_dir):
    """Whole text maps written as classic map groups."""
    blobs, _ = assemble.to_classic(assemble.text_tables(_text_maps(spark, sf_dir), Options()))
    return blobs.select("map", "name", F.octet_length("data").cast("long").alias("size"))


@register(f"""WITH {_ORD} SELECT 'C' || c AS map, CAST(i AS INTEGER) AS idx, CAST(i AS INTEGER) AS start, CASE WHEN k % 3 <> 0 THEN 0 END AS "right", CASE WHEN k % 5 = 0 THEN 0 END AS "left", CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS flags, CAST(k % 7 AS INTEGER) AS special FROM o""")
def textmap_rewritten(spark, sf_dir):
    """Linked tables of text maps, written as text maps again and read once more."""
    t = assemble.text_tables(_text_maps(spark, sf_dir), Options())
    again = assemble.text_tables(assemble.to_text(t), Options(), only="linedefs")
    return again["linedefs"].select("map", "idx", "start", "right", "left", "flags", "special")


@register(f"""WITH {_ORD}, m AS (SELECT DISTINCT c, n FROM o) SELECT 'f' || (c % 7) AS path, count(*) * 11 + 1 AS lumps, CAST(sum(14 * n) AS BIGINT) AS line_bytes, 'README' AS first FROM m GROUP BY c % 7""")
def converted_files(spark, sf_dir):
    """Files of text maps behind a note, converted to classic groups: eleven blobs for each map, the note where it was."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(F.col("o_custkey") % 7).orderBy("o_custkey")) * 3 - 2  # of a map's marker; texts are not sorted
    m = _text_maps(spark, sf_dir, place).withColumn("path", F.concat(F.lit("f"), (F.substring("map", 2, 20).cast("long") % 7).cast("string")))
    rows = m.select("path", F.inline(F.array(*[F.struct((F.col("place") + i).cast("int").alias("lump_idx"), n.alias("name"), d.alias("data")) for i, (n, d) in enumerate([(F.col("map"), F.lit(b"")), (F.lit("TEXTMAP"), F.col("data")), (F.lit("ENDMAP"), F.lit(b""))])])))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")).alias("path")).distinct()
    lumps = rows.union(files.select("path", F.lit(0), F.lit("README"), F.lit(b"x")))
    got, _ = assemble.convert(lumps, "doom")
    size = F.when(F.col("name") == "LINEDEFS", F.octet_length("data")).otherwise(0)
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("lumps"), F.sum(size).cast("long").alias("line_bytes"), F.min_by("name", "lump_idx").alias("first"))


@register("""SELECT 'MAP' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS map, CAST(i AS INTEGER) AS idx, i / 2.0 AS x, CAST(i AS INTEGER) AS start, CAST(CASE WHEN i < 3 THEN i + 1 ELSE 0 END AS INTEGER) AS "end", CASE WHEN i % 2 = 0 THEN 0 END AS "right", CAST(n_nationkey AS INTEGER) AS arg0,
    CASE WHEN i = 3 THEN 1 ELSE 0 END + CASE WHEN i % 2 = 1 THEN 1 ELSE 0 END AS warnings, CASE WHEN n_nationkey % 2 = 0 THEN 'T' || n_nationkey END AS floor_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 70 END AS floor_index, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 256 ELSE 0 END AS INTEGER) AS color, 257 AS lights
  FROM nation, (SELECT unnest(generate_series(0, 3)) AS i)""")
def doom64_maps(spark, sf_dir):
    """Maps in containers of their own, a file for each region: points, lines, a side, a sector and a light each."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    name = F.concat(F.lit("MAP"), F.lpad(F.col("k").cast("string"), 2, "0"))
    i = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    key = ["n_regionkey", "k", "n_name"]
    hashed = S.name_hash(F.concat(F.lit("T"), F.col("k").cast("string"))).cast("int")
    zero = lambda *names: [F.lit(0).alias(x) for x in names]
    tables = {
        "VERTEXES": ("d64_vertex", i.select(*key, "i", (F.col("i") * 32768).alias("x"), F.lit(0).alias("y"))),
        "LINEDEFS": ("d64_linedef", i.select(*key, "i", F.col("i").alias("start"), F.when(F.col("i") < 3, F.col("i") + 1).otherwise(99).alias("end"), F.lit(70_000).alias("flags"), F.lit(0).alias("special"), F.col("k").alias("tag"), F.when(F.col("i") % 2 == 0, 0).otherwise(5).alias("right"), F.lit(65535).alias("left"))),
        "SIDEDEFS": ("d64_sidedef", n.select(*key, F.lit(0).alias("i"), *zero("x_offset", "y_offset", "upper", "lower", "middle", "sector"))),
        "SECTORS": ("d64_sector", n.select(*key, F.lit(0).alias("i"), *zero("floor", "ceiling"), F.when(F.col("k") % 2 == 0, hashed).otherwise(70).alias("floor_tex"), *zero("ceiling_tex"), F.when(F.col("k") % 3 == 0, 256).otherwise(999).alias("floor_color"), *zero("ceiling_color", "thing_color", "top_color", "bottom_color", "special", "tag", "flags"))),
        "LIGHTS": ("d64_light", n.select(*key, F.lit(0).alias("i"), F.lit(9).alias("red"), *zero("green", "blue", "pad", "tag"))),
    }
    blobs = None
    for j, (lump, (record, rows)) in enumerate(tables.items()):
        b = decoders.pack_native(rows, record, key, "i").select(*key, F.lit(j).alias("j"), F.lit(lump).alias("name"), "data")
        blobs = b if blobs is None else blobs.union(b)
    inner = wad.pack(blobs.withColumn("who", F.concat_ws("/", F.col("n_regionkey").cast("string"), F.col("k").cast("string"))), "who", "j").select(F.split("who", "/")[0].alias("r"), F.split("who", "/")[1].cast("long").alias("k"), "content")
    outer = inner.select(F.concat(F.lit("r"), "r").alias("path"), F.col("k").alias("lump_idx"), F.concat(F.lit("MAP"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("name"), F.col("content").alias("data"))
    held = verbs.nested(wad.scan(verbs.build(outer)))
    lumps = held.select(F.split("path", "/")[0].alias("path"), F.split("path", "/")[1].alias("map"), "lump_idx", "name", "data")
    names = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), hashed.alias("hash"), F.concat(F.lit("T"), F.col("k").cast("string")).alias("name")).where("k % 2 = 0")
    t = assemble.doom64_tables(lumps, names)
    lines = t["linedefs"].select("path", "map", "idx", "start", "end", "right", "arg0", F.size("warnings").alias("warnings"))
    sectors = t["sectors"].select("path", "map", F.col("floor_tex.name").alias("floor_name"), F.col("floor_tex.index").alias("floor_index"), F.col("floor_color").alias("color"))
    lights = t["lights"].groupBy("path", "map").agg(F.count(F.lit(1)).cast("int").alias("lights"))
    points = t["vertexs"].select("path", "map", "idx", "x")
    return lines.join(points, ["path", "map", "idx"]).join(sectors, ["path", "map"]).join(lights, ["path", "map"]).drop("path")


@register("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN 0 ELSE CAST(p_size % 4 + 1 AS INTEGER) END AS leafs, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN 1 ELSE 0 END AS leaf_warnings, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size % 3 AS INTEGER) END AS macros, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS macro_warnings FROM part""")
def leafs_and_macros(spark, sf_dir):
    """Leaf and macro blobs, some with a wrong count, a dangling point, a cut record or bytes too many."""

    def run(batches):
        import struct

        import pandas as pd

        for pdf in batches:
            out = []
            for k, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                n = size % 4 + 1
                data = b"".join(struct.pack("<HHHHH", 2, 0, 0xFFFF, 9 if k % 5 == 2 else 1, 0) for _ in range(n))
                data = data[:-1] if k % 5 == 3 else data
                got, w = assemble.leafs(data, n + (k % 5 == 1), 2, 1, Options(strict=False))
                m = size % 3
                macro = struct.pack("<hh", m, 0) + b"".join(struct.pack("<h6h", 1, *range(6)) for _ in range(m)) + (b"x" if k % 3 == 0 else b"")
                acts, w2 = assemble.macros(macro, Options(strict=False))
                out.append((k, len(got), len(w), len(acts), len(w2)))
            yield pd.DataFrame(out, columns=["p_partkey", "leafs", "leaf_warnings", "macros", "macro_warnings"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, leafs int, leaf_warnings int, macros int, macro_warnings int")


@register("""SELECT 'z' || (c_custkey % 16) AS path, CASE WHEN c_custkey % 2 = 1 THEN 'sounds/' ELSE 'Flats/' END || lower(c_mktsegment) || c_custkey || '.txt' AS name, CAST(length(c_mktsegment) AS BIGINT) AS size, 'deflate' AS method FROM customer""")
def archive_tails(spark, sf_dir):
    """Members of archives of which only the last bytes are at hand; the rest is fetched as it is needed."""

    def run(pdf):
        import io
        import zipfile

        import pandas as pd

        out, a = io.BytesIO(), int(pdf["a"].iloc[0])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in zip(pdf["c_custkey"].tolist(), pdf["c_mktsegment"].tolist(), strict=True):
                z.writestr(f"{'sounds' if k % 2 else 'Flats'}/{name.lower()}{k}.txt", name)
        data = out.getvalue()
        got = archives.tail_members(data[-64:], len(data), lambda at, n: data[at : at + n])
        return pd.DataFrame({"path": [f"z{a}"] * len(got), "name": [m["name"] for m in got], "size": [m["uncompressed"] for m in got], "method": [m["method"] for m in got]})

    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 16).alias("a"), "c_custkey", "c_mktsegment")
    return c.groupBy("a").applyInPandas(run, "path string, name string, size long, method string")


@register("""WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, 'N' || n_nationkey AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
  SELECT 'r' || r AS path, 'TEX' || k AS texture, p AS part, CASE WHEN p = 0 THEN name END AS patch, CASE WHEN p = 0 AND i % 2 = 0 THEN CAST(2 + i // 2 AS INTEGER) END AS lump_idx, CAST(k AS INTEGER) AS x FROM n, (SELECT unnest([0, 1]) AS p)""")
def texture_patches(spark, sf_dir):
    """A texture for each nation of two patches: one of its own name, whose blob half of the nations have, and one that is not listed."""

    def run(pdf):
        import struct

        import pandas as pd

        pdf = pdf.sort_values("n_nationkey")
        ks, names = pdf["n_nationkey"].tolist(), [f"N{k}" for k in pdf["n_nationkey"]]
        pnames = struct.pack("<i", len(names)) + b"".join(x.encode().ljust(8, b"\0") for x in names)
        body = [struct.pack("<8sihhih", f"TEX{k}".encode(), 0, 64, 64, 0, 2) + struct.pack("<5h", k, 0, i, 0, 0) + struct.pack("<5h", k, 0, 999, 0, 0) for i, k in enumerate(ks)]
        at, offs = 4 + 4 * len(body), []
        for b in body:
            offs.append(at)
            at += len(b)
        tex = struct.pack("<i", len(body)) + struct.pack(f"<{len(offs)}i", *offs) + b"".join(body)
        lumps = [("PNAMES", pnames), ("TEXTURE1", tex)] + [(x, b"") for i, x in enumerate(names) if i % 2 == 0]
        return pd.DataFrame({"path": [f"r{int(pdf['n_regionkey'].iloc[0])}"] * len(lumps), "lump_idx": range(len(lumps)), "name": [x for x, _ in lumps], "data": [d for _, d in lumps]})

    lumps = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(run, "path string, lump_idx int, name string, data binary")
    return verbs.texture_patches(lumps).select("path", "texture", "part", "patch", "lump_idx", "x")


# ---------------------------------------------------------------- trees
def _room(size: int) -> tuple[list[tuple[int, int]], list[dict]]:
    """A room as wide as a part's size tells, with a pillar in it and a two-sided line across."""
    w = 200 + 8 * size
    points = [(0, 0), (0, 96), (w, 96), (w, 0), (40, 40), (40, 56), (56, 56), (56, 40), (100, 96), (120, 0)]
    ring = lambda ps, back=0xFFFF: [{"start": a, "end": b, "right": 0, "left": back} for a, b in zip(ps, [*ps[1:], ps[0]], strict=True)]
    return points, ring([0, 1, 8, 2, 3, 9]) + ring([7, 6, 5, 4]) + [{"start": 8, "end": 9, "right": 0, "left": 0}]


@register("SELECT p_partkey, CAST((200 + 8 * p_size) * 96 - 256 AS BIGINT) AS area, 0 AS faults, 0 AS classic_faults, 11 AS lines, 12 AS sides, true AS again FROM part")
def tree_builds(spark, sf_dir):
    """GL and classic trees of a room for each part: the leaves' areas make up the room, no loop is open, every side of every line
    has its seg, and the written tree reads back the same."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                points, lines = _room(size)
                t, c = gl.build(points, lines), bsp.build(points, lines)
                back = nodes.extended(nodes.write_extended(t, t["dialect"], compress=size % 2 == 0))
                sides = {(s["linedef"], s["side"]) for s in t["segs"] if s["linedef"] is not None}
                again = back["subsectors"] == t["subsectors"] and back["segs"] == t["segs"]
                out.append((k, bsp.near(gl.area(t, points)), len(gl.check(t)), len(bsp.check(c)), len({s["linedef"] for s in c["segs"]}), len(sides), again))
            yield pd.DataFrame(out, columns=["p_partkey", "area", "faults", "classic_faults", "lines", "sides", "again"])

    return steps.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").mapInPandas(run, "p_partkey long, area long, faults int, classic_faults int, lines int, sides int, again boolean")


@register("""SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'MAP01,TEXTMAP,ZNODES,ENDMAP' ELSE 'MAP01,THINGS,LINEDEFS,SIDEDEFS,VERTEXES,SEGS,SSECTORS,NODES,SECTORS,REJECT,BLOCKMAP' END AS lumps, p_partkey % 2 = 0 AS gl, p_partkey % 2 = 1 AS grid FROM part""")
def files_with_nodes(spark, sf_dir):
    """Files of one map each, half of them text maps and half classic groups, with trees put in."""

    def made(pdf_batches):
        import pandas as pd

        for pdf in pdf_batches:
            rows = []
            for k, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                points, lines = _room(size)
                if k % 2 == 0:
                    blocks = [("vertex", {"x": float(x), "y": float(y)}) for x, y in points]
                    blocks += [("linedef", {"v1": ln["start"], "v2": ln["end"], "sidefront": 0, **({"sideback": 0} if ln["left"] == 0 else {})}) for ln in lines]
                    blocks += [("sidedef", {"sector": 0}), ("sector", {"texturefloor": "F", "textureceiling": "F"})]
                    body = [("TEXTMAP", textmap.write("doom", blocks).encode()), ("ENDMAP", b"")]
                else:
                    full = [{**ln, "flags": 0, "special": 0, "tag": 0} for ln in lines]
                    side = {"x_offset": 0, "y_offset": 0, "upper": "-", "lower": "-", "middle": "-", "sector": 0}
                    sector = {"floor": 0, "ceiling": 64, "floor_tex": "F", "ceiling_tex": "F", "light": 160, "special": 0, "tag": 0}
                    blob = {"LINEDEFS": decoders.encode(full, "linedef"), "SIDEDEFS": decoders.encode([side], "sidedef"), "VERTEXES": decoders.encode([{"x": x, "y": y} for x, y in points], "vertex"), "SECTORS": decoders.encode([sector], "sector")}
                    body = [(n, blob.get(n, b"")) for n in directory.MAP_LUMPS[:10]]
                rows += [(f"p{k}", i, n, d) for i, (n, d) in enumerate([("MAP01", b""), *body])]
            yield pd.DataFrame(rows, columns=["path", "lump_idx", "name", "data"])

    lumps = steps.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").mapInPandas(made, "path string, lump_idx int, name string, data binary")
    got = oneshot.with_nodes(lumps)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lump_idx", "name"))), lambda p: p["name"]), ",")
    head = F.decode(F.call_function("substring", F.col("data"), F.lit(1), F.lit(4)), "US-ASCII")
    return got.groupBy("path").agg(names.alias("lumps"), F.max((F.col("name") == "ZNODES") & head.isin("XGLN", "XGL3")).alias("gl"), F.max((F.col("name") == "BLOCKMAP") & (F.octet_length("data") > 8)).alias("grid"))


# ---------------------------------------------------------------- scripts
@register("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT 'p' || k AS path, 'A' || s AS sequence, 0 AS step, 'play' AS command, 'snd' || s AS sound, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM p
  UNION ALL SELECT 'p' || k, 'A' || s, 1, 'delayrand', NULL, 1, s FROM p WHERE k % 3 <> 0 UNION ALL SELECT 'p' || k, 'A' || s, CASE WHEN k % 3 <> 0 THEN 2 ELSE 1 END, 'end', NULL, NULL, NULL FROM p
  UNION ALL SELECT 'p' || k, 'B', 0, 'playtime', 'x', k, NULL FROM p""")
def sound_sequences(spark, sf_dir):
    """Scripts of two sequences with comments, a bad number in some, an unknown command and no end of the second."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    rand = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" delayrand one "), s)).otherwise(F.concat(F.lit(" DelayRand 1 "), s))
    text = F.concat(F.lit("stray\n:A"), s, F.lit(" ; note\n Play snd"), s, F.lit("\n"), rand, F.lit("\n end\n:B // two\n jump\n playtime x "), k, F.lit("\n"))
    lumps = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("path"), text.cast("binary").alias("data"))
    return scripts.sequence_rows(lumps)


@register("""SELECT s_suppkey, 2 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS pairs, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS songs, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS warnings, 'DEFAULT' AS second,
    CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS patches, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS patch_warnings FROM supplier""")
def sound_tables(spark, sf_dir):
    """Sound tables and patch tables with a bad map number, a missing value or a cut line in some."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["s_suppkey"].tolist():
                text = f"$ARCHIVEPATH x\n$map {'one' if k % 3 == 0 else k % 30 + 1} d_e1m1\n$map 0 none\n$other\na b ; c\nd\n?\nlast" + (" one" if k % 2 == 0 else "")
                pairs, songs, w = scripts.sound_table(text, LENIENT)
                gus, w2 = scripts.gus_patches(f"# head\n0, 1, 2, 3, {k}, acpiano\n1, 1, 2, 3" + ("" if k % 4 == 0 else ", 4, brite # x") + "\n\n", LENIENT)
                out.append((k, len(pairs), len(songs), len(w), pairs[1][1], len(gus), len(w2)))
            yield pd.DataFrame(out, columns=["s_suppkey", "pairs", "songs", "warnings", "second", "patches", "patch_warnings"])

    return table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "s_suppkey long, pairs int, songs int, warnings int, second string, patches int, patch_warnings int")


@register("""SELECT 'g' || (s_suppkey % 3) AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'M' || s_suppkey ELSE 'LONGMAP' || s_suppkey END AS map, count(*) * 4 AS blobs FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY s_suppkey""")
def gl_sibling_groups(spark, sf_dir):
    """Files of GL groups: markers by name or by their text, each fifth of them without its nodes."""
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("M"), k.cast("string"))).otherwise(F.concat(F.lit("LONGMAP"), k.cast("string")))
    head = F.struct(F.when(k % 2 == 0, F.concat(F.lit("GL_"), name)).otherwise(F.lit("GL_LEVEL")).alias("name"), F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("BUILDER=x\nLEVEL="), name, F.lit("\r\n"))).cast("binary").alias("data"))
    body = [F.struct(F.lit(n).alias("name"), F.lit(b"").alias("data")) for n in ("GL_VERT", "GL_SEGS", "GL_SSECT", "GL_PVS")]
    last = F.when(k % 5 != 0, F.array(F.struct(F.lit("GL_NODES").alias("name"), F.lit(b"").alias("data")))).otherwise(F.array().cast("array<struct<name:string,data:binary>>"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("g"), (k % 3).cast("string")).alias("path"), k.alias("k"), F.posexplode(F.concat(F.array(head, *body), last)).alias("j", "x"))
    from pyspark.sql import Window as W

    lumps = rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("k", "j")) - 1).alias("lump_idx"), "x.name", "x.data")
    names = table(spark, sf_dir, "supplier").select(name.alias("map"))
    return directory.gl_sibling_groups(lumps, names).groupBy("path", "map").agg(F.count(F.lit(1)).alias("blobs"))


@register("""SELECT l_orderkey, l_linenumber, CAST((round(atan2(v, u) / (2 * pi()) * 65536) + 65536) % 65536 AS INTEGER) AS angle, CAST(round(sqrt(u * u + v * v)) AS INTEGER) AS "offset" FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 41 - 20 AS BIGINT) AS u, CAST(l_linenumber - 3 AS BIGINT) AS v FROM lineitem)""")
def seg_places(spark, sf_dir):
    u, v, zero = F.col("l_partkey") % 41 - 20, F.col("l_linenumber").cast("long") - 3, F.lit(0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.seg_angle(zero, zero, u, v).alias("angle"), S.seg_offset(zero, zero, u, v).alias("offset"))


@register("""SELECT 'r' || n_regionkey AS path, 'MAP' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS map, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 2 END AS nodes, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 3 END AS subsectors, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS warnings FROM nation""")
def bad_trees_dropped(spark, sf_dir):
    """Tree tables of maps, of which each third names a subsector too many: its three tables go together."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.concat(F.lit("MAP"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("map"), (F.col("n_nationkey") % 3 == 0).alias("bad"))
    i = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("idx")
    nodes_ = n.select("path", "map", "bad", i(2)).withColumn("right", F.when(F.col("idx") == 1, 0).otherwise(0x8000)).withColumn("left", F.when(F.col("idx") == 1, F.when(F.col("bad"), 0x8009).otherwise(0x8002)).otherwise(0x8001))
    subs = n.select("path", "map", i(3)).withColumn("seg_count", F.lit(2)).withColumn("first_seg", F.col("idx") * 2)
    segs = n.select("path", "map", i(6))
    t, warnings = maps.drop_bad_trees({"nodes": nodes_.drop("bad"), "subsectors": subs, "segs": segs})
    count = lambda d, c: d.groupBy("path", "map").agg(F.count(F.lit(1)).cast("int").alias(c))
    j = n.select("path", "map").join(count(t["nodes"], "nodes"), ["path", "map"], "left").join(count(t["subsectors"], "subsectors"), ["path", "map"], "left").join(count(warnings, "warnings"), ["path", "map"], "left")
    return j.fillna(0)


@register("""WITH p AS (SELECT p_partkey AS k, p_size AS s, 'P' || p_partkey AS stem FROM part) SELECT stem || '.wav' AS file, CAST(44 + s AS BIGINT) AS size, false AS warned FROM p WHERE k % 5 = 0
  UNION ALL SELECT stem || '.mus', 24, false FROM p WHERE k % 5 = 1 UNION ALL SELECT stem || '.mid', 39, false FROM p WHERE k % 5 = 1 UNION ALL SELECT stem || '.bin', CAST(4 + s AS BIGINT), true FROM p WHERE k % 5 = 2 AND s < 10 UNION ALL SELECT stem || '.mid', CAST(4 + s AS BIGINT), false FROM p WHERE k % 5 = 2 AND s >= 10
  UNION ALL SELECT stem || '.wav', CAST(12 + s AS BIGINT), false FROM p WHERE k % 5 = 3 UNION ALL SELECT stem || '.bin', CAST(s AS BIGINT), false FROM p WHERE k % 5 = 4""")
def extract_outputs(spark, sf_dir):
    """Sounds, scores, cut MIDI files, WAV files and other blobs, written with their conversions."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    sound = raw("0300112B", le(s + 32, 4), F.repeat(F.lit("80"), s + 32))
    score = raw("4D55531A", "0800", "1000", "0100", "0000", "0000", "0000", "90", "BC", "648C20", "00", "3C", "60")
    data = F.when(k % 5 == 0, sound).when(k % 5 == 1, score).when(k % 5 == 2, raw("4D546864", F.repeat(F.lit("00"), s)))
    data = data.when(k % 5 == 3, raw("52494646", "00000000", "57415645", F.repeat(F.lit("00"), s))).otherwise(raw(F.repeat(F.lit("EE"), s)))
    lumps = table(spark, sf_dir, "part").select(F.lit("f").alias("path"), k.alias("lump_idx"), F.concat(F.lit("P"), k.cast("string")).alias("name"), data.alias("data"))
    got = verbs.extract(lumps, midi=True)
    return got.select("file", F.octet_length("data").cast("long").alias("size"), F.col("warning").isNotNull().alias("warned"))
