"""Byte-level round trips: tables written as containers, archives, records and scores, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import bsp, directory
from oreline.options import Options
from oreline.plans.catalogue import register, table
from oreline.sources import archive, audio, decoders, graphics, textmap, wad

_LAYOUT = """SELECT source AS path, CAST(row_number() OVER w - 1 AS INTEGER) AS lump_idx, 'D' || (doc_id % 10000000) AS name,
  CAST(12 + coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filepos,
  CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"""


def _containers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("D"), (F.col("doc_id") % 10_000_000).cast("string")).alias("name"), F.col("text").cast("binary").alias("data"))
    return wad.pack(d, "source", "doc_id").select(F.col("source").alias("path"), "content")


@register(_LAYOUT)
def container_roundtrip(spark, sf_dir):
    got = wad.scan(_containers(spark, sf_dir), Options(strict=True))
    return got.select("path", "lump_idx", "name", "filepos", "size", F.sha2("data", 256).alias("digest"))


@register(_LAYOUT)
def container_native_scan(spark, sf_dir):
    got = wad.scan_native(_containers(spark, sf_dir))
    return got.select("path", "lump_idx", "name", "filepos", "size", F.sha2("data", 256).alias("digest"))


_THINGS = "SELECT l_orderkey AS key, CAST(l_linenumber AS INTEGER) AS n, CAST(l_quantity AS INTEGER) - 25 AS x, CAST(l_suppkey % 30000 AS INTEGER) AS y, CAST(l_partkey % 360 AS INTEGER) AS angle, CAST(l_linenumber AS INTEGER) AS type, CAST(l_orderkey % 65536 AS INTEGER) AS flags FROM lineitem"


def _thing_blobs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_quantity").cast("int") - 25).alias("x"), (F.col("l_suppkey") % 30000).cast("int").alias("y"),
        (F.col("l_partkey") % 360).cast("int").alias("angle"), F.col("l_linenumber").cast("int").alias("type"), (F.col("l_orderkey") % 65536).cast("int").alias("flags"),
    )
    return decoders.pack_native(t, "thing", ["key"], "n")


_THING_SQL = f"SELECT key, x, y, angle, type, flags FROM ({_THINGS})"


@register(_THING_SQL)
def fixed_record_roundtrip(spark, sf_dir):
    return decoders.records(_thing_blobs(spark, sf_dir), "thing", ["key"]).drop("idx")


@register(_THING_SQL)
def fixed_record_native(spark, sf_dir):
    return decoders.records_native(_thing_blobs(spark, sf_dir), "thing", ["key"]).drop("idx")


@register("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'midi' WHEN 1 THEN 'wav' WHEN 2 THEN 'mus' WHEN 3 THEN 'dmx' WHEN 4 THEN 'pc_speaker' ELSE 'unknown' END AS kind FROM documents")
def audio_kinds(spark, sf_dir):
    k = F.col("doc_id") % 6
    b = lambda h: F.unhex(F.lit(h))
    blob = (F.when(k == 0, b("4D546864000000060000000100460000")).when(k == 1, b("524946462400000057415645666D7420")).when(k == 2, b("4D55531A00000000"))
            .when(k == 3, b("0300112B20000000" + "80" * 32)).when(k == 4, b("00000200" + "1011")).otherwise(b("0102030405")))
    return table(spark, sf_dir, "documents").select("doc_id", audio.kind_column(blob).alias("kind"))


@register("SELECT source AS path, count(*) AS members, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE doc_id % 4 = 0) AS stored FROM documents GROUP BY source")
def archive_roundtrip(spark, sf_dir):
    """Documents zipped by source, listed and inflated again."""

    def zipped(pdf):
        import io
        import zipfile

        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                z.writestr(zipfile.ZipInfo(f"textures/d{i}.txt"), text.encode(), zipfile.ZIP_STORED if i % 4 == 0 else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [pdf["source"].iloc[0]], "content": [out.getvalue()]})

    files = table(spark, sf_dir, "documents").select("source", "doc_id", "text").groupBy("source").applyInPandas(zipped, "path string, content binary")
    m = archive.scan(files, Options(strict=True)).where("error is null and namespace = 'Textures'")
    return m.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("data")).alias("bytes"), F.count_if(F.col("method") == "stored").alias("stored"))


def section_lumps(spark, sf_dir):
    """Markers around each language's documents in each source, as a directory."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "lang", "doc_id")
    letters = {"en": "S", "de": "F", "fr": "P", "es": "T"}
    mark = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])[F.col("lang")]
    ends = d.select("path", "lang").distinct()
    rows = d.select("path", "lang", F.lit(1).alias("k"), "doc_id", F.concat(F.lit("L"), (F.col("doc_id") % 9_999_999).cast("string")).alias("name"))
    rows = rows.union(ends.select("path", "lang", F.lit(0), F.lit(0), F.concat(mark, F.lit("_START")))).union(ends.select("path", "lang", F.lit(2), F.lit(0), F.concat(mark, F.lit("_END"))))
    from pyspark.sql import Window as W

    rows = rows.withColumn("lump_idx", F.row_number().over(W.partitionBy("path").orderBy("lang", "k", "doc_id")) - 1)
    return rows.select("path", "lump_idx", "name")


@register("""WITH l AS (SELECT source AS path, lang, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT *, sum(n + 2) OVER (PARTITION BY path ORDER BY lang ROWS UNBOUNDED PRECEDING) AS e FROM l)
  SELECT path, CASE lang WHEN 'en' THEN 'sprites' WHEN 'de' THEN 'flats' WHEN 'fr' THEN 'patches' ELSE 'textures' END AS kind, CAST(e - n - 2 AS INTEGER) AS first, CAST(e - 1 AS INTEGER) AS last, CAST(n AS INTEGER) AS n FROM o""")
def section_scan(spark, sf_dir):
    """The sections of :func:`section_lumps`."""
    return directory.section_rows(section_lumps(spark, sf_dir)).select("path", "kind", "first", "last", F.size("names").alias("n"))


@register("SELECT n_regionkey AS region, CAST(n_nationkey AS DOUBLE) AS x, n_nationkey / 4.0 AS y FROM nation")
def udmf_parse(spark, sf_dir):
    """Text maps written from nations and read back."""

    def run(pdf):
        import pandas as pd

        blocks = [("vertex", {"x": float(k), "y": k / 4}) for k in pdf["n_nationkey"].tolist()]
        got = textmap.parse(textmap.write("doom", blocks))
        return pd.DataFrame({"region": [int(pdf["n_regionkey"].iloc[0])] * len(blocks), "x": [b["x"] for _, b in got["blocks"]], "y": [b["y"] for _, b in got["blocks"]]})

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(run, "region int, x double, y double")


@register("""WITH g AS (SELECT p_partkey, p_size AS s, p_size % 12 AS x0, least(8, 16 - p_size % 12) AS w0, p_size % 5 AS x1, p_size % 7 AS y1 FROM part),
  o AS (SELECT *, greatest(0, least(x0 + w0, x1 + 4) - greatest(x0, x1)) AS ox, greatest(0, least(10, y1 + 4) - greatest(2, y1)) AS oy FROM g)
  SELECT p_partkey, CAST(w0 * 8 + 16 - ox * oy AS INTEGER) AS opaque, CAST(16 - (w0 + 4 - ox) AS INTEGER) AS empty_columns, CAST(255 * 16 + s * (w0 * 8 - ox * oy) AS BIGINT) AS total FROM o""")
def texture_compose(spark, sf_dir):
    """Textures of two flat patches each, composed: opaque pixels and empty columns."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for k, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                p = {0: graphics.Image(np.full((8, 8), size, np.uint8), np.ones((8, 8), bool)), 1: graphics.Image(np.full((4, 4), 255, np.uint8), np.ones((4, 4), bool))}
                img, empty = graphics.compose({"name": "T", "width": 16, "height": 16, "patches": [(size % 12, 2, 0), (size % 5, size % 7, 1)]}, p)
                out.append((k, int(img.opaque.sum()), len(empty), int(img.pixels.sum())))
            yield pd.DataFrame(out, columns=["p_partkey", "opaque", "empty_columns", "total"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, opaque int, empty_columns int, total long")


@register()
def bsp_build(spark, sf_dir):
    """Trees for polygons of lines: the parts of a brand in the order of their keys, at most 64 to a polygon. A polygon's
    keys lie in one range of 1,600, so a brand is not one task."""

    def run(pdf):
        import math

        import numpy as np
        import pandas as pd

        out, pdf = [], pdf.sort_values(["p_partkey", "p_size"])
        for rows in np.array_split(np.arange(len(pdf)), -(-len(pdf) // 64)):
            part = pdf.iloc[rows]
            n = max(3, len(part))
            points = [(round(500 * math.cos(2 * math.pi * i / n)) + int(part["p_size"].iloc[i % len(part)]), round(500 * math.sin(2 * math.pi * i / n))) for i in range(n)]
            lines = [{"start": i, "end": (i + 1) % n, "right": 0, "left": 0xFFFF} for i in range(n)] + [{"start": 0, "end": n // 2, "right": 0, "left": 0}]
            tree = bsp.build(points, lines)
            out.append((part["p_brand"].iloc[0], part["p_partkey"].iloc[0], len(part), len(tree["segs"]), len(tree["subsectors"]), len(tree["nodes"]), len(bsp.check(tree))))
        return pd.DataFrame(out, columns=["brand", "first_part", "parts", "segs", "leaves", "nodes", "faults"])

    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    block = F.floor(F.col("p_partkey") / 1_600).alias("block")
    return p.groupBy("p_brand", block).applyInPandas(run, "brand string, first_part long, parts int, segs int, leaves int, nodes int, faults int")
