"""Bit matrices, ranges and cell grids of maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreline.operators import maps, verbs
from oreline.operators import grid as G
from oreline.plans.catalogue import register, table
from oreline.sources import nodes
from oreline.sources import audio as A
from oreline.sources import decoders as D


@register("SELECT o_orderkey, CAST(unnest(generate_series(o_custkey, o_custkey + o_orderkey % 4 - 1)) AS BIGINT) AS seg FROM orders WHERE o_orderkey % 4 > 0")
def range_expand(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").withColumn("n", F.col("o_orderkey") % 4)
    return o.select("o_orderkey", F.explode(F.sequence(F.col("o_custkey"), F.col("o_custkey") + F.col("n") - 1)).alias("seg"))


@register("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_nationkey * 25 + b.n_nationkey) % 3 = 0 AS rejected FROM nation a, nation b""")
def reject_lookup(spark, sf_dir):
    """The matrix is packed into bytes, least bit first, and read back bit by bit."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    bits = n.select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("b"), "k").select((F.col("k") * 25 + F.col("b")).alias("bit"))
    matrix = G.pack_bits(bits.select("bit", (F.col("bit") % 3 == 0).alias("set")), 625)
    pairs = n.select(F.col("k").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("b"))
    return pairs.join(matrix).select("a", "b", G.bit_at(F.col("matrix"), F.col("a") * 25 + F.col("b")).alias("rejected"))


_LINES = "SELECT p_partkey AS id, CAST(p_partkey * 37 % 2000 AS BIGINT) AS x1, CAST(p_partkey * 91 % 1500 AS BIGINT) AS y1, CAST((p_partkey * 37 + p_size * 11) % 2000 AS BIGINT) AS x2, CAST((p_partkey * 91 + p_size * 7) % 1500 AS BIGINT) AS y2 FROM part"


@register(f"""WITH l AS ({_LINES}), o AS (SELECT min(least(x1, x2)) AS ox, min(least(y1, y2)) AS oy FROM l),
  r AS (SELECT id, x1 - ox AS x1, y1 - oy AS y1, x2 - ox AS x2, y2 - oy AS y2 FROM l, o),
  c AS (SELECT id, x1, y1, x2, y2, unnest(generate_series(greatest((least(x1, x2) - 1) >> 7, 0), greatest(x1, x2) >> 7)) AS col FROM r),
  d AS (SELECT *, unnest(generate_series(greatest((least(y1, y2) - 1) >> 7, 0), greatest(y1, y2) >> 7)) AS row FROM c),
  s AS (SELECT *, (x2 - x1) * (row * 128 - y1) - (y2 - y1) * (col * 128 - x1) AS c1, (x2 - x1) * (row * 128 - y1) - (y2 - y1) * (col * 128 + 128 - x1) AS c2,
    (x2 - x1) * (row * 128 + 128 - y1) - (y2 - y1) * (col * 128 - x1) AS c3, (x2 - x1) * (row * 128 + 128 - y1) - (y2 - y1) * (col * 128 + 128 - x1) AS c4 FROM d)
  SELECT CAST(col AS BIGINT) AS col, CAST(row AS BIGINT) AS row, count(*) AS n, min(id) AS first, max(id) AS last FROM s
  WHERE least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0 GROUP BY 1, 2""")
def blockmap_cells(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    lines = table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 2000).alias("x1"), (k * 91 % 1500).alias("y1"), ((k * 37 + s * 11) % 2000).alias("x2"), ((k * 91 + s * 7) % 1500).alias("y2"))
    cells = G.cells(lines, "id")
    return cells.groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


# ---------------------------------------------------------------- references of a map's tables
_MAP = "'f' || (c % 5) AS path, 'M' || c AS map"
_L = "l AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def _tables(spark, sf_dir):
    """A map for each customer: a line, a point and a side for each order, some with references beyond the tables' ends."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("i"), F.count(F.lit(1)).over(w).cast("int").alias("n"))
    o = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("path"), F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("map"), F.col("o_orderkey").alias("k"), (F.col("i") - 1).alias("idx"), "n")
    k = F.col("k")
    lines = o.select("path", "map", "idx", F.col("idx").alias("start"), F.when(k % 11 == 0, 60_000).otherwise(F.lit(0)).alias("end"), F.when(k % 3 == 0, 65_535).otherwise(F.col("idx")).alias("right"), F.when(k % 4 == 0, 65_535).when(k % 7 == 0, 50_000).otherwise(0).alias("left"))
    return {"linedefs": lines, "vertexs": o.select("path", "map", "idx"), "sidedefs": o.select("path", "map", "idx", (k % 9).cast("int").alias("sector"))}


@register(f"""WITH {_L} SELECT {_MAP}, CAST(i AS INTEGER) AS idx, CAST(i AS INTEGER) AS start, 0 AS "end", CASE WHEN k % 3 <> 0 THEN CAST(i AS INTEGER) END AS "right", CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN 0 END AS "left",
    CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 <> 0 AND k % 7 = 0 THEN 1 ELSE 0 END AS warnings FROM l""")
def line_references(spark, sf_dir):
    got = maps.resolve_lines(_tables(spark, sf_dir))
    return got.select("path", "map", "idx", "start", "end", "right", "left", F.size("warnings").alias("warnings"))


@register(f"""WITH {_L}, z AS (SELECT c, min_by(k, i) % 9 AS s0 FROM l GROUP BY c) SELECT {_MAP.replace('c %', 'l.c %').replace('|| c', '|| l.c')}, CAST(i AS INTEGER) AS idx, CASE WHEN k % 3 <> 0 THEN CAST(k % 9 AS INTEGER) END AS right_sector, CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN CAST(s0 AS INTEGER) END AS left_sector FROM l JOIN z USING (c)""")
def line_sectors(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return maps.line_sectors(maps.resolve_lines(t), t["sidedefs"]).select("path", "map", "idx", "right_sector", "left_sector")


@register("SELECT CAST(c_custkey AS VARCHAR) AS map, side, CASE WHEN v >= 32768 THEN 'subsector' ELSE 'node' END AS kind, CAST(v % 32768 AS INTEGER) AS child FROM (SELECT c_custkey, 'right' AS side, c_custkey * 31 % 65536 AS v FROM customer UNION ALL SELECT c_custkey, 'left', (c_custkey * 32771) % 65536 FROM customer)")
def tagged_children(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(F.lit("p").alias("path"), k.cast("string").alias("map"), F.lit(0).alias("idx"), (k * 31 % 65_536).cast("int").alias("right"), (k * 32_771 % 65_536).cast("int").alias("left"))
    return maps.node_children(n).select("map", "side", "kind", "child")


@register(f"""WITH {_L}, s AS (SELECT c, i AS subsector, unnest(generate_series(i, i + k % 3 - 1)) AS g FROM l WHERE k % 3 > 0) SELECT {_MAP.replace('c %', 's.c %').replace('|| c', '|| s.c')}, CAST(subsector AS INTEGER) AS subsector, CAST(g AS INTEGER) AS idx, l.k AS seg FROM s JOIN l ON l.c = s.c AND l.i = s.g""")
def subsector_segs(spark, sf_dir):
    """Half-open ranges of segs, some reaching beyond the last one."""
    t = _tables(spark, sf_dir)["linedefs"].select("path", "map", "idx")
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window as W

    keyed = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("path"), F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("map"), F.col("o_orderkey").alias("seg"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("idx"))
    segs = t.join(keyed, ["path", "map", "idx"])
    subs = segs.select("path", "map", "idx", (F.col("seg") % 3).cast("int").alias("seg_count"), F.col("idx").alias("first_seg"))
    return maps.subsector_segs(subs, segs).select("path", "map", "subsector", "idx", "seg")


@register("SELECT 'r' || n_regionkey AS path, count(*) AS names, min('N' || n_nationkey) AS least FROM nation GROUP BY 1")
def texture_hashes(spark, sf_dir):
    """Names between texture markers by their 16-bit hash; a name that stands twice counts once."""
    k = F.col("n_nationkey").cast("string")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_nationkey").alias("k"), F.concat(F.lit("N"), k).alias("name"))
    ends = n.select("path").distinct()
    rows = n.select("path", F.lit(1).alias("o"), "k", "name").union(n.select("path", F.lit(2), "k", "name")).union(ends.select("path", F.lit(0), F.lit(0), F.lit("T_START"))).union(ends.select("path", F.lit(3), F.lit(0), F.lit("T_END")))
    from pyspark.sql import Window as W

    lumps = rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("o", "k")) - 1).alias("lump_idx"), "name")
    return verbs.hashed_names(lumps).groupBy("path").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("least"))


# ---------------------------------------------------------------- bytes that only Python reads
@register("""SELECT p_partkey, CAST(least(p_size % 3, (p_size * p_size + 7) // 8) AS INTEGER) AS reject_short, CAST((p_size * p_size + 7) // 8 AS BIGINT) AS reject_bytes, 70000 + p_size AS deep_start, true AS deep_leaf, p_size / 65536.0 AS gl_x, p_size AS gl_line, CAST(p_size % 4 + 1 AS INTEGER) AS tracks, 8 + p_size AS wav_data, 'I' || p_size AS instrument, p_size % 2 = 1 AS fixed,
    'hello ' || p_size AS said, p_partkey % 2 = 0 AS retail FROM part""")
def odd_blobs(spark, sf_dir):
    """Bit matrices cut short, 32-bit and GL trees, MIDI tracks, WAV chunks, an instrument bank and conversations, from each part."""

    def run(batches):
        import struct

        import pandas as pd

        from oreline.options import Options

        for pdf in batches:
            out = []
            for k, s in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                need = -(-s * s // 8)
                short = min(s % 3, need)
                matrix = maps.reject(bytes(need - short) or b"\0", s, Options(strict=False))
                node = struct.pack("<12h", 1, 2, 3, 4, *range(8))
                deep = nodes.deep(struct.pack("<iiHHhH", 70_000 + s, 1, 2, 3, 1, 4), struct.pack("<Hi", 1, 0), b"xNd4\0\0\0\0" + node + struct.pack("<II", 1 << 31, 0))
                gl = nodes.gl(b"gNd5" + struct.pack("<ii", s, 0), struct.pack("<IIHHI", 1 << 31, 1, s, 0, 0xFFFFFFFF), struct.pack("<II", 1, 0), node + struct.pack("<II", 1 << 31, 1))
                tracks = s % 4 + 1
                midi = A.midi_index(struct.pack(">4sIHHH", b"MThd", 6, 1, tracks, 96) + struct.pack(">4sI", b"MTrk", 3) .join([b""] + [b"abc"] * tracks))
                chunks = A.wav_chunks(A.wav(11_025, bytes(8 + s)))
                one = struct.pack("<HBB", s % 2, 0, 60) + bytes(32)
                bank = A.instrument_bank(b"#OPL_II#" + one * 175 + f"I{s}".encode().ljust(32, b"\0") * 175)
                text = f"hello {s}".encode()
                page = struct.pack("<6i", 1, 2, 0, 0, 0, 0) + b"Al".ljust(16, b"\0") + bytes(16) + text.ljust(320, b"\0") if k % 2 == 0 else struct.pack("<i", 1) + b"Al".ljust(16, b"\0") + bytes(8) + text.ljust(320, b"\0")
                talk = D.dialogue(page.ljust(1516 if k % 2 == 0 else 1488, b"\0"))[0]
                out.append((k, short, len(matrix), deep["segs"][0]["start"], deep["nodes"][0]["right_leaf"], gl["vertexes"][0][0], gl["segs"][0]["linedef"], len(midi["tracks"]), chunks[1][2], bank[174]["name"], bank[0]["fixed"], talk["text"], talk["drop"] == 2))
            yield pd.DataFrame(out, columns=["p_partkey", "reject_short", "reject_bytes", "deep_start", "deep_leaf", "gl_x", "gl_line", "tracks", "wav_data", "instrument", "fixed", "said", "retail"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, reject_short int, reject_bytes long, deep_start int, deep_leaf boolean, gl_x double, gl_line int, tracks int, wav_data int, instrument string, fixed boolean, said string, retail boolean")
