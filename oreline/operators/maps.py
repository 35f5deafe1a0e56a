"""Maps as linked tables: normalised records, resolved references, REJECT and BLOCKMAP, and their inverses."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.operators import directory, grid
from oreline.options import FormatError, Options, Report
from oreline.sources import decoders as D
from oreline.sources.wad import _arrow

NONE = 0xFFFF
KEYS = ["path", "map"]


def tables(lumps: DataFrame, options: Options = Options(strict=False), groups: DataFrame | None = None) -> dict[str, DataFrame]:
    """Record tables of all classic and Hexen maps in ``lumps`` (path, lump_idx, name, data): things, linedefs, … ``groups``: their
    map groups, where they are at hand."""
    g = (directory.group_rows(lumps) if groups is None else groups).join(lumps.select("path", "lump_idx", "data"), ["path", "lump_idx"])
    out = {}
    for lump, record in D.TABLES.items():
        mine = g.where((F.col("name") == lump) & (F.col("format") != "udmf"))
        if D.HEXEN_TABLES[lump] == record:
            out[record + "s"] = D.records(mine, record, KEYS, options=options)
        else:
            classic = D.records(mine.where("format = 'doom'"), record, KEYS, options=options)
            hexen = D.records(mine.where("format = 'hexen'"), D.HEXEN_TABLES[lump], KEYS, options=options)
            out[record + "s"] = normalize(record, classic, hexen)
    return out


def normalize(record: str, classic: DataFrame, hexen: DataFrame) -> DataFrame:
    """One shape for both formats: a classic line's tag is its first argument, Hexen thing flags are remapped."""
    args = [F.lit(0).alias(f"arg{i}") for i in range(5)]
    if record == "thing":
        a = classic.select(*KEYS, "idx", F.lit(0).alias("tid"), "x", "y", F.lit(0).alias("z"), "angle", "type", "flags", F.lit(0).alias("special"), *args)
        b = hexen.withColumn("flags", S.hexen_thing_flags(F.col("flags")))
    else:
        a = classic.select(*KEYS, "idx", "start", "end", "flags", "special", F.col("tag").alias("arg0"), *args[1:], "right", "left")
        b = hexen
    return a.unionByName(b.select(*a.columns))


def resolve_lines(t: dict[str, DataFrame]) -> DataFrame:
    """Lines with their ends and sides resolved: a missing end is 0, a missing side null, each with a warning row's
    text in ``warnings``; 65535 means there is no side."""
    lines = t["linedefs"]
    for ref, target, required in (("start", "vertexs", True), ("end", "vertexs", True), ("right", "sidedefs", False), ("left", "sidedefs", False)):
        known = t[target].select(*KEYS, F.col("idx").alias(f"__{ref}"))
        want = F.col(ref) if required else F.nullif(F.col(ref), F.lit(NONE))
        lines = lines.withColumn("__want", want).join(known.withColumnRenamed(f"__{ref}", "__k").withColumn("__want", F.col("__k")), [*KEYS, "__want"], "left")
        miss = F.col("__want").isNotNull() & F.col("__k").isNull()
        lines = lines.withColumn(f"__w_{ref}", F.when(miss, F.lit(f"{ref} out of range")))
        lines = lines.withColumn(ref, F.coalesce("__k", F.lit(0)) if required else F.col("__k")).drop("__want", "__k")
    warn = F.array_compact(F.array(*[F.col(f"__w_{r}") for r in ("start", "end", "right", "left")]))
    return lines.withColumn("warnings", warn).drop(*[f"__w_{r}" for r in ("start", "end", "right", "left")])


def line_sectors(lines: DataFrame, sides: DataFrame) -> DataFrame:
    """Each line with the sectors in front of and behind it."""
    side = lambda c: sides.select(*KEYS, F.col("idx").alias(c), F.col("sector").alias(f"{c}_sector"))
    return lines.join(side("right"), [*KEYS, "right"], "left").join(side("left"), [*KEYS, "left"], "left")


def subsector_segs(subsectors: DataFrame, segs: DataFrame) -> DataFrame:
    """Segs of each subsector: the half-open range from its first seg, expanded and joined by number."""
    s = subsectors.where("seg_count > 0").select(*KEYS, F.col("idx").alias("subsector"), F.explode(F.sequence(F.col("first_seg"), F.col("first_seg") + F.col("seg_count") - 1)).alias("idx"))
    return s.join(segs, [*KEYS, "idx"])


def node_children(nodes: DataFrame) -> DataFrame:
    """Children of each node; the high bit tells a subsector from a node."""
    sides = F.explode(F.array(F.struct(F.lit("right").alias("side"), F.col("right").alias("v")), F.struct(F.lit("left").alias("side"), F.col("left").alias("v"))))
    c = nodes.select(*KEYS, F.col("idx").alias("node"), sides.alias("c"))
    leaf = F.col("c.v").bitwiseAND(0x8000) != 0
    return c.select(*KEYS, "node", "c.side", F.when(leaf, "subsector").otherwise("node").alias("kind"), F.col("c.v").bitwiseAND(0x7FFF).alias("child"))


def bsp_state(nodes: DataFrame, subsectors: DataFrame, segs: DataFrame) -> DataFrame:
    """For each map whether its tree can be used: one leaf more than nodes, children and segs in range. Lenient assembly
    drops all three tables of a map that fails."""
    n = nodes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("nodes"))
    s = subsectors.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("leaves"), F.max(F.col("first_seg") + F.col("seg_count")).alias("reach"))
    g = segs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("segs"))
    c = node_children(nodes).groupBy(*KEYS).agg(F.max(F.when(F.col("kind") == "node", F.col("child"))).alias("top_node"), F.max(F.when(F.col("kind") == "subsector", F.col("child"))).alias("top_leaf"))
    j = s.join(n, KEYS, "left").join(g, KEYS, "left").join(c, KEYS, "left").fillna(0, ["nodes", "segs"])
    ok = (F.col("nodes") == F.col("leaves") - 1) & (F.col("reach") <= F.col("segs")) & (F.coalesce("top_node", F.lit(-1)) < F.greatest("nodes", F.lit(1))) & (F.coalesce("top_leaf", F.lit(-1)) < F.col("leaves"))
    return j.select(*KEYS, ok.alias("usable"), (F.col("nodes") - 1).alias("root"))


def drop_bad_trees(t: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, warnings): the three tree tables of a map go together if its tree cannot be used; the map stays, with one warning."""
    state = bsp_state(t["nodes"], t["subsectors"], t["segs"])
    bad = state.where(~F.col("usable")).select(*KEYS)
    kept = {n: t[n].join(bad, KEYS, "left_anti") for n in ("nodes", "subsectors", "segs")}
    return t | kept, bad.withColumn("warning", F.lit("tree dropped"))


# ---------------------------------------------------------------- REJECT and BLOCKMAP
def reject(data: bytes, sectors: int, options: Options = Options()) -> bytes | None:
    """The bit matrix, padded with zeros where the blob is short; None where there is none."""
    need = -(-sectors * sectors // 8)
    if not data:
        return None
    if len(data) < need:
        Report(options)("reject_short", f"{len(data)} of {need}")
    return data[:need].ljust(need, b"\0")


def blockmap(data: bytes, lines: int | None = None, options: Options = Options()) -> dict | None:
    """Origin, size, and the line numbers of each cell. In lenient mode anything odd means there is none."""
    if not data:
        return None
    say = Report(options)
    w = np.frombuffer(data, "<u2", len(data) // 2)
    if len(w) < 4:
        say("blockmap_header")
        return None
    ox, oy = np.frombuffer(data, "<i2", 2).tolist()
    cols, rows = w[2:4].tolist()
    if 4 + cols * rows > len(w):
        say("blockmap_table")
        return None
    stops = np.flatnonzero(w == 0xFFFF)
    cells = []
    for at in w[4 : 4 + cols * rows].tolist():
        i = np.searchsorted(stops, at)
        if at < 4 + cols * rows or i == len(stops):
            say("blockmap_list", str(at))
            return None
        ids = w[at : stops[i]].tolist()
        ids = ids[1:] if ids and ids[0] == 0 else ids
        if lines is not None and any(x >= lines for x in ids):
            say("blockmap_line", str(at))
            return None
        cells.append(ids)
    return {"origin": (ox, oy), "cols": cols, "rows": rows, "cells": cells}


def blockmap_bytes(origin: tuple[int, int], cols: int, rows: int, cells: list[list[int]], options: Options = Options()) -> bytes:
    """Serialised cells; equal lists are stored once. Offsets beyond 32767 words exceed old readers, beyond 65535 all."""
    body: list[int] = []
    known: dict[tuple, int] = {}
    table = []
    for ids in cells:
        key = tuple(ids)
        if key not in known:
            known[key] = 4 + cols * rows + len(body)
            body += [0, *ids, 0xFFFF]
        table.append(known[key])
    top = max(table, default=0)
    if top > 0xFFFF:
        raise FormatError("blockmap_too_large", str(top))
    if top > 0x7FFF:
        Report(options)("blockmap_beyond_vanilla", str(top))
    return struct.pack("<hhHH", *origin, cols, rows) + np.array([*table, *body], "<u2").tobytes()


def build_blockmaps(lines: DataFrame, vertexes: DataFrame) -> DataFrame:
    """path, map, data of a BLOCKMAP for every map, from all lines' cells; a map's lists meet in one row."""
    v = lambda c, n: vertexes.select(*KEYS, F.col("idx").alias(c), F.col("x").cast("long").alias(f"x{n}"), F.col("y").cast("long").alias(f"y{n}"))
    seg = lines.select(*KEYS, "idx", "start", "end").join(v("start", 1), [*KEYS, "start"]).join(v("end", 2), [*KEYS, "end"])
    w = W.partitionBy(*KEYS)
    seg = seg.withColumns({"ox": F.min(F.least("x1", "x2")).over(w), "oy": F.min(F.least("y1", "y2")).over(w)})
    seg = seg.select(*KEYS, F.struct(*KEYS, "idx", "ox", "oy").alias("key"), *[(F.col(f"{a}{i}") - F.col(f"o{a}")).alias(f"{a}{i}") for a in "xy" for i in (1, 2)])
    cells = grid.cells(seg.select("key", "x1", "y1", "x2", "y2"), "key").select("id.*", "col", "row")

    kind = "path string, map string, data binary"
    schema = _arrow(kind)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                out = []
                for path, name, ox, oy, ids in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns), strict=True):
                    cols, rows = max(r["col"] for r in ids) + 1, max(r["row"] for r in ids) + 1
                    lists: list[list[int]] = [[] for _ in range(cols * rows)]
                    for r in ids:
                        lists[r["row"] * cols + r["col"]].append(r["idx"])
                    out.append((path, name, blockmap_bytes((ox, oy), cols, rows, lists, Options(strict=False))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ids = F.array_sort(F.collect_list(F.struct("idx", "col", "row"))).alias("ids")
    return cells.groupBy(*KEYS).agg(F.min("ox").alias("ox"), F.min("oy").alias("oy"), ids).mapInArrow(run, kind)


def to_textmap(things, lines, sides, sectors, vertexes, namespace: str = "doom") -> str:
    """A text map of decoded records (lists of dicts)."""
    from oreline.sources import textmap as X

    flags = lambda f: {n: True for i, n in enumerate(X.LINE_FLAGS) if f >> i & 1}
    blocks = [("vertex", {"x": float(v["x"]), "y": float(v["y"])}) for v in vertexes]
    for ln in lines:
        side = {"sidefront": ln["right"]} | ({} if ln["left"] == NONE else {"sideback": ln["left"]})
        blocks.append(("linedef", {"v1": ln["start"], "v2": ln["end"], **side, "special": ln["special"], "arg0": ln.get("arg0", ln.get("tag", 0)), **flags(ln["flags"])}))
    for s in sides:
        blocks.append(("sidedef", {"sector": s["sector"], "offsetx": s["x_offset"], "offsety": s["y_offset"], "texturetop": s["upper"], "texturebottom": s["lower"], "texturemiddle": s["middle"]}))
    for s in sectors:
        blocks.append(("sector", {"texturefloor": s["floor_tex"], "textureceiling": s["ceiling_tex"], "heightfloor": s["floor"], "heightceiling": s["ceiling"], "lightlevel": s["light"], "special": s["special"], "id": s["tag"]}))
    for t in things:
        f = t["flags"]
        names = {n: True for n, on in (("skill1", f & 1), ("skill2", f & 1), ("skill3", f & 2), ("skill4", f & 4), ("skill5", f & 4), ("ambush", f & 8), ("single", not f & 16), ("dm", not f & 32), ("coop", not f & 64)) if on}
        blocks.append(("thing", {"x": float(t["x"]), "y": float(t["y"]), "type": t["type"], "angle": t["angle"], **names}))
    return X.write(namespace, blocks)
