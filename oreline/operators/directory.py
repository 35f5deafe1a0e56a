"""What the order of a directory means: sections between markers, and map groups.

Order is the meaning, and a directory is at most one file, so each file's directory is walked by one call; parallelism is
across files.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreline.options import FormatError, Options, Report
from oreline.sources.wad import _arrow

# Marker letters and what stands between them; blobs of a map, in order; trailers that belong to nothing.
SECTIONS = {"S": "sprites", "F": "flats", "P": "patches", "T": "textures", "G": "graphics", "DS": "sounds", "DM": "music"}
DOUBLED = {"FF": "F", "PP": "P", "SS": "S"}
MAP_LUMPS = ["THINGS", "LINEDEFS", "SIDEDEFS", "VERTEXES", "SEGS", "SSECTORS", "NODES", "SECTORS", "REJECT", "BLOCKMAP", "BEHAVIOR", "SCRIPTS", "LEAFS", "LIGHTS", "MACROS", "TEXTMAP", "ZNODES", "DIALOGUE", "ENDMAP"]
TRAILERS = ["CHECKSUM", "ENDOFWAD"]
SECTION_ROW = "kind string, sub string, first int, last int, names array<string>"


def _marker(name: str) -> tuple[str, str, str] | None:
    """(letters, number of a sub-section or '', START or END)."""
    m = re.fullmatch(r"([A-Z]+)(\d?)_(START|END)", name)
    if not m:
        return None
    letters = DOUBLED.get(m[1], m[1])
    return (letters, m[2], m[3]) if letters in SECTIONS else None


def sections(names: list[str], options: Options = Options(strict=False)) -> tuple[list[dict], list[str]]:
    """Sections of a directory: blobs between a START marker and the nearest END of its kind; a numbered marker
    opens a part of the section around it. A START without END ends with the directory or where the next section begins."""
    say = Report(options)
    out: list[dict] = []
    open_: list[list] = []  # kind, sub, index of the marker

    def close(top: list, end: int) -> None:
        inside = [i for i in range(top[2] + 1, end) if _marker(names[i]) is None]
        out.append({"kind": SECTIONS[top[0]], "sub": top[1], "first": top[2], "last": end, "names": [names[i] for i in inside]})

    for i, name in enumerate(names):
        m = _marker(name)
        if m is None or name in TRAILERS:
            continue
        letters, sub, what = m
        if what == "START":
            if sub and not any(o[0] == letters and not o[1] for o in open_):
                say("sub_section_alone", name)
            elif not sub and open_:
                say("section_inside", name)
                while open_:
                    close(open_.pop(), i)
            open_.append([letters, sub, i])
        else:
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][:2] == [letters, sub]), None)
            if at is None:
                say("end_without_start", name)
                continue
            while len(open_) > at + 1:
                say("part_not_ended", names[open_[-1][2]])
                close(open_.pop(), i)
            close(open_.pop(), i)
    while open_:
        say("start_without_end", names[open_[-1][2]])
        close(open_.pop(), len(names))
    return sorted(out, key=lambda s: (s["first"], s["last"])), say.warnings


def map_groups(names: list[str]) -> list[tuple[str, int, int]]:
    """(map, index of its marker, end) of every run of map blobs that follows a marker, from left to right. A text map
    runs to its ENDMAP, else to just before the marker of the next text map, else to the end."""
    data, out, i = set(MAP_LUMPS), [], 0
    while i + 1 < len(names):
        nxt = names[i + 1]
        if nxt == "TEXTMAP":
            stop = next((j for j in range(i + 2, len(names)) if names[j] in ("ENDMAP", "TEXTMAP")), None)
            end = len(names) if stop is None else stop + 1 if names[stop] == "ENDMAP" else stop - 1
        elif nxt in data:
            end = i + 1
            while end < len(names) and names[end] in data:
                end += 1
        else:
            i += 1
            continue
        out.append((names[i], i, end))
        i = max(end, i + 1)
    return out


def map_format(inside: list[str], marker_is_container: bool = False) -> str:
    """doom64, udmf, hexen or doom."""
    return "doom64" if marker_is_container else "udmf" if "TEXTMAP" in inside else "hexen" if "BEHAVIOR" in inside else "doom"


def section_rows(lumps: DataFrame, options: Options = Options(strict=False)) -> DataFrame:
    """Sections of every file in ``lumps`` (path, lump_idx, name)."""
    schema = _arrow(f"path string, {SECTION_ROW}")

    def run(batches):
        for b in batches:
            for path, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path, s["kind"], s["sub"], s["first"], s["last"], s["names"]) for s in sections(names, options)[0]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _directories(lumps).mapInArrow(run, f"path string, {SECTION_ROW}")


def group_rows(lumps: DataFrame) -> DataFrame:
    """Blobs of every map group: path, map, marker, part (place in the group), lump_idx, name, format."""
    out = "path string, map string, marker int, part int, lump_idx int, name string, format string"
    schema = _arrow(out)

    def run(batches):
        for b in batches:
            for path, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path, m, at, j - at - 1, j, names[j], map_format(names[at + 1 : end])) for m, at, end in map_groups(names) for j in range(at + 1, end)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _directories(lumps).mapInArrow(run, out)


def _directories(lumps: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("lump_idx", "name")))
    return lumps.groupBy("path").agg(F.transform(pairs, lambda p: p["name"]).alias("names")).select("path", "names")


def gl_groups(lumps: DataFrame, groups: DataFrame) -> DataFrame:
    """For each map, the run of GL_* blobs that follows it before the next map: path, map, lump_idx, name."""
    span = groups.groupBy("path", "map", "marker").agg((F.max("lump_idx") + 1).alias("from"))
    span = span.withColumn("until", F.coalesce(F.lead("marker").over(W.partitionBy("path").orderBy("marker")), F.lit(2**31 - 1)))
    j = lumps.select("path", "lump_idx", "name").join(span, "path").where("lump_idx >= `from` and lump_idx < until and startswith(name, 'GL_')")
    return j.select("path", "map", "lump_idx", "name")


def gl_sibling_groups(lumps: DataFrame, names: DataFrame) -> DataFrame:
    """For each map name (``names``: map), its group in a file of GL blobs (path, lump_idx, name, data): path, map, lump_idx, name. A
    group begins at ``GL_`` and the map's name, where that fits in 8 bytes, or at a ``GL_LEVEL`` whose text tells the name; the first
    one counts, and only if all four blobs come before the next marker."""
    need = ["GL_VERT", "GL_SEGS", "GL_SSECT", "GL_NODES"]
    marker = F.startswith("name", F.lit("GL_")) & ~F.col("name").isin([*need, "GL_PVS"])
    told = F.trim(F.regexp_replace(F.regexp_extract(F.decode("data", "ISO-8859-1"), r"(?m)^LEVEL=(.*)$", 1), "[\r\\x00]+$", ""))
    m = lumps.where(marker).select("path", F.col("lump_idx").alias("from"), F.when(F.col("name") == "GL_LEVEL", told).otherwise(F.substring("name", 4, 8)).alias("map"))
    m = m.withColumn("until", F.coalesce(F.lead("from").over(W.partitionBy("path").orderBy("from")), F.lit(2**31 - 1)))
    m = m.join(names.select("map").distinct(), "map").withColumn("n", F.row_number().over(W.partitionBy("path", "map").orderBy("from"))).where("n = 1")
    j = lumps.where(F.col("name").isin(need)).select("path", "lump_idx", "name").join(m, "path").where("lump_idx > `from` and lump_idx < until")
    whole = j.groupBy("path", "map").agg(F.countDistinct("name").alias("k")).where(F.col("k") == len(need)).select("path", "map")
    return j.join(whole, ["path", "map"], "left_semi").select("path", "map", "lump_idx", "name")


def game_of(lumps: DataFrame) -> DataFrame:
    """``strife`` for files with a dialogue script of whole pages, else ``doom``."""
    script = F.col("name").rlike("^SCRIPT[0-9]{2}$") & (F.col("size") > 0) & ((F.col("size") % 1516 == 0) | (F.col("size") % 1488 == 0))
    return lumps.groupBy("path").agg(F.when(F.bool_or(script), "strife").otherwise("doom").alias("game"))


def require(condition: bool, code: str) -> None:
    if not condition:
        raise FormatError(code)
