"""What the command line of a container tool does with archives, on members (``sources.archive.scan``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.operators import assemble, directory, maps
from oreline.options import FormatError, Options
from oreline.sources import archive, wad

# The order in which namespaces are listed.
NAMESPACES = ["Global", "Flats", "Textures", "Hires", "Sprites", "Voxels", "Colormaps", "Acs", "Voices", "Patches", "Graphics", "Sounds", "Music", "Hidden"]


def label(content: Column) -> Column:
    """Name of the archive format that the first bytes announce; null if they announce none."""
    head = F.hex(F.call_function("substring", content, F.lit(1), F.lit(6)))
    zipped = F.greatest(*[F.startswith(head, F.lit(h)) for h in ("504B0304", "504B0506", "504B0708")])
    return F.when(zipped, "pk3 (zip)").when(head == "377ABCAF271C", "pk7 (7z)")


def refuse_archives(files: DataFrame, verb: str) -> DataFrame:
    """``files`` (path, content) for a verb that reads containers only; an archive among them is an error when it is met."""
    said = F.concat(S.flatten_control(F.col("path")), F.lit(" is a "), label(F.col("content")), F.lit(f" archive; {verb} reads containers"))
    return files.withColumn("content", F.when(label(F.col("content")).isNotNull(), F.raise_error(said).cast("binary")).otherwise(F.col("content")))


def maps_of(members: DataFrame) -> DataFrame:
    """Maps of an archive: path, map, kind (wad or text), member_idx, in the order of members."""
    kind = F.when(F.endswith(S.ascii_lower(F.col("member")), F.lit(".wad")), "wad").otherwise("text")
    return members.where("map is not null").select("path", "map", kind.alias("kind"), "member_idx")


def embedded(members: DataFrame, options: Options = Options(strict=False)) -> DataFrame:
    """Blobs of the containers inside archives, embedded ones and maps: archive, member, and the columns of ``wad.scan``."""
    at_maps = F.col("map").isNotNull() & F.endswith(S.ascii_lower(F.col("member")), F.lit(".wad"))
    inner = members.where((F.col("embedded") | at_maps) & F.col("data").isNotNull())
    key = F.concat("path", F.lit("\0"), "member")  # a path holds no NUL
    got = wad.scan(inner.select(key.alias("path"), F.col("data").alias("content")), options)
    part = lambda i: F.split("path", "\0")[i]
    return got.withColumn("archive", part(0)).withColumn("member", part(1))


def embedded_map_names(members: DataFrame) -> DataFrame:
    """path, member, maps (names of its map groups, in order) of each embedded container; none for one that cannot be read."""
    inner = members.where("embedded and data is not null").select("path", "member")
    g = directory.group_rows(embedded(members.where("embedded")).where("lump_idx is not null").select("path", "lump_idx", "name")).select("path", "map", "marker").distinct()
    names = g.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("marker", "map"))), lambda m: m["map"]).alias("maps"))
    names = names.select(F.split("path", "\0")[0].alias("path"), F.split("path", "\0")[1].alias("member"), "maps")
    return inner.join(names, ["path", "member"], "left").withColumn("maps", F.coalesce("maps", F.array().cast("array<string>")))


def info(members: DataFrame) -> DataFrame:
    """For each archive: members, declared bytes, maps in order, and members by namespace in listing order."""
    base = members.groupBy("path").agg(F.count("member_idx").alias("members"), F.coalesce(F.sum("uncompressed"), F.lit(0)).alias("bytes"), F.transform(F.array_sort(F.collect_list(F.when(F.col("map").isNotNull(), F.struct("member_idx", "map")))), lambda m: m["map"]).alias("maps"))
    order = F.array_position(F.array(*[F.lit(n) for n in NAMESPACES]), F.col("namespace"))
    tally = members.where("member_idx is not null").groupBy("path", "namespace").agg(F.count(F.lit(1)).alias("n"))
    tally = tally.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "namespace", "n"))), lambda t: F.struct(t["namespace"], t["n"])).alias("namespaces"))
    return base.join(tally, "path", "left")


def listing(members: DataFrame) -> DataFrame:
    """A row for each member, with a short name safe to print."""
    return members.where("member_idx is not null").select(
        "path", F.col("member_idx").alias("index"), S.flatten_control(F.col("member")).alias("member"), "namespace", S.flatten_control(F.col("short")).alias("short_name"),
        "method", F.col("uncompressed").alias("size"), F.col("compressed").alias("compressed_size"), "encrypted", "embedded",
    )


def deep_validate(members: DataFrame) -> DataFrame:
    """For each map in each container of an archive: lines, faults, whether its tree can be used; a container that cannot be read is
    one row with ``error``."""
    got = embedded(members)
    bad = got.where("error is not null").select("archive", "member", F.lit(None).cast("string").alias("map"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("faults"), "error")
    t = maps.tables(got.where("lump_idx is not null").select("path", "lump_idx", "name", "data"))
    lines = maps.resolve_lines(t).groupBy("path", "map").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("warnings")).cast("long").alias("faults"))
    part = lambda i: F.split("path", "\0")[i]
    return lines.select(part(0).alias("archive"), part(1).alias("member"), "map", "lines", "faults", F.lit(None).cast("string").alias("error")).union(bad)


def tail_members(tail: bytes, size: int, fetch, options: Options = Options()) -> list[dict]:
    """Members of an archive of which only the end is at hand: ``fetch(offset, length)`` gets bytes that are missing, in at most four
    rounds, and never a directory of more than 64 MiB. Nothing else of the archive is read."""
    held = [(size - len(tail), tail)]

    def get(at: int, n: int) -> bytes:
        for start, data in held:
            if start <= at and at + n <= start + len(data):
                return data[at - start : at - start + n]
        if len(held) > 4:
            raise FormatError("too_many_rounds")
        held.append((at, fetch(at, n)))
        return held[-1][1]

    end = tail.rfind(archive.ZIP_EMPTY)
    if end < 0 or len(tail) - end < 22:
        raise FormatError("end_record")
    word = lambda b, i, n: int.from_bytes(b[i : i + n], "little")
    total, length, at = word(tail, end + 10, 2), word(tail, end + 12, 4), word(tail, end + 16, 4)
    here = size - len(tail) + end
    if (total == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and here >= 20:
        locator = get(here - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record = get(word(locator, 8, 8), 56)
            total, length, at = word(record, 32, 8), word(record, 40, 8), word(record, 48, 8)
    if length > 64 * 2**20:
        raise FormatError("directory_too_large", str(length))
    if total > options.limits.max_archive_members:
        raise FormatError("too_many_members", str(total))
    if at + length > size:
        raise FormatError("directory_bounds", f"{at}+{length} of {size}")
    d, out, i = get(at, length), [], 0
    while i + 46 <= len(d) and len(out) < total:
        if d[i : i + 4] != b"PK\x01\x02":
            raise FormatError("directory_entry", str(i))
        n, extra, note = word(d, i + 28, 2), word(d, i + 30, 2), word(d, i + 32, 2)
        compressed, plain = word(d, i + 20, 4), word(d, i + 24, 4)
        x, stop = i + 46 + n, i + 46 + n + extra
        while x + 4 <= stop:  # large sizes are in an extra field, in order, those that do not fit first
            if word(d, x, 2) == 1:
                y = x + 4
                if plain == 0xFFFFFFFF:
                    plain, y = word(d, y, 8), y + 8
                if compressed == 0xFFFFFFFF:
                    compressed = word(d, y, 8)
                break
            x += 4 + word(d, x + 2, 2)
        out.append({"name": d[i + 46 : i + 46 + n].decode("utf-8", "replace"), "compressed": compressed, "uncompressed": plain, "method": archive.METHODS.get(word(d, i + 10, 2), f"unsupported({word(d, i + 10, 2)})"), "encrypted": bool(word(d, i + 8, 2) & 1)})
        i = stop + note
    if len(out) < total:
        raise FormatError("directory_cut", f"{len(out)} of {total}")
    return out


def patch_nodes(lumps: DataFrame, groups: DataFrame, built: DataFrame, text: bool) -> DataFrame:
    """Node blobs of map groups put in or replaced: for text maps ``ZNODES`` before ``ENDMAP``, else the classic blobs."""
    return assemble.replace_lumps(lumps, groups, built, before="ENDMAP" if text else None)
