"""Column expressions for names, paths, dates, sizes and flags. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Archive folders and the namespaces they select.
NAMESPACES = {
    "flats": "Flats", "textures": "Textures", "hires": "Hires", "sprites": "Sprites", "voxels": "Voxels",
    "colormaps": "Colormaps", "acs": "Acs", "voices": "Voices", "patches": "Patches", "graphics": "Graphics",
    "sounds": "Sounds", "music": "Music",
}
# Roots of the archive that hold maps, and those that do not.
MAP_ROOTS = ["levels/", "deathmatch/", "combos/", "prefabs/", "themes/"]
OTHER_ROOTS = ["music/", "sounds/", "utils/", "lmps/", "docs/", "graphics/", "source/", "idstuff/", "skins/", "misc/", "historic/", "roguestuff/", "incoming/", "newstuff/"]
# Device names that file systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# ---------------------------------------------------------------- sizes and ratios
def safe_ratio(n: Column, d: Column) -> Column:
    """``n / d``; 0 where ``d`` is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.nullif(d, F.lit(0)).cast("double"))


def pow2_ceil(x: Column) -> Column:
    """Least power of two that is at least ``x``; 1 up to 1; the greatest long beyond 2^62."""
    x = x.cast("long")
    shift = F.length(F.bin(F.greatest(x, F.lit(2)) - 1))
    return F.when(x <= 1, F.lit(1)).when(x > 2**62, F.lit(2**63 - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(shift, F.lit(62)).cast("int")))


def format_bytes(n: Column) -> Column:
    """The exact number, with a binary unit only where it is a whole multiple of it."""
    text = n.cast("string")
    out = text
    for power, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB"), (40, "TiB")):
        size = 2**power
        out = F.when((n != 0) & (n % size == 0), F.concat(text, F.lit(" ("), F.floor(n / size).cast("string"), F.lit(f" {unit})"))).otherwise(out)
    return out


def log2_bucket(x: Column) -> Column:
    """``0``, or ``2^k-2^(k+1)`` with k the whole part of the binary logarithm."""
    k = log2_floor(x)
    return F.when(x == 0, F.lit("0")).otherwise(F.concat(F.lit("2^"), k.cast("string"), F.lit("-2^"), (k + 1).cast("string")))


def log2_floor(x: Column) -> Column:
    """-1 for 0, else the whole part of the binary logarithm."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.length(F.bin(x.cast("long"))) - 1)


def lenient_long(text: Column) -> tuple[Column, Column]:
    """(value, error): a number or trimmed numeric string; null is 0; anything else is an error."""
    value = F.expr("0") if text is None else text.cast("string")
    got = F.trim(value).try_cast("bigint")
    return F.coalesce(got, F.lit(0)), value.isNotNull() & got.isNull()


def lenient_double(x: Column) -> Column:
    """Null for what is not finite."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


# ---------------------------------------------------------------- paths
def year_of(date: Column) -> Column:
    return F.when(date.rlike(r"^[0-9]{4}-"), F.substring(date, 1, 4)).otherwise("unknown")


def normalize_dir(path: Column) -> Column:
    """One slash at the end; empty stays empty."""
    return F.when(path == "", "").otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/")))


def top_bucket(path: Column) -> Column:
    """First segment; below ``levels`` also the game, and ``Ports`` if a deeper segment is that."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    game = F.concat_ws("/", F.element_at(seg, 1), F.element_at(seg, 2))
    deep = F.array_contains(F.slice(seg, 3, F.greatest(F.size(seg), F.lit(1))), "Ports")
    return (
        F.when(F.size(seg) == 0, "")
        .when((F.element_at(seg, 1) != "levels") | (F.size(seg) == 1), F.element_at(seg, 1))
        .when(deep, F.concat(game, F.lit("/Ports")))
        .otherwise(game)
    )


def triage(path: Column) -> Column:
    """include, skip or triage by the roots a directory lies under."""
    under = lambda roots: F.greatest(*[F.startswith(path, F.lit(r)) for r in roots])
    return (
        F.when((path == "") | F.startswith(path, F.lit("levels/reviews/")), "skip")
        .when(under(MAP_ROOTS), "include").when(under(OTHER_ROOTS), "skip").otherwise("triage")
    )


def archive_path(raw: Column) -> Column:
    """Forward slashes, none at the start."""
    return F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^/+", "")


def namespace_of(path: Column) -> Column:
    first = ascii_lower(F.split(path, "/")[0])
    known = F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])
    return F.when(~F.contains(path, F.lit("/")), "Global").otherwise(F.coalesce(F.try_element_at(known, first), F.lit("Hidden")))


def short_name(path: Column, namespace: Column) -> Column:
    """Base name without its last extension, 8 characters, upper case; null for hidden members."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    name = ascii_upper(F.substring(stem, 1, 8))
    name = F.when(namespace.isin("Sprites", "Voxels", "Hires"), F.translate(name, "^", "\\")).otherwise(name)
    return F.when((namespace == "Hidden") | (stem == ""), F.lit(None)).otherwise(name)


def is_embedded(path: Column, archive: Column) -> Column:
    """A container at the root of an archive, or directly in the folder of the archive's own name."""
    seg = F.split(path, "/")
    ends = F.endswith(ascii_lower(path), F.lit(".wad"))
    own = ascii_lower(seg[0]) == ascii_lower(archive)
    return F.coalesce(ends & ((F.size(seg) == 1) | ((F.size(seg) == 2) & own)), F.lit(False))


def map_of(path: Column) -> Column:
    """Name of the map that ``maps/NAME.wad`` or ``maps/NAME.map`` holds, else null."""
    return F.nullif(ascii_upper(F.regexp_extract(path, r"(?i)^maps/([^/]+)\.(?:wad|map)$", 1)), F.lit(""))


# ---------------------------------------------------------------- names
def sanitize(name: Column) -> Column:
    safe = ascii_upper(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"))
    return F.when(safe == "", "UNNAMED").when(safe.isin(RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)


def flatten_control(s: Column) -> Column:
    """Escape characters go, other control characters become spaces."""
    return F.regexp_replace(F.replace(s, F.lit("\x1b"), F.lit("")), r"[\x00-\x1F\x7F-\u009F]", " ")


def name_hash(name: Column) -> Column:
    """16-bit hash of the first 8 bytes of a name, upper-cased, with 32-bit wrap-around."""
    # The start, the shifts (times 32, right by 2) and the mask of the hash.
    mask = 0xFFFFFFFF
    raw = ascii_upper(F.substring(name, 1, 8))
    codes = F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(
        codes, F.lit(1_315_423_911).cast("long"),
        lambda h, c: h.bitwiseXOR(((h * 32).bitwiseAND(mask) + c + F.shiftright(h, 2)).bitwiseAND(mask)),
    )
    return hashed.bitwiseAND(0xFFFF)


def dup_suffix(name: Column, seen_before: Column) -> Column:
    """``_1``, ``_2`` … after the first occurrence."""
    return F.when(seen_before > 0, F.concat(name, F.lit("_"), seen_before.cast("string"))).otherwise(name)


def method_label(label: Column) -> Column:
    """Readable names of compression methods reported by number."""
    n = F.regexp_extract(label, r"^unsupported\((\d+)\)$", 1)
    # Zip method numbers.
    names = {"1": "Shrink(1)", "6": "Implode(6)", "9": "Deflate64(9)", "12": "BZip2(12)", "14": "LZMA(14)"}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, n), label)


# ---------------------------------------------------------------- flags and coordinates
def hexen_thing_flags(flags: Column) -> Column:
    """Low four bits; absent single-player, deathmatch and co-op bits become 0x10, 0x20 and 0x40."""
    f = flags.cast("int")
    absent = lambda bit, out: F.when(f.bitwiseAND(bit) == 0, out).otherwise(0)
    return f.bitwiseAND(0x0F) + absent(0x100, 0x10) + absent(0x400, 0x20) + absent(0x200, 0x40)


def doom64_thing_flags(flags: Column) -> Column:
    """Low five bits; 1024 becomes 0x20 and 2048 becomes 0x40."""
    f = flags.cast("int").bitwiseAND(0xFFFF)
    return f.bitwiseAND(0x1F) + F.when(f.bitwiseAND(1024) != 0, 0x20).otherwise(0) + F.when(f.bitwiseAND(2048) != 0, 0x40).otherwise(0)


def narrow_coord(x: Column) -> tuple[Column, Column]:
    """(16-bit value, what was lost): non-finite 0, fractions rounded half away from zero, then clamped."""
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    r = F.round(F.when(finite, x).otherwise(0.0))
    value = F.least(F.greatest(r, F.lit(-32768.0)), F.lit(32767.0)).cast("int")
    lost = F.when(~finite, "non_finite").when((r < -32768) | (r > 32767), "out_of_range").when(r != x, "fractional")
    return value, lost


def narrow_int(x: Column, lo: int = -32768, hi: int = 32767) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def flags16(x: Column) -> Column:
    return x.bitwiseAND(0xFFFF)


def bam_angle(dx: Column, dy: Column) -> Column:
    """Direction in 65536ths of a turn."""
    return F.pmod(F.round(F.atan2(dy, dx) * (65536 / (2 * 3.141592653589793))).cast("int"), F.lit(65536))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot((ax - bx).cast("double"), (ay - by).cast("double"))


def bbox_union(a: Column, b: Column) -> Column:
    """Box around two boxes of (top, bottom, left, right)."""
    pick = lambda f, i: f(F.element_at(a, i), F.element_at(b, i))
    return F.array(pick(F.greatest, 1), pick(F.least, 2), pick(F.least, 3), pick(F.greatest, 4))


def name8(name: Column) -> tuple[Column, Column]:
    """(first 8 bytes of a name, whether more were cut off)."""
    raw = name.cast("string").cast("binary")
    return F.call_function("substring", raw, F.lit(1), F.lit(8)), F.octet_length(raw) > 8


def coerce_u16(x: Column) -> tuple[Column, Column]:
    """(value within 0 to 65535, whether it had to be moved there)."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(0xFFFF)).cast("int"), (x < 0) | (x > 0xFFFF)


def drop_field(is_set: Column, field: str) -> Column:
    """Warning for a field that the target format cannot hold; null where it holds nothing."""
    return F.when(is_set, F.lit(f"{field} dropped"))


def fixed_16_16(x: Column) -> Column:
    """A coordinate rounded to whole units, with 16 fraction bits; null beyond 32 bits."""
    return _in_32(F.round(x).cast("decimal(38,0)") * 65536)


def fixed_16_16_exact(x: Column) -> Column:
    """A coordinate to the nearest of 65536ths; null beyond 32 bits or not finite."""
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf"))) & (F.abs(x) < 2.0**40)
    return _in_32(F.round(F.when(finite, x) * 65536.0).cast("decimal(38,0)"))


def _in_32(v: Column) -> Column:
    return F.when((v >= -(2**31)) & (v < 2**31), v.cast("long"))


def cross_from_start(rx: Column, ry: Column, pdx: Column, pdy: Column) -> Column:
    """Signed area of a point, from a line's start, against the line; negative on its left."""
    return rx.cast("long") * pdy.cast("long") - ry.cast("long") * pdx.cast("long")


def within_half_unit(cross: Column, length_squared: Column) -> Column:
    """Whether a point is closer than half a unit to a line, in whole numbers."""
    c = cross.cast("decimal(19,0)")
    return c * c * 4 < length_squared.cast("decimal(38,0)")


def clamp_dimension(v: Column) -> tuple[Column, Column]:
    """(size, whether it was negative): a negative size is 0."""
    return F.greatest(v, F.lit(0)), v < 0


def linedef_id_unset(format: Column) -> Column:
    """The number that stands for no line id."""
    return F.when(format == "udmf", -1).otherwise(0)


def text_node_dialect(wanted: Column) -> Column:
    """Node dialect written for a text map: classic nodes are not for these."""
    return F.when(wanted == "classic", "gl").otherwise(wanted)


def script_lump(conversation: Column) -> Column:
    """Name of the blob of a conversation script; null beyond 0 to 99."""
    return F.when((conversation >= 0) & (conversation <= 99), F.concat(F.lit("SCRIPT"), F.lpad(conversation.cast("string"), 2, "0")))


def instrument_flags(flags: Column) -> Column:
    """fixed_pitch, double_voice."""
    return F.struct((flags.bitwiseAND(1) != 0).alias("fixed_pitch"), (flags.bitwiseAND(4) != 0).alias("double_voice"))


def palette_color(palette: Column, index: Column) -> Column:
    """Red, green and blue of a colour in a table of 3-byte entries; null beyond its end."""
    at = (index * 3 + 1).cast("int")
    rgb = F.call_function("substring", palette, at, F.lit(3))
    part = lambda i, n: le_uint(rgb, i, 1).cast("int").alias(n)
    return F.when((index >= 0) & (F.octet_length(rgb) == 3), F.struct(part(0, "red"), part(1, "green"), part(2, "blue")))


def gl_level_matches(text: Column, map_name: Column) -> Column:
    """Whether a marker's text holds a line ``LEVEL=`` with the map's name."""
    value = lambda ln: F.trim(F.regexp_replace(F.substring(ln, 7, 1 << 20), "[\r\\x00]+$", ""))
    return F.exists(F.split(text, "\n"), lambda ln: F.startswith(ln, F.lit("LEVEL=")) & (value(ln) == map_name))


def utf8_fault(data: Column) -> Column:
    """Whether bytes are no valid UTF-8."""
    return data.isNotNull() & ~F.is_valid_utf8(data.cast("string"))


def clockwise_key(ref_dx: Column, ref_dy: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """(rank, x, y) of a direction in the frame of a reference: directions with a smaller rank come first clockwise; within
    a rank, :func:`turns_before` tells."""
    x, y = _frame(ref_dx, ref_dy, dx, dy)
    return F.when((y == 0) & (x > 0), 0).when(y < 0, 1).when(y == 0, 2).otherwise(3), x, y


def counter_clockwise_key(ref_dx: Column, ref_dy: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    x, y = _frame(ref_dx, ref_dy, dx, dy)
    return F.when((y == 0) & (x > 0), 0).when(y > 0, 1).when(y == 0, 2).otherwise(3), x, y


def _frame(ref_dx: Column, ref_dy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    n = lambda c: c.cast("decimal(18,0)")
    return n(dx) * n(ref_dx) + n(dy) * n(ref_dy), n(ref_dx) * n(dy) - n(ref_dy) * n(dx)


def turns_before(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], clockwise: bool = True) -> Column:
    """-1, 0 or 1: whether direction ``a`` comes before, with or after ``b``, exactly, in whole numbers."""
    side = F.sign((a[1].cast("decimal(19,0)") * b[2].cast("decimal(19,0)") - a[2].cast("decimal(19,0)") * b[1].cast("decimal(19,0)")).cast("double")).cast("int")
    return F.when(a[0] != b[0], F.when(a[0] < b[0], -1).otherwise(1)).otherwise(side if clockwise else -side)


def seg_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Direction of a seg between two points; 0 where they are one."""
    return bam_angle((bx - ax).cast("double"), (by - ay).cast("double"))


def seg_offset(ax: Column, ay: Column, x: Column, y: Column) -> Column:
    """Distance along its line at which a seg starts, from the line's end it runs from, in whole units."""
    return F.round(F.sqrt((x - ax).cast("double") * (x - ax) + (y - ay).cast("double") * (y - ay))).cast("int")


# ---------------------------------------------------------------- little-endian integers in binary columns
def le_uint(data: Column, offset: Column | int, size: int) -> Column:
    """Unsigned little-endian integer of 1 to 4 bytes at a 0-based offset."""
    at = (F.lit(offset) if isinstance(offset, int) else offset).cast("int")
    part = F.call_function("substring", data, at + 1, F.lit(size))
    return swap_bytes(F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long")), size)


def swap_bytes(v: Column, size: int) -> Column:
    """The whole number of so many bytes with their order turned round."""
    out = None
    for i in range(size):
        byte = F.shiftright(v, 8 * i).bitwiseAND(0xFF) if i else v.bitwiseAND(0xFF)
        byte = F.shiftleft(byte, 8 * (size - 1 - i)) if i < size - 1 else byte
        out = byte if out is None else out.bitwiseOR(byte)
    return out


def le_int(data: Column, offset: Column | int, size: int) -> Column:
    u = le_uint(data, offset, size)
    half = 1 << (8 * size - 1)
    return F.when(u >= half, u - (1 << (8 * size))).otherwise(u)
