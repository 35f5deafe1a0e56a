"""Palettes, flats, column pictures, and textures composed of patches."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from oreline.options import FormatError, Limits, Options, Report


@dataclass
class Image:
    """Palette indices (height, width) and which pixels are there."""

    pixels: np.ndarray
    opaque: np.ndarray
    left: int = 0
    top: int = 0

    def rgba(self, palette: np.ndarray) -> np.ndarray:
        return np.dstack([palette[self.pixels], np.where(self.opaque, 255, 0).astype(np.uint8)])


def palettes(data: bytes, options: Options = Options()) -> np.ndarray:
    """(palettes, 256, 3) colours of 768-byte palettes."""
    return _tables(data, 768, options).reshape(-1, 256, 3)


def colormaps(data: bytes, options: Options = Options()) -> np.ndarray:
    """(maps, 256) of 256-byte tables."""
    return _tables(data, 256, options).reshape(-1, 256)


def _tables(data: bytes, size: int, options: Options) -> np.ndarray:
    n, rest = divmod(len(data), size)
    if rest or not n:
        Report(options)("table_size", str(len(data)))
    return np.frombuffer(data, np.uint8, n * size)


def flat(data: bytes) -> Image:
    if len(data) != 4096:
        raise FormatError("flat_size", str(len(data)))
    return Image(np.frombuffer(data, np.uint8).reshape(64, 64), np.ones((64, 64), bool))


def picture(data: bytes, options: Options = Options()) -> Image:
    """Columns of posts: offset table, then (row, count, pad, pixels, pad) up to 0xFF. A post that starts at or above the row
    of the one before continues from it (tall pictures)."""
    say = Report(options)
    if len(data) < 8:
        raise FormatError("picture_header")
    w, h, left, top = struct.unpack_from("<hhhh", data)
    if w < 0 or h < 0:
        say("picture_size", f"{w}x{h}")
        w, h = max(w, 0), max(h, 0)
    if w * h > options.limits.max_decoded_pixels:
        raise FormatError("too_many_pixels", f"{w}x{h}")
    if 8 + 4 * w > len(data):
        raise FormatError("picture_columns")
    pix, opaque = np.zeros((h, w), np.uint8), np.zeros((h, w), bool)
    for x, at in enumerate(struct.unpack_from(f"<{w}I", data, 8)):
        row = -1
        while True:
            if at >= len(data):
                say("post_bounds", f"column {x}")
                break
            if data[at] == 0xFF:
                break
            if at + 1 >= len(data) or at + 4 + data[at + 1] > len(data):
                say("post_bounds", f"column {x}")
                break
            delta, n = data[at], data[at + 1]
            row = row + delta if delta <= row else delta
            body = np.frombuffer(data, np.uint8, n, at + 3)
            keep = max(0, min(n, h - row))
            if keep < n:
                say("post_height", f"column {x}")
            pix[row : row + keep, x], opaque[row : row + keep, x] = body[:keep], True
            at += n + 4
    return Image(pix, opaque, left, top)


def patch_names(data: bytes, options: Options = Options()) -> list[str]:
    """Names of patches, upper case."""
    say = Report(options)
    n = struct.unpack_from("<i", data)[0] if len(data) >= 4 else 0
    if n < 0 or 4 + 8 * n > len(data):
        say("patch_count", str(n))
        n = max(0, min(n, (len(data) - 4) // 8))
    return [data[4 + 8 * i : 12 + 8 * i].split(b"\0", 1)[0].decode("latin-1").upper() for i in range(n)]


def texture_list(data: bytes, options: Options = Options()) -> list[dict]:
    """Textures: name, width, height, patches (x, y, patch number)."""
    say = Report(options)
    n = struct.unpack_from("<i", data)[0] if len(data) >= 4 else 0
    if n < 0 or 4 + 4 * n > len(data):
        say("texture_count", str(n))
        n = max(0, min(n, (len(data) - 4) // 4))
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{n}i", data, 4)):
        if at < 0 or at + 22 > len(data):
            say("texture_offset", str(i))
            continue
        name, _, w, h, _, k = struct.unpack_from("<8sihhih", data, at)
        if k < 0 or at + 22 + 10 * k > len(data):
            say("texture_patches", str(i))
            k = max(0, min(k, (len(data) - at - 22) // 10))
        parts = [struct.unpack_from("<hhh", data, at + 22 + 10 * j) for j in range(k)]
        out.append({"name": name.split(b"\0", 1)[0].decode("latin-1").upper(), "width": max(w, 0), "height": max(h, 0), "patches": parts})
    return out


def compose(texture: dict, patch: dict[int, Image | None], limits: Limits = Limits()) -> tuple[Image, list[int]]:
    """Patches drawn in order, later over earlier, clipped; and the columns no patch reaches."""
    w, h = texture["width"], texture["height"]
    if w * h > limits.max_composite_pixels:
        raise FormatError("too_many_pixels", texture["name"])
    pix, opaque, live = np.zeros((h, w), np.uint8), np.zeros((h, w), bool), np.zeros(w, bool)
    for x, y, number in texture["patches"]:
        p = patch.get(number)
        if p is None:
            continue
        ph, pw = p.pixels.shape
        x0, x1, y0, y1 = max(x, 0), min(x + pw, w), max(y, 0), min(y + ph, h)
        if x0 < x1:
            live[x0:x1] = True
        if x0 < x1 and y0 < y1:
            m = p.opaque[y0 - y : y1 - y, x0 - x : x1 - x]
            pix[y0:y1, x0:x1][m] = p.pixels[y0 - y : y1 - y, x0 - x : x1 - x][m]
            opaque[y0:y1, x0:x1] |= m
    return Image(pix, opaque), np.flatnonzero(~live).tolist()


def png(data: bytes, limits: Limits = Limits()) -> tuple[Image, np.ndarray, np.ndarray]:
    """Indexed PNG without interlacing: image (offsets from its grAb chunk), palette, alpha of each colour."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FormatError("png")
    at, body, pal, alpha, left, top, head = 8, b"", np.zeros((256, 3), np.uint8), np.full(256, 255, np.uint8), 0, 0, None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            pal[: n // 3] = np.frombuffer(part, np.uint8, n // 3 * 3).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha[:n] = np.frombuffer(part, np.uint8)
        elif kind == b"grAb":
            left, top = struct.unpack(">ii", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[3] != 3 or head[6] != 0:
        raise FormatError("png_kind")
    w, h, depth = head[:3]
    if w * h > limits.max_decoded_pixels:
        raise FormatError("too_many_pixels")
    stride = -(-w * depth // 8)
    raw = zlib.decompressobj().decompress(body, h * (stride + 1) + 1)
    if len(raw) < h * (stride + 1):
        raise FormatError("png_data")
    rows, before = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        line = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        before = rows[y] = _unfilter(line[0], np.frombuffer(line, np.uint8, stride, 1), before)
    bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
    pix = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return Image(pix, alpha[pix] > 0, left, top), pal, alpha


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    out = np.zeros(len(line), np.uint8)
    for i, v in enumerate(line.tolist()):
        a, b, c = (int(out[i - 1]) if i else 0), int(up[i]), (int(up[i - 1]) if i else 0)
        if kind == 4:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        else:
            near = a if kind == 1 else (a + b) // 2
        out[i] = (v + near) & 255
    return out
