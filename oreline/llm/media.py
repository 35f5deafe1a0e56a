"""Interleaved document sequences: ordered text and media references, payloads found by digest.

:func:`parse` turns HTML into an ordered sequence of structs; a media struct carries the reference and its
caption (``figcaption`` of its figure, else ``alt``). :func:`store` keeps payloads as binary PPM images, 64
pixels (192 samples of 8 bits) to a row, so any payload padded to a multiple of 192 bytes is stored without
loss. :func:`catalogue` reads stored images back and describes them; :func:`resolve` joins references to that by
digest and puts every item back at its position.

Payload bytes are never shuffled: the join moves digests and descriptions only. Both sides of the join are plain
tables, so adaptive execution splits a digest that very many documents refer to.

Defined results: null or empty HTML is an empty sequence; a null or empty text is a payload of 192 spaces; a text of any length is
one payload; a reference without a stored payload stays in its place, unresolved; equal payloads have one digest and one
description; repeated rows give repeated results; a null doc_id stays null; extra columns, whatever their names, are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C

ROW = 192
ITEM = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_BREAKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "ul", "ol", "article", "section", "figure", "figcaption", "nav", "header", "footer", "blockquote", "pre"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "template", "noscript", "head"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buffer)).strip()
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            said = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for i in self.figure or []:
                self.items[i]["caption"] = said or self.items[i]["caption"]
        elif tag == "figure":
            self.figure = self.caption = None
        if tag in _BREAKS:
            self.flush()

    def handle_data(self, data):
        if self.silent:
            return
        (self.buffer if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered items of one page."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id`` and ``items``, the ordered structs of each page."""
    ddl = T._parse_datatype_string(f"id long, items {ITEM}")
    schema = C._arrow_schema(ddl)

    def run(batches):
        for b in batches:
            ids, html = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 256):
                part = [sequence(x) for x in html.slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array(part, schema.field(1).type)], schema=schema)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(C.lean(run), ddl)


# ---------------------------------------------------------------- payloads
def encode(payload: bytes) -> bytes:
    """Binary PPM of a payload whose length is a positive multiple of 192."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


def decode(media: bytes) -> bytes:
    m = re.match(rb"P6\s(\d+)\s(\d+)\s255\s", media)
    if not m:
        raise ValueError("not a binary PPM of 8-bit samples")
    got = media[m.end() :]
    if len(got) != 3 * int(m[1]) * int(m[2]):
        raise ValueError("samples are missing")
    return got


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def describe(payload: bytes) -> str:
    """Size in pixels, mean and deviation of each channel, and the entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    rgb = x.reshape(-1, 3)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    mean, dev = rgb.mean(axis=0), rgb.std(axis=0)
    return f"64x{len(x) // ROW};" + ";".join(f"{m:.4f}/{d:.4f}" for m, d in zip(mean.tolist(), dev.tolist(), strict=True)) + f";{-(p * np.log2(p)).sum():.5f}"


def store(docs: DataFrame) -> DataFrame:
    """Written table ``__id``, n_bytes, digest, media: every text, padded and stored as an image."""

    def run(ids, data, offs):
        raw = data.tobytes()
        media = [encode(pad(raw[a:z])) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return {"__id": ids, "n_bytes": np.diff(offs), "digest": [hashlib.sha256(m).hexdigest() for m in media], "media": media}

    return C.materialize(C.map_chunks(docs, run, "__id long, n_bytes long, digest string, media binary"), "media-store")


def catalogue(stored: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes read back."""
    ddl = T._parse_datatype_string("digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    schema = C._arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows, seen = [], set()
                part = b.slice(lo, 256)
                for digest, media in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    m = media.as_py()
                    p = decode(m)
                    rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), describe(p)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = ddl.names[1:]
    got = stored.select("digest", "media").mapInArrow(C.lean(run), ddl)
    return C.materialize(got.groupBy("digest").agg(*[F.first(n).alias(n) for n in names]), "media-catalogue")


def resolve(sequences: DataFrame, known: DataFrame, prefix: str = "sha256:") -> DataFrame:
    """A row for each item of each sequence, with the columns of ``known`` where its reference is a digest in it."""
    items = sequences.select("id", F.explode("items").alias("x")).select("id", "x.*")
    items = items.withColumn("__digest", F.when(F.startswith("ref", F.lit(prefix)), F.substring("ref", len(prefix) + 1, 64)))
    return items.join(known, F.col("__digest") == known["digest"], "left").drop("__digest")
