"""Zip archives: central directory, bounded member reads, and containers inside."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.options import FormatError, Options, Report
from oreline.sources.wad import _arrow

# Signatures at the start of a file.
ZIP, ZIP_EMPTY, ZIP_SPANNED, SEVEN = b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08", b"7z\xbc\xaf\x27\x1c"
METHODS = {0: "stored", 8: "deflate"}
MEMBERS = "path string, member_idx int, name string, compressed long, uncompressed long, method string, encrypted boolean, data binary, warning string, error string"


def kind_of(data: bytes) -> str:
    """wad, zip or unknown, by content; archives that are refused raise."""
    if data[:6] == SEVEN:
        raise FormatError("unsupported_archive", "7z")
    if data[:4] == ZIP_EMPTY:
        raise FormatError("empty_archive")
    if data[:4] == ZIP_SPANNED:
        raise FormatError("spanned_archive")
    return "zip" if data[:4] == ZIP else "wad" if data[:4] in (b"IWAD", b"PWAD") else "unknown"


def kind_column(content: F.Column) -> F.Column:
    """:func:`kind_of` as an expression; refused archives are named."""
    head = F.hex(F.call_function("substring", content, F.lit(1), F.lit(6)))
    return (
        F.when(head == SEVEN.hex().upper(), "7z").when(F.startswith(head, F.lit("504B0506")), "empty").when(F.startswith(head, F.lit("504B0708")), "spanned")
        .when(F.startswith(head, F.lit("504B0304")), "zip").when(F.substring(head, 1, 8).isin("49574144", "50574144"), "wad").otherwise("unknown")
    )


def members(data: bytes, options: Options = Options()) -> list[zipfile.ZipInfo]:
    """Entries of the central directory, bounded in number."""
    kind_of(data)
    try:
        got = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, struct.error, NotImplementedError) as e:
        raise FormatError("zip", str(e)) from None
    if len(got) > options.limits.max_archive_members:
        raise FormatError("too_many_members", str(len(got)))
    return got


def zip64(data: bytes) -> bool:
    """Whether a 64-bit end record stands before the end record."""
    end = data.rfind(ZIP_EMPTY)
    return end >= 20 and data[end - 20 : end - 16] == b"PK\x06\x07"


def inflate(data: bytes, info: zipfile.ZipInfo, options: Options = Options()) -> bytes:
    """A member's bytes: stored or deflated, not encrypted, never more than the limit, checksum compared."""
    cap = options.limits.max_decoded_member_bytes
    if info.flag_bits & 1:
        raise FormatError("encrypted", info.filename)
    if info.compress_type not in METHODS:
        raise FormatError("method", str(info.compress_type))
    if info.file_size > cap:
        raise FormatError("member_too_large", info.filename)
    at = info.header_offset
    if data[at : at + 4] != ZIP:
        raise FormatError("local_header", info.filename)
    n, m = struct.unpack_from("<HH", data, at + 26)
    raw = data[at + 30 + n + m : at + 30 + n + m + info.compress_size]
    try:
        out = raw if info.compress_type == 0 else zlib.decompressobj(-15).decompress(raw, cap + 1)
    except zlib.error as e:
        raise FormatError("deflate", str(e)) from None
    if len(out) != info.file_size:
        raise FormatError("member_size", info.filename)
    if zlib.crc32(out) != info.CRC:
        raise FormatError("crc", info.filename)
    return out


def scan(files: DataFrame, options: Options = Options(strict=False), read_data: bool = True) -> DataFrame:
    """A row for each member of each archive (path, content)."""
    schema = _arrow(MEMBERS)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for i, info in enumerate(members(data, options)):
                        body, error = None, None
                        if read_data and not info.is_dir():
                            try:
                                body = inflate(data, info, options)
                            except FormatError as e:
                                error = str(e)
                        over = "member_too_large" if info.file_size > options.limits.max_decoded_member_bytes else None
                        method = METHODS.get(info.compress_type, f"unsupported({info.compress_type})")
                        rows.append((path, i, info.filename, info.compress_size, info.file_size, method, bool(info.flag_bits & 1), body, over, error))
                except FormatError as e:
                    Report(options)(e.code, e.detail)
                    rows = [(path, None, None, None, None, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    got = files.select("path", "content").mapInArrow(run, MEMBERS)
    p = S.archive_path(F.col("name"))
    ns = S.namespace_of(p)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return got.withColumns({"member": p, "namespace": ns, "short": S.short_name(p, ns), "embedded": S.is_embedded(p, stem), "map": S.map_of(p)})


def last_member(members_df: DataFrame, member: str) -> DataFrame:
    """The last member of a path in each archive, without regard to ASCII case."""
    same = members_df.where(S.ascii_lower(F.col("member")) == member.lower())
    return same.groupBy("path").agg(F.max_by(F.struct("member_idx", "member", "data"), "member_idx").alias("m")).select("path", "m.*")
