"""Container files: a 12-byte header, blobs, and a directory of 16-byte entries.

:func:`parse` and :func:`build` work on bytes; :func:`scan` reads files into one row for each blob, and
:func:`pack` writes a container for each group of blobs. :func:`scan_native` does the same as a strict scan
with built-in expressions only.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.options import FormatError, Options, Report

ENTRY = np.dtype([("filepos", "<i4"), ("size", "<i4"), ("name", "S8")])
HEADER = 12
MAX_OFFSET = 2**31 - 1

LUMPS = "path string, kind string, lump_idx int, name string, filepos long, size long, data binary"
SCAN = LUMPS + ", warnings array<string>, error string"


@dataclass
class Lump:
    name: str
    filepos: int
    size: int


@dataclass
class Container:
    kind: str
    lumps: list[Lump]
    data: bytes
    warnings: list[str]

    def bytes_of(self, index: int) -> bytes:
        lump = self.lumps[index]
        return self.data[lump.filepos : lump.filepos + lump.size]

    def first(self, name: str) -> int | None:
        """Index of the first blob of a name."""
        return next((i for i, lump in enumerate(self.lumps) if lump.name == name), None)


def parse(data: bytes, options: Options = Options()) -> Container:
    """Header and directory. Lenient reading takes as much of the directory as is there, and cuts blobs at the
    directory (those that begin before its end) or at the end of the file."""
    say = Report(options)
    if len(data) < HEADER:
        raise FormatError("header", f"{len(data)} bytes")
    magic, count, at = struct.unpack_from("<4sii", data)
    kind = magic.decode("latin-1")
    if magic not in (b"IWAD", b"PWAD"):
        say("magic", repr(magic))
    if count < 0:
        say("negative_count", str(count))
        count = 0
    if at < 0:
        say("negative_directory", str(at))
        at = 0
    if at > len(data) or at + 16 * count > len(data):
        say("directory_bounds", f"{at}+{16 * count} of {len(data)}")
        count = min(count, max(0, len(data) - at) // 16)
    entries = np.frombuffer(data, ENTRY, count, at) if count else np.zeros(0, ENTRY)
    limit = min(at, len(data))
    end_of_directory = min(at + 16 * count, len(data))
    lumps = []
    for i, (pos, size, raw) in enumerate(zip(entries["filepos"].tolist(), entries["size"].tolist(), (bytes(data[at + 16 * i + 8 : at + 16 * i + 16]) for i in range(count)), strict=True)):
        if pos < 0:
            say("negative_filepos", f"entry {i}")
            pos = 0
        if size < 0:
            say("negative_size", f"entry {i}")
            size = 0
        raw = raw.split(b"\0", 1)[0]
        if not raw.isascii():
            say("name_ascii", f"entry {i}")
        most = limit if pos < end_of_directory else len(data)
        if pos > most or pos + size > most:
            say("lump_bounds", f"entry {i}")
            pos = min(pos, most)
            size = min(size, most - pos)
        lumps.append(Lump(raw.decode("ascii", "replace"), pos, size))
    return Container(kind, lumps, data, say.warnings)


def build(lumps: list[tuple[str, bytes]], kind: str = "PWAD", options: Options = Options()) -> bytes:
    """A container of named blobs in order. A name that is too long is an error or, in lenient mode, cut; NUL and
    non-ASCII characters always are errors."""
    at, names = HEADER, []
    directory = np.zeros(len(lumps), [("filepos", "<i4"), ("size", "<i4"), ("name", "u1", 8)])
    for i, (name, data) in enumerate(lumps):
        raw = name.encode("utf-8")
        if not raw.isascii() or b"\0" in raw:
            raise FormatError("name_characters", repr(name))
        if len(raw) > 8:
            if options.strict:
                raise FormatError("name_length", repr(name))
            raw = raw[:8]
        if at + len(data) > MAX_OFFSET:
            raise FormatError("too_large", f"blob {i}")
        directory[i] = (at, len(data), np.frombuffer(raw.ljust(8, b"\0"), "u1"))
        names.append(raw)
        at += len(data)
    return struct.pack("<4sii", kind.encode(), len(lumps), at) + b"".join(d for _, d in lumps) + directory.tobytes()


# ---------------------------------------------------------------- DataFrames
def scan(files: DataFrame, options: Options = Options(strict=False), path: str = "path", content: str = "content") -> DataFrame:
    """A row for each blob of each file (path, content); a file that cannot be read gives one row with ``error``."""
    schema = _arrow(SCAN)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    c = parse(data or b"", options)
                    rows = [(p, c.kind, i, x.name, x.filepos, x.size, c.bytes_of(i), c.warnings, None) for i, x in enumerate(c.lumps)]
                    rows = rows or [(p, c.kind, None, None, None, None, None, c.warnings, None)]
                except FormatError as e:
                    rows = [(p, None, None, None, None, None, None, [], str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col(path).cast("string"), F.col(content)).mapInArrow(run, SCAN)


def read(spark: SparkSession, path: str, options: Options = Options(strict=False)) -> DataFrame:
    """Blobs of all files under a path; a file is one task's work, so parallelism is across files."""
    return scan(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), options)


def scan_native(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Blobs of well-formed files, by built-in expressions."""
    c = F.col("content")
    head = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where(F.octet_length("content") >= HEADER)
    head = head.select("path", "content", F.decode(F.call_function("substring", c, F.lit(1), F.lit(4)), "US-ASCII").alias("kind"), S.le_int(c, 4, 4).alias("n"), S.le_int(c, 8, 4).alias("at"))
    head = head.where("kind in ('IWAD', 'PWAD') and n > 0 and at >= 12 and at + 16 * n <= octet_length(content)")
    # generated code reads the file's bytes once for all its entries; a lambda over them would copy the file for each
    e = head.withColumn("lump_idx", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    at = F.col("at") + F.col("lump_idx") * 16
    name = F.split(F.decode(F.call_function("substring", c, (at + 9).cast("int"), F.lit(8)), "US-ASCII"), "\0")[0]
    e = e.select("path", "kind", "lump_idx", name.alias("name"), S.le_int(c, at, 4).alias("filepos"), S.le_int(c, at + 4, 4).alias("size"), "content")
    return e.select("path", "kind", "lump_idx", "name", "filepos", "size", F.call_function("substring", F.col("content"), (F.col("filepos") + 1).cast("int"), F.col("size").cast("int")).alias("data"))


def pack(lumps: DataFrame, by: str, order: str, name: str = "name", data: str = "data", kind: str = "PWAD", options: Options = Options(strict=False)) -> DataFrame:
    """One container for each value of ``by``: ``by``, content. A container is one file of at most 2 GiB, which bounds a group."""

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        blobs = [(n, bytes(d) if d is not None else b"") for n, d in zip(pdf[name], pdf[data], strict=True)]
        import pandas as pd

        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [build(blobs, kind, options)]})

    kept = lumps.select(by, order, name, data)
    return kept.groupBy(by).applyInPandas(run, f"{by} {kept.schema[by].dataType.simpleString()}, content binary")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
