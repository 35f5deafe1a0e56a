"""Shared pieces: byte-level views of text columns, vectorised word hashing, intermediate tables.

Text travels to Python as Arrow binary and is processed in chunks of a few MB as one ``uint8``
array with document offsets, so memory does not depend on the number of rows in a batch.
A null text counts as empty; a null id is carried as ``NULL_ID`` inside an operator and is
null again in its result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_ID = -(2**63)
CHUNK = 1 << 19
_BATCH, _READ = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))


# ---------------------------------------------------------------- intermediate tables
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a local one serves a session whose executors are threads of
    the driver (tests); on a cluster it would not be shared, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="oreline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives
    lost executors and lets adaptive execution split skewed joins on plain scans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/oreline-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # its shuffle files go as soon as it is written
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def release(*tables: DataFrame) -> None:
    """Delete intermediate tables that only written results depended on."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _drop(t.sparkSession, path)


def by_part(df: DataFrame, bits: int, parts: int) -> DataFrame:
    """Rows with a number ``part`` of so many bits, dealt evenly in its order over ``parts`` partitions and sorted."""
    where = F.shiftright(F.col("part").cast("long") * parts, bits).cast("int")
    return df.repartitionById(parts, where).sortWithinPartitions("part")


def partitions(spark: SparkSession, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- documents as bytes
def small_batches(spark: SparkSession) -> None:
    """From now on at most 4 MB of rows go to Python at a time in this session, and 1,024 rows are read from Parquet at a time,
    unless it has bounds of its own: by default a batch may hold 64 MB of long documents, and 4,096 of them are read together."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, "4m")
    if spark.conf.get(_READ) == "4096":
        spark.conf.set(_READ, "1024")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker, which serves other stages next, gives free memory back."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return kept


def _trim() -> None:
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def doc_bytes(df: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id``, ``__text`` (binary, never null) and the columns named in ``keep``."""
    small_batches(df.sparkSession)
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text"),
        *keep,
    )


def row(df: DataFrame) -> F.Column:
    """All columns of ``df`` as one value, so that no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def back(col: str = "__id") -> F.Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def chunks(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    ids = batch.column(batch.schema.get_field_index("__id")).to_numpy(zero_copy_only=False)
    col = batch.column(batch.schema.get_field_index("__text"))
    if len(col) == 0:
        return
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(ids):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(ids))
        yield row, end, ids[row:end], data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def map_chunks(df: DataFrame, fn: Callable[..., dict | None], schema: str, **cols: str) -> DataFrame:
    """Apply ``fn(ids, data, offs)`` -> {column: array} to every chunk of ``df``'s documents."""
    ddl = T._parse_datatype_string(schema)
    out = _arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, ids, data, offs in chunks(b):
                got = fn(ids, data, offs)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return doc_bytes(df, **cols).mapInArrow(lean(run), ddl)


def _arrow_schema(ddl: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl)


# ---------------------------------------------------------------- words
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_RAND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.arange(256)
_LOW[65:91] += 32
_RAND_LOW = _RAND[_LOW]
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 1)
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW.insert(0, np.multiply.accumulate(p))
        del _POW[2:]
        _POW.reverse()
    return _POW[0], _POW[1]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs without white space, and each document's first word (plus the end)."""
    n = len(data)
    space = is_space(data)
    prev, nxt = np.ones(n, bool), np.ones(n, bool)
    prev[1:], nxt[:-1] = space[:-1], space[1:]
    inner = offs[(offs > 0) & (offs < n)]
    prev[inner], nxt[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & prev), np.flatnonzero(~space & nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the punctuation around them; a word of punctuation only becomes empty."""
    n = len(data)
    good = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    where = np.arange(n)
    before = np.maximum.accumulate(np.where(good, where, -1)) if n else where
    after = np.minimum.accumulate(np.where(good, where, n)[::-1])[::-1] if n else where
    return np.minimum(after[starts], ends), np.maximum(before[ends - 1] + 1, np.minimum(after[starts], ends))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words, lower-cased (A-Z) unless told otherwise; spans of up to ``CHUNK`` bytes at a time."""
    table = _RAND_LOW if lower else _RAND
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        pw, inv = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * pw[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every ``k``-word shingle; a shorter document is one shingle."""
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if len(h) >= k:
        c = np.uint64(0xD6E8FEB86659FD93)
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for t in range(k):
            acc = acc * c + h[t : t + len(acc)]
        ok = doc[: len(acc)] == doc[k - 1 :]
        docs, vals = doc[: len(acc)][ok], mix(acc[ok])
    else:
        docs, vals = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(few):
        extra = np.array([_short(h[first[i] : first[i + 1]]) for i in few], np.uint64)
        docs, vals = np.concatenate([docs, few]), np.concatenate([vals, extra])
    return docs, vals


def _short(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0xA0761D6478BD642F + v + 1) & (2**64 - 1)
    return int(mix(np.array([x], np.uint64))[0])


def sets(docs: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of ``n`` documents, ascending, as (values, offsets)."""
    order = np.argsort(vals)
    order = order[np.argsort(docs[order].astype(np.uint16) if n <= 65536 else docs[order], kind="stable")]
    d, v = docs[order], vals[order]
    if len(d):
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        d, v = d[keep], v[keep]
    return v, np.searchsorted(d, np.arange(n + 1))
