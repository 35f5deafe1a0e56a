"""Removal of repeated byte strings: every byte covered by a ``size``-byte string that also starts earlier.

1. Every ``size``-byte window has an anchor, the least hash among the ``GRAM``-byte strings in it,
   so equal windows have equal anchors. A run of windows with one anchor is a fragment.
2. Anchors that occur once cannot belong to a repeated window; their fragments go no further.
3. Equal fragments are one row with their first occurrence. Fragments with one anchor meet in a
   block of bounded size, whose suffix array (induced sorting) and permuted common prefixes give the
   classes of equal windows; all but the first window of a class are repeated. An anchor with
   more than ``BLOCK_ROWS`` different fragments is dealt over several blocks; windows that are
   first in their block are then compared across blocks by digest.
4. Every occurrence of a fragment but the first is repeated as a whole.

Which bytes go where: a fragment's windows are told apart by its block's suffix array; whole equal fragments are one row
by two 64-bit hashes of their bytes from different seeds before that, so that exact copies, however many, make no large block.

Windows never cross documents. Positions are ordered by (doc_id, start). Defined results: a null or
empty text has nothing to remove; texts shorter than ``size`` stay whole; rows that repeat a
doc_id do not come before each other, so neither removes the other; a null doc_id comes before all
others; extra columns are ignored, whatever their names (kept by :func:`rewrite`); an empty table gives an empty result. The bytes of a very long
text are looked at in overlapping pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C
from oreline.llm.suffix_array import common_prefixes, suffix_array

SIZE = 100
GRAM = 40
BLOCK_BYTES = 5_000_000  #: text in one suffix array, about
BLOCK_ROWS = 16_000  #: different fragments of one anchor in one block
PIECE = 1 << 19
_TOP = ~np.uint64(0x3FFFFF)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every position, built from hashes of power-of-two lengths."""
    base, n = int(C._BASE), len(data) - k + 1
    pw = lambda m: np.uint64(pow(base, m, 2**64))
    power, at, h, out = 1, 0, C._RAND[data], None
    while True:
        if k & power:
            out = h[at : at + n].copy() if out is None else out * pw(power) + h[at : at + n]
            at += power
        power *= 2
        if power > k:
            return C.mix(out)
        h = h[: -(power // 2)] * pw(power // 2) + h[power // 2 :]


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, offs: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(document, anchor hash, first window, windows) of every run of windows with one anchor."""
    found = []
    for lo in range(0, max(len(data) - size + 1, 0), PIECE):
        part = data[lo : lo + PIECE + size - 1]
        if len(part) < size:
            break
        g = _grams(part, gram)
        at = np.arange(len(g), dtype=np.uint64)
        best = (_slide_min((g & _TOP) | at, size - gram + 1) & ~_TOP).astype(np.int64)
        p = np.arange(len(best), dtype=np.int64) + lo
        doc = np.searchsorted(offs, p, "right") - 1
        inside = p + size <= offs[doc + 1]
        new = np.ones(len(p), bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        s = np.flatnonzero(new)
        count = np.diff(np.append(s, len(p)))
        ok = inside[s]
        s, count = s[ok], count[ok]
        d = doc[s]
        found.append((d, g[best[s]].view(np.int64), p[s] - offs[d], count))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _key(docs: DataFrame) -> F.Column:
    """A key for the id and the text of a row: the id itself, where no two rows have the same."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID))
    repeated = docs.select(number.alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return number if repeated.isEmpty() else F.xxhash64(number, F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``__doc`` (the id), ``__id`` (the key of :func:`_key`) and ``__text``."""
    return C.doc_bytes(docs, _key(docs).alias("__key")).select(F.col("__id").alias("__doc"), F.col("__key").alias("__id"), "__text")


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    ddl = T._parse_datatype_string(schema)
    out = C._arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for r0, r1, ids, data, offs in C.chunks(b):
                got = fn(b, r0, r1, ids, data, offs)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(C.lean(run), ddl)


def spans(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """``__id`` (key of :func:`_keyed`, whose rows are given) and ``spans``, the array of its repeated ranges (lo, hi), unordered."""
    spark = keyed.sparkSession
    parts = C.partitions(spark)

    def count(b, r0, r1, ids, data, offs):
        h, n = np.unique(runs(data, offs, size)[1], return_counts=True)
        return {"h": h, "n": n}

    repeated = _map(keyed, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2").select("h")
    repeated = C.materialize(repeated, "sa-anchors")

    def places(b, r0, r1, ids, data, offs):
        d, h, s, w = runs(data, offs, size)
        return {"h": h, "__id": ids[d], "s": s.astype(np.int32), "w": w.astype(np.int32)}

    cand = _map(keyed, places, "h long, __id long, s int, w int").join(repeated, "h", "left_semi")
    cand = C.materialize(cand.groupBy("__id").agg(F.collect_set(F.struct("h", "s", "w")).alias("c")), "sa-places")

    def cut(b, r0, r1, ids, data, offs):
        c = b.column(b.schema.get_field_index("c")).slice(r0, r1 - r0)
        flat, counts = c.flatten(), np.diff(c.offsets.to_numpy())
        d = np.repeat(np.arange(r1 - r0), counts)
        h, s, w = (flat.field(i).to_numpy() for i in range(3))
        lo = offs[d] + s
        raw = data.tobytes()
        frag = [raw[a:z] for a, z in zip(lo.tolist(), (lo + w + size - 1).tolist(), strict=True)]
        doc = b.column(b.schema.get_field_index("__doc")).to_numpy()[r0:r1]
        return {"h": h, "frag": frag, "doc": doc[d], "__id": ids[d], "s": s, "w": w}

    occ = _map(keyed.join(cand, "__id"), cut, "h long, frag binary, doc long, __id long, s int, w int")
    # f1 and f2 are hashes of the same bytes from different seeds, 128 bits together
    occ = C.materialize(occ.withColumns({"f1": F.xxhash64("frag"), "f2": F.xxhash64(F.lit(7), "frag")}), "sa-occ")
    C.release(cand, repeated)
    frags = occ.groupBy("h", "f1", "f2").agg(
        F.min(F.struct("doc", "s")).alias("first"), F.max("frag").alias("frag"), F.count(F.lit(1)).alias("n")
    )
    frags = C.materialize(frags, "sa-frags")
    groups = C.materialize(frags.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m >= 2"), "sa-groups")
    multi = frags.join(groups, "h").withColumn("salt", F.pmod(F.col("f1"), F.ceil(F.col("m") / BLOCK_ROWS)).cast("int"))
    multi = multi.select("h", "salt", "f1", "f2", "frag", F.col("first.doc").alias("doc"), F.col("first.s").alias("s"), (F.col("m") > BLOCK_ROWS).alias("hot"))
    arrays = multi.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(C.lean(_blocks(size)), _BLOCK_DDL)
    arrays = C.materialize(arrays, "sa-blocks")
    # windows of hot anchors that are first in their block
    across = arrays.where("hot").select("h", "f1", "f2", "doc", "s", F.explode("left").alias("x")).select("h", "f1", "f2", "doc", (F.col("s") + F.col("x.j")).alias("p"), "x.*")
    least = across.groupBy("h", "d1", "d2").agg(F.min(F.struct("doc", "p")).alias("least"))
    late = across.join(least, ["h", "d1", "d2"]).where(F.struct("doc", "p") > F.col("least"))
    late = late.groupBy("h", "f1", "f2").agg(F.collect_list(F.struct(F.col("j").alias("lo"), (F.col("j") + size).cast("int").alias("hi"))).alias("more"))
    inner = arrays.join(late, ["h", "f1", "f2"], "left").select("h", "f1", "f2", F.concat("dup", F.coalesce("more", F.array().cast("array<struct<lo:int,hi:int>>"))).alias("dup"))
    known = frags.select("h", "f1", "f2", "first", "n").join(inner, ["h", "f1", "f2"], "left").where("n >= 2 or size(dup) > 0")
    known = C.materialize(known, "sa-known")
    C.release(frags, groups, arrays)
    gone = occ.select("h", "f1", "f2", "doc", "__id", "s", "w").join(known, ["h", "f1", "f2"])
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("w") + size - 1).cast("int").alias("hi")))
    own = F.struct("doc", "s") == F.col("first")
    ranges = F.when(own, F.coalesce("dup", F.array().cast("array<struct<lo:int,hi:int>>"))).otherwise(whole)
    gone = gone.select("__id", F.explode(ranges).alias("x"), "s").select("__id", (F.col("s") + F.col("x.lo")).alias("lo"), (F.col("s") + F.col("x.hi")).alias("hi"))
    found = C.materialize(gone.groupBy("__id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "sa-spans")
    C.release(occ, known)
    return found


_BLOCK_DDL = "h long, f1 long, f2 long, doc long, s int, hot boolean, dup array<struct<lo:int,hi:int>>, left array<struct<j:int,d1:long,d2:long>>"


def _blocks(size: int):
    """Suffix arrays over blocks of fragments; rows arrive ordered by anchor and block."""
    schema = C._arrow_schema(T._parse_datatype_string(_BLOCK_DDL))
    pair, window = schema.field("dup").type, schema.field("left").type

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        frag = col["frag"]
        offs = np.frombuffer(frag.buffers()[1], np.int32)[frag.offset : frag.offset + len(frag) + 1]
        data = np.frombuffer(frag.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs.astype(np.int64) - offs[0]
        at, lo, hi, late = repeated_windows(data, offs, col["doc"].to_numpy(), col["s"].to_numpy(), size)
        dup = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], fields=list(pair.value_type)), type=pair)
        left: list[list] = [[] for _ in range(len(frag))]
        for i in np.flatnonzero(col["hot"].to_numpy(zero_copy_only=False)).tolist():
            text = data[offs[i] : offs[i + 1]].tobytes()
            for j in np.flatnonzero(~late[offs[i] : offs[i + 1] - size + 1]).tolist():
                x = hashlib.blake2b(text[j : j + size], digest_size=16).digest()
                left[i].append({"j": j, "d1": int.from_bytes(x[:8], "little", signed=True), "d2": int.from_bytes(x[8:], "little", signed=True)})
        arrays = [col["h"], col["f1"], col["f2"], col["doc"], col["s"], col["hot"], dup, pa.array(left, window)]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def cut(rows: list[pa.RecordBatch], over: bool):
        """Blocks of whole groups, and the rows that are not yet a block."""
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        h, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
        size_of = np.cumsum(pa.compute.binary_length(b.column(b.schema.get_field_index("frag"))).to_numpy())
        ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1  # groups known to be over
        ends = np.append(ends, len(h)) if over else ends
        at, blocks = 0, []
        while at < len(h):
            want = (size_of[at - 1] if at else 0) + BLOCK_BYTES
            i = np.searchsorted(ends, max(at + 1, np.searchsorted(size_of, want) + 1))
            if i == len(ends):
                if not over:
                    break
                i -= 1
            blocks.append(b.slice(at, int(ends[i]) - at))
            at = int(ends[i])
        return blocks, [b.slice(at)] if at < len(h) else []

    def run(batches):
        import pyarrow.compute  # noqa: F401

        rows: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                held += b.nbytes
            if held >= 2 * BLOCK_BYTES:
                blocks, rows = cut(rows, False)
                yield from map(emit, blocks)
                held = sum(r.nbytes for r in rows)
        if rows:
            yield from map(emit, cut(rows, True)[0])

    return run


def repeated_windows(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, start: np.ndarray, size: int):
    """For fragments (bytes and offsets) whose first occurrences are at (doc, start): the ranges covered by windows that
    start earlier elsewhere, as (offsets by fragment, lo, hi); and a flag for every byte at which such a window starts."""
    base = len(offs) - 1
    lens = np.diff(offs)
    starts = offs[:-1] + np.arange(base)
    text = np.empty(len(data) + base, np.int32)
    inside = np.ones(len(text), bool)
    inside[starts + lens] = False
    text[~inside] = np.arange(base)  # separators differ, so nothing shared runs over an end
    text[inside] = data
    text[inside] += base
    sa = suffix_array(text, base + 256)
    shared = common_prefixes(text, sa)
    owner = np.repeat(np.arange(base, dtype=np.int32), lens + 1)
    off = np.arange(len(text), dtype=np.int32) - starts[owner].astype(np.int32)
    window = off + size <= lens[owner]
    ranked = sa[window[sa]]
    klass = np.cumsum(shared[ranked] < size)
    # the least occurrence of each class: fragments by (doc, start), then the offset
    order = np.lexsort((start, doc))
    place = np.empty(base, np.int64)
    new = np.ones(base, bool)
    new[1:] = doc[order][1:] != doc[order][:-1]
    place[order] = np.cumsum(new)  # documents, densely numbered
    key = place[owner[ranked]] * (np.int64(1) << 34) + start[owner[ranked]] + off[ranked]
    late = np.zeros(len(text), bool)
    if len(ranked):
        head = np.flatnonzero(np.append(True, klass[1:] != klass[:-1]))
        least = np.minimum.reduceat(key, head)
        late[ranked] = key != np.repeat(least, np.diff(np.append(head, len(key))))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], late, [False]]).view(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    frag = owner[lo] if len(lo) else np.zeros(0, np.int32)
    at = np.searchsorted(frag, np.arange(base + 1))
    return at, lo - starts[frag], hi - 1 + size - starts[frag], late[inside]


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by half-open ranges (touching ranges are one)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


def _kept(b, r0: int, r1: int, data: np.ndarray, offs: np.ndarray):
    """Per row of a chunk with a ``spans`` column: (kept bytes, removed bytes, removed runs)."""
    c = b.column(b.schema.get_field_index("spans")).slice(r0, r1 - r0)
    flat, at = c.flatten(), np.concatenate([[0], np.cumsum([0 if v is None else v for v in pa.compute.list_value_length(c).to_pylist()])]).astype(int)
    los, his = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    raw = data.tobytes()
    for i in range(r1 - r0):
        text = raw[offs[i] : offs[i + 1]]
        if at[i] == at[i + 1]:
            yield text, 0, 0
            continue
        lo, hi = merge(los[at[i] : at[i + 1]], his[at[i] : at[i + 1]])
        cuts = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(text)]]).tolist()
        yield b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)), int((hi - lo).sum()), len(lo)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: ``__doc``, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow.compute  # noqa: F401

    def run(b, r0, r1, ids, data, offs):
        kept = list(_kept(b, r0, r1, data, offs))
        return {
            "__doc": b.column(b.schema.get_field_index("__doc")).to_numpy()[r0:r1],
            "n_bytes": np.diff(offs),
            "n_removed": [x[1] for x in kept],
            "n_spans": [x[2] for x in kept],
            "kept_sha256": [hashlib.sha256(x[0]).hexdigest() for x in kept],
        }

    keyed = _keyed(docs)
    return _map(keyed.join(spans(keyed, size), "__id", "left"), run, "__doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def rewrite(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text`` (and ``n_chars`` counted again, where there
    is such a column); a character that lost some of its bytes goes as a whole, and so does a document
    of which nothing is left. A text without repeats, null or empty included, is returned as it is."""
    import pyarrow.compute  # noqa: F401

    keyed = _keyed(docs)
    whole = docs.select(_key(docs).alias("__id"), C.row(docs).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("__text"))
    joined = whole.join(spans(keyed, size), "__id", "left")
    ddl = T.StructType([joined.schema["__row"], T.StructField("__new", T.StringType()), T.StructField("__cut", T.LongType())])
    out = C._arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for r0, r1, _, data, offs in C.chunks(b):
                kept = list(_kept(b, r0, r1, data, offs))
                row = b.column(b.schema.get_field_index("__row")).slice(r0, r1 - r0)
                new = pa.array([x[0].decode("utf-8", "ignore") for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([row.cast(out.field(0).type), new, pa.array([x[1] for x in kept], pa.int64())], schema=out)

    cut = joined.mapInArrow(C.lean(run), ddl).where("not (__cut > 0 and __new = '')")
    changed = F.col("__cut") > 0

    def column(name: str) -> F.Column:
        old = F.col("__row").getField(name)
        if name == "text":
            return F.when(changed, F.col("__new")).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        if name == "n_chars":
            return F.when(changed, F.length("__new")).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old.alias(name)

    return cut.select(*map(column, docs.columns))
