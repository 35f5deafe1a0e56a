"""Similarity join on distinct word n-grams: links of all pairs with a Jaccard of at least 3/4.

Documents with equal sets are one class, known by a 64-bit digest of the set; digests that two different sets share (told
apart by a second digest) are replaced. Rows of the class by n-gram incidence matrix are ordered by one global
order of the n-grams: rarest first, by the number of classes that hold them. Two sets that link share one of the first
``n - ceil(3n/4) + 1`` n-grams of each, so only that part of the matrix is multiplied, in blocks of n-gram columns;
an n-gram of one class alone makes no column, but takes a place in that part.

1. Counts. Entries (n-gram, class) travel as packed blocks, in ``SLICES`` passes to keep disk low, and come back to
   their class with the count if it is two or more. N-grams in more than about a thousandth of the
   documents (at most 1,024 times the mean set size of them) are counted beforehand, come last in the order, and
   are looked at only by classes that consist of little else.
2. Star rounds pair each class of a column with few leaders, the classes with the least share of n-grams of their own: enough
   to join up groups of near copies, with no more pairs than a few for each class.
3. Then, in columns with more than one component left, the classes outside the column's largest component are multiplied with all
   its others, tile by tile, and pairs beyond the size and position bounds are discarded.

For pairs of both kinds the overlap counts of their columns are accumulated, those that share fewer than two
linked sets of their sizes must are discarded, and the exact overlap of whole sets is counted for the rest. So no link
is lost and no copies are paired. Hashes of 64 bits stand for n-grams.

Defined results: a null or empty text, or one without words, has an empty set and no links; a text of
fewer words than ``k`` is one n-gram; equal rows get equal results, each its own row; a Jaccard of exactly 3/4 links; a very
long text is one set like any other; a null doc_id gets a component like any other but never names one, unless
no other is there (null); a repeated doc_id stands for all its rows' texts, each with its own component; extra columns are
ignored, whatever their names (kept by :func:`keep_one`); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C
from oreline.llm.graph import components as connected

SLICES = 3  #: passes over the n-grams when they are counted
BLOCK = 600_000  #: entries packed at a time
RUN = 2_000_000  #: n-grams counted at a time when frequent ones are looked for
FREQUENT_SHARE = 1024  #: an n-gram is frequent in one of so many documents
LEADERS = 4  #: leaders a class is compared with in a star round, at most
TILE = 1024  #: classes of a column in one tile of the product, about
SEND_IDS = 2_000_000  #: document ids sent to all executors, at most; more are joined


@dataclass(frozen=True)
class Sets:
    """N-gram sets of documents and the keys of their classes."""

    k: int = 5
    bits: int = 64  #: of the first digest; fewer only in tests
    twice: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  #: first digests of more than one set

    def digests(self, vals: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for seed in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(vals + np.uint64(seed)), dtype=np.uint64)])
            out.append(C.mix((sums[at[1:]] - sums[at[:-1]]) ^ np.diff(at).astype(np.uint64)))
        return out[0] >> np.uint64(64 - self.bits), out[1]

    def of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, offsets, class) of every document's set."""
        vals, at = C.sets(*C.shingles(data, offs, self.k), len(offs) - 1)
        one, two = self.digests(vals, at)
        if len(self.twice):
            one = np.where(np.isin(one, self.twice), two, one)
        return vals, at, one


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of ``n`` with any set it links with."""
    return -(-3 * n // 4)


def _first_of_class(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    return first & (np.diff(at) > 0)


# ---------------------------------------------------------------- counts and columns
def _frequent(docs: DataFrame, sets: Sets) -> np.ndarray:
    """N-grams of about a thousandth of the documents or more, rarest first, by lossy counting: all n-grams of all
    documents are counted, in runs of ``RUN`` values, and those seen under four times in a run are let go. Their number is
    bounded; they only shape the order, which any choice keeps correct."""
    ddl = T._parse_datatype_string("h long, n long")
    least = max(32, docs.count() // FREQUENT_SHARE)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            h = np.concatenate(held)
            held.clear()
            h.sort()
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(at, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[at[n > 3]].view(np.int64)), pa.array(n[n > 3])], ["h", "n"])

        for b in batches:
            for _, _, _, data, offs in C.chunks(b):
                vals, at, cls = sets.of(data, offs)
                held.append(vals[np.repeat(_first_of_class(cls, at), np.diff(at))])
                size += len(held[-1])
                if size > RUN:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    top = C.doc_bytes(docs).mapInArrow(C.lean(run), ddl).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return top.orderBy("n", "h").select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)


def _packed(keys: np.ndarray, cols: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows (part, entries) of entries dealt by the top bits of their keys."""
    part = (keys >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    cols = [c[order] for c in cols]
    some = np.flatnonzero(np.diff(cuts))
    blobs = [b"".join(c[cuts[i] : cuts[i + 1]].tobytes() for c in cols) for i in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])


def _unpacked(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of several packed blobs."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        m, at = len(blob) // width, 0
        for o, kind in zip(out, kinds, strict=True):
            o.append(np.frombuffer(blob, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds, strict=True)]


def _by_part(batches, names: tuple[str, ...]):
    """(part, list of rows of that part) of batches sorted by part."""
    part, held = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
        for i, p in enumerate(b.column(b.schema.get_field_index("part")).to_pylist()):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append([c[i] for c in cols])
    if held:
        yield part, held


def _count_slice(docs: DataFrame, sets: Sets, hot_b, slice_no: int, bits: int, parts: int) -> DataFrame:
    """Packed (class, n-gram, count) of the n-grams of one slice that two or more classes hold, by class."""
    packed = "part int, entries binary"

    def deal(batches):
        hot = np.sort(hot_b.value)
        held: list[tuple] = []
        size = 0

        def flush():
            h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            return _packed(h, [h, cls], bits)

        for b in batches:
            for _, _, _, data, offs in C.chunks(b):
                vals, at, cls = sets.of(data, offs)
                ok = np.repeat(_first_of_class(cls, at), np.diff(at)) & (vals % np.uint64(SLICES) == slice_no)
                if len(hot):
                    ok &= hot[np.minimum(np.searchsorted(hot, vals), len(hot) - 1)] != vals
                held.append((vals[ok], np.repeat(cls, np.diff(at))[ok]))
                size += len(held[-1][0])
                if size > BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            cls, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return _packed(cls, [cls, h, n], bits)

        for _, rows in _by_part(batches, ("entries",)):
            h, cls = _unpacked([r[0] for r in rows], [np.uint64, np.uint64])
            order = np.argsort(h)
            h = h[order]
            same = h[1:] == h[:-1]
            ok = np.zeros(len(h), bool)
            ok[1:] |= same
            ok[:-1] |= same
            h, cls = h[ok], cls[order[ok]]
            order = np.lexsort((cls, h))
            h, cls = h[order], cls[order]
            if len(h):
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])  # a class met in several blocks
                h, cls = h[new], cls[new]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(start, len(h)))
                n = np.repeat(n, n)
                held.append((cls[n > 1], h[n > 1], n[n > 1].astype(np.uint32)))
                size += len(held[-1][0])
            if size > BLOCK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    dealt = C.doc_bytes(docs).mapInArrow(C.lean(deal), packed)
    return C.materialize(C.by_part(dealt, bits, parts).mapInArrow(C.lean(count), packed), "jj-counts")


def classes(docs: DataFrame, sets: Sets, hot_b=None) -> DataFrame:
    """``__id``, n, cls, other (second digest) for every row, written; n_hot and hot: how many frequent n-grams the set has, and
    which, rarest first, where they are so many that they decide about links."""

    def run(ids, data, offs):
        vals, at, cls = sets.of(data, offs)
        n = np.diff(at)
        got = {"__id": ids, "n": n, "cls": cls.view(np.int64), "other": sets.digests(vals, at)[1].view(np.int64)}
        n_hot, hot = np.zeros(len(n), np.int64), [None] * len(n)
        rare_first = hot_b.value if hot_b is not None else np.zeros(0, np.uint64)
        if len(rare_first) and len(vals):
            rank = np.argsort(rare_first)
            i = np.minimum(np.searchsorted(rare_first, vals, sorter=rank), len(rank) - 1)
            is_hot = rare_first[rank[i]] == vals
            n_hot = np.diff(np.concatenate([[0], np.cumsum(is_hot)])[at])
            for d in np.flatnonzero(n_hot > needed(n) - 1).tolist():
                mine = rank[i[at[d] : at[d + 1]][is_hot[at[d] : at[d + 1]]]]
                hot[d] = rare_first[np.sort(mine)].tobytes()
        return got | {"n_hot": n_hot, "hot": hot}

    return C.materialize(C.map_chunks(docs, run, "__id long, n long, cls long, other long, n_hot long, hot binary"), "jj-classes")


def columns(docs: DataFrame, own: DataFrame, sets: Sets, hot_b) -> DataFrame:
    """The part of the incidence matrix that decides about links, written: ``h``, ``cls``, ``n`` (set size), ``p`` (place of the
    n-gram in the set's order), ``lone`` (share of n-grams that no other class has)."""
    parts = C.partitions(docs.sparkSession)
    bits = min(16, max(8, int(2 * parts - 1).bit_length()))
    counts = [_count_slice(docs, sets, hot_b, s, bits, parts) for s in range(SLICES)]
    none = F.lit(None).cast("binary")
    info = own.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("n_hot").alias("n_hot"), F.max("hot").alias("hot"))
    part = F.shiftrightunsigned("cls", 64 - bits).cast("int")
    rows = info.select(part.alias("part"), none.alias("entries"), "cls", "n", "n_hot", "hot")
    for c in counts:
        rows = rows.union(c.select("part", "entries", *(F.lit(None).cast(t) for t in ("long", "long", "long", "binary"))))

    def order(batches):
        for _, got in _by_part(batches, ("entries", "cls", "n", "n_hot", "hot")):
            known = [r for r in got if r[0] is None]
            cls, h, m = _unpacked([r[0] for r in got if r[0] is not None], [np.uint64, np.uint64, np.uint32])
            own_cls = np.array([r[1] for r in known], np.int64).view(np.uint64)
            by = np.argsort(own_cls)
            own_cls, n, n_hot = own_cls[by], np.array([r[2] for r in known], np.int64)[by], np.array([r[3] for r in known], np.int64)[by]
            d = np.searchsorted(own_cls, cls)
            shared = np.bincount(d, minlength=len(n))
            prefix, lone = n - needed(n) + 1, n - n_hot - shared
            o = np.lexsort((h, m, d))
            d, h = d[o], h[o]
            p = lone[d] + np.arange(len(d)) - np.concatenate([[0], np.cumsum(shared)])[d]
            keep = p < prefix[d]
            out = [(d[keep], h[keep], p[keep])]
            for i, j in enumerate(by.tolist()):
                if known[j][4] is not None:
                    v = np.frombuffer(known[j][4], np.uint64)
                    at = n[i] - len(v) + np.arange(len(v))
                    v = v[at < prefix[i]]
                    out.append((np.full(len(v), i), v, at[: len(v)]))
            d, h, p = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(own_cls[d].view(np.int64)), pa.array(n[d], pa.int32()), pa.array(p, pa.int32()), pa.array((lone / n)[d], pa.float32())],
                ["h", "cls", "n", "p", "lone"],
            )

    out = C.materialize(C.by_part(rows, bits, parts).mapInArrow(C.lean(order), "h long, cls long, n int, p int, lone float"), "jj-columns")
    C.release(*counts)
    return out


# ---------------------------------------------------------------- links
def links(docs: DataFrame, own: DataFrame, sets: Sets, hot_b) -> DataFrame:
    """Links (a, b) between classes, from which all links of ``docs`` follow in the transitive sense. ``own``: the written
    result of :func:`classes`."""
    every = columns(docs, own, sets, hot_b)
    counted = every.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")  # frequent ones may stand alone
    block = C.materialize(every.join(counted, "h", "left_semi"), "jj-block")
    C.release(every)
    values = _fetch(docs, own, block.select("cls").distinct(), sets)

    found = tried = None
    rest = block.select("*", F.col("cls").alias("root"), F.lit(None).cast("long").alias("main"))
    for _ in range(2):
        # a leader is of another component than the column's largest one, where that is known
        lead = F.struct(F.coalesce(F.col("root") == F.col("main"), F.lit(False)), "lone", "cls")
        leaders = C.materialize(rest.groupBy("h").agg(F.min_by(F.struct("n", "cls", "root"), lead).alias("l")), "jj-lead")
        stars = rest.join(leaders, "h").where(F.col("root") != F.col("l.root"))
        stars = stars.select(F.col("l.cls").alias("a"), F.col("cls").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb"))
        stars = stars.where(F.least("na", "nb") >= _overlap()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
        best = stars.groupBy("b").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("c", "a")))), 1, LEADERS).alias("s"))
        best = best.select("b", F.explode("s.a").alias("a"))
        pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = C.materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jj-stars")
        more = _verify(_plausible(pairs, block), values)
        found, tried = (more, pairs) if found is None else (found.union(more), tried.union(pairs))
        C.release(leaders)
        roots = C.materialize(connected(found), "jj-roots")
        marked = block.join(roots, block["cls"] == roots["node"], "left").select(*block.columns, F.coalesce("root", "cls").alias("root"))
        sizes = marked.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
        opened = sizes.groupBy("h").agg(F.sum("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("r")).where("r > 1")
        before, rest = rest, C.materialize(marked.join(C.materialize(opened.drop("r"), "jj-open"), "h"), "jj-rest")
        C.release(roots)
        if "m" in before.columns:
            C.release(before)

    # product, in the columns that are left: classes outside the column's largest component go to all its tiles,
    # every class of the column is in one tile of its own
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    out = F.col("root") != F.col("main")
    place = F.when(out, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.col("own")))
    tiled = rest.withColumn("own", F.pmod(F.xxhash64("cls"), tiles).cast("int")).select("h", "cls", "n", "p", "root", "own", out.alias("out"), F.explode(place).alias("tile"))
    dealt = tiled.repartition(C.partitions(docs.sparkSession), "h", "tile").sortWithinPartitions("h", "tile")
    pairs = dealt.mapInArrow(C.lean(_tile_product), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = C.materialize(pairs, "jj-pairs")
    out = C.materialize(found.union(_verify(_plausible(pairs, block), values)), "jj-links")
    C.release(rest, block, values)
    return out


def _overlap() -> F.Column:
    """Least overlap of two linked sets of ``na`` and ``nb``."""
    return F.expr("(3 * (cast(na as long) + nb) + 6) div 7")


def _plausible(pairs: DataFrame, block: DataFrame) -> DataFrame:
    """The pairs (a < b, distinct) whose overlap count, accumulated over the columns of the block, is what two linked sets of
    their sizes must have there. An overlap of ``o`` leaves out ``n - o`` of a set's n-grams, so of the part that ends first in
    the order all but as many are shared, and lie in the other part too."""
    x = pairs.join(block.select(F.col("cls").alias("a"), "h", F.col("n").alias("na")), "a").join(block.select(F.col("cls").alias("b"), "h", F.col("n").alias("nb")), ["b", "h"])
    counts = x.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count(F.lit(1)).alias("c"))
    prefix = lambda n: F.expr(f"{n} - (3 * {n} + 3) div 4 + 1")
    least = F.least(prefix("na") - F.col("na"), prefix("nb") - F.col("nb")) + _overlap()
    return C.materialize(counts.where(F.col("c") >= least).select("a", "b"), "jj-plausible")


def _fetch(docs: DataFrame, own: DataFrame, members: DataFrame, sets: Sets) -> DataFrame:
    """``cls`` and ``vals`` (ascending hashes as bytes) of each class in ``members``, written."""
    reps = own.groupBy("cls").agg(F.min("__id").alias("rep")).join(members, "cls", "left_semi")
    reps = C.materialize(reps.select(F.col("rep").alias("__rep")).distinct(), "jj-reps")
    reps = F.broadcast(reps) if reps.count() <= SEND_IDS else reps
    d = C.doc_bytes(docs).join(reps, F.col("__id") == F.col("__rep"), "left_semi")
    ddl = T._parse_datatype_string("cls long, vals binary")
    schema = C._arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for _, _, _, data, offs in C.chunks(b):
                vals, at, cls = sets.of(data, offs)
                raw = vals.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls.view(np.int64)), pa.array([raw[8 * a : 8 * z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
                    schema=schema,
                )

    return C.materialize(d.mapInArrow(C.lean(run), ddl).join(members, "cls", "left_semi").groupBy("cls").agg(F.first("vals").alias("vals")), "jj-sets")


def _verify(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs (written) that link, by the overlap of their whole sets."""
    left = values.select(F.col("cls").alias("b"), F.col("vals").alias("vb"))
    right = values.select(F.col("cls").alias("a"), F.col("vals").alias("va"))
    ddl = T._parse_datatype_string("a long, b long")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                va = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                vb = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                inter = np.array([np.intersect1d(x, y, assume_unique=True).size for x, y in zip(va, vb, strict=True)], np.int64)
                total = np.array([len(x) + len(y) for x, y in zip(va, vb, strict=True)], np.int64) - inter
                ok = 100 * inter >= 75 * total
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return C.materialize(pairs.join(left, "b").join(right, "a").select("a", "b", "va", "vb").mapInArrow(C.lean(run), ddl), "jj-links")


def _tile_product(batches):
    """Products of tiles: pairs of a class outside the column's largest component with the tile's own classes, of different
    components, that may link by size and by the place of the column in both orders. Two sets that link pass in the
    first column they share, as all before it are lost to their overlap."""
    names = ("cls", "n", "p", "root", "own", "out")
    rest: list[np.ndarray] | None = None
    for b in _then_end(batches):
        if b is not None:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "tile", *names)]
            rest = cols if rest is None else [np.concatenate(z) for z in zip(rest, cols, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        h, tile = rest[:2]
        edge = np.flatnonzero((h[1:] != h[:-1]) | (tile[1:] != tile[:-1])) + 1
        cuts = np.concatenate([[0], edge, [len(h)]] if b is None else [[0], edge])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            cls, n, p, root, own, out = (c[lo:hi] for c in rest[2:])
            n, p = n.astype(np.int64), p.astype(np.int64)
            mine = np.flatnonzero(own == tile[lo])
            for block in np.array_split(np.flatnonzero(out), max(1, hi - lo >> 10)):
                i, j = np.repeat(block, len(mine)), np.tile(mine, len(block))
                need = (3 * (n[i] + n[j]) + 6) // 7
                ok = (root[i] != root[j]) & (~out[j] | (cls[i] < cls[j])) & (np.minimum(n[i] - p[i], n[j] - p[j]) >= need)
                i, j = i[ok], j[ok]
                if len(i):
                    pairs = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        rest = [c[cuts[-1] :] for c in rest]


def _then_end(batches):
    """The batches, and None when they are over."""
    yield from batches
    yield None


def _grouped(docs: DataFrame, k: int, bits: int) -> tuple[DataFrame, DataFrame, Sets]:
    """The written classes of all rows, and for each class that is not empty its least real id ``rep`` and its ``root``."""
    sets = Sets(k, bits)
    hot_b = docs.sparkSession.sparkContext.broadcast(_frequent(docs, sets))
    own = classes(docs, sets, hot_b)
    twice = own.groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("cls").collect()
    if twice:  # of 10^10 sets, about three pairs share a digest
        sets = Sets(k, bits, np.array([r["cls"] for r in twice], np.int64).view(np.uint64))
        C.release(own)
        own = classes(docs, sets, hot_b)
    roots = connected(links(docs, own, sets, hot_b))
    reps = own.where("n > 0").groupBy("cls").agg(F.min(_real()).alias("rep"))
    return own, C.materialize(reps.join(roots, reps["cls"] == roots["node"], "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "jj-reps"), sets


def _real() -> F.Column:
    return F.when(F.col("__id") != C.NULL_ID, F.col("__id"))


def components(docs: DataFrame, k: int = 5, bits: int = 64) -> DataFrame:
    """``__id``, n_shingles, component_id for every row of ``docs``."""
    own, reps, _ = _grouped(docs, k, bits)
    comp = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = C.materialize(reps.join(comp, "root").select(F.col("cls").alias("__cls"), "component_id"), "jj-comp")
    got = own.join(table, own["cls"] == table["__cls"], "left")
    return got.select("__id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(_real()).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with one row of each group of linked rows: of those with the least doc_id, one of the least class (a row with
    a null id only if its group has no other). Rows with an empty set all stay. An id decides for its rows where all of
    them stay or go; those of the other ids (null or repeated) are decided by id and class."""
    own, reps, sets = _grouped(docs, k, 64)
    first = reps.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "cls")).alias("f"))
    first = C.materialize(first.select(F.coalesce("f.rep", F.lit(C.NULL_ID)).alias("__id"), F.col("f.cls").alias("cls")), "jj-first")
    pairs = own.groupBy("__id", "cls").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    pairs = pairs.join(first.withColumn("first", F.lit(1)), ["__id", "cls"], "left")
    stay = F.when(F.col("n") == 0, F.col("rows")).otherwise(F.coalesce("first", F.lit(0)))
    ids = pairs.groupBy("__id").agg(F.sum("rows").alias("rows"), F.sum(stay).alias("stay")).where("stay < rows")
    ids = C.materialize(ids.select("__id", (F.col("stay") > 0).alias("some")), "jj-gone")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("__id"), C.row(docs).alias("__row"))
    whole = keyed.join(ids, "__id", "left_anti").select("__row.*")
    some = ids.where("some").select("__id")
    if some.isEmpty():
        return whole
    mixed = C.materialize(_with_class(keyed.join(some, "__id", "left_semi"), sets), "jj-mixed")
    one = mixed.where("__n > 0").join(first, (mixed["__id"] == first["__id"]) & (mixed["__cls"] == first["cls"]), "left_semi")
    one = one.groupBy("__id", "__cls").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
    return whole.union(mixed.where("__n = 0").select("__row.*")).union(one)


def _with_class(keyed: DataFrame, sets: Sets) -> DataFrame:
    """``__id``, ``__row`` with the size and class of each row's set."""
    got = keyed.select("__id", F.coalesce(F.col("__row.text").cast("string"), F.lit("")).cast("binary").alias("__text"), "__row")
    ddl = T.StructType([keyed.schema["__row"], *T._parse_datatype_string("__id long, __n long, __cls long").fields])

    def run(batches):
        for b in batches:
            for lo, hi, ids, data, offs in C.chunks(b):
                _, at, cls = sets.of(data, offs)
                row = b.column(b.schema.get_field_index("__row")).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([row, pa.array(ids), pa.array(np.diff(at).astype(np.int64)), pa.array(cls.view(np.int64))], ["__row", "__id", "__n", "__cls"])

    return got.mapInArrow(C.lean(run), ddl)
