"""Benchmark decontamination by greedy string tiling.

Word hashes of the benchmark's ``seed``-word strings are looked up in every document; items that share seeds with
it, enough of them to reach the threshold, are its candidates. Each candidate pair is tiled: the longest
common strings of words not yet marked are searched for by running Karp-Rabin hashes and marked, again and again down to
``seed`` words, so passages are found in whatever order they stand. The marked share of the item's words is its coverage.

A benchmark of at most ``BLOCK_SEEDS`` words goes to all executors. A larger one stays on disk, and its seeds are joined
with the documents': an item that leaks shares so many of its seeds that some of its rarest ones are among them, so only those
are joined, and a filter of bounded size keeps most of the documents' other strings from being shuffled at all.

Words are compared without case (A-Z) and without punctuation at their ends. Defined results: null or empty texts and
items have no words and leak nothing; an item shorter than ``seed`` words is looked for as a whole; of matches of equal length the
one that starts first in the document, then in the item, is marked first; repeated rows each get their own results; a null doc_id or
item_id stays null; extra columns, whatever their names, are ignored by :func:`leaks` and kept by :func:`clean`; empty
tables give empty results; long texts are searched whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C

SEED = 4  #: least words of a tile
THRESHOLD = 0.5  #: coverage from which an item counts as leaked
BLOCK_SEEDS = 1_000_000  #: words of a benchmark that is sent to all executors, at most
FILTER_BITS = 27  #: size of the filter of a larger benchmark's seeds


# ---------------------------------------------------------------- tiling
def _windows(words: list[int], marked: list[bool], s: int):
    """(start, hash) of all windows of ``s`` unmarked words, by a rolling Karp-Rabin hash."""
    base, mask = 0x100000001B3, (1 << 64) - 1
    top = pow(base, s - 1, 1 << 64)
    h = n = 0
    for i, w in enumerate(words):
        if marked[i]:
            h = n = 0
            continue
        if n == s:
            h = (h - words[i - s] * top) & mask
            n -= 1
        h = (h * base + w) & mask
        n += 1
        if n == s:
            yield i - s + 1, h


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles of two word sequences, by their start in b."""
    ma, mb = [False] * len(a), [False] * len(b)
    found: list[tuple[int, int, int]] = []
    s = max(least, min(len(a), len(b)) // 2)
    while True:
        at = defaultdict(list)
        for i, h in _windows(a, ma, s):
            at[h].append(i)
        heap: list[tuple[int, int, int]] = []
        longest = 0
        for j, h in _windows(b, mb, s):
            for i in at.get(h, ()):
                if i and j and a[i - 1] == b[j - 1] and not ma[i - 1] and not mb[j - 1]:
                    continue  # inside a longer match
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k >= s:
                    heap.append((-k, i, j))
                    longest = max(longest, k)
        if longest > 2 * s:  # much longer than looked for: begin there
            s = longest
            continue
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            run = 0
            for n in range(-k + 1):  # what is left of it, if a part has been marked since
                if n < -k and not ma[i + n] and not mb[j + n]:
                    run += 1
                    continue
                if run == -k:
                    ma[i : i + run] = mb[j : j + run] = [True] * run
                    found.append((i, j, run))
                elif run >= s:
                    heapq.heappush(heap, (-run, i + n - run, j + n - run))
                run = 0
        if s == least:
            return sorted(found, key=lambda t: t[1])
        s = max(least, s // 2)


# ---------------------------------------------------------------- seeds
def _seeds(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of all ``k``-word strings."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) < k:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for t in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[t : t + len(acc)]
    ok = np.flatnonzero(doc[: len(acc)] == doc[k - 1 :])
    return doc[ok], ok - first[doc[ok]], C.mix(acc[ok])


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of all documents; words of punctuation only are left out."""
    starts, ends, _ = C.words(data, offs)
    s, e = C.trim(data, starts, ends) if len(starts) else (starts, ends)
    keep = e > s
    s, e = s[keep], e[keep]
    return C.word_hashes(data, s, e), np.searchsorted(s, offs)


class Block:
    """A part of the benchmark: items as word hashes, and where each seed occurs."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], seed: int):
        self.ids = [i for i, _ in items]
        self.words = [w.tolist() for _, w in items]
        self.seed = seed
        n = np.array([len(w) for _, w in items])
        self.n = n
        flat = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        per = defaultdict(list)  # an item shorter than a seed is a seed of its own length
        for i, k in enumerate(np.minimum(n, seed).tolist()):
            if k:
                per[k].append(i)
        self.tables = {}
        for k, members in per.items():
            d, p, h = _seeds(flat, first, k)
            ok = np.isin(d, members)
            d, p, h = d[ok], p[ok], h[ok]
            order = np.argsort(h, kind="stable")
            self.tables[k] = (h[order], d[order], p[order])

    def candidates(self, h: np.ndarray, first: np.ndarray, threshold: float):
        """(document, item) pairs whose shared seeds cover enough of the item."""
        for k, (seeds, item, pos) in self.tables.items():
            d, _, v = _seeds(h, first, k)
            i = np.searchsorted(seeds, v)
            hit = (i < len(seeds)) & (seeds[np.minimum(i, len(seeds) - 1)] == v)
            if not hit.any():
                continue
            pair = np.unique(np.stack([d[hit].astype(np.uint64), v[hit]]), axis=1)
            d, v = pair[0].astype(np.int64), pair[1]
            lo, hi = np.searchsorted(seeds, v, "left"), np.searchsorted(seeds, v, "right")
            times = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
            docs, items, places = np.repeat(d, times), item[at], pos[at]
            width = int(self.n.max()) + 1
            cover = (((docs * len(self.n) + items) * width + places)[:, None] + np.arange(k)).ravel()
            cover = np.unique(cover) // width
            both, covered = np.unique(cover, return_counts=True)
            ok = covered >= threshold * self.n[both % len(self.n)]
            for x in both[ok].tolist():
                yield divmod(x, len(self.n))


def _items(benchmark: DataFrame) -> DataFrame:
    """The benchmark as a written table: no (tells its rows apart), item_id, words (hashes), n."""
    ddl = T._parse_datatype_string("no long, item_id long, words binary, n long")

    def run(batches):
        for b in batches:
            no = b.column(b.schema.get_field_index("__no")).to_numpy()
            for r0, r1, ids, data, offs in C.chunks(b):
                h, first = _words(data, offs)
                words = [h[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(no[r0:r1]), pa.array(ids), pa.array(words, pa.binary()), pa.array(np.diff(first).astype(np.int64))], ["no", "item_id", "words", "n"])

    rows = C.doc_bytes(benchmark, F.monotonically_increasing_id().alias("__no"), id_col="item_id").mapInArrow(C.lean(run), ddl)
    return C.materialize(rows.withColumn("item_id", C.back("item_id")).where("n > 0"), "bench-items")


def _found(block: Block, data: np.ndarray, offs: np.ndarray, threshold: float):
    """(row, item number, tiles) of leaks in a chunk."""
    h, first = _words(data, offs)
    for d, i in sorted(block.candidates(h, first, threshold)):
        t = tiles(h[first[d] : first[d + 1]].tolist(), block.words[i], min(block.seed, len(block.words[i])))
        if sum(n for _, _, n in t) >= threshold * len(block.words[i]):
            yield d, i, t


def _block(items: DataFrame, seed: int) -> Block | None:
    """The benchmark as a table to send to executors; None if it is too large for that."""
    if (items.agg(F.sum("n").alias("n")).first()["n"] or 0) > BLOCK_SEEDS:
        return None
    return Block([(r["item_id"], np.frombuffer(r["words"], np.uint64)) for r in items.orderBy("no").collect()], seed)


# ---------------------------------------------------------------- seeds joined on disk
def _telling(items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """h, no: the rarest seeds of each item, so many that an item that leaks shares one of them. Tiles that cover ``m`` words hold
    ``m / k`` seeds of ``k`` words at least, so all but one less than that may be left out."""
    def run(batches):
        for b in batches:
            out = []
            for no, words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k = min(n, seed)
                h, times = np.unique(_seeds(np.frombuffer(words, np.uint64), np.array([0, n]), k)[2], return_counts=True)
                out.append((np.full(len(h), no), h.view(np.int64), times, np.full(len(h), n - k + 1 - max(1, -int(-threshold * n // k)) + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, ["no", "h", "times", "keep"])

    seeds = C.materialize(items.select("no", "words", "n").mapInArrow(C.lean(run), "no long, h long, times long, keep long"), "bench-seeds")
    common = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    w = W.partitionBy("no").orderBy("items", "h").rowsBetween(W.unboundedPreceding, 0)
    ranked = seeds.join(common, "h").withColumn("before", F.sum("times").over(w) - F.col("times"))
    return C.materialize(ranked.where("before < keep").select("h", "no"), "bench-telling")


def _filter(telling: DataFrame) -> np.ndarray:
    """``2 ** FILTER_BITS`` bits, those of the seeds' hashes set; each of 1,024 parts is built by one task."""
    part = FILTER_BITS - 10
    low = F.pmod("h", F.lit(1 << FILTER_BITS))
    rows = telling.select(F.shiftright(low, part).cast("int").alias("part"), F.pmod(low, F.lit(1 << part)).alias("at")).distinct()

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            parts, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(parts).tolist():
                held.setdefault(p, np.zeros(1 << part, bool))[at[parts == p]] = True
            if len(held) > 1:
                last = parts[-1].item()
                for p in [p for p in held if p != last]:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(held.pop(p)).tobytes()], pa.binary())], ["part", "bits"])
        for p, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(v).tobytes()], pa.binary())], ["part", "bits"])

    got = rows.repartition(C.partitions(telling.sparkSession), "part").sortWithinPartitions("part").mapInArrow(C.lean(run), "part int, bits binary").collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in got:
        out[r["part"] << (part - 3) : (r["part"] + 1) << (part - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _keyed(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``__id``, ``__text`` and two 64-bit hashes from different seeds that tell texts apart, and what is asked for."""
    return C.doc_bytes(docs, *more).withColumns({"__k": F.xxhash64("__id", "__text"), "__l": F.xxhash64(F.lit(7), "__text")})


def _joined(docs: DataFrame, items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """``__k``, ``__l``, item_id, n, m, tiles of every different document and item it leaks."""
    telling = _telling(items, seed, threshold)
    bits = docs.sparkSession.sparkContext.broadcast(_filter(telling))  # 2 ** FILTER_BITS bits
    lengths = sorted(r["k"] for r in items.select(F.least("n", F.lit(seed)).alias("k")).distinct().collect())

    def look(batches):
        for b in batches:
            k, ell = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("__k", "__l"))
            for r0, _, _, data, offs in C.chunks(b):
                h, first = _words(data, offs)
                for length in lengths:
                    d, _, v = _seeds(h, first, length)
                    at = v & np.uint64((1 << FILTER_BITS) - 1)
                    ok = (bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
                    pair = np.unique(np.stack([d[ok].astype(np.uint64), v[ok]]), axis=1)
                    row = pair[0].astype(np.int64) + r0
                    yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(ell[row]), pa.array(pair[1].view(np.int64))], ["__k", "__l", "h"])

    keyed = _keyed(docs)
    shared = keyed.mapInArrow(C.lean(look), "__k long, __l long, h long").join(telling, "h").select("__k", "__l", "no").distinct()
    shared = C.materialize(shared, "bench-pairs")
    texts = keyed.select("__k", "__l", "__id", "__text").join(shared.select("__k", "__l").distinct(), ["__k", "__l"], "left_semi").groupBy("__k", "__l").agg(F.first("__text").alias("__text"))
    pairs = shared.join(texts, ["__k", "__l"]).join(items, "no").select(F.lit(0).cast("long").alias("__id"), "__text", "__k", "__l", "item_id", "words", "n")
    ddl = T._parse_datatype_string("__k long, __l long, item_id long, n long, m long, n_tiles long")
    schema = C._arrow_schema(ddl)

    def tile(batches):
        for b in batches:
            k, ell, ids, words = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("__k", "__l", "item_id", "words"))
            for r0, r1, _, data, offs in C.chunks(b):
                h, first = _words(data, offs)
                rows = []
                for i in range(r0, r1):
                    item = np.frombuffer(words[i], np.uint64).tolist()
                    t = tiles(h[first[i - r0] : first[i - r0 + 1]].tolist(), item, min(seed, len(item)))
                    m = sum(x[2] for x in t)
                    if m >= threshold * len(item):
                        rows.append((k[i], ell[i], ids[i], len(item), m, len(t)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return C.materialize(pairs.mapInArrow(C.lean(tile), ddl), "bench-leaks")


_DDL = "__id long, item_id long, coverage double, matched_words long, item_words long, n_tiles long"


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """A row for every document and item it leaks: ids, coverage, words matched, tiles."""
    schema = C._arrow_schema(T._parse_datatype_string(_DDL))
    items = _items(benchmark)
    block = _block(items, seed)
    if block is None:
        got = _joined(docs, items, seed, threshold)
        rows = _keyed(docs).select("__id", "__k", "__l").join(got, ["__k", "__l"])
        return rows.select("__id", "item_id", (F.col("m") / F.col("n")).alias("coverage"), F.col("m").alias("matched_words"), F.col("n").alias("item_words"), "n_tiles")
    held = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_SEEDS words

    def run(batches):
        for b in batches:
            for _, _, ids, data, offs in C.chunks(b):
                rows = []
                for d, i, t in _found(held.value, data, offs, threshold):
                    n, m = len(held.value.words[i]), sum(x[2] for x in t)
                    rows.append((int(ids[d]), held.value.ids[i], m / n, m, n, len(t)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return C.doc_bytes(docs).mapInArrow(C.lean(run), _DDL)


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    import pyarrow.compute  # noqa: F401

    spark = docs.sparkSession
    C.small_batches(spark)
    items = _items(benchmark)
    block = _block(items, seed)
    if block is None:
        got = _joined(docs, items, seed, threshold).select("__k", "__l").distinct()
        return _keyed(docs, C.row(docs).alias("__row")).join(got, ["__k", "__l"], "left_anti").select("__row.*")
    held = spark.sparkContext.broadcast(block)  # at most BLOCK_SEEDS words

    def run(batches):
        for b in batches:
            text = pa.compute.fill_null(b.column(b.schema.get_field_index("text")).cast(pa.large_binary()), b"")
            view = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], ["__id", "__text"])
            for r0, r1, _, data, offs in C.chunks(view):
                keep = np.ones(r1 - r0, bool)
                for d, _, _ in _found(held.value, data, offs, threshold):
                    keep[d] = False
                yield b.slice(r0, r1 - r0).filter(pa.array(keep))

    return docs.mapInArrow(C.lean(run), docs.schema)
