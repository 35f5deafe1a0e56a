"""Packing of token sequences into bins by linear grouping and best fit.

Pieces are counted by length: at most ``capacity`` numbers, whatever the corpus. On this histogram the
driver makes the plan:

* lengths above a share of ``capacity`` are large. In descending order they are dealt into groups of equal
  cardinality, and each counts as the greatest length of its group;
* for these few sizes, configurations (multisets that fit one bin) are chosen by the linear
  programme of the cutting-stock problem, with columns generated by a knapsack; its solution is rounded
  down and what remains is put together first-fit;
* actual lengths take the places of their group's size, in descending order, which leaves gaps;
* small lengths go, largest first, where they fit best.

Several shares and numbers of groups are tried (``TRIES``) and the plan with the fewest bins is taken. With a share of one
half, every large length has a bin of its own and the others go where they fit best, as in best-fit
decreasing, so the plan taken never needs more bins than that.

Bins with equal contents are one class with a multiplicity, so the plan stays small. Executors
number the pieces of each length (salted, so that a length with many pieces is no hot spot) and look
up their bin and offset by length and number.

Defined results: a null or empty text is the end token alone; repeated rows, and rows with a null doc_id, are packed each on
its own (their pieces are told apart by a number); an empty table gives an empty result; extra
columns are ignored, whatever their names; a text of any length is cut into pieces of ``capacity``, of which only
the first may be shorter; pieces of one length take their places in the order of salt, id and row.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C

CAPACITY = 2048
END = 0  #: id that ends every document
TRIES = ((8, 48), (8, 128), (4, 128), (2, 48))  #: (lengths above capacity / share are large, size groups of them)
SALT_ROWS = 1_000  #: pieces of one length that are numbered together, about,
CELLS = 1_000_000  #: or more of them, so that their groups are about so many at most


# ---------------------------------------------------------------- tokens
KNOWN, KNOWN_IDS = 1_200_000, 8_000_000  #: words, and ids of words, that are kept for the next texts, at most
LETTER, DIGIT, SPACE, OTHER = range(4)
_encoders: dict[str, Encoder] = {}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of a character by its first byte, and by the second one after 0xC2. 255: not among the plain ones."""
    one, two = np.full(256, 255, np.uint8), np.full(256, 255, np.uint8)
    one[0x20:0x7F], one[[9, 10, 13, 32]] = OTHER, SPACE
    one[48:58], one[65:91], one[97:123] = DIGIT, LETTER, LETTER
    one[0xC2], one[0xC3:0xCA], one[0xE2] = OTHER, LETTER, OTHER
    two[0xA1:0xC0], two[0xAD] = OTHER, 255
    two[[0xAA, 0xB5, 0xBA]], two[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = LETTER, DIGIT
    return one, two


_ONE, _TWO = _kinds()


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the words, flags of the texts that were not split) as byte-level BPE files split texts: endings after an apostrophe
    ('s 't 're 've 'm 'll 'd), runs of letters, of digits and of other characters, each with a space before it, and runs of
    white space but for its last character where something follows. Only texts of plain characters are split: ASCII
    without odd control characters, Latin letters and common punctuation, on whose kinds all tables agree."""
    n = len(data)
    kind = _ONE[data]
    cont = (data & 0xC0) == 0x80
    want = np.zeros(n + 2, bool)  # continuation bytes that the first bytes ask for
    lead2, lead3 = np.flatnonzero((data >= 0xC2) & (data < 0xE0)), np.flatnonzero(data == 0xE2)
    want[lead2 + 1] = want[lead3 + 1] = want[lead3 + 2] = True
    bad = (kind == 255) & ~cont
    bad |= cont != want[:n]
    for at in (lead2[lead2 < n - 1],):
        second = data[at + 1]
        c2, c3, c9 = at[data[at] == 0xC2], at[data[at] == 0xC3], at[data[at] == 0xC9]
        kind[c2] = _TWO[data[c2 + 1]]
        bad[c2] |= kind[c2] == 255
        kind[c3[(data[c3 + 1] == 0x97) | (data[c3 + 1] == 0xB7)]] = OTHER
        bad[c9] |= data[c9 + 1] > 0x8F
        kind[at + 1] = np.where((second & 0xC0) == 0x80, kind[at], kind[at + 1])
    three = lead3[lead3 < n - 2]
    b, c = data[three + 1], data[three + 2]
    known = ((b == 0x80) & (((c >= 0x90) & (c <= 0xA7)) | (c >= 0xB0))) | ((b == 0x81) & (c <= 0x9E)) | ((b == 0x82) & (c == 0xAC))
    bad[three] |= ~known
    bad[lead3[lead3 >= n - 2]] = True
    kind[three + 1] = kind[three + 2] = OTHER
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    # the last of a run of white space, where something of the same text follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    # endings after an apostrophe that no space was joined to
    q = np.flatnonzero((data == 39) & start)
    q = q[q + 1 < n]
    q = q[~edge[q + 1]]
    single = np.isin(data[q + 1], np.frombuffer(b"stmd", np.uint8))
    r = q[(q + 2 < n) & ~single]
    r = r[~edge[r + 2]]
    pair = data[r + 1].astype(np.int32) * 256 + data[r + 2]
    r = r[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    for at, size in ((q[single], 2), (r, 3)):
        for k in range(1, size):
            start[at + k] = False
        after = at + size
        start[after[after < n]] = True
    doc_bad = np.zeros(len(offs) - 1, bool)
    if bad.any():
        doc_bad[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = True
        start &= ~np.repeat(doc_bad, np.diff(offs)) | edge[:n]
    return np.flatnonzero(start), doc_bad


class Encoder:
    """Ids of texts by a file of the tokenizers library. Byte-level BPE looks at each word of a text on its own, so a word that was
    met before needs no second look; a text that :func:`split` leaves whole is one word here and goes to the library as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of known words, ascending, and their places
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # bytes of the word at a place
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # its ids

    def _learn(self, raw: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, number of each word's ids) of words: those of a space and letters are encoded in runs, which are split
        just there again, the others one by one."""
        words = [w.decode("utf-8", "replace") for w in raw]
        easy = [w[0] == " " and w[1:].isalpha() for w in words]
        runs, rest = [i for i, e in enumerate(easy) if e], [i for i, e in enumerate(easy) if not e]
        order, ids, sizes = [], [], []
        for lo in range(0, len(runs), 2000):
            part = runs[lo : lo + 2000]
            e = self.tokenizer.encode("".join([words[i] for i in part]), add_special_tokens=False)
            got = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1
            if len(cuts) + 1 == len(part):
                order += part
                ids.append(got)
                sizes.append(np.diff(np.concatenate([[0], cuts, [len(got)]])))
            else:
                rest += part
        each = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        ids.append(np.array([x for e in each for x in e], np.uint32))
        sizes.append(np.array([len(e) for e in each], np.int64))
        return order + rest, np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts in ``data``."""
        starts = split(data, offs)[0] if self.by_word else np.unique(offs[:-1][np.diff(offs) > 0])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        size = np.diff(np.append(starts, len(data)))
        h = C.word_hashes(data, starts, starts + size, lower=False)
        u, rep, inv = np.unique(h, return_index=True, return_inverse=True)
        self._equal(data, starts, size, data, starts[rep][inv], size[rep][inv])
        if len(self.keys) + len(u) > KNOWN or len(self.ids) > KNOWN_IDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        known = self.keys[at] == u if len(self.keys) else np.zeros(len(u), bool)
        slot = np.full(len(u), -1, np.int64)
        slot[known] = self.slot[at[known]]
        self._equal(data, starts[rep][known], size[rep][known], self.text, self.text_at[slot[known]], np.diff(self.text_at)[slot[known]])
        new = np.flatnonzero(~known)
        if len(new):
            raw, first = data.tobytes(), starts[rep[new]]
            order, ids, sizes = self._learn([raw[a:z] for a, z in zip(first.tolist(), (first + size[rep[new]]).tolist(), strict=True)])
            new = new[order]
            slot[new] = len(self.text_at) - 1 + np.arange(len(new))
            s, n = starts[rep[new]], size[rep[new]]
            self.text = np.concatenate([self.text, data[_spread(s, n)]])
            self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, ids])
            self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(sizes)])
            keys, places = np.concatenate([self.keys, np.sort(u[new])]), np.concatenate([self.slot, slot[np.sort(new)].astype(np.int32)])
            merged = np.argsort(keys, kind="stable")  # two ascending runs
            self.keys, self.slot = keys[merged], places[merged]
        slot = slot[inv]
        first, count = self.ids_at[slot], self.ids_at[slot + 1] - self.ids_at[slot]
        done = np.concatenate([[0], np.cumsum(count)])
        return self.ids[_spread(first, count)], done[np.searchsorted(starts, offs)]

    @staticmethod
    def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> None:
        """Words of one hash must be one word; the hash has 64 bits."""
        if (a_size != b_size).any() or (a[_spread(a_at, a_size)] != b[_spread(b_at, b_size)]).any():
            raise AssertionError("two words have the same hash")


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each run of so many."""
    kind = np.int32 if not len(first) or int(first.max()) < 2**30 else np.int64
    ends = np.cumsum(size)
    return np.repeat((first - (ends - size)).astype(kind), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=kind)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``__id``, n (a number that tells rows apart), piece, start, length, ids_crc32."""
    ddl = T._parse_datatype_string("__id long, row long, piece int, start long, length long, ids_crc32 long")
    schema = C._arrow_schema(ddl)

    def run(batches):
        encode = encoder(path)
        for b in batches:
            row = b.column(b.schema.get_field_index("__row")).to_numpy()
            for r0, r1, ids, data, offs in C.chunks(b):
                cols: list[list] = [[] for _ in schema]
                got, at = encode(data, offs)
                for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    tokens = np.append(got[a:z], np.uint32(END)).astype("<u4")
                    n = -(-len(tokens) // capacity)
                    cuts = [0, *range(len(tokens) - capacity * (n - 1), len(tokens) + 1, capacity)]
                    for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for col, v in zip(cols, (int(ids[i]), int(row[r0 + i]), p, a, z - a, zlib.crc32(tokens[a:z].tobytes())), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return C.doc_bytes(docs, F.monotonically_increasing_id().alias("__row")).mapInArrow(C.lean(run), ddl)


# ---------------------------------------------------------------- plan
def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(units of each size, bins) that cover ``demand``: the linear programme rounded down, then first fit."""
    m = len(sizes)
    if not m:
        return []
    cols = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    basis = np.array(cols).T
    b = np.array(demand, float)
    x = np.linalg.solve(basis, b)
    for _ in range(60 * m):
        y = np.linalg.solve(basis.T, np.ones(m))
        value, col = knapsack(sizes, y, capacity)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, col)
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * d
        x[out] = ratio[out]
        basis[:, out] = col
    got: dict[tuple[int, ...], int] = defaultdict(int)
    left = np.array(demand, np.int64)
    for i in range(m):
        n = int(max(0.0, math.floor(x[i] + 1e-6)))
        units = basis[:, i].round().astype(np.int64)
        some = units > 0
        if some.any():
            n = min(n, int((left[some] // units[some]).min()))
        if n > 0:
            got[tuple(units.tolist())] += n
            left -= n * units
    while left.any():  # greatest first, as many bins of one kind as possible
        room, units = capacity, np.zeros(m, np.int64)
        for i in sorted(range(m), key=lambda i: -sizes[i]):
            k = min(room // sizes[i], int(left[i]))
            units[i] += k
            room -= k * sizes[i]
        n = int((left[units > 0] // units[units > 0]).min())
        got[tuple(units.tolist())] += n
        left -= n * units
    return list(got.items())


def knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the sizes."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in range(len(sizes)):
        s = sizes[i]
        if values[i] <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):  # a unit more in every step
            hi = min(lo + s, capacity + 1)
            got = best[lo - s : hi - s] + values[i]
            more = got > best[lo:hi] + 1e-12
            best[lo:hi][more] = got[more]
            last[lo:hi][more] = i
    col, c = np.zeros(len(sizes)), int(best.argmax())
    value = float(best[c])
    while c > 0 and last[c] >= 0:
        col[last[c]] += 1
        c -= sizes[last[c]]
    return value, col


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, bins) of every class of bins for pieces counted by length: the best of ``TRIES``."""
    counts = {k: v for k, v in counts.items() if v}
    bound = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    best: list[tuple[tuple[int, ...], int]] | None = None
    for share, groups in TRIES:
        got = _plan(counts, capacity, share, groups)
        if best is None or sum(n for _, n in got) < sum(n for _, n in best):
            best = got
        if sum(n for _, n in best) <= bound:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, share: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """One plan, with lengths above ``capacity / share`` in ``groups`` groups."""
    classes: list[tuple[tuple[int, ...], int]] = []
    if counts.get(capacity):
        classes.append(((capacity,), counts[capacity]))
    large = sorted((k for k in counts if capacity // share < k < capacity), reverse=True)
    small = sorted((k for k in counts if k <= capacity // share and k < capacity), reverse=True)
    total = sum(counts[k] for k in large)
    size_of, demand, members = [], [], []
    per, room = -(-total // groups) if total else 1, 0
    for k in large:  # equal cardinality; a length may be dealt over several groups
        n = counts[k]
        while n:
            if room == 0:
                size_of.append(k)
                demand.append(0)
                members.append([])
                room = per
            take = min(n, room)
            demand[-1] += take
            members[-1].append([k, take])
            n -= take
            room -= take
    merged: dict[int, int] = {}
    order: dict[int, list] = defaultdict(list)
    for s, d, mem in zip(size_of, demand, members, strict=True):
        merged[s] = merged.get(s, 0) + d
        order[s] += mem
    sizes = list(merged)
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for units, bins in configurations(sizes, [merged[s] for s in sizes], capacity):
        slots = [s for s, u in zip(sizes, units, strict=True) for _ in range(u)]
        while bins:  # actual lengths, as long as every place keeps its length
            run = bins
            for s in set(slots):
                run = min(run, max(1, order[s][0][1] // slots.count(s)))
            actual = []
            if all(order[s][0][1] >= run * slots.count(s) for s in set(slots)):
                for s in slots:
                    actual.append(order[s][0][0])
                for s in slots:
                    order[s][0][1] -= run
                    if not order[s][0][1]:
                        order[s].pop(0)
            else:
                run = 1
                for s in slots:
                    actual.append(order[s][0][0])
                    order[s][0][1] -= 1
                    if not order[s][0][1]:
                        order[s].pop(0)
            bins -= run
            open_bins[capacity - sum(actual)].append((tuple(actual), run))
    gaps = sorted(open_bins)
    gaps_set = set(gaps)
    def put(rest: int, item: tuple[tuple[int, ...], int]) -> None:
        if rest not in open_bins or not open_bins[rest]:
            if rest not in gaps_set:
                bisect.insort(gaps, rest)
                gaps_set.add(rest)
        open_bins[rest].append(item)

    for k in small:
        n = counts[k]
        while n:
            at = bisect.bisect_left(gaps, k)
            while at < len(gaps) and not open_bins[gaps[at]]:
                gaps_set.discard(gaps[at])
                gaps.pop(at)
            if at == len(gaps):
                fit = capacity // k
                full, rest = divmod(n, fit)
                if full:
                    put(capacity - fit * k, ((k,) * fit, full))
                if rest:
                    put(capacity - rest * k, ((k,) * rest, 1))
                n = 0
                break
            gap = gaps[at]
            have, bins = open_bins[gap].pop()
            each = min(gap // k, n)  # a bin is filled before the next one
            take = min(bins, n // each)
            if take < bins:
                open_bins[gap].append((have, bins - take))
            n -= take * each
            put(gap - k * each, (have + (k,) * each, take))
    for items in open_bins.values():
        classes += items
    return classes


# ---------------------------------------------------------------- operator
def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with ``sequence_id`` and ``offset``: ``__id``, row, piece, start, length, ids_crc32, …"""
    cut = C.materialize(pieces(docs, path, capacity), "pack-pieces")
    counts = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    classes = plan(counts, capacity)
    rows = []
    base, used = 0, defaultdict(int)
    for lengths, bins in classes:
        at = 0
        for k in lengths:
            rows.append((k, used[k], base, at))
            used[k] += bins
            at += k
        base += bins
    lens, first, seq, off = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    begin = np.searchsorted(lens, np.arange(capacity + 2))
    table = docs.sparkSession.sparkContext.broadcast((first, seq, off, begin))  # its size follows the number of classes

    # the pieces of a length are dealt over cells by a hash; a cell's first number follows from the cells before it
    rows_each = max(SALT_ROWS, sum(counts.values()) // CELLS)
    known = np.array(sorted(counts), np.int64)
    salts = np.array([-(-counts[int(k)] // rows_each) for k in known], np.int64)
    cell0 = np.cumsum(salts) - salts
    if not len(known):
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cells = F.broadcast(docs.sparkSession.createDataFrame([(int(k), int(c), int(n)) for k, c, n in zip(known, cell0, salts, strict=True)], "length long, cell0 long, salts long"))  # <= capacity rows
    salted = cut.join(cells, "length").withColumn("cell", F.col("cell0") + F.pmod(F.xxhash64("__id", "row", "piece"), F.col("salts"))).select(*cut.columns, "cell")
    sizes = salted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # <= capacity + CELLS rows
    count = np.zeros(int(salts.sum()), np.int64)
    count[sizes["cell"].to_numpy()] = sizes["n"].to_numpy()
    start = np.cumsum(count) - count
    start -= np.repeat(start[cell0], salts)
    start_b = docs.sparkSession.sparkContext.broadcast(start)
    ddl = T._parse_datatype_string("__id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    schema = C._arrow_schema(ddl)

    def place(batches):
        first, seq, off, begin = table.value
        start = start_b.value
        seen: dict[int, int] = {}
        for b in batches:
            k = b.column(4).to_numpy()
            key = b.column(b.schema.get_field_index("cell")).to_numpy()
            order = np.argsort(key, kind="stable")
            ks = key[order]
            head = np.flatnonzero(np.append(True, ks[1:] != ks[:-1])) if len(ks) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(ks)))
            number = np.empty(len(key), np.int64)
            before = np.array([seen.get(int(x), 0) for x in ks[head]], np.int64)
            number[order] = np.arange(len(ks)) - np.repeat(head - before, size) + start[ks]
            for x, n in zip(ks[head].tolist(), (before + size).tolist(), strict=True):
                seen[x] = n
            span = np.int64(1) << 40
            at = np.searchsorted(np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * span + first, k * span + number, "right") - 1
            arrays = [b.column(i) for i in range(6)] + [pa.array(seq[at] + number - first[at]), pa.array(off[at])]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    dealt = salted.repartition(C.partitions(docs.sparkSession), "cell").sortWithinPartitions("cell", "__id", "row", "piece")
    return dealt.mapInArrow(C.lean(place), ddl)
