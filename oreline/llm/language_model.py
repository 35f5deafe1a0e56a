"""Document log-likelihood under a gated recurrent language model, beside a smoothed unigram base.

Counts of all training tokens are a written table. The ``WORDS`` most frequent tokens are the model's own
words, in classes of about equal mass; all others form a last class in which a token has its smoothed share of
the class's counts. The probability of a token is that of its class times that within the class, both given the
state of a gated recurrent unit. The network is trained by truncated backpropagation in numpy: first on a
bounded number of tokens on the driver, then on all training documents, each shard of them on its own,
and the shards' weights are averaged in a tree. Scoring carries the state across windows, so a document counts as a whole.

Counts of the ``HOT`` most frequent tokens go to all executors; rarer tokens are joined to the written
counts, so no table that grows with the vocabulary is broadcast, and no rare token is a hot key.

Tokens are hashes of 64 bits. Defined results: a null or empty text is the end token alone; repeated rows get
equal scores, each its own row; of equally frequent tokens those with the lesser hash come first; a null doc_id belongs to no fold
and is not learned from; a text of any length is scored whole; extra columns, whatever their names, are ignored; an empty table gives an empty result; with no training token at all both scores are
those of a token out of one possible.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C

WORDS, CLASSES, HIDDEN, ENDINGS = 1_536, 32, 24, 64
HOT = 65_536  #: tokens whose counts are sent to all executors
WARM_TOKENS = 250_000  #: tokens of the first training on the driver, about
STREAMS, WINDOW, RATE = 64, 24, 0.01
SHARD_STREAMS = 512  #: streams of a shard: more of them make a token cheaper
SHARD_BYTES = 16 << 20  #: text a shard holds before it trains on it
SCORE_WINDOW = 48
SCORE_ROWS = 100_000  #: states whose outputs are computed together, about
OUT_ROWS = 16_384  #: states whose outputs are in memory together
SCORE_DOCS = 1_024  #: documents of about equal length that take a step together
FEW = 12  #: rows up to which sums over an input's rows are taken row by row
SCORE_BYTES = 32 << 20  #: text whose documents are scored together, about
END = np.uint64(0xE4D0E4D0E4D0E4D1)  #: hash of the end token


# ---------------------------------------------------------------- tokens
def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, endings, offsets): each document's words and its end token."""
    starts, ends, first = C.words(data, offs)
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    h = np.empty(at[-1], np.uint64)
    e = np.zeros(at[-1], np.int32)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    h[~inside] = END
    h[inside] = C.word_hashes(data, starts, ends)
    if len(starts):
        last = data[ends - 1].astype(np.int32)
        e[inside] = (last * 31 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)) % ENDINGS
    return h, e, at


@dataclass
class Vocabulary:
    hashes: np.ndarray  # ascending; the HOT most frequent tokens
    counts: np.ndarray
    word: np.ndarray  # number among the model's words, or -1
    first: np.ndarray  # first word of each class, plus the end
    total: int  # N
    distinct: int  # V
    own: int  # tokens of the model's words

    @property
    def rest(self) -> float:
        """Mass by which the share of a token in the last class is taken."""
        n = int((self.word >= 0).sum())
        return self.total - self.own + 0.5 * (self.distinct - n + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    t = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # how frequent a token must be to be among the first, to within a tenth, so that no task orders or sends more than a few of its own
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect()  # a few hundred rows
    least, seen = 1, 0
    for r in steps:
        least, seen = r["c"], seen + r["n"]
        if seen >= HOT:
            break
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(HOT).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    m = min(WORDS, len(h))
    word = np.full(len(h), -1)
    word[:m] = np.arange(m)
    mass = np.cumsum(np.sqrt(c[:m]))  # classes of about equal mass of root counts
    cut = np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES) + 1) if m else np.zeros(0, int)
    first = np.unique(np.concatenate([[0], cut[cut < m], [m]])).astype(np.int64)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], word[order], first, int(t["n"] or 0), int(t["v"]), int(c[:m].sum()))


def look_up(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count or -1 if not among the frequent, model word or -1) of every token."""
    u, inv = np.unique(h, return_inverse=True)
    if not len(v.hashes):
        return np.full(len(h), -1), np.full(len(h), -1)
    i = np.minimum(np.searchsorted(v.hashes, u), len(v.hashes) - 1)
    ok = v.hashes[i] == u
    return np.where(ok, v.counts[i], -1)[inv], np.where(ok, v.word[i], -1)[inv]


# ---------------------------------------------------------------- network
class Room:
    """Memory that is used again for every window: to get new memory from the system takes longer than what is computed in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __reduce__(self):  # nothing of it goes to other processes
        return Room, ()

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, a = math.prod(shape), self.held.get(name)
        if a is None or a.size < size or a.dtype != kind:
            a = self.held[name] = np.empty(size, kind)
        return a[:size].reshape(shape)


class Network:
    """Gated recurrent unit with an output factored into classes."""

    def __init__(self, first: np.ndarray, word_counts: np.ndarray, rest: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        m, k, f32 = len(word_counts), len(first) - 1, np.float32
        self.first, self.m, self.room = first, m, Room()
        self.klass = np.repeat(np.arange(k), np.diff(first)) if m else np.zeros(0, np.int64)
        mass = np.append(np.add.reduceat(word_counts, first[:-1]) if m else np.zeros(0), max(rest, 1.0)).astype(float)
        self.p = {
            "x": rng.normal(0, 0.1, (m + ENDINGS + 1, 3 * HIDDEN)).astype(f32),
            "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(f32),
            "b": np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(f32),
            "oc": rng.normal(0, 0.05, (HIDDEN, k + 1)).astype(f32),
            "bc": np.log(mass / mass.sum()).astype(f32),
            "ow": rng.normal(0, 0.05, (m, HIDDEN)).astype(f32),
            "bw": np.log(word_counts).astype(f32),
        }

    def inputs(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where(word >= 0, word, self.m + ending)

    @property
    def begin(self) -> int:
        return self.m + ENDINGS

    def cell(self, h: np.ndarray, a: np.ndarray, ut: np.ndarray, g: np.ndarray, zr: np.ndarray, c: np.ndarray, out: np.ndarray) -> np.ndarray:
        """States after one more input, in ``out``; its terms are left in ``g``, ``zr`` and ``c``. Arrays are (units, streams),
        so that each gate is one piece of memory; ``a`` is what the inputs add, ``ut`` the turned weights of the state."""
        n = HIDDEN
        np.matmul(ut, h, out=g)
        s = np.add(a[: 2 * n], g[: 2 * n], out=zr)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        np.reciprocal(s, out=s)
        k = np.multiply(s[n:], g[2 * n :], out=c)
        k += a[2 * n :]
        np.tanh(k, out=k)
        np.subtract(h, k, out=out)
        out *= s[:n]
        out += k
        return out

    def log_probs(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log probability of words given states; of the last class for -1."""
        return np.concatenate([self._log_probs(h[i : i + OUT_ROWS], word[i : i + OUT_ROWS]) for i in range(0, max(1, len(h)), OUT_ROWS)])

    def _log_probs(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = self.p
        k = len(self.first) - 1
        klass = np.where(word >= 0, self.klass[np.maximum(word, 0)] if self.m else k, k)
        order = np.argsort(klass.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(klass[order], np.arange(k + 1))
        h, word, klass, rows = h[order], word[order], klass[order], np.arange(len(h))
        s = p["oc"].T @ h.T
        s += p["bc"][:, None]
        s -= s.max(0)
        got = s[klass, rows]
        got -= np.log(np.exp(s, out=s).sum(0))
        for c in range(k):
            lo, hi, a, z = bounds[c], bounds[c + 1], self.first[c], self.first[c + 1]
            if hi > lo and z - a > 1:
                t = p["ow"][a:z] @ h[lo:hi].T
                t += p["bw"][a:z, None]
                t -= t.max(0)
                got[lo:hi] += t[word[lo:hi] - a, rows[: hi - lo]]
                got[lo:hi] -= np.log(np.exp(t, out=t).sum(0))
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, h0: np.ndarray, x: np.ndarray, y: np.ndarray, reset: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """One window: x, y, reset are (steps, streams); y is a word, -1 the last class, -2 nothing."""
        p, n, steps, width = self.p, HIDDEN, *x.shape
        kind, room = p["u"].dtype, self.room
        before, zr, c, g, flat = (room(k, (steps, w, width), kind) for k, w in (("before", n), ("zr", 2 * n), ("c", n), ("g", 3 * n), ("flat", n)))
        inputs = x.astype(np.intp)
        table, ut, own_rows = p["x"] + p["b"], np.ascontiguousarray(p["u"].T), room("own", (width, 3 * n), kind)
        h, fresh = h0.T, reset.any(1)
        for t in range(steps):
            before[t] = h
            if fresh[t]:
                before[t][:, reset[t]] = 0
            np.take(table, inputs[t], axis=0, out=own_rows, mode="clip")
            h = self.cell(before[t], own_rows.T, ut, g[t], zr[t], c[t], flat[t])
        last, word = flat[-1].T.copy(), y.ravel()
        states = room("states", (steps, width, n), kind)
        states[:] = flat.transpose(0, 2, 1)
        k = len(self.first) - 1
        klass = np.where(word >= 0, self.klass[np.maximum(word, 0)] if self.m else k, k)
        order = np.argsort(np.where(word > -2, klass, k + 1).astype(np.uint16), kind="stable")
        bounds = np.searchsorted(klass[order[: int((word > -2).sum())]], np.arange(k + 2))
        live = order[: bounds[-1]]
        hl, wl, kl = np.take(states.reshape(-1, n), live, axis=0, out=room("hl", (len(live), n), kind), mode="clip"), word[live].astype(np.intp), klass[live]
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        rows = np.arange(len(live))
        scale = kind.type(1 / max(1, len(live)))
        s = np.matmul(p["oc"].T, hl.T, out=room("s", (k + 1, len(live)), kind))
        s += p["bc"][:, None]
        s -= s.max(0)
        np.exp(s, out=s)
        mass = s.sum(0)
        flat_s, own = s.reshape(-1), kl * len(live) + rows
        likely, likely_in_class = flat_s[own] / mass, np.ones(len(live), kind)
        s *= scale / mass
        flat_s[own] -= scale
        grad["oc"] += (s @ hl).T
        grad["bc"] += s.sum(1)
        dl = np.matmul(s.T, p["oc"].T, out=room("dl", (len(live), n), kind))
        for j in range(k):
            lo, hi, first, end = bounds[j], bounds[j + 1], self.first[j], self.first[j + 1]
            if hi > lo and end - first > 1:
                q = p["ow"][first:end] @ hl[lo:hi].T
                q += p["bw"][first:end, None]
                q -= q.max(0)
                np.exp(q, out=q)
                flat_q, own, mass = q.reshape(-1), (wl[lo:hi] - first) * (hi - lo) + rows[: hi - lo], q.sum(0)
                likely_in_class[lo:hi] = flat_q[own] / mass
                q *= scale / mass
                flat_q[own] -= scale
                grad["ow"][first:end] += q @ hl[lo:hi]
                grad["bw"][first:end] += q.sum(1)
                dl[lo:hi] += q.T @ p["ow"][first:end]
        out = room("out", (steps, width, n), kind)
        if len(live) < steps * width:
            out[:] = 0
        out.reshape(-1, n)[live] = dl
        da, to_u, dg = room("da", (steps, width, 3 * n), kind), room("to_u", (steps, width, n), kind), room("dg", (3 * n, width), kind)
        d, dc, e, dh = (room(k, (n, width), kind) for k in ("d", "dc", "e", "dh"))
        dh[:] = 0
        dz, dr, dn = dg[:n], dg[n : 2 * n], dg[2 * n :]
        for t in range(steps - 1, -1, -1):
            z, r = zr[t, :n], zr[t, n:]
            np.add(dh, out[t].T, out=d)
            np.subtract(1, z, out=e)
            e *= d  # what reaches the candidate
            np.subtract(before[t], c[t], out=dz)
            dz *= z
            dz *= e
            np.multiply(c[t], c[t], out=dc)
            np.subtract(1, dc, out=dc)
            dc *= e
            np.multiply(dc, r, out=dn)
            np.subtract(1, r, out=dr)
            dr *= dn
            dr *= g[t, 2 * n :]
            d *= z
            np.matmul(p["u"], dg, out=dh)
            dh += d
            if fresh[t]:
                dh[:, reset[t]] = 0
            da[t, :, : 2 * n] = dg[: 2 * n].T
            da[t, :, 2 * n :] = dc.T
            to_u[t] = dn.T
        # states before each step, by rows: those after the step before it
        states[1:] = states[:-1].copy()
        states[0] = h0
        states[reset] = 0
        by_rows = states.reshape(-1, n).T
        grad["u"][:, : 2 * n] = by_rows @ da.reshape(-1, 3 * n)[:, : 2 * n]
        grad["u"][:, 2 * n :] = by_rows @ to_u.reshape(-1, n)
        self._sums(da.reshape(-1, 3 * n), inputs.ravel(), grad["x"])
        grad["b"] += grad["x"].sum(0)
        return grad, last, -float(np.log(likely + 1e-12).sum() + np.log(likely_in_class + 1e-12).sum())

    def _sums(self, rows: np.ndarray, of: np.ndarray, into: np.ndarray) -> None:
        """Adds each row to the row of ``into`` it belongs to: those of frequent ones together, of others one at a time."""
        order = np.argsort(of.astype(np.uint16), kind="stable")
        rows = np.take(rows, order, axis=0, out=self.room("sorted", rows.shape, rows.dtype), mode="clip")
        n = np.bincount(of, minlength=len(into))
        starts, one = np.cumsum(n) - n, np.ones(int(n.max()), rows.dtype)
        for i in np.flatnonzero(n > FEW).tolist():
            into[i] += one[: n[i]] @ rows[starts[i] : starts[i] + n[i]]
        few = np.flatnonzero((n > 0) & (n <= FEW))
        for j in range(FEW):
            few = few[n[few] > j]
            into[few] += rows[starts[few] + j]


def train(net: Network, docs: list[tuple[np.ndarray, np.ndarray]], passes: int = 1, rate: float = RATE, parallel: int = STREAMS) -> int:
    """Adam over windows of ``parallel`` streams of documents, of which those not yet at their end are computed; docs:
    (words, endings). Returns tokens used."""
    docs = [d for d in docs if len(d[0])]
    streams: list[list] = [[] for _ in range(min(parallel, len(docs)))]
    heap = [(0, i) for i in range(len(streams))]
    for w, e in sorted(docs, key=lambda d: -len(d[0])):
        load, i = heap[0]
        streams[i].append((w, e))
        heapq.heapreplace(heap, (load + len(w), i))
    if not streams:
        return 0
    streams.sort(key=lambda s: -sum(len(w) for w, _ in s))
    docs = [d for s in streams for d in s]
    lens = np.array([sum(len(w) for w, _ in s) for s in streams])
    width, starts = int(lens[0]), np.cumsum(lens) - lens
    y = np.concatenate([w for w, _ in docs]).astype(np.int16)
    x = np.append(net.begin, net.inputs(y[:-1], np.concatenate([e for _, e in docs])[:-1])).astype(np.int16)
    reset = np.zeros(len(y), bool)
    reset[np.cumsum([0] + [len(w) for w, _ in docs])[:-1]] = True
    x[reset] = net.begin
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, passes * -(-width // WINDOW)
    for _ in range(passes):
        h = np.zeros((len(streams), HIDDEN), np.float32)
        for lo in range(0, width, WINDOW):
            live = int(np.searchsorted(-lens, -lo, "left"))
            t = np.arange(lo, min(lo + WINDOW, width))[:, None]
            over = t >= lens[:live]
            at = np.where(over, 0, starts[:live] + t)
            g, h, _ = net.gradients(h[:live], np.where(over, np.int16(net.begin), x[at]), np.where(over, np.int16(-2), y[at]), reset[at] & ~over)
            norm = np.sqrt(sum(float(np.vdot(a, a)) for a in g.values()))
            cut = min(1.0, 1.0 / (norm + 1e-9))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k in net.p:
                gk, e = g[k], net.room("adam", g[k].shape, g[k].dtype)
                gk *= np.float32(cut)
                np.subtract(gk, m[k], out=e)
                e *= np.float32(0.1)
                m[k] += e
                gk *= gk
                gk -= v[k]
                gk *= np.float32(0.01)
                v[k] += gk
                np.multiply(v[k], np.float32(1 / (1 - 0.99**step)), out=e)
                np.sqrt(e, out=e)
                e += np.float32(1e-6)
                np.divide(m[k], e, out=e)
                e *= np.float32(lr / (1 - 0.9**step))
                net.p[k] -= e
    return int(lens.sum())


def score_batch(net: Network, word: np.ndarray, ending: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document; states are carried from window to window."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    out = np.zeros(len(n))
    x = np.empty(len(word), np.intp)
    x[1:] = net.inputs(word[:-1], ending[:-1])
    x[at[:-1]] = net.begin
    table, ut = net.p["x"] + net.p["b"], np.ascontiguousarray(net.p["u"].T)
    kind, room = table.dtype, Room()
    for first in range(0, len(order), SCORE_DOCS):
        docs = order[first : first + SCORE_DOCS]
        starts, lens = at[:-1][docs], n[docs]
        h = np.zeros((HIDDEN, len(docs)), kind)
        lo, longest = 0, int(lens[0])
        while lo < longest:
            end = min(lo + min(SCORE_WINDOW, max(1, SCORE_ROWS // h.shape[1])), longest)
            lives = np.searchsorted(-lens, -np.arange(lo, end), "left").tolist()
            states, places, done = room("states", (sum(lives), HIDDEN), kind), np.empty(sum(lives), np.intp), 0
            for t, live in zip(range(lo, end), lives, strict=True):
                if live < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :live])
                i = np.add(starts[:live], t, out=places[done : done + live])
                rows = np.take(table, x[i], axis=0, out=room("rows", (live, 3 * HIDDEN), kind), mode="clip")
                g, zr, c = (room(k, (w * HIDDEN, live), kind) for k, w in (("g", 3), ("zr", 2), ("c", 1)))
                h = net.cell(h, rows.T, ut, g, zr, c, room(f"h{t % 2}", (HIDDEN, live), kind))
                states[done : done + live] = h.T
                done += live
            lp = net.log_probs(states, word[places])
            out += np.bincount(np.concatenate([docs[:live] for live in lives]), lp, len(n))
            lo = end
    return out


# ---------------------------------------------------------------- operator
def score(docs: DataFrame, in_training: F.Column) -> DataFrame:
    """``__id``, n_tokens, n_known, train_tokens, base_score, score. ``in_training`` is a condition on ``__id``."""
    spark = docs.sparkSession
    base = C.doc_bytes(docs)
    training = base.where(in_training)

    def count(ids, data, offs):
        h, n = np.unique(tokens(data, offs)[0], return_counts=True)
        return {"h": h.view(np.int64), "c": n}

    counts = C.materialize(_chunked(training, count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    v = vocabulary(counts)
    words = v.counts[v.word >= 0][np.argsort(v.word[v.word >= 0])]
    net = Network(v.first, words, v.total - v.own)
    held = spark.sparkContext.broadcast(v)
    net = _trained(training, net, v, held)
    model = spark.sparkContext.broadcast(net)

    ddl = T._parse_datatype_string("__id long, n_tokens long, n_known long, n_last long, own double, frequent double, last double, rare array<struct<h:long,n:int>>")
    schema = C._arrow_schema(ddl)

    def run(batches):
        v, net = held.value, model.value
        waiting: list[tuple[dict, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            """Score the documents that wait together: a step costs little more for many documents than for one."""
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, _, _, a in waiting]))])
            lp = score_batch(net, np.concatenate([w for _, w, _, _ in waiting]), np.concatenate([e for _, _, e, _ in waiting]), at) / np.log(10)
            done = 0
            for cols, _, _, a in waiting:
                cols["own"] = pa.array(lp[done : done + len(a) - 1])
                done += len(a) - 1
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

        size = 0
        for b in batches:
            for _, _, ids, data, offs in C.chunks(b):
                h, e, at = tokens(data, offs)
                c, w = look_up(v, h)
                n = len(ids)
                doc = np.repeat(np.arange(n), np.diff(at))
                known, last = c >= 0, w < 0
                logs = np.where(known, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                head = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(order) else np.zeros(0, bool)
                first = np.flatnonzero(head)
                times = np.diff(np.append(first, len(order))).astype(np.int32)
                cuts = np.searchsorted(doc[order][first], np.arange(n + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(times)], fields=list(schema.field("rare").type.value_type))
                cols = {
                    "__id": pa.array(ids), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(np.bincount(doc, known, n).astype(np.int64)), "n_last": pa.array(np.bincount(doc, last, n).astype(np.int64)),
                    "frequent": pa.array(np.bincount(doc, logs, n)), "last": pa.array(np.bincount(doc, logs * last, n)),
                    "rare": pa.ListArray.from_arrays(pa.array(cuts), items, type=schema.field("rare").type),
                }
                waiting.append((cols, w.astype(np.int16), e.astype(np.int16), at))
                size += len(data)
                if size > SCORE_BYTES:
                    yield from flush()
                    waiting, size = [], 0
        if waiting:
            yield from flush()

    part = C.materialize(base.mapInArrow(C.lean(run), ddl).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("seen")
    )
    whole, rest = float(v.total + 0.5 * (v.distinct + 1)), float(v.rest)
    got = part.drop("rare").join(sums, "row", "left").withColumns({"logs": F.coalesce("logs", F.lit(0.0)), "seen": F.coalesce("seen", F.lit(0))})
    return got.select(
        "__id", "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.col("logs") - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        (F.col("own") + F.col("last") + F.col("logs") - F.col("n_last") * float(np.log10(rest))).alias("score"),
    )


def _chunked(df: DataFrame, fn, schema: str) -> DataFrame:
    return C.map_chunks(df.select(F.col("__id").alias("doc_id"), F.col("__text").cast("string").alias("text")), fn, schema)


def _trained(training: DataFrame, net: Network, v: Vocabulary, held) -> Network:
    """Warm start on the driver, then one pass over all training documents in shards from there, averaged by their tokens."""
    n = training.count()
    want = max(1, int(WARM_TOKENS / max(1.0, v.total / max(1, n))))
    warm = training.where(F.pmod(F.xxhash64("__id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, want / max(1, n))))

    def encode(data, offs, v):
        h, e, at = tokens(data, offs)
        w = look_up(v, h)[1]
        return [(w[a:z].astype(np.int16), e[a:z].astype(np.int16)) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pack(batches):
        for b in batches:
            for _, _, ids, data, offs in C.chunks(b):
                docs = encode(data, offs, held.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([w.tobytes() for w, _ in docs], pa.binary()), pa.array([e.tobytes() for _, e in docs], pa.binary())], ["id", "w", "e"])

    got = warm.mapInArrow(C.lean(pack), "id long, w binary, e binary").orderBy("id", "w").limit(4 * want).collect()
    train(net, [(np.frombuffer(bytes(r["w"]), np.int16).astype(np.int64), np.frombuffer(bytes(r["e"]), np.int16).astype(np.int64)) for r in got], passes=3)
    start = training.sparkSession.sparkContext.broadcast(net)

    def shard(batches):
        own, used, held_docs, size = None, 0, [], 0
        for b in batches:
            for _, _, _, data, offs in C.chunks(b):
                held_docs += encode(data, offs, held.value)
                size += len(data)
                if size > SHARD_BYTES:
                    own = own or pickle.loads(pickle.dumps(start.value))
                    used += train(own, held_docs, rate=RATE / 10, parallel=SHARD_STREAMS)
                    held_docs, size = [], 0
        if held_docs:
            own = own or pickle.loads(pickle.dumps(start.value))
            used += train(own, held_docs, rate=RATE / 10, parallel=SHARD_STREAMS)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({k: a * np.float64(used) for k, a in own.p.items()})], pa.binary()), pa.array([used])], ["p", "n"])

    def add(batches):
        total, n = None, 0
        for b in batches:
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = pickle.loads(p)
                total = p if total is None else {x: total[x] + p[x] for x in p}
                n += k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary()), pa.array([n])], ["p", "n"])

    parts = C.materialize(training.mapInArrow(C.lean(shard), "p binary, n long"), "lm-shards")
    count = parts.count()
    while count > 8:
        parts = C.materialize(parts.repartition(max(1, count // 8)).mapInArrow(C.lean(add), "p binary, n long"), "lm-shards")
        count = parts.count()
    sums = [(pickle.loads(bytes(r["p"])), r["n"]) for r in parts.collect()]
    n = sum(k for _, k in sums)
    if n:
        net.p = {k: (sum(p[k] for p, _ in sums) / n).astype(np.float32) for k in net.p}
    return net
