"""Document quality by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other training text is unlabelled web text. The class prior is estimated from
both (least ratio of the unlabelled to the positive score density), and a small network on surface statistics
minimises the non-negative unbiased risk: the positive risk, plus the unlabelled negative risk less the
positives' share of it, which is never let fall below zero.

Means, densities and the risk are taken over all unlabelled rows outside the held-out fold: their statistics are a written
table. The network begins on the driver with a bounded part of them, then each shard goes over all its own
rows against the (at most ``SAMPLE_POSITIVE``) positives, and the shards' weights are averaged by their rows.

Defined results: a null or empty text is scored from all-zero statistics; repeated rows get equal scores; a score of exactly
the threshold is good; a null doc_id is learned from as unlabelled text; a text of any length is read whole; extra columns,
whatever their names, are ignored; an empty table gives an empty result; without any labelled positive all scores are the prior 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm import common as C

SAMPLE_POSITIVE = 8_000  #: labelled positives read for training, at most about this many
WARM_UNLABELLED = 16_000  #: unlabelled rows the network begins with, at most about this many
SHARD_ROWS = 20_000  #: unlabelled rows a shard holds before it goes over them
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 1024, 0.01
N_FEATURES = 22


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Surface statistics of every document: shares of kinds of bytes, lengths, repetition, line structure."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]) / some

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, space, high = (data >= 48) & (data <= 57), C.is_space(data), data >= 128
    punct = ~(upper | lower | digit | space | high)
    cols = [share(m) for m in (upper, lower, digit, space, high, punct, data == 33, data == 124, data == 10, (data == 44) | (data == 46))]
    twice = np.zeros(len(data), bool)
    if len(data) > 1:
        twice[1:] = punct[1:] & (data[1:] == data[:-1])
    cols.append(share(twice))
    starts, ends, first = C.words(data, offs)
    h = C.word_hashes(data, starts, ends)
    w = np.diff(first)
    doc = np.repeat(np.arange(n), w)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(w, 1)
    square = np.bincount(doc, length**2, n) / np.maximum(w, 1)
    distinct = np.diff(C.sets(doc, h, n)[1]) / np.maximum(w, 1)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    d3, v3 = C.shingles(data, offs, 3)
    n3 = np.bincount(d3, minlength=n)
    distinct3 = np.diff(C.sets(d3, v3, n)[1]) / np.maximum(n3, 1)
    trimmed_s, trimmed_e = C.trim(data, starts, ends) if len(starts) else (starts, ends)
    bare = np.bincount(doc, (trimmed_e == trimmed_s).astype(float), n) / np.maximum(w, 1)
    tail = np.bincount(doc, (ends - trimmed_e > 1).astype(float), n) / np.maximum(w, 1)
    cap = np.bincount(doc, (upper[starts] & (length > 1) & upper[np.minimum(starts + 1, max(len(data) - 1, 0))]).astype(float) if len(starts) else np.zeros(0), n) / np.maximum(w, 1)
    cols += [mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, distinct, np.bincount(doc, again, n) / np.maximum(w, 1), distinct3, bare, tail, cap, np.log1p(size) / 10, np.log1p(w) / 10, distinct * np.log1p(w) / 10]
    return np.stack(cols, 1)


@dataclass
class Model:
    prior: float
    center: np.ndarray
    scale: np.ndarray
    layers: list

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, (x - self.center) / self.scale)[1], -40, 40)))


def _forward(layers: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d[0]


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 0, start: list | None = None, epochs: int = EPOCHS, first_rate: float = RATE) -> list:
    """Adam on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    k = pos.shape[1]
    layers = [p.copy() for p in start] if start else [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0

    def grads(x: np.ndarray, dz: np.ndarray) -> list:
        hidden, _ = _forward(layers, x)
        dh = dz[:, None] * layers[2][None] * (1 - hidden**2)
        return [x.T @ dh, dh.sum(0), hidden.T @ dz, np.array([dz.sum()])]

    steps = max(1, len(unl) // BATCH)
    for epoch in range(epochs):
        up, pp = rng.permutation(len(unl)), rng.permutation(len(pos))
        rate = first_rate * (1 - epoch / epochs) + 1e-4
        for s in range(steps):
            u, p = unl[up[s::steps]], pos[pp[s::steps]]
            if not len(p):
                p = pos
            zp, zu = _forward(layers, p)[1], _forward(layers, u)[1]
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = _soft(zu).mean() - prior * _soft(zp).mean()
            if negative >= 0:
                g = [a + b for a, b in zip(grads(p, prior * ((sp - 1) - sp) / len(p)), grads(u, su / len(u)), strict=True)]
            else:  # step back from where the estimate of the negative risk is below zero
                g = [a - b for a, b in zip(grads(p, prior * sp / len(p)), grads(u, su / len(u)), strict=True)]
            t += 1
            for i, gi in enumerate(g):
                gi = gi + 1e-4 * layers[i]
                m[i] = 0.9 * m[i] + 0.1 * gi
                v[i] = 0.999 * v[i] + 0.001 * gi**2
                layers[i] = layers[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def scorer(pos: np.ndarray, unl: np.ndarray) -> np.ndarray:
    """Weights of a balanced classifier of positives against unlabelled rows; the last one is the bias."""
    a = np.hstack([np.vstack([pos, unl]), np.ones((len(pos) + len(unl), 1))])
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(unl))])
    w = np.zeros(a.shape[1])
    weight = np.where(y > 0, len(y) / (2 * max(1, len(pos))), len(y) / (2 * max(1, len(unl))))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a / len(y) + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (weight * (p - y)) / len(y) + 1e-2 * w)
    return w


def cuts(zp: np.ndarray) -> np.ndarray:
    """Scores at which the densities are compared: upper quantiles of the positives'."""
    return np.sort(zp)[(np.linspace(0.02, 0.9, 45) * (len(zp) - 1)).astype(int)]


def least_ratio(zp: np.ndarray, above: np.ndarray, n: int) -> float:
    """Share of positives among ``n`` unlabelled rows, of which ``above`` score at least each of the cuts: the least ratio
    of the densities, with a margin for small numbers."""
    fp = (zp[None, :] >= cuts(zp)[:, None]).mean(1)
    fu = above / max(1, n)
    slack = np.sqrt(1 / (fp * len(zp)) + 1 / np.maximum(above, 1))
    return float(np.clip(min(1.0, (fu / fp * (1 + slack)).min()), 0.05, 0.98))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled rows."""
    w = scorer(pos, unl)
    zp, zu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
    return least_ratio(zp, (zu[None, :] >= cuts(zp)[:, None]).sum(1), len(zu))


def _statistics(docs: DataFrame) -> DataFrame:
    """``__id`` and ``x``, the statistics as packed numbers, of every row."""

    def run(ids, data, offs):
        return {"__id": ids, "x": [r.tobytes() for r in features(data, offs).astype(np.float32)]}

    return C.map_chunks(docs, run, "__id long, x binary")


def _rows(batches):
    """The statistics of each batch of packed rows."""
    for b in batches:
        if b.num_rows:
            yield np.frombuffer(b"".join(b.column(b.schema.get_field_index("x")).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)


def _sums(df: DataFrame, fn, width: int) -> np.ndarray:
    """Sum of ``fn(rows)``, a vector for each batch, over all rows; one vector for each task goes to the driver."""
    import pyarrow as pa

    def run(batches):
        total = sum((fn(x) for x in _rows(batches)), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    each = df.mapInArrow(C.lean(run), "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in each:
        out[r["i"]] = r["v"]
    return out


def fit(docs: DataFrame, labels: DataFrame, exclude_fold: int = 2, folds: int = 4) -> Model:
    """Learn from rows outside the held-out fold."""
    import pickle

    import pyarrow as pa

    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % folds
    spark = docs.sparkSession
    pos = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__lab")).where(fold("__lab") != exclude_fold).distinct()
    pick = lambda c, n, want: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, want / max(1, n)))
    rest = C.materialize(_statistics(docs).where((F.col("__id") == C.NULL_ID) | (fold("__id") != exclude_fold)), "pu-statistics")
    trusted = rest.join(pos.where(pick("__lab", pos.count(), SAMPLE_POSITIVE)), F.col("__id") == F.col("__lab"), "left_semi")
    local = lambda df: np.concatenate([np.zeros((0, N_FEATURES)), *_rows(df.select("x").toArrow().to_batches())])
    raw, n = local(trusted), rest.count()
    if not len(raw) or not n:
        return Model(0.5, np.zeros(N_FEATURES), np.ones(N_FEATURES), [])
    begin = local(rest.where(pick("__id", n, WARM_UNLABELLED)))
    begin = begin if len(begin) else raw
    raw, begin = raw[np.lexsort(raw.T)], begin[np.lexsort(begin.T)]  # rows arrive in any order
    moments = _sums(rest, lambda x: np.concatenate([x.sum(0), (x**2).sum(0)]), 2 * N_FEATURES) / n
    center = moments[:N_FEATURES]
    scale = np.sqrt(np.maximum(moments[N_FEATURES:] - center**2, 0)) + 1e-6
    norm = lambda x: np.clip((x - center) / scale, -8, 8)
    zpos = norm(raw)
    w = scorer(zpos, norm(begin))
    zp = zpos @ w[:-1] + w[-1]
    at = cuts(zp)
    above = _sums(rest, lambda x: (norm(x) @ w[:-1] + w[-1] >= at[:, None]).sum(1).astype(float), len(at))
    prior = least_ratio(zp, above, n)
    first = train(zpos, norm(begin), prior)
    held = spark.sparkContext.broadcast((zpos, first))  # at most about SAMPLE_POSITIVE rows

    def shard(batches):
        zpos, layers = held.value
        used, waiting = 0, []
        for x in _rows(batches):
            waiting.append(norm(x))
            if sum(map(len, waiting)) >= SHARD_ROWS:
                layers = train(zpos, np.vstack(waiting), prior, start=layers, epochs=2, first_rate=RATE / 10)
                used, waiting = used + sum(map(len, waiting)), []
        if waiting:
            layers = train(zpos, np.vstack(waiting), prior, start=layers, epochs=2, first_rate=RATE / 10)
            used += sum(map(len, waiting))
        if used:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([p * used for p in layers])], pa.binary()), pa.array([used])], ["p", "n"])

    def add(batches):
        total, n = None, 0
        for b in batches:
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = pickle.loads(p)
                total = p if total is None else [a + c for a, c in zip(total, p, strict=True)]
                n += k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary()), pa.array([n])], ["p", "n"])

    shards = C.materialize(rest.mapInArrow(C.lean(shard), "p binary, n long"), "pu-shards")
    count = shards.count()
    while count > 64:
        shards = C.materialize(shards.repartition(max(1, count // 64)).mapInArrow(C.lean(add), "p binary, n long"), "pu-shards")
        count = shards.count()
    got = sorted((bytes(r["p"]), r["n"]) for r in shards.collect())
    layers = [sum(pickle.loads(p)[i] for p, _ in got) / sum(k for _, k in got) for i in range(4)]
    C.release(rest)
    return Model(prior, center, scale, layers)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``__id``, score, predicted for each row of ``docs``."""

    def run(ids, data, offs):
        x = features(data, offs)
        s = model.score(model.center + np.clip((x - model.center) / model.scale, -8, 8) * model.scale)
        return {"__id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return C.map_chunks(docs, run, "__id long, score double, predicted int")
