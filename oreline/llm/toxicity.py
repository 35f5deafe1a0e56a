"""Toxicity scores from a lexicon that tolerates misspellings.

The lexicon (whole terms and word stems) is learned from labelled documents. A trie of its
terms is intersected with Levenshtein automata and the product is made deterministic once,
on the driver; its size depends on the lexicon only. Words then run through one transition
table, all words of a chunk at a time, so a word leaves the loop at its first impossible byte.
Every hit is looked at in a window of context: hits inside quotation marks or after a
reporting verb count apart from hits near a second-person pronoun, and a logistic regression
on these counts gives the document's score.

How many edits a term or stem allows follows from its length, and is less where words of clean training documents
would be taken for it. Labelled documents hold few misspelled terms, so each one with a plain hit is also learned from
with all its hits misspelled, under its own label.

Defined results: a null or empty text has no hits and gets the score of a text without hits;
repeated rows each get a row with equal scores; a score of exactly the threshold is toxic; an empty table gives an empty result;
a null doc_id is never learned from; a text of any length is read whole; extra columns, whatever their names, are ignored
by :func:`score` and kept by :func:`reject`. One edit is one byte; ASCII case is ignored.
Without any positive training label the lexicon is empty and all scores are 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm import common as C

SAMPLE_DOCS = 12_000  #: labelled documents read for training, at most about this many
STEM_LENGTHS = (4, 5, 6, 7, 8)  #: prefixes tried as stems, in characters
EVIDENCE = 0.01  #: share of toxic training documents that a term is in, at least
PURITY = 20  #: documents with a term that are toxic, for one that is not, at least
WINDOW = 60  #: bytes of context on either side of a hit
REPORTING = ("said", "says", "wrote", "quoted", "called")
SECOND_PERSON = ("you", "your", "du", "dein", "tu", "vous", "eres")
N_FEATURES = 7


# ---------------------------------------------------------------- automaton
@dataclass
class Automaton:
    """Deterministic product of a lexicon trie and Levenshtein automata. State 0 is dead."""

    classes: np.ndarray  # byte -> symbol
    step: np.ndarray  # state, symbol -> state
    accept: np.ndarray  # state -> 0 nothing, 1 exact term or stem, 2 misspelled term
    start: int = 1

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = np.zeros(len(starts), np.int8)
        idx, pos, state = np.arange(len(starts)), starts.copy(), np.full(len(starts), self.start, np.int32)
        stop = ends
        while len(idx):
            done = pos >= stop
            if done.any():
                kind[idx[done]] = self.accept[state[done]]
                live = ~done
                idx, pos, state, stop = idx[live], pos[live], state[live], stop[live]
            state = self.step[state, self.classes[data[pos]]]
            live = state != 0
            if not live.all():
                idx, pos, state, stop = idx[live], pos[live], state[live], stop[live]
            pos = pos + 1
        return kind


def build(terms: dict[str, tuple[int, bool]]) -> Automaton:
    """``terms``: term -> (edits allowed, whether it is a stem that any ending may follow)."""
    children: list[dict[int, int]] = [{}]
    limit = [0]  # edits allowed by any term at or below a node
    ends: dict[int, tuple[int, bool]] = {}
    for term, (k, stem) in sorted(terms.items()):
        node, path = 0, [0]
        for byte in term.lower().encode():
            if byte not in children[node]:
                children.append({})
                limit.append(0)
                children[node][byte] = len(children) - 1
            node = children[node][byte]
            path.append(node)
        old = ends.get(node, (0, False))
        ends[node] = (max(old[0], k), old[1] or stem)
        for p in path:
            limit[p] = max(limit[p], k)
    symbols = sorted({b for c in children for b in c})
    of = {b: i + 1 for i, b in enumerate(symbols)}
    classes = np.zeros(256, np.int32)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        classes[b] = of.get(low, 0)
    FULL = ((-1, 0),)  # a stem has matched; whatever follows is accepted

    def close(items: dict[int, int], near: bool) -> tuple:
        """State of trie nodes with their edits, and whether a stem with edits lies behind."""
        work = list(items.items())
        while work:
            n, e = work.pop()
            for child in children[n].values():  # a byte of the term is missing in the word
                if e + 1 <= limit[child] and items.get(child, 99) > e + 1:
                    items[child] = e + 1
                    work.append((child, e + 1))
        stems = [e for n, e in items.items() if n in ends and ends[n][1] and e <= ends[n][0]]
        if stems and min(stems) == 0:
            return (FULL, False)
        return (tuple(sorted(items.items())), near or bool(stems))

    first = close({0: 0}, False)
    number, todo, rows, accept = {first: 1}, [first], [[0] * (len(symbols) + 1)], [0]
    while todo:
        state = todo.pop(0)
        at, near = state
        good = 2 if near else 0
        for n, e in at:
            if n == -1 or (n in ends and e == 0):
                good = 1
            elif n in ends and e <= ends[n][0] and good == 0:
                good = 2
        row = []
        for sym in [None, *symbols]:
            if at == FULL:
                nxt = state
            else:
                items: dict[int, int] = {}
                for n, e in at:
                    for b, child in children[n].items():
                        cost = e + (b != sym)
                        if cost <= limit[child] and items.get(child, 99) > cost:
                            items[child] = cost
                    if e + 1 <= limit[n] and items.get(n, 99) > e + 1:  # a byte too many
                        items[n] = e + 1
                nxt = close(items, near) if items or near else None
            if nxt and nxt not in number:
                number[nxt] = len(number) + 1
                todo.append(nxt)
            row.append(number[nxt] if nxt else 0)
        rows.append(row)
        accept.append(good)
    return Automaton(classes, np.array(rows, np.int32), np.array(accept, np.int8))


def edits_for(term: str) -> int:
    """Edits allowed by a term's length."""
    n = len(term)
    return 0 if n < 5 else 1 if n < 9 else 2


# ---------------------------------------------------------------- features
def features(auto: Automaton, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per document: plain exact, plain misspelled, quoted exact, quoted misspelled hits and hits
    near a second person, as log1p; whether there is any plain exact, any plain misspelled hit."""
    n = len(offs) - 1
    out = np.zeros((n, N_FEATURES))
    starts, ends, first = C.words(data, offs)
    if len(starts):
        s, e = C.trim(data, starts, ends)
        kind = auto.run(data, s, e)
        hit = np.flatnonzero(kind)
        doc = np.searchsorted(first, hit, "right") - 1
        for w, d in zip(hit.tolist(), doc.tolist(), strict=True):
            lo, hi = max(int(offs[d]), int(starts[w]) - WINDOW), min(int(offs[d + 1]), int(ends[w]) + WINDOW)
            left = bytes(data[lo : s[w]]).decode("utf-8", "ignore").lower()
            right = bytes(data[e[w] : hi]).decode("utf-8", "ignore").lower()
            quoted = _quoted(left, right)
            out[d, (2 if quoted else 0) + (kind[w] == 2)] += 1
            near = set(left.split()[-4:]) | set(right.split()[:4])
            out[d, 4] += not quoted and any(x in near for x in SECOND_PERSON)
    out[:, 5:7] = np.expm1(out[:, 0:2] > 0)
    return np.log1p(out)


def _quoted(left: str, right: str) -> bool:
    """Whether marks open before and close after the hit, or a reporting verb stands just before."""
    for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        opened = left.count(a) % 2 == 1 if a == b else left.rfind(a) > left.rfind(b)
        if opened and b in right:
            return True
    return any(x.strip(':,"') in REPORTING for x in left.split()[-2:])


# ---------------------------------------------------------------- training
@dataclass
class Model:
    terms: dict[str, tuple[int, bool]]
    auto: Automaton
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = features(self.auto, data, offs)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _term_rows(batches):
    """Per training document: a near-copy signature and its distinct words."""
    schema = pa.schema([("y", pa.int32()), ("sig", pa.int64()), ("terms", pa.list_(pa.string()))])
    for b in batches:
        y = b.column(b.schema.get_field_index("__y")).to_numpy()
        for r0, r1, _, data, offs in C.chunks(b, 1 << 18):
            vals, at = C.sets(*C.shingles(data, offs), len(offs) - 1)
            least = np.zeros(len(offs) - 1, np.uint64)
            some = np.diff(at) > 0
            least[some] = vals[at[:-1][some]]
            starts, ends, first = C.words(data, offs)
            s, e = C.trim(data, starts, ends) if len(starts) else (starts, ends)
            raw, terms = data.tobytes(), []
            for i in range(len(offs) - 1):
                found = {raw[a:b2].lower() for a, b2 in zip(s[first[i] : first[i + 1]].tolist(), e[first[i] : first[i + 1]].tolist(), strict=True) if b2 > a}
                terms.append(sorted({w.decode("utf-8", "ignore").lower() for w in found}))
            yield pa.RecordBatch.from_arrays([pa.array(y[r0:r1], pa.int32()), pa.array(least.view(np.int64)), pa.array(terms, schema.field("terms").type)], schema=schema)


def prefix_distances(term: str, word: str) -> list[int]:
    """Edits between ``term`` and each prefix of ``word``, in bytes."""
    row = list(range(len(word.encode()) + 1))
    for i, x in enumerate(term.encode(), 1):
        new = [i]
        for j, y in enumerate(word.encode(), 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def tolerances(terms: dict[str, tuple[int, bool]], bad: dict[str, int], near: list[tuple[str, int]]) -> dict[str, tuple[int, bool]]:
    """``terms`` with no more edits than words of clean documents allow: those taken for a term (``near``: word, clean
    documents) must be in fewer than one for ``PURITY`` toxic documents that the term itself is in."""
    out = {}
    for t, (k, stem) in terms.items():
        clean = [0] * (k + 1)
        for w, n in near:
            row = prefix_distances(t, w)
            d = min(row) if stem else row[-1]
            for e in range(max(d, 1), k + 1):
                clean[e] += n
        while k and clean[k] * PURITY >= bad.get(t + "*" * stem, 0):
            k -= 1
        out[t] = (k, stem)
    return out


def misspell(auto: Automaton, terms: dict[str, tuple[int, bool]], data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents with exact hits, one edit made in each hit that allows it: (document numbers, bytes, offsets)."""
    starts, ends, first = C.words(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), data[:0], np.zeros(1, np.int64)
    s, e = C.trim(data, starts, ends)
    hit = np.flatnonzero(auto.run(data, s, e) == 1)
    doc = np.searchsorted(first, hit, "right") - 1
    raw, who, texts = data.tobytes(), [], []
    for d in np.unique(doc).tolist():
        at, parts, changed = int(offs[d]), [], False
        for w in hit[doc == d].tolist():
            word = raw[s[w] : e[w]].lower()
            mine = [t.encode() for t, (k, stem) in terms.items() if k and (word.startswith(t.encode()) if stem else word == t.encode())]
            if mine:
                n = len(max(mine, key=len))
                x = (int(w) * 2654435761 + d) % (1 << 32)
                i, kind = 1 + x % max(1, n - 2), x // 65536 % 3
                edited = word[:i] + (b"*" + word[i + 1 :], word[i + 1 :], word[i : i + 1] + word[i:])[kind]
                parts += [raw[at : s[w]], edited]
                at, changed = int(e[w]), True
        if changed:
            who.append(d)
            texts.append(b"".join([*parts, raw[at : offs[d + 1]]]))
    return np.array(who, np.int64), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, exclude_fold: int = 1, folds: int = 3) -> Model:
    """Learn from labelled rows outside the held-out fold, at most about ``SAMPLE_DOCS`` of them
    (chosen by a hash of the id, so the same ones each time)."""
    lab = labels.select(F.col("doc_id").cast("long").alias("__lab"), F.col("toxic").cast("int").alias("__y")).where("__lab is not null and __y is not null")
    lab = lab.where(F.crc32(F.col("__lab").cast("string").cast("binary")) % folds != exclude_fold).groupBy("__lab").agg(F.max("__y").alias("__y"))
    n = lab.count()
    if n > SAMPLE_DOCS:
        lab = lab.where(F.pmod(F.xxhash64("__lab"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_DOCS / n))
    train = C.materialize(C.doc_bytes(docs).join(lab, F.col("__id") == F.col("__lab")).select("__id", "__text", "__y"), "toxtrain")
    rows = train.mapInArrow(C.lean(_term_rows), "y int, sig long, terms array<string>")
    rows = rows.groupBy("sig", "y").agg(F.min_by("terms", F.size("terms")).alias("terms"))  # one of a group of near copies
    rows = C.materialize(rows, "toxterms")
    n_bad = rows.where("y = 1").count()
    need = max(4, int(EVIDENCE * n_bad))
    stem = lambda w: F.array_compact(F.array(*[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEM_LENGTHS]))
    every = F.array_distinct(F.concat("terms", F.flatten(F.transform("terms", stem))))
    stats = rows.select("y", F.explode(every).alias("term")).groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    stats = C.materialize(stats, "toxstats")
    # a document has a bounded number of terms on average, so no more than 1 / EVIDENCE as many are in so many documents
    got = [(r["term"], r["bad"]) for r in stats.where((F.col("bad") >= need) & (F.col("good") * PURITY < F.col("bad"))).orderBy(F.desc("bad"), "term").collect()]
    terms = choose(got)
    near = _taken(stats.where("good > 0 and term not like '%*'"), build(terms))
    terms = tolerances(terms, dict(got), near)
    auto = build(terms)
    model = Model(terms, auto)

    def feats(batches):
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            y = b.column(b.schema.get_field_index("__y")).to_numpy()
            for r0, r1, _, data, offs in C.chunks(b):
                x = features(auto, data, offs)
                who, data2, offs2 = misspell(auto, terms, data, offs)
                x2 = features(auto, data2, offs2)
                y2 = y[r0:r1][who]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([y[r0:r1], y2]), pa.int32()), pa.array([*x.tolist(), *x2.tolist()], pa.list_(pa.float64()))], schema=schema)

    pts = train.mapInArrow(C.lean(feats), "y int, x array<double>").collect()
    if pts and any(p["y"] for p in pts):
        x, y = np.array([p["x"] for p in pts]), np.array([p["y"] for p in pts], float)
        order = np.lexsort((*x.T, y))  # rows arrive in any order
        model.weights = logistic(x[order], y[order])
    else:
        model.weights = np.append(np.zeros(N_FEATURES), -40.0)
    return model


def _taken(words: DataFrame, auto: Automaton) -> list[tuple[str, int]]:
    """Words (``term``, ``good``) that the automaton takes for misspelled terms."""

    def run(batches):
        for b in batches:
            for _, _, n, data, offs in C.chunks(b):
                hit = np.flatnonzero(auto.run(data, offs[:-1], offs[1:]) == 2)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[offs[i] : offs[i + 1]].decode() for i in hit.tolist()], pa.string()), pa.array(n[hit])], ["term", "n"])

    got = words.select(F.col("good").alias("__id"), F.col("term").cast("binary").alias("__text")).mapInArrow(C.lean(run), "term string, n long")
    return [(r["term"], r["n"]) for r in got.orderBy("term").collect()]


def choose(ranked: list[tuple[str, int]]) -> dict[str, tuple[int, bool]]:
    """Terms and stems with the edits their lengths allow: a stem stands for its words if they are several and none is most of it;
    of nested stems the longest is kept that covers nearly as many documents as the shortest."""
    count = dict(ranked)
    stems: list[str] = []
    for t, n in sorted(ranked, key=lambda x: (len(x[0]), x[0])):
        inside = [s for s in stems if t.startswith(s[:-1])]
        if t.endswith("*") and inside and n >= 0.9 * count[inside[0]]:
            stems[stems.index(inside[0])] = t
        if not t.endswith("*") or inside:
            continue
        whole = max([m for w, m in ranked if not w.endswith("*") and w.startswith(t[:-1])], default=0)
        if whole < 0.6 * n:
            stems.append(t)
    out: dict[str, tuple[int, bool]] = {s[:-1]: (edits_for(s[:-1]), True) for s in sorted(stems, key=lambda s: -count[s])}
    for t, _ in ranked:
        if not t.endswith("*") and t not in out and not any(t.startswith(s[:-1]) for s in stems):
            out[t] = (edits_for(t), False)
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method; the last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge @ w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- operators
def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``__id``, score, predicted for each row of ``docs``."""

    def run(ids, data, offs):
        s = model.score(data, offs)
        return {"__id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return C.map_chunks(docs, run, "__id long, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    def run(batches):
        for b in batches:
            text = pa.compute.fill_null(b.column(b.schema.get_field_index(text_col)).cast(pa.large_binary()), b"")
            view = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], ["__id", "__text"])
            for r0, r1, _, data, offs in C.chunks(view):
                yield b.slice(r0, r1 - r0).filter(pa.array(model.score(data, offs) < threshold))

    import pyarrow.compute  # noqa: F401

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(C.lean(run), docs.schema)
