"""URL verdicts: list rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix, and fits its host and all subdomains; the longest fitting rule decides. URLs that
rules decide are the labelled ones the trees learn from, unless ``labels`` (url, block) are given. Features are the length, the
depth of the path, the share of digits, the entropy of host and path, the number of parameters, hyphens, labels of the
host, the lengths of its labels, and how often URLs with the same last label, and the same last two labels of the host, are
blocked (smoothed counts over all labelled rows, in ``SUFFIX_CELLS`` hashed cells each, so the tables are bounded; a URL that
is learned from is left out of its own counts).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees on its features; a null page_id stays null; repeated rows get equal verdicts; a block probability of exactly one half blocks;
a url of any length is read whole; extra columns, whatever their names, are ignored; an empty table gives an empty result. If the labels hold one class only, that class is the verdict; without labels it is ``allow``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.llm import common as C

SAMPLE_URLS = 20_000  #: labelled URLs the trees are fitted on, at most about this many
SUFFIX_CELLS = 4_096
TREES, DEPTH, RATE, BINS, L2 = 60, 4, 0.2, 32, 1.0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """``"block example.com/en/"`` and the like."""
    out = []
    for line in lines:
        verdict, _, where = line.partition(" ")
        host, slash, path = where.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


# ---------------------------------------------------------------- host, path and rules, as expressions
def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(tail, r"^([^?#]*)", 1)


def rule_for(host: F.Column, path: F.Column, rules: list[Rule]) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest fitting rule, null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def suffix_cells(host: F.Column) -> list[F.Column]:
    """Hashed cells of the host's last label and of its last two."""
    return [F.pmod(F.xxhash64(F.substring_index(host, ".", -n), F.lit(n)), F.lit(SUFFIX_CELLS)).cast("int").alias(f"cell{n}") for n in (1, 2)]


# ---------------------------------------------------------------- features
def _entropy(x: bytes) -> float:
    if not x:
        return 0.0
    p = np.bincount(np.frombuffer(x, np.uint8), minlength=1)
    p = p[p > 0] / len(x)
    return float(-(p * np.log2(p)).sum())


def features(urls: list[str], hosts: list[str], paths: list[str], rates: np.ndarray) -> np.ndarray:
    """A row for each URL; ``rates``: how often its suffixes are blocked."""
    rows = []
    for u, h, p, r in zip(urls, hosts, paths, rates.tolist(), strict=True):
        n = max(1, len(u))
        query = u.partition("?")[2].partition("#")[0]
        labels = h.split(".")
        rows.append((
            len(u), len(h), len(p), p.count("/"), sum(ch.isdigit() for ch in u) / n, _entropy(h.encode()), _entropy(p.encode()),
            query.count("=") if query else 0, h.count("-"), len(labels), "#" in u, u.startswith("https"), h.startswith("www."), len(p.split("/")[1]) if p.count("/") > 1 else 0,
            len(labels[-1]), max(map(len, labels)), *r,
        ))
    return np.array(rows, float).reshape(len(urls), 18)


# ---------------------------------------------------------------- boosting
@dataclass
class Trees:
    base: float = 0.0
    nodes: list = field(default_factory=list)  # per tree: (feature, threshold, value), complete binary trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feat, thr, val in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feat[at]] > thr[at])
            out += val[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order leaves, histogram splits; depth-wise complete trees."""
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(p0 / (1 - p0))))
    if y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    score = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        inner = 2**DEPTH - 1
        feat, thr, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, None)
            if len(rows) > 1:
                G, H = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], BINS + 1))[: len(edges[f])]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], BINS + 1))[: len(edges[f])]
                    gain = gl**2 / (hl + L2) + (G - gl) ** 2 / (H - hl + L2) - G**2 / (H + L2)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, edges[f][i], i)
            feat[node], thr[node] = best[1], best[2]
            go = x[rows, feat[node]] > thr[node]
            at[rows] = 2 * node + 1 + go
        leaf = at - inner
        G, H = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        val = -RATE * G / (H + L2)
        model.nodes.append((feat, thr, val))
        score += val[leaf]
    return model


# ---------------------------------------------------------------- operator
def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """``page_id``, host, path, rule, verdict, score (block probability by the trees, also where a rule decides). ``labels``: url
    and block (0 or 1) of URLs to learn from, in place of those the rules decide."""
    host, path = host_path(F.col("url"))
    parts = (host.alias("host"), path.alias("path"))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), *parts)
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "url", "host", "path", text.alias("rule"), verdict.alias("listed"), *suffix_cells(F.col("host")))
    if labels is None:
        known = base.where("listed is not null").select("url", "host", "path", "cell1", "cell2", (F.col("listed") == "block").cast("int").alias("y"))
    else:
        known = labels.where("url is not null and block is not null").select("url", F.col("block").cast("int").alias("y"), *parts)
        known = known.select("url", "host", "path", *suffix_cells(F.col("host")), "y")
    rates, prior = [], 0.0
    tables = []
    for c in ("cell1", "cell2"):
        counts = known.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).collect()  # <= SUFFIX_CELLS rows
        n, bad = np.zeros(SUFFIX_CELLS), np.zeros(SUFFIX_CELLS)
        for r in counts:
            n[r[c]], bad[r[c]] = r["n"], r["bad"]
        prior = bad.sum() / max(1.0, n.sum())
        tables.append((n, bad))
        rates.append((bad + 10 * prior) / (n + 10))
    total = int(tables[0][0].sum())
    model = Trees(-40.0)
    if total:
        share = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_URLS / total)) + 1
        # a url that fills many rows is learned from once
        sample = known.where(share).groupBy("url", "host", "path", "cell1", "cell2").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
        sample = sample.orderBy(F.xxhash64("url"), "url").limit(SAMPLE_URLS).toPandas()
        if len(sample):
            own = []
            for c, (n, bad) in zip(("cell1", "cell2"), tables, strict=True):
                at = sample[c].to_numpy()
                own.append((bad[at] - sample["bad"].to_numpy() + 10 * prior) / (n[at] - sample["n"].to_numpy() + 10))
            model = boost(features(list(sample["url"]), list(sample["host"]), list(sample["path"]), np.stack(own, 1)), sample["y"].to_numpy(float))
    ddl = T._parse_datatype_string("page_id long, host string, path string, rule string, verdict string, score double")

    def run(batches):
        for b in batches:
            url, host, path, listed = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path", "listed"))
            cells = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cell1", "cell2")]
            x = features(url, host, path, np.stack([r[c] for r, c in zip(rates, cells, strict=True)], 1))
            s = 1 / (1 + np.exp(-np.clip(model.raw(x), -40, 40)))
            said = [v if v is not None else ("block" if p >= 0.5 else "allow") for v, p in zip(listed, s.tolist(), strict=True)]
            cols = [b.column(0).cast(pa.int64()), pa.array(host), pa.array(path), b.column(b.schema.get_field_index("rule")), pa.array(said), pa.array(s)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=ddl.names)

    return base.mapInArrow(C.lean(run), ddl)
