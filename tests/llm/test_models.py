"""Trained operators on held-out rows and on planted cases."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oreline.llm import common as C
from oreline.llm import queries as llm_queries
from oreline.llm import decontamination, licenses, quality, toxicity, url_filter

WORD = st.text(alphabet="abcd", min_size=1, max_size=8)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def view(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(WORD, st.integers(0, 2), min_size=1, max_size=4), WORD)
def test_automaton(terms, word):
    terms = {t: min(k, max(0, len(t) - 1)) for t, k in terms.items()}
    auto = toxicity.build({t: (k, False) for t, k in terms.items()})
    data, _ = view(word)
    got = auto.run(data, np.array([0]), np.array([len(word)]))[0]
    want = 1 if word in terms else 2 if any(distance(t, word) <= k for t, k in terms.items()) else 0
    assert got == want


def test_stems_quotes_and_misspellings():
    auto = toxicity.build({"idiot": (1, False), "vile": (0, True)})
    x = toxicity.features(auto, *view("you idiot!", "an idoit? IDIOTT.", 'he said "idiot" to me', "vileness here", "nothing", ""))
    assert (x[:, 0] > 0).tolist() == [True, False, False, True, False, False]
    assert x[1, 1] > 0 and x[2, 2] > 0 and x[0, 4] > 0 and not x[4:].any()


def bare_bytes(text):
    """Words of a text without the punctuation around them, as lower-cased bytes."""
    good = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    out = []
    for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()):
        keep = [i for i, c in enumerate(w) if good(c)]
        if keep:
            out.append(w[keep[0] : keep[-1] + 1])
    return out


def test_toxicity_hits_equal_brute_force(spark):
    """Every word of a table against every term: exact, a stem of it, or within the edits the term allows."""
    terms = {"idiot": (1, False), "achl": (1, True), "worthless": (2, False), "the": (0, False), "thion": (1, False), "tion": (0, True)}
    model = toxicity.Model(terms, toxicity.build(terms))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    extra = ["an idot, IDIOT idiiot", "achx wrthles worthlesss", 'he said "idiot"', "", None]
    for text in [*(r.text for r in docs), *extra]:
        ws = bare_bytes(text)
        want = []
        for w in ws:
            kind = 0
            for t, (k, stem) in terms.items():
                row = toxicity.prefix_distances(t, w.decode("utf-8", "ignore")) if w.isascii() else None
                if row is None:  # bytes that are no whole characters: distances in bytes
                    row = [distance(t.encode(), w[:n]) for n in range(len(w) + 1)]
                d = min(row) if stem else row[-1]
                kind = 1 if d == 0 else 2 if d <= k and kind != 1 else kind
            want.append(kind)
        data, offs = view(text or "")
        starts, ends, _ = C.words(data, offs)
        s, e = C.trim(data, starts, ends) if len(starts) else (starts, ends)
        got = model.auto.run(data, s, e)[e > s] if len(starts) else []
        assert list(got) == want


def test_toxicity_misspelled_and_quoted(spark):
    """Documents whose terms are all misspelled are rejected, those that only quote them are not."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    toxic = [r.doc_id for r in labels.collect() if r.toxic and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    texts = [r.text or "" for r in docs.where(docs["doc_id"].isin(toxic)).collect()]
    who, data, offs = toxicity.misspell(model.auto, model.terms, *view(*texts))
    only = toxicity.features(model.auto, data, offs)[:, 0] == 0
    assert only.sum() > 10 and (model.score(data, offs)[only] >= 0.7).mean() > 0.9
    quoted = [f'They wrote: "{t}" and went on with other things.' for t in model.terms]
    assert (model.score(*view(*quoted)) < 0.7).all()


def test_quality_scores_equal_the_model(spark):
    """Every row of a table against the model's features and network, one text at a time."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["__id"]: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = np.clip((quality.features(*view(r.text or "")) - model.center) / model.scale, -8, 8)
        z = np.tanh(x @ model.layers[0] + model.layers[1]) @ model.layers[2] + model.layers[3][0]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z[0]))) < 1e-6


def held_out(spark, sf, module, label, folds, fold):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.fit(docs, labels, fold, folds)
    s = {r["__id"]: r for r in module.score(docs, model).collect()}
    rows = [(s[r.doc_id].score, r[label]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == fold]
    return np.array(rows), s


def test_toxicity_held_out(spark):
    rows, s = held_out(spark, "/root/testdata/sf0.1", toxicity, "toxic", 3, 1)
    hit = rows[:, 0] >= 0.7
    assert len(s) == 10_000 and (hit == rows[:, 1]).mean() > 0.97 and hit[rows[:, 1] == 1].mean() > 0.85


def test_quality_held_out(spark):
    rows, _ = held_out(spark, "/root/testdata/sf0.1", quality, "quality", 4, 2)
    assert ((rows[:, 0] >= 0.7) == rows[:, 1]).mean() > 0.95


def test_nonnegative_risk_finds_the_prior():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (3000, 3))
    unl = np.vstack([rng.normal(1.5, 1, (2800, 3)), neg[:1200]])
    prior = quality.estimate_prior(pos, unl)
    assert abs(prior - 0.7) < 0.12
    layers = quality.train(pos, unl, prior)
    z = quality._forward(layers, np.vstack([pos[:500], neg[1500:2000]]))[1]
    assert ((z > 0) == np.repeat([True, False], 500)).mean() > 0.95


def test_licences(spark):
    model = licenses.fit([f"plain text number {i} about things and the rest of it" for i in range(300)])
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "words and\nLicensed under the Apache License, Version 2.0.", "plain text about the things", None, "", "Use of this map is subject to the license of its makers.", "Licensed under CC BY-SA 4.0. " + "x " * 3000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)] + [(0, lines[0], "z")], "doc_id long, text string, family string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(docs, model).collect())
    assert [g for g in got if g[3]][:4] == [(0, 0, "MIT", True), (0, 0, "MIT", True), (1, 0, "CC-BY-NC", True), (2, 1, "Apache-2.0", True)]
    assert all(g[0] not in (3, 4, 5) for g in got) and all(g[2] == "unknown" for g in got if not g[3])


def test_licence_scan_equals_brute_force(spark):
    """Every line of a table against the model and the templates, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(-1, "CC BY 4.0\nCC BY-SA 4.0\nCC BY-NC 4.0\nCC0"), (-2, "MIT"), (-3, None), (-4, ""), (-5, "GNU\nlicensed under\nof the terms")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    model = licenses.fit(licenses.sample_lines(docs))
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(docs, model).collect()}
    seen = set()
    for r in docs.collect():
        for n, line in enumerate((r.text or "").split("\n")):
            ws = licenses.words(line)
            gs = set(licenses.grams(ws))
            if not gs & set(model.weights):
                continue
            z = (np.array(model.bias) + sum(np.array(model.weights[g]) for g in gs if g in model.weights)) / model.temperature
            p = np.exp(z)
            p /= p.sum()
            if p[-1] >= licenses.FLOOR - 1e-9:
                assert (r.doc_id, n) not in got or abs(p[-1] - licenses.FLOOR) < 1e-6
                continue
            seen.add((r.doc_id, n))
            mine, guess = got[r.doc_id, n], model.classes[int(p[:-1].argmax())]
            pairs = set(licenses.grams(ws)[len(ws) :])
            alike = 0.0
            for t in licenses.TEMPLATES.get(guess, []):
                own = set(licenses.grams(licenses.words(t))[len(licenses.words(t)) :])
                if own:
                    alike = max(alike, len(own & pairs) / len(own), len(own & pairs) / len(pairs) if len(pairs) >= 3 else 0)
            assert abs(mine.similarity - alike) < 1e-9 and abs(mine.probability - p[:-1].max()) < 1e-9
            assert mine.family == (guess if alike >= licenses.CONFIRM else "unknown") and mine.confirmed == (alike >= licenses.CONFIRM)
    assert seen == set(got)
    assert [got[-1, i].family for i in range(3)] == ["CC-BY", "CC-BY-SA", "CC-BY-NC"]


def test_licence_scores_equal_the_model(spark):
    model = licenses.fit([f"plain text number {i}" for i in range(50)])
    line = "This work is licensed under the GNU General Public License, version 3."
    r = licenses.scan(spark.createDataFrame([(1, line)], "doc_id long, text string"), model).first()
    z = np.array(model.bias)
    for g in set(licenses.grams(licenses.words(line))):
        z = z + np.array(model.weights.get(g, [0.0] * len(z)))
    p = np.exp(z / model.temperature - (z / model.temperature).max())
    p /= p.sum()
    assert model.classes[int(p[:-1].argmax())] == r.family == "GPL" and abs(p[:-1].max() - r.probability) < 1e-9


def test_urls(spark):
    rules = url_filter.parse_rules(["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"])
    urls = ["http://A.Example.COM/en/1?x=1", "https://www.example.com/en/2#t", "http://x.net/es/3", "http://x.net/de/3", "nothing", None, "http://com", "http://com/", "ftp://notcom/", "http://q.org?a/b", "http://b.example.com/EN/"] * 2
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.text) and r.verdict in ("allow", "block")
        assert best is None or r.verdict == best.verdict


def test_urls_learn_from_given_labels(spark):
    rng = np.random.default_rng(4)
    name = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    urls = [(f"http://{name()}.org/{name()}?{'&'.join(f'p{j}=1' for j in range(6))}" if i % 2 else f"https://{name()}.org/{name()}", i % 2) for i in range(600)]
    labels = spark.createDataFrame(urls[:400], "url string, block int")
    pages = spark.createDataFrame([(i, u, "z") for i, (u, _) in enumerate(urls[400:])] + [(None, None, None)] * 2, "page_id long, url string, cell1 string")
    got = url_filter.judge(pages, url_filter.parse_rules(["block q.org/"]), labels).collect()
    by = {r.page_id: r.verdict for r in got}
    assert len(got) == 202 and all(by[i] == ("block" if y else "allow") for i, (_, y) in enumerate(urls[400:]))
    assert url_filter.judge(pages, []).select("verdict").distinct().collect()[0][0] == "allow"


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = url_filter.boost(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=20), st.integers(2, 4))
def test_tiles(a, b, least):
    tiles = decontamination.tiles(a, b, least)
    ua = [i + k for i, _, n in tiles for k in range(n)]
    ub = [j + k for _, j, n in tiles for k in range(n)]
    assert len(set(ua)) == len(ua) and len(set(ub)) == len(ub) and all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in tiles)
    free_a, free_b = set(range(len(a))) - set(ua), set(range(len(b))) - set(ub)
    for i in range(len(a) - least + 1):  # nothing of the least length is left over
        for j in range(len(b) - least + 1):
            if a[i : i + least] == b[j : j + least]:
                assert not (set(range(i, i + least)) <= free_a and set(range(j, j + least)) <= free_b)


def longest_first(a, b, least):
    """Greedy string tiling as it is defined: the longest common unmarked string, the earliest of equal ones, again and again."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                best = min(best, (-k, i, j))
        k, i, j = best
        if -k < least:
            return sorted(out, key=lambda t: t[1])
        ma[i : i - k] = mb[j : j - k] = [True] * -k
        out.append((i, j, -k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=16), st.integers(1, 4))
def test_tiles_are_the_longest_first(a, b, least):
    assert decontamination.tiles(a, b, least) == longest_first(a, b, least)


def test_tiles_of_one_repeated_word():
    assert sum(n for _, _, n in decontamination.tiles([7] * 20_000, [7] * 40, 4)) == 40


def bare(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    good = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    out = []
    for w in re.split("[\x20\x09-\x0d]+", low):
        keep = [i for i, c in enumerate(w) if good(c)]
        if keep:
            out.append(w[keep[0] : keep[-1] + 1])
    return out


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_leaks_equal_brute_force(spark, block, monkeypatch):
    """The whole query on a table: every document against every item that shares a string of four words with it."""
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", block)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 16)
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): (r.matched_words, r.item_words, r.n_tiles) for r in llm_queries.op1_decontamination(spark, sf).collect()}
    tables = [[tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    want = leaked(*tables)
    assert got == want and want


def leaked(docs, bench):
    """{(doc, item): (matched words, item words, tiles)} of rows (id, text)."""
    items = {i: bare(t) for i, t in bench}
    number: dict[str, int] = {}
    ids = lambda ws: [number.setdefault(x, len(number) + 1) for x in ws]
    grams = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)} for i, w in items.items()}
    want = {}
    for i, text in docs:
        w = bare(text)
        mine = {tuple(w[k : k + n]) for n in (1, 2, 3, 4) for k in range(len(w) - n + 1)}
        for item, words in items.items():
            covered = {k + x for k in range(len(words) - 3) if tuple(words[k : k + 4]) in mine for x in range(4)}
            if not words or not grams[item] & mine or (len(words) > 3 and len(covered) < 0.5 * len(words)):
                continue
            t = decontamination.tiles(ids(w), ids(words), min(4, len(words)))
            if sum(n for _, _, n in t) >= 0.5 * len(words):
                want[i, item] = (sum(n for _, _, n in t), len(words), len(t))
    return want


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_leaks_are_found_in_any_order(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", block)
    items = {i: " ".join(f"q{i}x{j}" for j in range(24)) for i in range(6)}
    half = items[0].split()
    texts = [f"some words {items[1].upper()}, more words", " ".join(half[12:]) + " between " + " ".join(half[:12]), " ".join(half[:9]) + " only", "clean text of many other words here", None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["__id"], r.item_id, r.n_tiles, r.coverage) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(0, 1, 1, 1.0), (1, 0, 2, 1.0)}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}


def test_word_hashes_do_not_depend_on_place():
    data, offs = view("Aa bb cc dd ee ff", "zz aA bb CC dd ee")
    d, v = C.shingles(data, offs, 5)
    assert set(v[d == 0].tolist()) & set(v[d == 1].tolist()) and len(v) == 4
    d, v = C.shingles(*view("a b", "A  b", "", "b a"), 5)
    assert v[0] == v[1] != v[2] and d.tolist() == [0, 1, 3]
