"""Pair, suffix, packing, payload and token results against brute force."""

import bisect
import hashlib
import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreline.llm import jaccard_join, language_model, media, packing, suffix_dedup
from oreline.llm import queries as Q
from oreline.llm.suffix_array import common_prefixes, suffix_array

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __extra string"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w]


def crafted(spark):
    rng = np.random.default_rng(3)
    w = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    base, line = w(120), w(30)
    texts = [base, base, base.replace("w1", "W1"), base[:-40], base + " tail end", None, "", "  \n ", "one two", "one two", "One  two", w(80) + " " + line, line + " " + w(70), w(3000) + " " + line, "x" * 5000]
    parts = base.split()
    for i in range(40):  # near copies
        p = list(parts)
        for j in rng.integers(0, len(p), 2):
            p[j] = f"n{i}"
        texts.append(" ".join(p))
    rows = [(i, t, "en", "s", None, "e") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, base, None, None, 1, None), (8, "one two", "en", "s", 7, "e")], SCHEMA)


def components(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = words(t)
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse, shared = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            inverse[g].append(k)
    for members in inverse.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                shared[members[a], members[b]] += 1
    for (a, b), o in shared.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("source", "bits"), [("crafted", 64), ("crafted", 4), ("table", 64)])
def test_op10(spark, sf, source, bits, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    docs = crafted(spark) if source == "crafted" else spark.read.parquet(f"{sf}/documents.parquet")
    if source == "crafted":
        got = jaccard_join.components(docs, bits=bits).select(Q.C.back().alias("doc_id"), "n_shingles", "component_id").collect()
    else:
        got = Q.op10_ngram_jaccard(spark, sf).collect()
    want = components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_op10_keeps_one(spark):
    docs = crafted(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and not ids & {1, 2, 15, 54, None} and {5, 6, 7, 11, 12, 13} <= ids


def test_op10_keeps_one_decides_by_row(spark):
    rng = np.random.default_rng(9)
    w = lambda: " ".join(f"w{x}" for x in rng.integers(0, 4000, 60))
    a, b, c, d, e, f = (w() for _ in range(6))
    rows = [
        (1, a), (None, a), (2, a + " end"),  # a group with a real id
        (None, b), (None, c), (None, ""), (None, None),  # unrelated rows without an id
        (3, d), (3, a + " tail"),  # an id with two texts, one a near copy of a smaller id
        (4, e), (4, e), (4, e + " x"),  # repeats of the id that stays
        (None, f), (None, f), (None, f + " x"),  # a group without an id
        (5, ""), (5, ""),
    ]
    kept = jaccard_join.keep_one(spark.createDataFrame([(i, t, "en", "s", 1, "e") for i, t in rows], SCHEMA).repartition(3))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert {r: n for r, n in got.items() if r[1] not in (e, e + " x", f, f + " x")} == {(1, a): 1, (None, b): 1, (None, c): 1, (None, ""): 1, (None, None): 1, (3, d): 1, (5, ""): 2}
    assert sum(n for (i, t), n in got.items() if i == 4) == 1
    assert sum(n for (i, t), n in got.items() if t in (f, f + " x")) == 1


def covers(rows, size=100):
    """(id, bytes, flags of the bytes to remove) of every row, in the order of ids."""
    seen = {}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        key = (i is not None, i or 0)
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p : p + size], (key, p))
    for i, t in rows:
        b, key = (t or "").encode(), (i is not None, i or 0)
        cover = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] < (key, p):
                cover[p : p + size] = b"\1" * size
        yield i, b, cover


def kept_bytes(rows):
    return [bytes(c for c, m in zip(b, cover, strict=True) if not m) for _, b, cover in covers(rows)]


def repeats(rows, size=100):
    out = []
    for i, b, cover in covers(rows, size):
        spans = sum(cover[j] and (j == 0 or not cover[j - 1]) for j in range(len(cover)))
        out.append((str(i), len(b), sum(cover), spans, hashlib.sha256(bytes(c for c, m in zip(b, cover, strict=True) if not m)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("source", "rows"), [("crafted", 16_000), ("crafted", 2), ("table", 16_000)])
def test_op5(spark, sf, source, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", rows)
    docs = crafted(spark) if source == "crafted" else spark.read.parquet(f"{sf}/documents.parquet")
    got = suffix_dedup.digest(docs).select(Q.C.back("__doc").alias("d"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_op5_rewrite(spark):
    docs = crafted(spark)
    out = suffix_dedup.rewrite(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and rows[5].text is None and rows[6].text == "" and rows[5].n_chars is None
    assert sorted(r.n_chars or 0 for r in out.where("doc_id = 8").collect()) == [0, 7]
    assert len(rows[14].text) < 5000 and rows[14].n_chars == len(rows[14].text)


def test_clashing_names(spark):
    """Columns named like those the operators add stay as they are."""
    docs = crafted(spark).selectExpr("*", "concat('a', doc_id) as __id", "'s' as spans", "1 as __row", "2 as cls", "'t' as __text", "3 as __cut")
    few = docs.where("doc_id in (5, 6, 7, 11, 14)")  # nothing of these goes whole
    for got in (suffix_dedup.rewrite(few), jaccard_join.keep_one(few), jaccard_join.keep_one(docs)):
        assert got.columns == docs.columns
        assert all((r["__id"], r.spans, r["__row"], r.cls, r["__text"], r["__cut"]) == (f"a{r.doc_id}" if r.doc_id is not None else None, "s", 1, 2, "t", 3) for r in got.collect())
    assert {r.doc_id for r in suffix_dedup.rewrite(few).collect()} == {5, 6, 7, 11, 14}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4))
def test_suffix_arrays(symbols, times):
    t = symbols * times
    sa = suffix_array(np.array(t, np.int64))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    lcp = common_prefixes(np.array(t, np.int64), sa)
    for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        n = next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0)
        assert lcp[a] == n


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 700).astype(np.uint8)
    offs = np.array([0, 50, 50, 149, 700])
    d, h, s, w = suffix_dedup.runs(text, offs, 100, 40)
    got = sorted((int(a), int(b) + j) for a, b, n in zip(d, s, w, strict=True) for j in range(n))
    assert got == [(3, p) for p in range(551 - 99)]
    twice = np.concatenate([text, text])
    d2, h2, s2, w2 = suffix_dedup.runs(twice, np.array([0, 700, 1400]), 100, 40)
    assert np.array_equal(h2[d2 == 0], h2[d2 == 1]) and np.array_equal(s2[d2 == 0], s2[d2 == 1])


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 40), min_size=1, max_size=40))
def test_plans(counts):
    classes = packing.plan(counts, 256)
    used = Counter()
    for lengths, bins in classes:
        assert sum(lengths) <= 256
        for k in lengths:
            used[k] += bins
    assert used == Counter(counts)
    assert sum(n for _, n in classes) <= best_fit_decreasing(counts, 256)


def best_fit_decreasing(counts, capacity):
    rooms = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            i = bisect.bisect_left(rooms, k)
            room = rooms.pop(i) if i < len(rooms) else capacity
            bisect.insort(rooms, room - k)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(list(" \t\n\r\x0b\x1c\x85\xa0\u2028'sdtß×²ªÀ你<|>")), max_size=40), max_size=8))
def test_ids_are_the_library_s(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, "it's  <|endoftext|> x\n\n y  ", "", "we'll 's ''re'd don't've\n's  'm"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for _ in range(2):
        ids, at = enc(data, offs)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_texts_are_split():
    """Texts of plain characters, all of them, never go to the library whole."""
    plain = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]))
    data = np.frombuffer(plain.encode(), np.uint8)
    assert not packing.split(data, np.array([0, len(data)]))[1].any()
    for odd in ("\x0b", "\xa0", "\xad", "\u0250", "\u2028", "你", "😀", "\x7f"):
        data = np.frombuffer(odd.encode(), np.uint8)
        assert packing.split(data, np.array([0, len(data)]))[1].all()


@pytest.mark.parametrize("kind", ["uniform", "middle", "log-normal"])
def test_plans_of_many_pieces(kind):
    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 2048, 8_000), "middle": rng.integers(257, 1400, 8_000), "log-normal": np.exp(rng.normal(5.5, 1.2, 8_000)).astype(int).clip(1, 2048)}[kind]
    counts = Counter(lengths.tolist())
    bins = sum(n for _, n in packing.plan(counts))
    assert bins <= best_fit_decreasing(counts, 2048) and bins <= -(-lengths.sum() // 2048) * 1.02 + 1


@pytest.mark.parametrize("source", ["crafted", "table"])
def test_op8(spark, sf, source):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = crafted(spark) if source == "crafted" else spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, path, 256).toPandas()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 256)
        at = 0
        for p in range(n):
            size = len(ids) - 256 * (n - 1) if p == 0 else 256
            want[str(r.doc_id), p, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at += size
    have = Counter((str(None if i == Q.C.NULL_ID else i), p, s, n, c) for i, p, s, n, c in got[["__id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all() and g["length"].sum() <= 256


@pytest.mark.parametrize("source", ["crafted", "table"])
def test_op2(spark, sf, source, monkeypatch):
    if source == "crafted":
        monkeypatch.setattr(Q, "table", lambda *a: crafted(spark))
    got = Counter((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in Q.op2_media_columns(spark, sf).collect())
    want = Counter()
    for r in Q.table(spark, sf, "documents").select("doc_id", "text").collect():
        b = (r.text or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        stored = b"P6\n64 %d\n255\n" % (len(p) // 192) + p
        want[str(r.doc_id), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.describe(p)] += 1
    assert got == want


def test_op2_sequences(spark):
    d = "0" * 64
    html = f'<head><title>t</title></head><p>a &amp; b<img src="sha256:{d}" alt="x">c</p><script>var p;</script><figure><img src=q><figcaption>cap <b>z</b></figcaption></figure>tail'
    items = media.sequence(html)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("text", "a & b", None), ("media", f"sha256:{d}", "x"), ("text", "c", None), ("media", "q", "cap z"), ("text", "tail", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    known = spark.createDataFrame([(d, 5)], "digest string, payload_bytes long")
    rows = media.resolve(media.parse(pages), known).orderBy("id", "position").collect()
    assert [(r.id, r.position, r.kind) for r in rows] == [(1, 0, "text"), (1, 1, "media"), (1, 2, "text"), (1, 3, "media"), (1, 4, "text")] and rows[1].payload_bytes == 5
    p = media.pad(b"abc")
    assert media.decode(media.encode(p)) == p and len(p) == 192 and len(media.pad(b"")) == 192


def test_op4_counts(spark, sf):
    got = Q.op4_lm_scoring(spark, sf).collect()
    docs = {r.doc_id: words(r.text) + [None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(count.values()), len(count)
    for r in got:
        ws = docs[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), total, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_op4_gradients_and_probabilities():
    rng = np.random.default_rng(0)
    net = language_model.Network(np.array([0, 2, 5]), np.array([9, 7, 5, 3, 2]), 10.0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, net.begin + 1, (6, 3)), rng.integers(-1, 5, (6, 3))
    reset = rng.random((6, 3)) < 0.2
    h0 = np.zeros((3, language_model.HIDDEN))
    g, _, loss = net.gradients(h0, x, y, reset)
    for key in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[key].shape) if key != "x" else (int(x[2, 1]), 5)
        old, eps = net.p[key][at], 1e-5
        net.p[key][at] = old + eps
        up = net.gradients(h0, x, y, reset)[2]
        net.p[key][at] = old - eps
        down = net.gradients(h0, x, y, reset)[2]
        net.p[key][at] = old
        assert abs((up - down) / (2 * eps) / y.size - g[key][at]) < 1e-5
    h = rng.normal(0, 1, (1, language_model.HIDDEN))
    assert abs(sum(math.exp(net.log_probs(h, np.array([w]))[0]) for w in range(-1, 5)) - 1) < 1e-6
    w, e, at = rng.integers(-1, 5, 40), rng.integers(0, 9, 40), np.array([0, 1, 30, 40])
    one = [language_model.score_batch(net, w[a:z], e[a:z], np.array([0, z - a]))[0] for a, z in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(language_model.score_batch(net, w, e, at), one)


def test_op4_learns_from_every_training_document(spark, monkeypatch):
    """The order of the words of any one document is seen by the network only; the counts stay the same."""
    monkeypatch.setattr(language_model, "WARM_TOKENS", 1)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20, 60)) for _ in range(12)]

    def scores(turned):
        rows = [(i, " ".join(t.split()[::-1]) if i == turned else t, "en", "s", 1, "e") for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        return {r["__id"]: r.score for r in language_model.score(docs, F.col("__id") != 11).select("__id", "score").collect()}

    plain = scores(None)
    for i in (0, 5, 10):
        assert abs(scores(i)[11] - plain[11]) > 1e-5
    assert scores(11)[0] == pytest.approx(plain[0], abs=1e-9)  # not in training


def test_op4_streams_end_on_their_own():
    rng = np.random.default_rng(2)
    net = language_model.Network(np.array([0, 2, 5]), np.array([9, 7, 5, 3, 2]), 10.0)
    docs = [(rng.integers(-1, 5, n).astype(np.int16), rng.integers(0, 9, n).astype(np.int16)) for n in (700, 1, 30, 0, 24, 25, 3)]
    seen, plain = [], net.gradients
    net.gradients = lambda h, x, y, reset: seen.append((y.copy(), reset.copy())) or plain(h, x, y, reset)
    assert language_model.train(net, docs, parallel=4) == 783
    assert sum(int((y > -2).sum()) for y, _ in seen) == 783 and sum(int(r.sum()) for _, r in seen) == 6
    assert seen[-1][0].shape[1] == 1 and all(np.isfinite(a).all() for a in net.p.values())


def test_op4_windows_use_their_memory_again():
    rng = np.random.default_rng(4)
    net = language_model.Network(np.arange(0, 1537, 48), np.arange(1600, 64, -1), 1000.0)
    x, y, reset = rng.integers(0, net.begin + 1, (24, 512)), rng.integers(-1, 1536, (24, 512)), rng.random((24, 512)) < 0.01
    h0 = np.zeros((512, language_model.HIDDEN), np.float32)
    first = net.gradients(h0, x, y, reset)
    tracemalloc.start()
    again = net.gradients(h0, x, y, reset)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6
    assert first[2] == again[2] and all((first[0][k] == again[0][k]).all() for k in net.p)
    narrow = net.gradients(h0[:5], x[:7, :5], y[:7, :5], reset[:7, :5])  # in what wider windows left behind
    other = pickle.loads(pickle.dumps(net))
    assert not other.room.held
    fresh = other.gradients(h0[:5], x[:7, :5], y[:7, :5], reset[:7, :5])
    assert narrow[2] == fresh[2] and all((narrow[0][k] == fresh[0][k]).all() for k in net.p)
    rows, of = rng.normal(0, 1, (900, 6)), rng.integers(0, 8, 900) ** 2
    got, want = np.zeros((60, 6)), np.zeros((60, 6))
    of[:20] = np.arange(20) // 2  # some rare, some frequent
    net._sums(rows, of, got)
    np.add.at(want, of, rows)
    assert np.allclose(got, want)


def test_op4_groups_of_documents_and_blocks_of_states(monkeypatch):
    rng = np.random.default_rng(6)
    net = language_model.Network(np.array([0, 2, 5]), np.array([9, 7, 5, 3, 2]), 10.0)
    w, e = rng.integers(-1, 5, 600).astype(np.int16), rng.integers(0, 9, 600).astype(np.int16)
    at = np.concatenate([[0, 1, 2, 300], np.sort(rng.choice(np.arange(301, 600), 20, replace=False)), [600]])
    whole = language_model.score_batch(net, w, e, at)
    monkeypatch.setattr(language_model, "SCORE_DOCS", 4)
    monkeypatch.setattr(language_model, "OUT_ROWS", 7)
    assert np.allclose(language_model.score_batch(net, w, e, at), whole, atol=1e-3)
    assert len(language_model.score_batch(net, w[:0], e[:0], np.array([0]))) == 0 and len(net.log_probs(np.zeros((0, language_model.HIDDEN)), w[:0])) == 0


@pytest.mark.parametrize("query", ["op2_media_columns", "op4_lm_scoring", "op5_suffix_dedup", "op8_packing", "op9_toxicity", "op10_ngram_jaccard", "op7_quality", "op1_decontamination", "op6_license_scan", "op3_url_filter"])
def test_empty_tables(spark, query, monkeypatch):
    kinds = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}
    monkeypatch.setattr(Q, "table", lambda s, d, name: spark.createDataFrame([], kinds[name]))
    assert Q.queries()[query](spark, "none").count() == 0


@pytest.mark.parametrize("query", ["op1_decontamination", "op4_lm_scoring", "op6_license_scan", "op7_quality", "op9_toxicity"])
def test_odd_rows(spark, query, monkeypatch):
    tables = {
        "documents": crafted(spark), "labels": spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "e") for i in range(30)] + [(None, 1, 1, "e"), (3, None, None, None)], "doc_id long, quality int, toxic int, __extra string"),
        "benchmark": spark.createDataFrame([(1, "one two"), (2, None), (None, " ".join(f"w{i}" for i in range(20))), (4, "")], "item_id long, text string"),
    }
    monkeypatch.setattr(Q, "table", lambda s, d, name: tables[name])
    rows = Q.queries()[query](spark, "none").collect()
    if query not in ("op1_decontamination", "op6_license_scan"):
        assert len(rows) == tables["documents"].count()
        assert all(r.score is not None and math.isfinite(r.score) for r in rows)
    if query == "op1_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} >= {(8, 1), (9, 1), (10, 1)}


def test_queries_are_whole():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in Q.queries()] == list(range(1, 11))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    """Texts of several chunks' size are whole in every operator."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(8)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 350_000))
    assert len(long) > 2 * Q.C.CHUNK
    texts = {1: long, 2: long + " and a tail of its own", 3: "a short text of a few words only", 4: long[:1_200_000].upper()}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "e") for i, t in texts.items()], SCHEMA)
    tables = {"documents": docs, "labels": spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(7, " ".join(long.split()[300_000:300_030]))], "item_id long, text string")}
    monkeypatch.setattr(Q, "table", lambda s, d, name: tables[name])
    got = {r.doc_id: r for r in Q.op10_ngram_jaccard(spark, "").collect()}
    size = lambda t: len({tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)})
    assert {i: r.n_shingles for i, r in got.items()} == {i: size(t) for i, t in texts.items()}
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: r for r in Q.op5_suffix_dedup(spark, "").collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in got.items()} == {1: (len(long), 0, 0), 2: (len(texts[2]), len(long), 1), 3: (32, 0, 0), 4: (1_200_000, 0, 0)}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.n for r in Q.op8_packing(spark, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert {r.doc_id: r.n_bytes for r in Q.op2_media_columns(spark, "").collect()} == {i: len(t) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in Q.op4_lm_scoring(spark, "").collect()} == {i: len(words(t)) + 1 for i, t in texts.items()}
    assert {(r.doc_id, r.item_id) for r in Q.op1_decontamination(spark, "").collect()} == {(1, 7), (2, 7)}
    for query in (Q.op7_quality, Q.op9_toxicity):
        assert {r.doc_id for r in query(spark, "").collect()} == set(texts)
