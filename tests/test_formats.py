"""Containers, archives, records, directories, text maps, graphics, audio, trees, listings, logs."""

import io
import random
import struct
import zipfile


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreline.operators import bsp, directory, maps
from oreline.operators import relational as R
from oreline.options import FormatError, Limits, Options
from oreline.sources import archive, audio, decoders, graphics, records, textmap, wad
from oreline.streaming import logs

LENIENT = Options(strict=False)
NAMES = st.text(alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", min_size=1, max_size=8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(NAMES, st.binary(max_size=256)), max_size=16))
def test_container_roundtrip(blobs):
    c = wad.parse(wad.build(blobs))
    assert [(x.name, c.bytes_of(i)) for i, x in enumerate(c.lumps)] == blobs and not c.warnings


@pytest.mark.parametrize(("change", "code"), [
    (lambda b: b"XWAD" + b[4:], "magic"), (lambda b: b[:4] + struct.pack("<i", -1) + b[8:], "negative_count"), (lambda b: b[:8] + struct.pack("<i", -5) + b[12:], "negative_directory"),
    (lambda b: b[:-1], "directory_bounds"), (lambda b: b[:-16] + struct.pack("<i", -1) + b[-12:], "negative_filepos"), (lambda b: b[:-12] + struct.pack("<i", 10**6) + b[-8:], "lump_bounds"),
    (lambda b: b[:-8] + b"\xff" * 8, "name_ascii"),
])
def test_anomalies(change, code):
    bad = change(wad.build([("A", b"12345"), ("B", b"678")]))
    with pytest.raises(FormatError) as e:
        wad.parse(bad)
    assert e.value.code == code
    assert any(w.startswith(code) for w in wad.parse(bad, LENIENT).warnings)


def test_first_match_and_writer():
    c = wad.parse(wad.build([("A", b"1"), ("A", b"2")]))
    assert c.bytes_of(c.first("A")) == b"1" and c.first("Z") is None
    assert wad.parse(wad.build([("ABCDEFGHIJ", b"")], options=LENIENT)).lumps[0].name == "ABCDEFGH"
    for name, options in (("ABCDEFGHI", Options()), ("É", LENIENT), ("A\0B", LENIENT)):
        with pytest.raises(FormatError):
            wad.build([(name, b"")], options=options)


def test_scans_agree(spark):
    files = spark.createDataFrame([("a", wad.build([("X", b"abc"), ("Y", b""), ("X", b"zz")])), ("b", b"bad")], "path string, content binary")
    got = {(r.path, r.lump_idx, r.name, bytes(r.data)) for r in wad.scan(files).where("error is null").collect()}
    assert got == {(r.path, r.lump_idx, r.name, bytes(r.data)) for r in wad.scan_native(files).collect()} and len(got) == 3
    assert wad.scan(files).where("error is not null").count() == 1


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_archive(spark):
    inner = wad.build([("MAP01", b""), ("THINGS", b"")])
    data = zipped(**{"maps__e1m1.wad": inner, "big.wad": inner, "sounds__pop^1.lmp": b"x" * 500, "odd__x": b"1"})
    rows = {r.member: r for r in archive.scan(spark.createDataFrame([("dir/big.pk3", data)], "path string, content binary")).collect()}
    assert rows["maps/e1m1.wad"].map == "E1M1" and rows["big.wad"].embedded and rows["sounds/pop^1.lmp"].short == "POP^1" and rows["odd/x"].namespace == "Hidden"
    assert bytes(rows["big.wad"].data) == inner and rows["big.wad"].method == "deflate"
    info = archive.members(data)[2]
    with pytest.raises(FormatError):
        archive.inflate(data, info, Options(limits=Limits(max_decoded_member_bytes=100)))
    with pytest.raises(FormatError):
        archive.inflate(data.replace(b"PK\x03\x04", b"PK\x03\x05"), info)
    for head in (archive.SEVEN, archive.ZIP_EMPTY, archive.ZIP_SPANNED):
        with pytest.raises(FormatError):
            archive.kind_of(head + b"\0" * 20)


@pytest.mark.parametrize("record", sorted(decoders.LAYOUTS))
def test_records(spark, record):
    rng = random.Random(1)
    make = {"s1": lambda: rng.randint(-128, 127), "u1": lambda: rng.randint(0, 255), "s2": lambda: rng.randint(-32768, 32767), "u2": lambda: rng.randint(0, 65535), "u4": lambda: rng.randint(0, 2**32 - 1), "x": lambda: rng.randint(-100, 100) / 4, "n8": lambda: rng.choice(["", "STARTAN2", "A-B"])}
    rows = [{n: make[k]() for n, k in decoders.fields(record)} for _ in range(5)]
    data = decoders.encode(rows, record)
    cols, _ = decoders.decode(data, record)
    assert [dict(zip(cols, v, strict=True)) for v in zip(*cols.values(), strict=True)] == rows
    with pytest.raises(FormatError):
        decoders.decode(data + b"1", record)
    assert decoders.decode(data + b"", record, LENIENT)[1] == []
    if record in ("thing", "sidedef", "d64_vertex", "d64_linedef"):
        df = spark.createDataFrame([("a", data), ("b", b"")], "k string, data binary")
        assert decoders.records(df, record, ["k"]).collect() == decoders.records_native(df, record, ["k"]).orderBy("idx").collect()


def test_sections_and_groups():
    names = ["S_START", "A", "S1_START", "B", "S1_END", "SS_END", "X", "F_START", "C", "END", "MAP01", "THINGS", "LINEDEFS", "E1M1", "TEXTMAP", "FOO", "ENDMAP", "THINGS"]
    s, warn = directory.sections(names)
    assert [(x["kind"], x["sub"], x["names"]) for x in s] == [("sprites", "", ["A", "B"]), ("sprites", "1", ["B"]), ("flats", "", ["C", "END", "MAP01", "THINGS", "LINEDEFS", "E1M1", "TEXTMAP", "FOO", "ENDMAP", "THINGS"])]
    assert warn == ["start_without_end: F_START"]
    assert directory.map_groups(names) == [("MAP01", 10, 13), ("E1M1", 13, 17)]
    assert directory.map_groups(["A", "TEXTMAP", "Q", "B", "TEXTMAP"]) == [("A", 0, 3), ("B", 3, 5)]
    assert [directory.map_format(x) for x in (["TEXTMAP"], ["BEHAVIOR"], ["THINGS"])] == ["udmf", "hexen", "doom"]


def square_map():
    v = [{"x": 0, "y": 0}, {"x": 256, "y": 0}, {"x": 256, "y": 256}, {"x": 0, "y": 256}]
    ln = [{"start": i, "end": (i + 1) % 4, "flags": 1, "special": 0, "tag": 7, "right": 0, "left": 0xFFFF} for i in range(4)]
    side = [{"x_offset": 0, "y_offset": 0, "upper": "-", "lower": "-", "middle": "WALL", "sector": 0}]
    sector = [{"floor": 0, "ceiling": 128, "floor_tex": "F", "ceiling_tex": "C", "light": 160, "special": 0, "tag": 0}]
    thing = [{"x": 64, "y": 64, "angle": 90, "type": 1, "flags": 7}]
    return {"THINGS": (thing, "thing"), "LINEDEFS": (ln, "linedef"), "SIDEDEFS": (side, "sidedef"), "VERTEXES": (v, "vertex"), "SECTORS": (sector, "sector")}


def test_map_tables(spark):
    blobs = [("MAP01", b"")] + [(n, decoders.encode(*x)) for n, x in square_map().items()]
    lumps = wad.scan(spark.createDataFrame([("m", wad.build(blobs))], "path string, content binary"))
    t = maps.tables(lumps)
    lines = maps.resolve_lines(t)
    got = maps.line_sectors(lines, t["sidedefs"]).orderBy("idx").collect()
    assert [(r.start, r.end, r.right, r.left, r.right_sector, r.left_sector, r.arg0, r.warnings) for r in got] == [(i, (i + 1) % 4, 0, None, 0, None, 7, []) for i in range(4)]
    bm = maps.blockmap(bytes(maps.build_blockmaps(lines, t["vertexs"]).first().data), 4)
    assert (bm["origin"], bm["cols"], bm["rows"]) == ((0, 0), 3, 3) and bm["cells"][4] == [1, 2]
    assert maps.blockmap(b"") is None and maps.blockmap(b"\0" * 8 + b"\1\0", options=LENIENT) == {"origin": (0, 0), "cols": 0, "rows": 0, "cells": []}
    assert maps.reject(b"\1", 3, LENIENT) == b"\1\0" and maps.reject(b"", 3) is None
    m = square_map()
    text = maps.to_textmap(*(m[k][0] for k in ("THINGS", "LINEDEFS", "SIDEDEFS", "SECTORS", "VERTEXES")))
    blocks = textmap.parse(text)["blocks"]
    assert [k for k, _ in blocks].count("linedef") == 4 and textmap.thing_flags(dict(blocks[-1][1])) == 7


def test_text_map():
    t = textmap.parse(b'namespace = "x"; // c\nvertex { x = 1.5; y = -2; user_k = "a\\"b"; }\nodd { q = 0x1F; }')
    assert t["blocks"] == [("vertex", {"x": 1.5, "y": -2, "user_k": 'a"b'}), ("odd", {"q": 31})]
    assert textmap.parse(textmap.write("x", t["blocks"]))["blocks"] == t["blocks"]
    for bad in (b"vertex { x = 1; y = 2; }", b'namespace = "x"; vertex { x = 1; }', b'namespace = "x"; a { b = 1;', b"\xff", b'namespace = "x"; a { b = 99999999999999999999; }'):
        with pytest.raises(FormatError):
            textmap.parse(bad)


def test_graphics():
    cols = [bytes([0, 2, 0, 5, 6, 0, 0xFF]), bytes([1, 1, 0, 9, 0, 0xFF])]
    data = struct.pack("<hhhhII", 2, 3, 1, 2, 16, 16 + len(cols[0])) + b"".join(cols)
    p = graphics.picture(data)
    assert p.pixels.tolist() == [[5, 0], [6, 9], [0, 0]] and p.opaque.sum() == 3 and (p.left, p.top) == (1, 2)
    with pytest.raises(FormatError):
        graphics.picture(data[:-1])
    names = struct.pack("<i", 1) + b"wall1\0\0\0"
    assert graphics.patch_names(names) == ["WALL1"]
    tex = struct.pack("<ii", 1, 8) + struct.pack("<8sihhih", b"TEX", 0, 4, 4, 0, 2) + struct.pack("<hhhhh", -1, 0, 0, 0, 0) + struct.pack("<hhhhh", 1, 1, 0, 0, 0)
    img, empty = graphics.compose(graphics.texture_list(tex)[0], {0: p})
    assert img.opaque.sum() == 4 and empty == [3]
    assert graphics.palettes(bytes(range(256)) * 3).shape == (1, 256, 3) and graphics.flat(bytes(4096)).opaque.all()


def test_audio(spark):
    s = struct.pack("<HHI", 3, 11025, 48) + b"\x80" * 48
    assert audio.sample_sound(s) == (11025, b"\x80" * 16) and audio.wav_chunks(audio.wav(11025, b"\x80" * 3))[1][2] == 3
    mus = b"MUS\x1a" + struct.pack("<HHHHH", 9, 16, 1, 0, 0) + b"\0\0" + bytes([0x90 | 0, 0x80 | 60, 100, 0x81, 0x00, 0x00, 60, 0x60, 0])
    head, events = audio.score(mus)
    assert [(e["kind"], e["tick"], e["a"], e["b"]) for e in events] == [("play", 0, 60, 100), ("release", 128, 60, None), ("end", 128, None, None)]
    m = audio.midi_index(audio.to_midi(events))
    assert (m["format"], m["division"], len(m["tracks"])) == (0, 70, 1) and audio.varlen(300) == b"\x82\x2c"
    assert audio.speaker_tones(struct.pack("<HH", 0, 2) + b"\1\2") == [1, 2]
    blobs = spark.createDataFrame([(mus,), (s,), (b"\0\0\0\0",), (b"abc",), (audio.to_midi(events),), (audio.wav(1, b"1"),)], "b binary")
    assert [r[0] for r in blobs.select(audio.kind_column(F.col("b"))).collect()] == ["mus", "dmx", "pc_speaker", "unknown", "midi", "wav"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-500, 500), st.integers(-500, 500)), min_size=3, max_size=24, unique=True))
def test_trees(points):
    n = len(points)
    lines = [{"start": i, "end": (i + 1) % n, "right": 0, "left": 0xFFFF if i % 3 else 0} for i in range(n)]
    tree = bsp.build(points, lines)
    assert bsp.check(tree) == []
    assert {s["linedef"] for s in tree["segs"]} == set(range(n))
    blobs = bsp.lumps(tree)
    assert len(blobs["SEGS"]) == 12 * len(tree["segs"]) and len(blobs["NODES"]) == 28 * len(tree["nodes"])


def test_listing_and_jsonl(spark, tmp_path):
    text = "./levels:\ntotal 3\n-rw-r--r-- 1 a b 10 Jan 1 2000 a file.zip\nbad\ndrwxr-xr-x 2 a b 3 Jan 1 2000 sub\n\n./levels/sub:\n-rw-r--r-- 1 a b 7 Jan 1 2000 B.ZIP\n"
    (tmp_path / "ls.txt").write_text(text)
    files, bad = records.listing(spark, str(tmp_path / "ls.txt"))
    assert {(r.dir, r.name, r.size) for r in files.collect()} == {("levels/", "a file.zip", 10), ("levels/sub/", "B.ZIP", 7)} and bad.count() == 1
    own = spark.createDataFrame([("levels/sub/", "b.zip"), ("x/", "y")], "dir string, filename string")
    assert {(r.filename, r.listed) for r in records.listed_sizes(own, files).collect()} == {("b.zip", 7), ("y", None)}
    (tmp_path / "r.jsonl").write_text('{"id": 1, "title": "a"}\n\nnot json\n{"id": 2}\n')
    good, wrong = records.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id long, title string")
    assert {r.id for r in good.collect()} == {1, 2} and wrong.count() == 1
    assert [r.slug for r in records.outliers(spark, '[[outlier]]\nslug = "a"\nurl = "u"\n').collect()] == ["a"]
    env = spark.createDataFrame([('{"content": {"file": {"id": 1}}}',), ('{"content": {"file": [{"id": 1}, {"id": 2}]}}',), ('{"error": 1}',)], "b string")
    assert [len(r[0]) for r in env.select(records.envelope(F.col("b"), "file", "id:long")).collect()] == [1, 2, 0]


def test_listing_cap_and_gzip(spark, tmp_path, monkeypatch):
    import gzip

    text = "./levels:\n" + "".join(f"-rw-r--r-- 1 a b {i} Jan 1 2000 f{i}.zip\n" for i in range(50))
    (tmp_path / "ls.gz").write_bytes(gzip.compress(text.encode()))
    assert records.listing(spark, str(tmp_path / "ls.gz"))[0].count() == 50
    monkeypatch.setattr(records, "LISTING_CAP", 100)
    with pytest.raises(Exception, match="listing_too_large"):
        records.listing(spark, str(tmp_path / "ls.gz"))[0].count()
    files, bad = records.listing(spark, str(tmp_path / "ls.gz"), Options(strict=False))
    assert files.count() == 0 and [r.n for r in bad.collect()] == [-1]


def test_scrub_at_any_depth(spark):
    d = spark.createDataFrame([("a", "m", ("n", "q"), [("r", "s")], {"Email2": "x", "k": "y"})], "id string, authorEmail string, s struct<name:string,eMail:string>, l array<struct<reviews:string,b:string>>, m map<string,string>")
    got = records.scrub(d)
    assert got.schema.simpleString() == "struct<id:string,s:struct<name:string>,l:array<struct<b:string>>,m:map<string,string>>"
    r = got.first()
    assert (r.s.name, r.l[0].b, r.m) == ("n", "s", {"k": "y"})
    body = spark.createDataFrame([('{"a": [{"email": 1, "b": {"TextFile": 2, "c": 3}}]}',), (None,)], "b string")
    assert [x[0] for x in body.select(records.scrub_json(F.col("b"))).collect()] == ['{"a":[{"b":{"c":3}}]}', None]


def test_reports_are_never_cut(spark):
    from oreline.functions import report

    assert report.table_markdown(spark.range(3), limit=3).count("\n") == 5
    for f in (report.table_markdown, report.table_json):
        with pytest.raises(ValueError):
            f(spark.range(4), limit=3)


def test_reach_ends_on_cycles_and_resumes(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    want = {("a", 0), ("b", 1), ("c", 2)}
    at = str(tmp_path / "ck")
    assert set(map(tuple, R.reach(edges, roots).collect())) == want
    assert set(map(tuple, R.reach(edges, roots, limit=1, checkpoint=at).collect())) == {("a", 0), ("b", 1)}
    assert set(map(tuple, R.reach(edges, roots, checkpoint=at).collect())) == want
    other = spark.createDataFrame([("x",)], "node string")
    assert set(map(tuple, R.reach(edges, other, checkpoint=at).collect())) == {("x", 0), ("y", 1)}


def test_score_bytes():
    ev = lambda kind, channel, a, b, tick: {"kind": kind, "channel": channel, "a": a, "b": b, "tick": tick}
    body = audio.to_midi([ev("play", 0, 60, 100, 0), ev("controller", 15, 3, 200, 0), ev("release", 0, 60, None, 140), ev("end", 3, None, None, 140)])[22:]
    assert body == bytes([0, 0xB0, 0x7B, 0, 0, 0x90, 60, 100, 0, 0xB9, 7, 127, 0x81, 0x0C, 0x80, 60, 0, 0, 0xFF, 0x2F, 0])
    many = audio.to_midi([ev("play", c, 60, 1, 0) for c in range(11)])
    assert bytes([0x9A, 60, 1]) in many and bytes([0x99, 60, 1]) not in many


def test_split_points_round_half_away():
    assert [bsp.half_away(n, d) for n, d in ((1, 2), (-1, 2), (3, 2), (-3, 2), (5, -2), (7, 3), (0, 5))] == [1, -1, 2, -2, -3, 2, 0]


def test_log_replay(spark, tmp_path):
    schema = "id long, seq long, v string"
    src, out = str(tmp_path / "log"), str(tmp_path / "table")
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        logs.replay(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck"), "id", "seq").awaitTermination()
        assert n or logs.current(spark, out).count() == 2
    assert {(r.id, r.v) for r in logs.current(spark, out).collect()} == {(1, "c"), (2, "b")}


def test_resolve_and_diff(spark):
    a = spark.createDataFrame([("x", 0, "1"), ("x", 1, "2"), ("y", 2, "3")], "name string, o int, d string")
    b = spark.createDataFrame([("x", 0, "2"), ("x", 1, "1"), ("z", 2, "3")], "name string, o int, d string")
    assert {(r.name, r.status) for r in R.diff(a, b, "name", "o", "d").collect()} == {("x", "changed"), ("y", "only_in_first"), ("z", "only_in_second")}
    t = spark.createDataFrame([(0,), (1,)], "idx int")
    r = R.resolve(spark.createDataFrame([(0,), (9,), (65535,)], "ref int"), "ref", t, "idx", "got", sentinel=65535)
    assert {(x.ref, x.got, x.got_miss) for x in r.collect()} == {(0, 0, False), (9, None, True), (65535, None, False)}



@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["vertex", "sector", "odd", "Vertex"]), st.dictionaries(st.sampled_from(["x", "y", "texturefloor", "textureceiling", "Note", "z_1"]), st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.booleans() | st.text(max_size=6), max_size=6)), max_size=5), st.sampled_from(["", "}", "{", "x", "a=1", "a=1;", "// c", "b { c { } }", "true=1;", 'q="', "y=1 2;", "x=5a;", "x=.5;", "x=9223372036854775808;", "v{x=1;", "x=TRUE;"]))
def test_plain_texts_read_as_by_tokens(blocks, tail):
    """The short way reads what the tokens read, and leaves every fault to them."""
    text = textmap.write("a\\\"b", blocks) + tail

    def slow():
        whole, textmap.plain = textmap.plain, lambda text: None
        try:
            return textmap.parse(text)
        except FormatError as e:
            return str(e)
        finally:
            textmap.plain = whole

    try:
        got = textmap.parse(text)
    except FormatError as e:
        got = str(e)
    assert got == slow()


def text_lumps(spark, **texts):
    return spark.createDataFrame([("p", k, v.encode()) for k, v in texts.items()], "path string, map string, data binary")


def test_text_tables_are_read_once_and_linked(spark):
    """References in and out of range, values of another type, many blocks, texts that cannot be read; no table reads the texts again."""
    from oreline.operators import assemble

    vertex = [("vertex", {"x": 0.5, "y": i}) for i in range(45_000)]
    odd = [("vertex", {"x": True, "y": 1}), ("linedef", {"v1": 0, "v2": 1, "sidefront": 7, "sideback": -1, "special": 2**40}), ("linedef", {"v1": 1.5, "v2": -1, "sidefront": 0, "sideback": 0}), ("sidedef", {"sector": 3, "texturetop": 5}), ("strange", {"x": 1})]
    t = assemble.text_tables(text_lumps(spark, BIG=textmap.write("doom", vertex), ODD=textmap.write("doom", odd), BAD="vertex {"))
    assert {(r.map, r.n, r.least, r.most) for r in t["vertexs"].groupBy("map").agg(F.count("*").alias("n"), F.min("idx").alias("least"), F.max("idx").alias("most")).collect()} == {("BIG", 45_000, 0, 44_999), ("ODD", 1, 0, 0)}
    lines = [(r.start, r.end, r.right, r.left, r.special, r.warnings) for r in t["linedefs"].orderBy("idx").collect()]
    assert lines == [(0, 0, None, None, None, ["end 1 out of range", "right 7 out of range"]), (0, 0, 0, 0, 0, ["end -1 out of range"])]
    assert [(r.sector, r.texturetop, r.warnings) for r in t["sidedefs"].collect()] == [(0, "5", ["sector 3 out of range"])] and t["things"].count() == 0
    assert t["vertexs"].where("map = 'ODD'").first().x is None
    assert not any("MapInArrow" in d._jdf.queryExecution().toString() or "Join" in d._jdf.queryExecution().toString() for d in t.values())
    with pytest.raises(Exception, match="block_not_closed"):
        assemble.text_tables(text_lumps(spark, BAD="vertex {"), Options(strict=True))


def test_text_of_tables_reads_back(spark):
    """Text maps written from tables by expressions: strings with marks, fractions, lost sides and flags come back."""
    from oreline.operators import assemble

    blocks = [("vertex", {"x": 1e-7, "y": -2.0**60}), ("vertex", {"x": 0.1, "y": -0.0}), ("linedef", {"v1": 0, "v2": 1, "sidefront": 9, "blocking": True, "mapped": True, "id": 5, "arg0": 3}), ("sidedef", {"sector": 0, "offsetx": 4, "texturetop": 'a"\\b'}), ("sector", {"texturefloor": "F", "textureceiling": "", "lightlevel": 0}), ("thing", {"x": 1.0, "y": 2.5, "type": 3, "angle": 90, "height": 0.5, "skill1": True, "skill2": True, "single": True})]
    t = assemble.text_tables(text_lumps(spark, M=textmap.write("doom", blocks)))
    again = textmap.parse(bytes(assemble.to_text(t, 'x"y').first().data))
    line = {"v1": 0, "v2": 1, "sidefront": 65535, "sideback": -1, "id": 5, "special": 0, "arg0": 3, "arg1": 0, "arg2": 0, "arg3": 0, "arg4": 0, "blocking": True, "mapped": True}
    assert again["namespace"] == 'x"y' and [k for k, _ in again["blocks"]] == [k for k, _ in blocks] and again["blocks"][2][1] == line
    want = textmap.parse(textmap.write("doom", blocks))["blocks"]
    assert [again["blocks"][i] for i in (0, 1, 3, 4)] == [want[i] for i in (0, 1, 3, 4)]
    assert {k: v for k, v in again["blocks"][5][1].items() if k in ("x", "y", "type", "angle", "height", "skill1", "skill2", "single")} == {k: v for k, v in blocks[5][1].items()}


def test_narrow_records_are_packed_at_once(spark):
    """Records of maps of several sizes as classic blobs, in order; maps without a kind of record have an empty blob of it."""
    from oreline.operators import assemble

    one = [("vertex", {"x": float(i), "y": 1.0}) for i in range(300)]
    two = [("vertex", {"x": 7.0, "y": 8.0}), ("sidedef", {"sector": 0, "texturetop": "LONGNAME9"}), ("sector", {"texturefloor": "F", "textureceiling": "G"})]
    blobs, lost = assemble.to_classic(assemble.text_tables(text_lumps(spark, A=textmap.write("doom", one), B=textmap.write("doom", two))))
    got = {(r.map, r.name): bytes(r.data) for r in blobs.collect()}
    assert len(got) == 20 and got["A", "VERTEXES"] == b"".join(struct.pack("<hh", i, 1) for i in range(300)) and got["A", "SECTORS"] == b""
    assert got["B", "SIDEDEFS"] == struct.pack("<hh8s8s8sH", 0, 0, b"LONGNAME", b"-", b"-", 0) and [r.loss for r in lost.collect()] == ["upper cut"]


_MESSY = ["namespace='x';", "vertex{x=1;y=2;}", "Vertex { X = 0x1F; y = -0.5e1; note = \"a;{}=/\\\"b\"; x = 3; }", "linedef { v1 = 0; v2 = 1; sidefront = 2; blocking = TRUE; mapped = false; special = 5000000000; }", "linedef { v1 = 1.5; v2 = 0; sidefront = 0; }", "linedef{v1=0;}", "sidedef { sector = 0; texturetop = 5; }", 'sidedef { sector = +7; texturetop = "\\\\"; offsetx = -3; }', "thing { x = 1; y = 2.25; type = 7; skill1 = true; single = 1; dm = true; }", "odd { v = 1; }", "odd { in { x = 1; } }", "// c\n", "}", "{", 'a = "', "b = 9223372036854775808;", "é = 1;", 'n = "é";', "namespace = 3;", "x = 1 2;", 'x = "a" "b";', "= 5;", "true = 1;", "y == 2;", "z = ;", "", " \t\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(st.sampled_from(_MESSY), max_size=4)), min_size=1, max_size=6))
def test_many_texts_are_read_as_one_by_one(texts):
    """Columns of many texts at once hold what each text says when it is read alone; texts with faults are left out."""
    import pyarrow as pa
    from oreline.operators import assemble

    kinds = {k: dict(c.split() for c in ddl.split(", ")) for k, ddl in assemble.TEXT_TABLES.items()}
    whole = [(('namespace = "m\\"";\n' if named else "") + "\n".join(parts)).encode() for named, parts in texts]
    at, got = textmap.flat(pa.array([b"cut", *whole], pa.binary()).slice(1), kinds)
    found = {(k, int(t)): [] for k, (text, _) in got.items() for t in text}
    for k, (text, cols) in got.items():
        for t, row in zip(text.tolist(), pa.table(cols).to_pylist(), strict=True):
            found[k, t].append(row)
    for i, text in enumerate(whole):
        try:
            blocks = textmap.parse(text)["blocks"]
        except FormatError:
            assert i not in at
            continue
        for k, columns in kinds.items():
            rows = [f | {"flags": textmap.line_flags(f) if k == "linedef" else textmap.thing_flags(f)} for kind, f in blocks if kind == k]
            want = [{c: None if t == "int" and not -(2**31) <= f[c] < 2**31 else f[c] for c, t in columns.items()} for f in rows] if i in at else []
            assert found.get((k, i), []) == want
    plain = pa.array([b'namespace = "a";\nvertex\n{\n  x = 1;\n  y = -2.5;\n}\n', b"vertex {", b'namespace="\\"";thing{x=1e3;y=2;type=3;}'], pa.binary())
    assert textmap.flat(plain, kinds)[0].tolist() == [0, 2]


def test_texts_of_tables_over_several_batches(spark):
    """Maps whose blocks come in several batches, or many to a batch, are whole texts; one table of them is made without the disk."""
    from oreline.operators import assemble

    sizes = {"A": 1, "B": 7, "C": 2, "D": 1, "E": 13}
    texts = {m: textmap.write("doom", [("vertex", {"x": float(i), "y": 0.25}) for i in range(n)] + [("linedef", {"v1": i, "v2": i + 1, "sidefront": 0}) for i in range(n)]) for m, n in sizes.items()}
    t = assemble.text_tables(text_lumps(spark, **texts), Options())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "3", "4", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            made = assemble.to_text(t)
            got = {r.map: textmap.parse(bytes(r.data))["blocks"] for r in made.collect()}
            assert {m: ([k for k, _ in b].count("vertex"), [(f["v1"], f["v2"]) for k, f in b if k == "linedef"]) for m, b in got.items()} == {m: (n, [(i, i + 1 if i + 1 < n else 0) for i in range(n)]) for m, n in sizes.items()}
            assert made.count() == len(sizes)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    again = assemble.text_tables(assemble.to_text(t), Options(), only="linedefs")
    plan = again["linedefs"]._jdf.queryExecution().executedPlan().toString()
    assert list(again) == ["linedefs"] and plan.count("MapInArrow") == 2 and "Aggregate" not in plan
    assert sorted((r.map, r.idx, r.end) for r in again["linedefs"].collect()) == sorted((m, i, i + 1 if i + 1 < n else 0) for m, n in sizes.items() for i in range(n))


def test_texts_of_customers_are_as_written(spark, sf):
    """The texts that queries make of orders by expressions are those of the writer."""
    from oreline.plans import decoding

    def made(ks):
        blocks = [("vertex", {"x": float(k), "y": k / 4}) for k in ks]
        blocks += [("linedef", {"v1": i, "v2": i + 1, "sidefront": 0 if k % 3 else 9, **({"sideback": 0} if k % 5 == 0 else {}), "blocking": k % 2 == 0, "special": k % 7}) for i, k in enumerate(ks)]
        blocks += [("sidedef", {"sector": 0, "texturemiddle": 'W"' + str(len(ks))}), ("sector", {"texturefloor": "F", "textureceiling": "LONGNAME9", "heightfloor": -40_000})]
        blocks += [("thing", {"x": 1.5, "y": -2.5, "type": k % 70_000 if k % 2 else 70_000, "angle": -90}) for k in ks[:2]]
        return textmap.write("doom", blocks).encode()

    keys = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks")).collect()
    assert {r.map: bytes(r.data) for r in decoding._text_maps(spark, sf).collect()} == {f"C{r.o_custkey}": made(r.ks) for r in keys}
