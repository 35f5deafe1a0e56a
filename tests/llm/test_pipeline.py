"""The stages one by one against plain Python, on a table and on odd rows, and as a whole."""

import numpy as np
import pytest

import corpus_pipeline
from oreline.llm import toxicity
from tests.llm.test_brute_force import SCHEMA, components, crafted, kept_bytes
from tests.llm.test_models import leaked

LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_stages(spark, docs, sf):
    """Each stage's rows follow from its input's, by plain Python on ids and texts that are not repeated."""
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, after = rows(docs), corpus_pipeline.materialize(stage(spark, docs, sf), name)
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            score = lambda t: model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
            want = [(i, t) for i, t in before if score(t) < 0.7]
        elif name == "ngram_jaccard_join":
            comp = components(before)
            stays = {i for i, n, c in comp if n == 0 or i == c}
            want = [(i, t) for i, t in before if str(i) in stays]
        elif name == "suffix_array_dedup":
            want = []
            for (i, t), kept in zip(sorted(before, key=lambda r: (r[0] is not None, r[0] or 0)), kept_bytes(before), strict=True):
                if kept == (t or "").encode():
                    want.append((i, t))
                elif kept.decode("utf-8", "ignore"):
                    want.append((i, kept.decode("utf-8", "ignore")))
        elif name == "decontamination":
            bad = {i for i, _ in leaked(before, bench)}
            want = [(i, t) for i, t in before if i not in bad]
        else:
            ids = {i for i, _ in before}
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == ids
            assert all(r[1] <= 2048 for r in after.groupBy("sequence_id").sum("length").collect())
            return after
        assert after.columns == columns
        assert sorted(rows(after), key=str) == sorted(want, key=str), name
        docs = after


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    last = check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    whole = corpus_pipeline.run(spark, sf)
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(place).collect())) == sorted(map(tuple, last.select(place).collect()))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Null, empty and repeated rows, ties and a column no stage knows; and no rows at all."""
    sf = str(tmp_path)
    docs = crafted(spark) if kind == "odd" else spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(12)] if kind == "odd" else [], LABELS).write.parquet(f"{sf}/labels.parquet")
    bench = [(1, "w1 w2 w3 w4 w5 w6"), (None, None), (3, ""), (1, "one two")] if kind == "odd" else []
    spark.createDataFrame(bench, BENCH).write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    if kind == "empty":
        assert got == []
        return
    ids = {r.doc_id for r in got}
    assert {0, 5, 6, 7, 11, 13} <= ids and not ids & {1, 2, 8, 9, 10}  # copies and "one two" go, empty texts stay
    assert all(r.length == 1 for r in got if r.doc_id in (5, 6))


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert 0.5 * docs.count() < len(ids) < docs.count()
    assert max(r[1] for r in packed.groupBy("sequence_id").sum("length").collect()) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "decontamination", "packing"]
