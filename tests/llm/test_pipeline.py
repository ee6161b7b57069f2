"""The corpus pipeline, stage by stage, against what each stage must do to its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests_llm_brute import brute_components, brute_targets
from weftline.llm import mixing, packing

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append([r.asDict() for r in docs.collect()])
    rated, single, mixed, packed = outs
    # 1: good documents stay, bad ones go
    kept = {r["doc_id"] for r in rated}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.97 * len(right)
    # 2: one document of each component, the one with the smallest id
    want = {r.split(", ")[2].rstrip(")") for r in brute_components([(r["doc_id"], r["text"]) for r in rated])}
    assert sorted(r["doc_id"] for r in single) == sorted(map(int, want))
    # 3: copies as the mix takes them, at most three, and near the targets
    copies = Counter(r["doc_id"] for r in mixed)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "1"))).collect()}
    assert copies == Counter({k: v for k, v in taken.items() if v}) and max(copies.values()) <= 3
    sizes = Counter()
    for r in single:
        sizes[r["source"]] += len(r["text"].split())
    assert abs(sum(brute_targets(dict(sizes)).values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    # 4: every piece of every copy has a place, and no sequence is over its capacity
    pieces = [r.asDict() for r in packing.pieces(spark.read.parquet(str(tmp_path / "2"))).collect()]
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, packed)) == Counter(map(key, pieces))
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * -(-sum(fill.values()) // 2048) + 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run_returns_pieces(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def odd_documents(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, text, "en", "a", 1, "x"), (7, "another text of the same id with words of its own here", "en", "a", 1, "x"), (3, text.upper(), None, None, None, None), (None, text, "en", "b", 2, "y"), (None, "words without an id that nobody else has at all", "en", "b", 2, "y"), (5, "", "en", "a", 0, "z"), (6, None, "en", "a", 0, "z"), (8, "tie one", "en", "a", 1, "x"), (8, "tie one", "en", "a", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long, doc string")


def test_one_of_each_on_odd_rows(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.one_of_each(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])[:7]) for r in out.collect())
    assert got == sorted([("7", "another"), ("3", "ONE TWO"), ("None", "words w"), ("5", ""), ("6", "None"), ("8", "tie one")])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.staged(stage(spark, docs, DATA), "odd")
            assert k == 3 or docs.columns == columns
        assert docs.filter("offset is null or sequence_id is null").count() == 0
