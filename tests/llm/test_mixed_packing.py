"""Packing in the order of the mix: the stage on what the mixing stage wrote."""

import random

import corpus_pipeline
from brasstally.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, mixing.REST_WEIGHT, 2048))
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (256, 8, 8))
    r = random.Random(8)
    sources = ["src0", "src1", "src10"]
    rows = [(i, " ".join(r.choice(["the", "of", "words"]) for _ in range(r.choice([3, 20, 90, 200, 700]))), "en", sources[i % 3], 0) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None), rows[0]], DOCS)
    corpus_pipeline.mix_sources(spark, df, "").write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    plain = packing.pack(docs, 256).collect()
    key = lambda x: (x.doc_id or -1, x.piece, x.start, x.length, x.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, plain))
    by: dict = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(by) == list(range(len(by)))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= len({x.sequence_id for x in plain}) * 1.1 + 8
    # while every source has documents, each quarter of that stretch has the shares of the weights 5, 2 and 1
    stretch = int(len(by) * 0.44)
    for q in range(4):
        part = [x for x in got if q * stretch // 4 <= x.sequence_id < (q + 1) * stretch // 4 and x.doc_id is not None]
        tokens = sum(x.length for x in part)
        for k, weight in enumerate([5, 2, 1]):
            assert abs(sum(x.length for x in part if x.doc_id % 3 == k) / tokens - weight / 8) < 0.08


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none")
    assert packing.pack_in_order(spark.read.parquet(f"{tmp_path}/none")).count() == 0
