"""The pipeline's stages on unusual rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


def kept(spark, rows):
    return sorted((r.doc_id or -1, (r.text or "")[:2]) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect())


def test_texts_that_share_an_id_stay(spark):
    assert kept(spark, [(1, A, "en", "s", 1), (1, B, "en", "s", 1), (2, C, "en", "s", 1)]) == [(1, "a0"), (1, "b0"), (2, "c0")]


def test_repeated_rows_leave_one(spark):
    rows = [(1, A, "en", "s", 1), (1, A, "en", "r", 1), (1, A, "en", "s", 1), (3, A, "de", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    assert kept(spark, rows) == [(1, "a0"), (4, "")]
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").where("doc_id = 1").first().source == "r"


def test_rows_without_an_id_take_part(spark):
    assert kept(spark, [(None, A, "en", "s", 1), (7, A, "en", "s", 1), (None, B, "en", "s", 1), (None, B, "en", "s", 1), (None, C, "en", "s", 1)]) == [(-1, "b0"), (-1, "c0"), (7, "a0")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("empty", [False, True])
def test_all_stages_with_odd_rows_and_columns(spark, tmp_path, empty):
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, A, None, None, None), (0, B, "en", "s", 1), (None, None, None, None, None), (9001, "long " * 30_000, "en", "s", 1)], DOCS)
    docs = real.unionByName(odd)
    docs = docs.limit(0) if empty else docs
    for c in ("score", "predicted", "slot", "position", "fp", "label", "component"):
        docs = docs.withColumn(c, F.lit("mine"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert docs.where("score <> 'mine' or predicted <> 'mine' or slot <> 'mine' or position <> 'mine'").count() == 0
    assert (docs.count() == 0) == empty
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_replaced_stages_are_removed(spark):
    folder = corpus_pipeline.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, DATA).count()
    new = [n for n in set(os.listdir(folder)) - before if n.startswith("corpus-")]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["3-mixing"]
