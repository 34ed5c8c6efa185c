import json
import math

import pytest
from pyspark.sql import functions as F

from brasstally.errors import ConfigError, IngestError, InputError
from brasstally.operators import metrics, retrieval
from brasstally.sources import datasets, documents
from brasstally.sources.datasets import Source


def test_headers(spark):
    assert [datasets.header(h) for h in ("Transaction ID", "amt", " Ccy ", "created-at", "a//b", "Val!")] == ["transaction_id", "amount", "currency", "timestamp", "a_b", "value"]
    with pytest.raises(IngestError):
        datasets.with_headers(spark.createDataFrame([(1, 2)], "`date` int, `timestamp` int"))


def test_load_mixed_formats(spark, tmp_path):
    root = tmp_path / "transactions"
    (root / "2026").mkdir(parents=True)
    (root / "a.csv").write_text("Transaction ID,acct_id,amt,ccy,date,merchant\n001,00123,\"£1,250.50\",GHS,2026-03-05T10:15:30Z,Melcom\n002,x,bad,USD,05/03/2026,\n")
    (root / "2026" / "b.jsonl").write_text('{"tx_id": "001", "accountid": "later", "amount": 1, "currency": "USD", "timestamp": "2026-01-01"}\n\n{"tx_id": "003", "accountid": "y", "amount": 2.5, "currency": "USD", "timestamp": "nonsense"}\n')
    (root / "c.json").write_text(json.dumps({"records": [{"id": "004", "account_id": "z", "amount": "3", "currency": "EUR", "timestamp": "2026-02-02", "extra": 1}]}))
    (root / "notes.txt").write_text("not data")
    got = {r.transaction_id: r for r in datasets.load(spark, "transactions", Source(root=str(tmp_path))).collect()}
    assert sorted(got) == ["001", "002", "003", "004"]
    assert got["001"].account_id in ("00123", "later") and got["002"].amount is None and got["003"].timestamp is None
    assert got["002"].timestamp.isoformat() == "2026-03-05T00:00:00" and got["004"].amount == 3.0
    assert all(r._source_name for r in got.values())


def test_keep_first_order(spark):
    rows = [("b", None, 1), ("a", None, 2), ("a", "k", 3), ("b", "k", 1), ("c", "k", 0)]
    got = datasets.keep_first(spark.createDataFrame(rows, "f string, k string, o int"), "k", ["f", "o"])
    assert {(r.k, r.f, r.o) for r in got.collect()} == {(None, "a", 2), ("k", "a", 3)}
    assert datasets.keep_first(got, None, ["f"]) is got and datasets.keep_first(got, "missing", ["f"]) is got
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_contracts(spark, tmp_path):
    assert Source(mode=" S3 ", bucket="b", prefix="/p/").path("accounts") == "s3a://b/p/accounts"
    for bad in (Source(mode="s3"), Source(mode="ftp")):
        with pytest.raises(ConfigError):
            bad.path("accounts")
    (tmp_path / "accounts").mkdir()
    (tmp_path / "accounts" / "a.csv").write_text("account_id\n1\n")
    with pytest.raises(IngestError):
        datasets.load(spark, "accounts", Source(root=str(tmp_path)))
    found, failed = datasets.load_bundle(spark, Source(root=str(tmp_path)), strict=False)
    assert not found and set(failed) == set(datasets.DATASETS)
    with pytest.raises(IngestError):
        datasets.union_by_name([])
    with pytest.raises(IngestError):
        datasets.read_files(spark, str(tmp_path), "orc")


def test_write(spark, tmp_path):
    for fmt in ("parquet", "csv", "jsonl"):
        path = datasets.write_tables({"t": spark.range(3)}, str(tmp_path), fmt)["t"]
        assert path.endswith(f"t.{fmt}")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 3
    with pytest.raises(IngestError):
        datasets.write_tables({}, str(tmp_path), "xml")


def test_union(spark):
    got = datasets.union_by_name([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2,)], "x int")])
    assert [(r.x, r.y) for r in got.orderBy("x").collect()] == [(1, "a"), (2, None)]


def test_documents(spark, tmp_path):
    root = tmp_path / "kb"
    for p, t in {"fees/a.md": "A\nB", "fees/placeholder.md": "x", "products/deep/b.txt": "C", "products/c.bin": "no"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    got = {(r.doc_type, r.text) for r in documents.read_documents(spark, str(root)).collect()}
    assert got == {("fees", "A\nB"), ("products", "C")}
    store = str(tmp_path / "store")
    documents.write_store(spark.createDataFrame([(0, "t", [0.1, 0.2])], "chunk_id int, text string, embedding array<float>"), store)
    assert retrieval.store_profile(documents.read_store(spark, store)).first() == (1, 2)
    with pytest.raises(IngestError):
        documents.write_store(spark.createDataFrame([], "chunk_id int, embedding array<float>"), store)
    (tmp_path / "tests.jsonl").write_text('{"question": "q", "keywords": ["a"], "reference_answer": "r", "category": "c"}\n')
    assert documents.read_cases(spark, str(tmp_path / "tests.jsonl")).first().keywords == ["a"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_id): len(r.chunk) for r in retrieval.chunk_by_stride(df).collect()}
    assert got == {(1, 0): 1000, (1, 1): 1000, (1, 2): 900, (4, 0): 3}
    with pytest.raises(InputError):
        retrieval.chunk_by_stride(df, 10, 10)
    long = "\n\n".join(" ".join(["word"] * 50) for _ in range(20))
    parts = retrieval.split_recursively(long)
    assert all(len(p) <= 1000 for p in parts) and set(" ".join(parts).split()) == {"word"} and sum(map(len, parts)) >= len(long) - 60
    assert retrieval.split_recursively(None) == [] and max(map(len, retrieval.split_recursively("y" * 3000))) == 1000
    assert retrieval.chunk_recursively(df).where("doc_id = 4").first().chunk == "abc"


def test_questions_and_contexts(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "z" * 60), (1, 2, "user", "b"), (1, 3, "user", "c"), (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.question for r in retrieval.combined_question(df).collect()} == {1: "a\nb\nc", 2: "\nonly"}
    assert {r.conv_id: r.context for r in retrieval.assemble_context(df, "conv_id", "turn").collect()} == {1: "z" * 60, 2: "No relevant context found."}


def test_top_k(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.top_k(df, [1.0, 0.0], 2).collect()] == [4, 3]
    assert "TakeOrderedAndProject" in retrieval.top_k(df, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    cases = spark.createDataFrame([(1, ["Foo", "bar", "none"]), (2, [])], "test_id int, keywords array<string>")
    seen = spark.createDataFrame([(1, 1, "a foo"), (1, 2, "x"), (1, 3, "BAR foo"), (1, 4, "bar")], "test_id int, rank int, text string")
    got = {r.test_id: r for r in metrics.retrieval_metrics(cases, seen, 3).collect()}
    assert got[1].mrr == pytest.approx((1 + 1 / 3) / 3) and got[1].keywords_found == 2 and got[1].keyword_coverage == pytest.approx(200 / 3)
    foo = (1 + 1 / 2) / (1 + 1 / math.log2(3))
    bar = (1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert got[1].ndcg == pytest.approx((foo + bar) / 3)
    assert (got[2].mrr, got[2].ndcg, got[2].keyword_coverage, got[2].total_keywords) == (0, 0, 0, 0)
    mean = metrics.mean_metrics(metrics.retrieval_metrics(cases, seen)).first()
    assert mean.tests == 2 and mean.mrr_band == "red"
    assert metrics.mean_metrics(metrics.retrieval_metrics(cases.limit(0), seen)).count() == 0
    assert spark.range(1).select(metrics.band(F.lit(0.9), "mrr"), metrics.band(F.lit(80.0), "coverage"), metrics.band(F.lit(1), "odd")).first() == ("green", "orange", "black")
    answers = spark.createDataFrame([(5.0, 4.0, 3.0)], "accuracy double, completeness double, relevance double")
    assert metrics.mean_answers(answers).first().asDict()["relevance_band"] == "red"
