"""Chunks against a slow splitter, contexts, exact ranking, and readers of files in capitals or in parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from brasstally.operators import quality, retrieval, tools
from brasstally.plans.requests import SpendRequest
from brasstally.sources import datasets

DATA = "/root/testdata/sf0.001"


def slow_chunks(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Recursive chunks by single characters and lists that are joined anew at each step."""

    def merge(parts):
        out, now = [], []
        for p in parts:
            if now and sum(map(len, now)) + len(p) > size:
                out.append("".join(now))
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > size):
                    now = now[1:]
            now = [*now, p]
        return [*out, "".join(now)]

    sep, *rest = next([s, *separators[i + 1 :]] for i, s in enumerate(separators) if s in text)
    parts = list(text) if not sep else [p for i, p in enumerate(text.split(sep)) for p in [(sep if i else "") + p] if p]
    out, run = [], []
    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            out += merge(run) + slow_chunks(p, size, overlap, rest)
            run = []
    return [c for c in (x.strip() for x in [*out, *merge(run)]) if c]


def test_chunks_against_slow_ones():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab  \n\nxyz\n") if r.random() < 0.6 else "word" * r.randint(1, 20) for _ in range(r.randint(0, 60)))
        size = r.randint(5, 60)
        overlap = r.randint(0, size - 1)
        assert retrieval.split_recursively(text, size, overlap) == slow_chunks(text, size, overlap)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chunks_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 20000")
    want = {(d.doc_id, i): c for d in docs.collect() for i, c in enumerate(slow_chunks(d.text or "", 1000, 200))}
    assert {(x.doc_id, x.chunk_id): x.chunk for x in retrieval.chunk_recursively(docs).collect()} == want


def test_context_of_a_group_without_usable_texts(spark):
    rows = [(1, 0, "x" * 60), (1, 1, "short"), (1, 2, "y" * 51), (2, 0, "short"), (3, 0, None)]
    got = {r.g: r.context for r in retrieval.assemble_context(spark.createDataFrame(rows, "g int, o int, text string"), "g", "o").collect()}
    assert got == {1: "x" * 60 + "\n\n" + "y" * 51, 2: "No relevant context found.", 3: "No relevant context found."}


def test_top_k_ranks_before_it_rounds(spark):
    rows = [(1, [1.0, 1e-4]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)]
    got = retrieval.top_k(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), [1.0, 0.0]).collect()
    assert [r.vec_id for r in got] == [2, 1] and got[0].score == got[1].score == 1.0


def test_token_count(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts, path = ["one two", None, "", "three " * 50], public.path("byte_bpe_50k.json")
    want = sum(len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts if t)
    assert tuple(retrieval.token_count(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), path).first()) == (3, want)


def test_blank_currency_and_missing_month_are_errors(spark):
    schema = "transaction_id string, account_id string, timestamp timestamp, amount double, currency string, direction string, merchant string, category string, subcategory string"
    blank = spark.createDataFrame([("1", "a", None, 1.0, "  ", "debit", "m", "c", "s")], schema)
    with pytest.raises(Exception, match="blank currency"):
        tools.spend_by_currency(blank, SpendRequest()).collect()
    with pytest.raises(Exception, match="without a timestamp"):
        tools.spend_grouped(blank, SpendRequest(group_by="month")).collect()
    assert tools.spend_grouped(blank, SpendRequest(group_by="category")).count() == 1


def test_extensions_in_capitals(spark, tmp_path):
    head = "transaction_id,account_id,amount,currency,timestamp"
    os.makedirs(tmp_path / "transactions" / "deep")
    (tmp_path / "transactions" / "A.CSV").write_text(f"{head}\n1,a,5,GHS,2024-01-01\n")
    (tmp_path / "transactions" / "deep" / "b.csv").write_text(f"{head}\n2,a,6,GHS,2024-01-01\n")
    (tmp_path / "transactions" / "c.JsonL").write_text('{"transaction_id": "3", "account_id": "a", "amount": "7", "currency": "GHS", "timestamp": "2024-01-01"}\n')
    source = datasets.Source(root=str(tmp_path))
    assert sorted(r.transaction_id for r in datasets.load(spark, "transactions", source).collect()) == ["1", "2", "3"]


def test_first_rows_by_file_and_line(spark, tmp_path):
    head = "transaction_id,account_id,amount,currency,timestamp"
    os.makedirs(tmp_path / "transactions")
    for name, account in (("b.csv", "second"), ("A.csv", "first")):
        lines = [f"{i % 500},{account}{i},5,GHS,2024-01-01" for i in range(3000)]
        (tmp_path / "transactions" / name).write_text("\n".join([head, *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = datasets.load(spark, "transactions", datasets.Source(root=str(tmp_path), options={"multiLine": "false"}))
        assert {r.transaction_id: r.account_id for r in got.collect()} == {str(i): f"first{i}" for i in range(500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_excel_needs_its_package(spark, tmp_path):
    openpyxl = None
    try:
        import openpyxl
    except ImportError:
        with pytest.raises(datasets.IngestError, match="openpyxl"):
            datasets.read_files(spark, f"{tmp_path}/a.xlsx", "xlsx")
    if openpyxl is None:
        pytest.skip("no openpyxl here")
    book = openpyxl.Workbook()
    for row in (["Tx ID", "amt"], ["007", 5], ["8", 6]):
        book.active.append(row)
    book.save(tmp_path / "a.xlsx")
    got = datasets.read_files(spark, f"{tmp_path}/a.xlsx", "xlsx")
    assert [(r["Tx ID"], r["amt"]) for r in got.orderBy("_ord").collect()] == [("007", "5"), ("8", "6")]


def test_findings_evaluate_the_rows_once(spark, tmp_path):
    columns = {c: F.lit("x") for c in quality.NEEDED} | {"timestamp": F.lit("2024-01-01").cast("timestamp"), "amount": F.lit(1.0), "is_recurring": F.lit(False), "recurrence_occurrence_count": F.lit(1)}
    spark.range(100).select(*(c.alias(n) for n, c in columns.items()), F.col("id").alias("_ord")).drop("transaction_id").withColumn("transaction_id", F.when(F.col("_ord") > 9, F.col("_ord").cast("string"))).write.parquet(f"{tmp_path}/rows")
    found = quality.findings(spark.read.parquet(f"{tmp_path}/rows"), "2024-06-01")
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.check_name: (r.row_count, r.sample_ids) for r in found.collect()}
    assert got["duplicate_transaction_id"] == (10, ["null"] * 5) and got["null_transaction_id"] == (10, ["null"] * 5)
    assert got["enum_direction"] == (100, ["null"] * 5)


def test_json_lines_under_a_wrong_name(spark, tmp_path):
    for name, content in {"one": '{"a": 1}\n', "list": '[\n{"a": 1},\n{"a": 2}\n]\n', "rows": '{"n": 1, "data": [\n{"a": 1}\n]}', "lines": '\n{"a": 1}\n\n{"a": 2}\n'}.items():
        (tmp_path / f"{name}.json").write_text(content)
    read = lambda name: datasets.read_files(spark, str(tmp_path / f"{name}.json"), "json")
    assert [read(n).count() for n in ("one", "list", "rows")] == [1, 2, 1]
    with pytest.raises(datasets.IngestError, match="lines.json"):
        read("lines")
