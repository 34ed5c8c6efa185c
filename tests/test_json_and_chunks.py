"""Bad lines of split files, JSON shapes in one pass, and the SQL of recursive chunks on made-up texts."""

import json
import random

import duckdb
import pytest

from brasstally.errors import IngestError
from brasstally.operators import retrieval
from brasstally.oracles import _recursive_chunks
from brasstally.sources import datasets


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(kept, ("700b", "1b"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_bad_lines_are_named_in_split_files(spark, tmp_path, small_splits):
    r = random.Random(4)
    bad = {"a.jsonl": {3: "{broken", 150: "[1, 2]", 199: "text"}, "b.jsonl": {1: '{"id": '}, "c.jsonl": {}}
    for name, lines in bad.items():
        rows = [lines.get(i, r.choice(["", "  "]) if i % 10 == 0 else json.dumps({"id": i, "text": "x" * r.randint(0, 40)})) for i in range(1, 201)]
        (tmp_path / name).write_text("\n".join(rows) + "\n" * (name == "a.jsonl"))
    paths = [str(tmp_path / n) for n in bad]
    assert spark.read.text(paths).rdd.getNumPartitions() > 12
    got = {(x["path"].rsplit("/", 1)[1], x["line"], x["content"]) for x in datasets.bad_lines(spark, paths, {}).collect()}
    assert got == {(name, line, text) for name, lines in bad.items() for line, text in lines.items()}
    with pytest.raises(IngestError, match=r"a\.jsonl, line 3: \{broken"):
        datasets.read_files(spark, paths, "jsonl")
    fine = datasets.read_files(spark, [paths[2]], "jsonl")
    assert fine.count() == 180 and datasets.bad_lines(spark, [paths[2]], {}).count() == 0


def test_shapes_in_one_pass(spark, tmp_path):
    rows = lambda a, n: [{"id": a + i, "name": f"n{a + i}"} for i in range(n)]
    files = {
        "list.json": rows(0, 3), "items.json": {"items": rows(10, 2), "page": 1}, "data.json": {"data": [{"id": 20, "extra": 1.5}], "items": rows(99, 1)},
        "one.json": {"id": 30, "name": "n30"}, "pretty.json": rows(40, 2), "none.json": {"records": []}, "typed.json": {"rows": [{"id": "s50"}]},
    }
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, indent=2 if name == "pretty.json" else None))
    df = datasets.read_files(spark, str(tmp_path), "json")
    got = sorted((x["_source_name"].rsplit("/", 1)[1], x["id"], x["extra"]) for x in df.collect())
    want = [("list.json", str(i), None) for i in range(3)] + [("items.json", str(i), None) for i in (10, 11)] + [("data.json", "20", 1.5), ("one.json", "30", None)] + [("pretty.json", str(i), None) for i in (40, 41)] + [("typed.json", "s50", None)]
    assert got == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 or plan.count("Scan json") == 1


def test_recursive_chunks_and_their_sql(spark):
    r = random.Random(11)
    pieces = ["a", "bb", "ccc dd", " ", "  ", "\n", "\n\n", "\n\n\n", "word", "x" * 30, "y" * 60, "é", "日本語"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["", None, " ", "z" * 200, "\n\n", "q" * 20, "q" * 19 + " " + "q" * 21]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    for size, overlap in ((20, 5), (50, 0), (7, 6)):
        theirs = sorted(con.execute(_recursive_chunks(size, overlap)).fetchall())
        ours = sorted((i, k, c) for i, t in enumerate(texts) for k, c in enumerate(retrieval.split_recursively(t, size, overlap)))
        assert ours == theirs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(x) for x in retrieval.chunk_recursively(df, 20, 5).collect()) == sorted((i, k, c) for i, t in enumerate(texts) for k, c in enumerate(retrieval.split_recursively(t, 20, 5)))


def test_files_as_a_table(spark, tmp_path):
    root = tmp_path / "transactions"
    (root / "sub" / "b.jsonl").mkdir(parents=True)
    head = "transaction_id,account_id,amount,currency,timestamp\n"
    (root / "Z.CSV").write_text(head + "1,a,1.0,GHS,2026-01-01\n")
    (root / "a.csv").write_text(head + "1,first,2.0,GHS,2026-01-01\n2,b,1,GHS,2026-01-02\n")
    line = json.dumps({"transaction_id": "3", "account_id": "c", "amount": 1, "currency": "GHS", "timestamp": "2026-01-03"})
    (root / "sub" / "b.jsonl" / "part-0.json").write_text(line + "\n" + line.replace('"3"', '"1"') + "\n")
    (root / "sub" / "c.json").write_text(f"[{line.replace('3', '4', 1)}]")
    (root / "notes.txt").write_text("no data")
    files = {r["path"].rsplit("/", 1)[1]: (r["format"], r["bytes"] > 0, r["by_folder"]) for r in datasets.file_table(spark, str(root)).collect()}
    assert files == {"Z.CSV": ("csv", True, False), "a.csv": ("csv", True, False), "part-0.json": ("jsonl", True, True), "c.json": ("json", True, False)}
    assert [p.rsplit("/", 1)[1] for p in datasets.list_files(spark, str(root))] == ["a.csv", "part-0.json", "c.json", "Z.CSV"]
    got = {r["transaction_id"]: r["account_id"] for r in datasets.load(spark, "transactions", datasets.Source(root=str(tmp_path))).collect()}
    assert got == {"1": "first", "2": "b", "3": "c", "4": "c"}
    from dataclasses import replace

    one = datasets.load(spark, replace(datasets.DATASETS["transactions"], multi_file=False), datasets.Source(root=str(tmp_path)))
    assert {r["transaction_id"] for r in one.collect()} == {"1", "2"}
    flat = datasets.load(spark, replace(datasets.DATASETS["transactions"], recursive=False), datasets.Source(root=str(tmp_path)))
    assert {r["transaction_id"] for r in flat.collect()} == {"1", "2"}
