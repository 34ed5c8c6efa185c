"""The pipeline stage by stage against what the operators decide, and the queries that have SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brasstally.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_rows(stages):
    docs = stages[0]
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == docs.columns
        assert set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))


def test_filters(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = set(ids(stages[1]))
    clean = [i for i in ids(stages[0]) if i in labels and not labels[i].toxic]
    assert sum(i in kept for i in clean) / len(clean) > 0.97
    good = [i for i in ids(stages[1]) if i in labels and labels[i].quality]
    kept = set(ids(stages[2]))
    assert sum(i in kept for i in good) / len(good) > 0.95


def test_near_duplicates_leave_one_of_each_group(stages):
    """The stage's rule, five-word shingles and 0.8, over every pair (the two bits of op9 are another contract's)."""
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in stages[2].collect()]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, w in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(ids(stages[3])) == sorted({find(i) for i in sets})
    assert len(ids(stages[3])) < len(sets)


def test_mixing_keeps_all_in_order(stages):
    from brasstally.llm import mixing

    place = {r.doc_id: (r.slot, r.position) for r in mixing.placements(stages[3]).collect()}
    files = stages[4].select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()
    assert [r.doc_id for r in files] == sorted(place, key=place.get)


def test_packing_takes_all(stages):
    assert set(ids(stages[5])) == set(ids(stages[4]))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "length").exceptAll(stages[5].select("doc_id", "piece", "length")).count() == 0


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[at[c]] for c in columns)) for r in result.fetchall())
