"""Moments and components against numpy, neighbours of many queries against all products, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasstally.errors import InputError
from brasstally.operators import metrics, vectors

ODD = [(900, None), (901, [1.0, 2.0]), (902, [None] + [1.0] * 5), (903, [float("inf")] + [1.0] * 5), (904, [])]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    return r.normal(size=(200, 6)) @ r.normal(size=(6, 6)) + 1e6  # a far mean, where digits would cancel


def test_moments(spark, rows):
    df = table(spark, [*enumerate(rows.tolist()), *ODD])
    assert vectors.dimension(df) == 6
    means = {x["i"]: x["mean"] for x in vectors.mean(df).collect()}
    assert np.allclose([means[i] for i in range(6)], rows.mean(0), rtol=1e-14) and vectors.mean(df).first()["n"] == 200
    found = {(x["i"], x["j"]): x["covariance"] for x in vectors.covariance(df).collect()}
    want = np.cov(rows.T, bias=True)
    assert len(found) == 21 and all(abs(found[i, j] - want[i, j]) < 1e-7 for i, j in found)


def test_components_and_coordinates(spark, rows):
    df = table(spark, [*enumerate(rows.tolist()), *ODD])
    centre, axes, shares = vectors.components(df, 3)
    _, s, vt = np.linalg.svd(rows - rows.mean(0), full_matrices=False)
    assert np.allclose(np.abs((axes * vt[:3].T).sum(0)), 1, atol=1e-8) and np.allclose(shares, s[:3] ** 2 / (s**2).sum(), atol=1e-9)
    assert all(axes[np.abs(axes[:, c]).argmax(), c] > 0 for c in range(3))
    got = {x["vec_id"]: x["coordinates"] for x in vectors.project(df, 3).collect()}
    assert all(got[i] is None for i, _ in ODD) and len(got) == 205
    assert np.allclose([got[i] for i in range(200)], (rows - centre) @ axes, atol=1e-9)


def test_tables_without_vectors(spark):
    empty = table(spark, [])
    assert vectors.mean(empty).count() == 0 and vectors.covariance(empty).count() == 0
    assert vectors.nearest_of(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0
    assert [x["coordinates"] for x in vectors.project(table(spark, [(1, None)]), 1).collect()] == [None]
    with pytest.raises(InputError):
        vectors.components(table(spark, [(1, [1.0])]), 2)


def slow(rows, asked, k, own):
    out = set()
    for q, v in asked:
        near = sorted((-round(float(np.dot(v, x) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(x, x))), vectors.DECIMALS), i) for i, x in rows if (own or i != q) and np.any(x))
        out |= {(q, rank, i) for rank, (_, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("bytes_,queries_,vectors_", [(10**9, 1024, 2048), (0, 7, 16), (10**9, 5, 11)])
@pytest.mark.parametrize("own", [True, False])
def test_nearest_of_many(spark, monkeypatch, bytes_, queries_, vectors_, own):
    for name, value in (("BROADCAST_BYTES", bytes_), ("QUERY_BLOCK", queries_), ("VECTOR_BLOCK", vectors_)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(5)
    plain = [(i, x) for i, x in enumerate(r.integers(-2, 3, size=(120, 6)).astype(float))]  # many ties and some zeros
    rows = plain + [(200 + i, plain[3][1] * 2) for i in range(40)]  # copies of one direction
    df = table(spark, [*((i, x.tolist()) for i, x in rows), *ODD], 4)
    asked = [(i, x) for i, x in rows if i % 10 == 3 and np.any(x)]
    got = vectors.nearest_of(df, df.where("vec_id % 10 = 3").withColumnRenamed("vec_id", "query_id"), 9, own=own)
    assert {(x["query_id"], x["rank"], x["vec_id"]) for x in got.collect()} == slow(rows, asked, 9, own)


def test_best_against_sorting():
    r = np.random.default_rng(1)
    for n, k in ((3, 5), (50, 4), (50, 1)):
        scores, ids = r.integers(0, 4, size=(20, n)).astype(float), r.permutation(n)
        got = vectors.best(scores, ids, k)
        for q in range(20):
            want = sorted(range(n), key=lambda i: (-scores[q, i], ids[i]))[:k]
            assert got[0][q].tolist() == [scores[q, i] for i in want] and got[1][q].tolist() == [ids[i] for i in want]


def test_sweep_of_cases_reports_progress(spark):
    cases = spark.createDataFrame([(i, ["alpha", "beta"]) for i in range(10)], "test_id long, keywords array<string>")
    found = spark.createDataFrame([(i, 1, "alpha and more") for i in range(10)], "test_id long, rank int, text string")
    steps = list(metrics.sweep(cases, found, parts=4))
    assert [round(done, 3) for done, _ in steps] == [0.25, 0.5, 0.75, 1.0]
    got = sorted(x["test_id"] for _, df in steps for x in df.where(F.col("mrr") == 0.5).collect())
    assert got == list(range(10))
