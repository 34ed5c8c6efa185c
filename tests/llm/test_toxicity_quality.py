import random

import pytest
from pyspark.sql import functions as F

from brasstally.llm import quality, toxicity
from brasstally.llm.common import key_crc32, labelled_sample
from brasstally.llm.toxicity import Lexicon, fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_fold():
    assert fold("Idiot!") == fold("1D10T") == fold("іdіоt") == fold("ídïot") == fold("i​diot")
    assert fold("in 2024, 10 of 35") == " in 2024 i0 of 35 " or fold("in 2024").split()[0] == "in"
    assert fold("") == "  ".replace("  ", "  ") and fold("!!!").strip() == ""


def test_exceptions_and_length():
    lexicon = Lexicon({fold(w).strip(): 3.0 for w in ("clown", "trash")}, curve=(-4.0, 1.0, 1.0))
    assert lexicon.hits(fold("a clown fish in the trash can")) == []
    assert lexicon.hits(fold("a clown, trash clown")) == [3.0, 3.0, 3.0]
    assert lexicon.hits(fold("clowns trashy")) == []
    assert lexicon.score("clown") > lexicon.score("clown " + "word " * 3000) > lexicon.score("word " * 3000)
    assert lexicon.score("") == lexicon.score("fine") and 0 < lexicon.score("") < 1
    assert Lexicon({}).score("clown") == Lexicon({}).score("")


def test_stems():
    lexicon = Lexicon({"trash": 3.0, "tras*": 2.0, "trashy": 4.0})
    assert lexicon.hits(fold("trash trashes trashy tra strash")) == [3.0, 2.0, 4.0]
    assert lexicon.hits(fold("a trash can")) == []


def test_near_copies_count_once(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(f"{same} oddword {i}", 1) for i in range(40)] + [(f"{w} {w}ia {w}ib villain{i}", 1) for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(f"fine {i} text {i + 1}", 0) for i in range(200)]
    found = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert "viiia*" in found.weights and not any(w.startswith("odd") for w in found.weights)


def corpus(n=600, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, poor = int(i % 9 == 0), i % 5 == 0
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if toxic:
            text[3:3] = ["v1le", "scoundrel"]
        text = " ".join(w.upper() + "!!" for w in text) if poor else " ".join(text).capitalize() + "."
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not poor), toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    edge = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 50_000, "en", "s", 1), (None, "x", "en", "s", 1), (9003, "word " * 50_000, "en", "s", 1)]
    return spark.createDataFrame(docs + edge, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (7, 1, 0)], LABELS)


def accuracy(rows, labels, at):
    truth = {r[0]: r[at] for r in labels.collect() if r[0] is not None and r[at] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held), len(held)


@pytest.mark.parametrize(("module", "at", "folds", "out"), [(toxicity, 2, 4, 2), (quality, 1, 5, 0)])
def test_held_out_accuracy(spark, tables, module, at, folds, out):
    docs, labels = tables
    rows = module.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    right, n = accuracy(rows, labels, at)
    assert n > 60 and right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_keep_other_columns(spark, tables, module):
    docs, labels = tables
    model = module.train(docs, labels)
    odd = docs.limit(3).withColumn("score", F.lit("old")).withColumn("predicted", F.lit("old")).withColumn("label", F.lit(1))
    got = module.score(odd, model)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "label", "score", "predicted"] and got.count() == 3
    assert module.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nothing_to_learn_from(spark, tables, module):
    docs, labels = tables
    got = module.scored(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and len({round(r.score, 9) for r in got}) == 1


def test_sample_is_bounded_and_not_held_out(spark, tables):
    docs, labels = tables
    assert labelled_sample(docs, labels, "toxic", 4, 2, 50).count() == 50
    held = labels.where(key_crc32(F.col("doc_id")) % 4 == 2)
    assert labelled_sample(docs, held, "toxic", 4, 2, 50).count() == 0


def test_exact_votes():
    import numpy as np

    r = np.random.default_rng(0)
    unit = lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    known, asked, y = unit(r.normal(size=(200, 8))), unit(r.normal(size=(20, 8))), r.integers(0, 2, 200).astype(float)
    space = quality.Space({}, np.zeros(0), np.zeros((0, 8)), known, y, float(y.mean()))
    cos = asked @ known.T
    for got, c in zip(space.vote(asked), cos, strict=True):
        near = np.argsort(-c)[: space.neighbours]
        w = np.maximum(c[near].astype(float), 0) ** 4
        assert got == pytest.approx((w @ y[near] + 1e-3 * y.mean()) / (w.sum() + 1e-3))


def test_balanced_votes():
    import numpy as np

    known = np.array([[1, 0], [1, 0], [1, 0], [1, 0], [0, 1]], np.float32)
    asked, y = np.array([[np.sqrt(0.5), np.sqrt(0.5)]], np.float32), np.array([1.0, 1, 1, 1, 0])
    plain, balanced = (quality.Space({}, np.zeros(0), np.zeros((0, 2)), known, y, 0.8, balanced=b).vote(asked)[0] for b in (False, True))
    assert plain == pytest.approx(0.8, abs=1e-3) and balanced == pytest.approx(0.5, abs=1e-3)


def test_shapes_and_marks():
    assert quality.shape("Hello!!") == "Aa!" and quality.shape("AB12***") == "A0*" and quality.shape("|") == "|"
    assert quality.marks("a a a a\nb\nb", "a a a a b b".split()) == ["r:6", "l:3"] and quality.marks("", []) == []
