"""What classifiers learn from: whole words, one row an id, near copies that count once, phrases that excuse a term."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from brasstally.llm import quality, toxicity
from brasstally.llm.common import labelled_sample
from brasstally.llm.toxicity import fold


def test_words_are_read_whole():
    a, b = "x" * 40 + "a" * 40, "x" * 40 + "!9" * 20
    assert "".join(quality.split(a)) == a and len(quality.split(a)) == 5
    assert [quality.terms(p) for p in quality.split(a)] != [quality.terms(p) for p in quality.split(b)]
    assert quality.split("short words\nstay") == ["short", "words", "stay"] and quality.split(" ") == []
    assert quality.shape("aA" * 20) == "*Aa" and quality.shape("aA" * 4) == "aA" * 4 and quality.shape("aA" * 20 + "!") == "*!Aa"


def test_no_term_is_without_a_column(spark):
    rows = [(f"{'common ' * 3} rare{i} another{i}", i % 2) for i in range(40)]
    space = quality.fit(spark.createDataFrame(rows, "text string, label int"), max_terms=5)
    counts = space.counts(["unseen common"], quality._Ids(space.vocabulary))[0]
    assert len(space.vocabulary) == 5 and len(counts) == 5 + quality.SHARED == len(space.idf) and counts.sum() == 4


def test_unspaced_texts_with_one_beginning_score_apart(spark):
    r = random.Random(1)
    start = "".join(r.choice("abcdef") for _ in range(70))
    rows = [(start + "fedcba" * r.randint(20, 60), 1) for _ in range(60)] + [(start + "#3!?10" * r.randint(20, 60), 0) for _ in range(60)]
    space = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    good, poor = space.score([start + "fedcba" * 30, start + "#3!?10" * 30])
    assert good > 0.6 > 0.4 > poor


def test_an_id_that_many_documents_share_gives_one_row(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(100, 200)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), *((i, 1, 0) for i in range(100, 200))], "doc_id long, quality int, toxic int")
    for folds, held in ((4, 2), (5, 0)):
        rows = labelled_sample(docs, labels, "toxic", folds, held, 1000).collect()
        assert len(rows) == len({r.text for r in rows}) <= 101
        assert labelled_sample(docs, labels, "toxic", folds, held, 10).count() == 10
        shared = [r for r in rows if r.text.startswith("text")]
        assert all(r.text == "text 00000" and r.label == 1 for r in shared)
    assert sum(r.text.startswith("text") for r in labelled_sample(docs, labels, "toxic", 1000, 999, 1000).collect()) == 1


def kin_of(texts):
    batch = pa.RecordBatch.from_pydict({"text": texts, "label": [1] * len(texts)}, schema=pa.schema([("text", pa.string()), ("label", pa.int32())]))
    rows = next(toxicity._kin(iter([batch]))).to_pandas()
    return sorted(t for _, g in rows.groupby("kin") for t in toxicity._first_of_kin(g)["text"])


def test_texts_with_a_common_opening_stay_apart():
    r = random.Random(2)
    line = " ".join(f"open{i}" for i in range(12))
    texts = [line + " " + " ".join(f"w{r.randrange(10_000)}" for _ in range(60)) for _ in range(80)]
    assert kin_of(texts) == sorted(texts)
    copies = [f"{texts[0]} end{i}" for i in range(30)]
    assert len(kin_of(copies)) < 8 and len(kin_of([texts[0]] * 5)) == 1
    assert kin_of(["", "one", "one two"]) == ["", "one", "one two"]


def test_learned_exceptions(spark):
    r = random.Random(3)
    word = lambda: f"n{r.randrange(3000)}"
    toxic = [f"{word()} {word()} you snake {word()} {word()} {i}" for i in range(120)]
    fine = [f"{word()} {word()} the snake river {word()} {word()} {i}" for i in range(12)] + [f"{word()} {word()} {word()} {i}" for i in range(900)]
    found = toxicity.fit(spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in fine], "text string, label int"))
    assert "snake" in found.weights and fold("snake river") in found.learned
    assert found.hits(fold("near the snake river")) == [] and found.hits(fold("you snake")) != []
    assert toxicity.Lexicon(*found.__reduce__()[1]) == found
