"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from brasstally.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=5):
    """Texts with near copies by edits of some words, and with less similar ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = [None, "", "one two", "One  two"]
    for _ in range(60):
        base = [word() for _ in range(r.choice([8, 40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(30))
    texts += [f"{line} {' '.join(word() for _ in range(r.choice([3, 12, 40])))}" for _ in range(80)]
    r.shuffle(texts)
    return texts


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def slow_groups(texts):
    sets, root, far = [shingled(t) for t in texts], list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                far += sets[i] != sets[j]
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert far > 40
    return root


@pytest.mark.parametrize("seed", [5, 6])
def test_stage_leaves_one_of_each_near_copies(spark, seed):
    texts = planted(seed)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted(set(slow_groups(texts)))


@pytest.mark.parametrize("most", [1, 300, 3000])
def test_large_groups_are_cut_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "GROUP_SHINGLES", most)
    texts = planted(8)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted(set(slow_groups(texts)))


def test_search_reaches_the_same(seed=7):
    texts = planted(seed)
    root = near_copies.reached([near_copies.shingles(t) for t in texts]).tolist()
    assert root == slow_groups(texts)


def test_no_rows(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], DOCS), "").count() == 0
