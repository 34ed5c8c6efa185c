"""Whole scores of the two classifiers against plain loops over whole texts."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from brasstally.llm import quality, toxicity


def slow_toxicity(lexicon, text):
    """Words one by one, with every term and every exception phrase looked for in the folded text."""
    folded = toxicity.fold(text)
    spans = [(at, at + len(p)) for p in (*map(toxicity.fold, lexicon.exceptions), *lexicon.learned) for at in range(len(folded)) if folded.startswith(p, at)]
    found, at = [], 0
    for word in folded.split():
        at = folded.index(f" {word} ", at)
        weights = []
        for term, weight in lexicon.weights.items():
            shown = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            if (f" {word} ").startswith(shown) and not any(a <= at and at + len(shown) <= b for a, b in spans):
                weights.append(weight)
        if weights:
            found.append(max(weights))
        at += len(word) + 1
    total, words = sum(found), len(folded.split())
    x = (math.log1p(100 * total / max(words, 20)), math.log1p(100 * len(set(found)) / max(words, 20)))
    return 1 / (1 + math.exp(-(lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], x, strict=True)))))


def test_toxicity_scores():
    r = random.Random(1)
    words = ["vile", "v1ie", "scum", "scumbag", "pond", "snake", "river", "the", "a", "fine", "vilest", "trash", "can"]
    lexicon = toxicity.Lexicon({"viie": 3.0, "vii*": 2.0, "scum*": 2.5, "snake": 1.5, "trash": 4.0}, curve=(-3.0, 1.2, -0.3), learned=(" snake river ",))
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 50))) + r.choice(["", "!", " ..."])
        assert lexicon.score(text) == pytest.approx(slow_toxicity(lexicon, text), abs=1e-12)


def on_grid(xs, bits):
    return [round(x * 2**bits) / 2**bits for x in xs]


def slow_quality(space, text):
    """Terms counted one by one, a dictionary of columns, and all cosines sorted."""
    n, bag, words = len(space.vocabulary), Counter(), []
    for word in text.split():
        words += [word] if len(word) <= 32 else [word[i : i + 16] for i in range(0, len(word), 16)]
    terms = [t for w in words for t in quality.terms(w)]
    terms += [m for m in quality.marks(text, words) for _ in words]
    for t in terms:
        bag[space.vocabulary[t] if t in space.vocabulary else n + crc32(t.encode()) % quality.SHARED] += 1
    row = np.zeros(n + quality.SHARED)
    for column, count in bag.items():
        row[column] = math.log1p(count) * space.idf[column]
    row /= max(math.sqrt(math.fsum(x * x for x in row)), 1e-12)
    point = [math.fsum(a * b for a, b in zip(on_grid(row, quality.ROW_BITS), axis, strict=True)) for axis in space.projection.T]
    length = max(math.sqrt(math.fsum(x * x for x in point)), 1e-12)
    point = on_grid([x / length for x in point], quality.VECTOR_BITS)
    cosines = sorted((-math.fsum(a * b for a, b in zip(point, v, strict=True)), i) for i, v in enumerate(space.vectors))[: space.neighbours]
    cosines = [(-c, space.labels[i]) for c, i in cosines]
    share = {1: 0.5 / space.prior, 0: 0.5 / (1 - space.prior)}
    weights = [(max(c, 0) ** 4 * share[int(label)], label) for c, label in cosines]
    return (sum(w * y for w, y in weights) + 1e-3 * space.prior) / (sum(w for w, _ in weights) + 1e-3)


def test_quality_scores(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    rows = [(" ".join(word() for _ in range(r.randint(5, 40))), 1) for _ in range(50)] + [(" ".join(word().upper() + "!" for _ in range(r.randint(5, 40))), 0) for _ in range(30)]
    space = quality.fit(spark.createDataFrame(rows, "text string, label int"), max_terms=60, dimensions=8)
    texts = [" ".join(r.choice([word(), word().upper() + "!", "x" * 50, "same same"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    assert np.allclose(space.score(texts), [slow_quality(space, t) for t in texts], rtol=0, atol=1e-9)


def test_equal_texts_score_alike_in_any_batch():
    r, n = np.random.default_rng(4), 700
    vocabulary = {f"w:{chr(97 + i)}{chr(97 + j)}": 26 * i + j for i in range(26) for j in range(26)}
    size = len(vocabulary) + quality.SHARED
    grid = lambda m: quality._grid(quality._unit(m), quality.VECTOR_BITS)
    vectors = grid(r.normal(size=(n, 48)))
    vectors[n // 2 :] = vectors[: n - n // 2]  # each labelled vector twice, with other labels: ties everywhere
    space = quality.Space(vocabulary, np.ones(size), quality._grid(r.normal(size=(size, 48)) / 30, quality.ROW_BITS), vectors, np.arange(n) % 2.0, 0.5)
    words = sorted(x[2:] for x in vocabulary)
    texts = [" ".join(words[k] for k in r.integers(len(words), size=r.integers(1, 60))) for _ in range(90)]
    alone = [space.score([t])[0] for t in texts]
    for _ in range(4):
        order = r.permutation(len(texts) * 2) % len(texts)
        assert space.score([texts[i] for i in order]).tolist() == [alone[i] for i in order]
