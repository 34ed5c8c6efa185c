"""Collocations against brute force, the trie's bursts and spills against a plain count, and the unusual tables."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from brasstally.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, l string"


def plain_counts(rows, longest=3):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang, ""] += len(w)
            f.update(("und" if lang is None else lang, " ".join(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    return f


def brute(rows, least, ranks=2000, subsumed=50, longest=3):
    f = plain_counts(rows, longest)
    cands = {k: n for k, n in f.items() if " " in k[1] and n >= least}
    found = []
    for (lang, phrase), a in cands.items():
        w = phrase.split(" ")
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not any(lg == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} " and 100 * n >= subsumed * a for (lg, p), n in cands.items()):
            found.append((lang, -score, -a, phrase.encode(), phrase, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    out, seen = set(), Counter()
    for lang, score, a, _, phrase, left, right in sorted(found):
        seen[lang] += 1
        if seen[lang] <= ranks:
            out.add((lang, seen[lang], phrase, -a, left, right, f[lang, ""], -score))
    return out


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "cé", " d", "日本", "e\x85", "f'g", "\U0001f600", "h"]
    make = lambda: "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\x0b", "!", "\r\n"]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "de", None, ""]), make()) for _ in range(n)]
    return [*rows, *rows[:5], ("en", None), (None, ""), ("de", " . , "), ("long", "x y z " * 100_000)]


@pytest.mark.parametrize("least,ranks,longest", [(10, 2000, 3), (2, 5, 3), (4, 2000, 2), (4, 2000, 4)])
def test_same_as_brute_force(spark, least, ranks, longest):
    rows = texts(least, 60)
    df = spark.createDataFrame([(i, text, lang, "p", "q") for i, (lang, text) in enumerate(rows)], DOCS).repartition(4)
    got = {tuple(x) for x in phrases.collocations(df, longest, least, ranks=ranks).collect()}
    assert got == brute(rows, least, ranks, longest=longest)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", "", ""), (2, None, None, "", "")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        phrases.frequent_phrases(spark.createDataFrame([], DOCS), 5)


@pytest.mark.parametrize("seed", range(4))
def test_bursts_spills_and_slices(monkeypatch, seed):
    r = random.Random(seed)
    for name, value in {"HELD": r.choice([50, 700]), "BURST": r.choice([2, 20]), "WORDS": r.choice([7, 10_000]), "SLICE": r.choice([3, 50]), "RUN_ROWS": r.choice([2, 500])}.items():
        monkeypatch.setattr(phrases, name, value)
    words = [f"w{i}" for i in range(40)]
    rows = [(r.choice(["en", "de"]), " ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randint(0, 200)))) for _ in range(30)]
    batches = pa.table({"lang": [x[0] for x in rows], "text": [x[1] for x in rows]}).to_batches(max_chunksize=7)
    got, home = Counter(), {}
    for batch in phrases._runs(3, 8)(batches):
        for lang, part, run in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "run")), strict=True):
            lines = phrases.unpacked(pa.py_buffer(run))
            words = [x.split(" ") for x in lines.column("phrase").to_pylist()]
            assert words == sorted(words)
            for phrase, n in zip(*(lines.column(c).to_pylist() for c in ("phrase", "n")), strict=True):
                got[lang, phrase] += n
                assert home.setdefault((lang, phrase), part) == part  # a phrase always goes to one prefix partition
    assert got == plain_counts(rows)


def test_popular_pairs_are_spread():
    trie = phrases.PhraseTrie(3)
    list(trie.add(". ".join(f"of the w{i}" for i in range(500))))
    list(trie.counted())
    parts = {part for part, run in trie.spill(16) if any(x.startswith("of the w") for x in run.column("phrase").to_pylist())}
    assert len(parts) > 12 and not trie.size


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 3 * 10**12, 10**12 + 1)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * 10**24 // (3 * 10**12 * (10**12 + 1))
