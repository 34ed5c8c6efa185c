"""Source divergence against brute force, skybands against all pairs, and the unusual tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from brasstally.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n string"


def brute(rows, min_docs, k):
    docs = [(lang or "", source or "", divergence.terms_of(text or "")) for _, text, lang, source, *_ in rows]
    groups, totals, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        totals[lang].update(terms)
        seen[lang].update(set(terms))
    out = set()
    kept = {lang: [t for t in totals[lang] if seen[lang][t] >= min_docs] for lang in totals}
    share = lambda counts, terms: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in terms) + 5 * len(terms)) for t in terms}
    p = {g: share(c, kept[g[0]]) for g, c in groups.items()}
    for (lang, source), mine in p.items():
        pairs = [(-sum(abs(mine[t] - p[lang, s][t]) for t in kept[lang]), s) for g, s in p if g == lang and s != source]
        whole = share(totals[lang], kept[lang])
        terms = [(whole[t] - mine[t], t) for t in kept[lang] if groups[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, source, part, item, -v, i) for i, (v, item) in enumerate(found[:most], 1)}
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "é", "日本", "a b", "\U0001f600"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 30))).title(), r.choice(["en", "de", None, ""]), r.choice(["hot"] * 8 + ["a", "b", None]), "x", "y") for i in range(n)]
    return rows + rows[:7] + [(None, None, "en", "a", None, None), (1, "", "zz", "only", None, None), (2, "Lone", "yy", "p", "", ""), (3, None, "yy", "q", "", ""), (4, "wa " * 300_000, "en", "long", None, None)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_same_as_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 7)
    rows = rows_of(k, 150)
    got = {tuple(x) for x in divergence.audit(spark.createDataFrame(rows, DOCS).repartition(5), 4, k).collect()}
    assert got == brute(rows, 4, k)


def test_empty_and_without_kept_terms(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b", "en", "s", "", ""), (2, None, "en", "t", "", ""), (3, "a", "de", "s", "", "")]
    got = {tuple(x) for x in divergence.audit(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_skyband_keeps_what_few_dominate():
    r = random.Random(5)
    for size, high in ((0, 3), (1, 3), (700, 4), (1500, 40), (1200, 10**6)):
        terms = sorted({"".join(r.choices("abé日", k=r.randint(1, 6))) for _ in range(size)}, key=lambda _: r.random())
        n, total = (np.array([r.randint(1, high) for _ in terms], np.int64) for _ in range(2))
        rank = np.argsort(np.argsort([t.encode().hex() for t in terms])) if terms else np.empty(0)
        for k in (1, 5, 50):
            want = {i for i in range(len(terms)) if np.count_nonzero((n >= n[i]) & (total <= total[i]) & (rank < rank[i])) < k}
            assert set(divergence.skyband(n, total, terms, k).tolist()) == want


def test_chunks_and_flushes_change_nothing(spark):
    import pyarrow as pa

    r = random.Random(8)
    table = pa.table({"lang": ["en"] * 400, "source": [r.choice("ab") for _ in range(400)], "term": [f"t{i:03}" for i in r.sample(range(400), 400)], "n": [r.randint(1, 9) for _ in range(400)], "total": [r.randint(9, 20) for _ in range(400)]})
    whole = pa.Table.from_batches(divergence._retained(5)(table.to_batches()))
    parts = [b for i in range(0, 400, 80) for b in divergence._retained(5)(table.slice(i, 80).to_batches())]
    again = pa.Table.from_batches(divergence._retained(5)(parts))
    key = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in ("source", "term")), strict=True))
    assert key(whole) == key(again) and 0 < len(whole) < 400


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    counts = [0, 7, 9_000_000_000, 10**13]
    want = [1 + 10**9 * (c + 5) // (10**14 + 5 * 10**7) for c in counts]
    assert divergence.exact_shares(np.array(counts), 10**14, 10**7).tolist() == want
    df = spark.createDataFrame([(c, 10**14, 10**7) for c in counts], "c long, n long, v long").orderBy("c")
    assert [x[0] for x in df.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
