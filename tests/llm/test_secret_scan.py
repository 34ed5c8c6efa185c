"""Secret scans against plain regular expressions, queries of trigrams against the expressions' matches, sums in blocks, native plans, and the unusual tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brasstally.llm import secret_scan, trigrams

DOCS = "doc_id long, text string, lang string, key string, spans string"


def brute(text):
    found = []
    for i, r in enumerate(secret_scan.RULES):
        pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
        least = 24 if r.kind == "hex" else r.least
        found += [(m.start(), i, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[r.group]) >= least]
    found.sort()
    show = lambda xs: ",".join(f"{secret_scan.RULES[i].kind}:{a}:{b}" for a, i, b in xs)
    base = [x for x in found if x[1] < 3]
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), show(found))


def made(r):
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    letters = lambda n: "".join(r.choice("ABCXYZabcxyz0189") for _ in range(n))
    pieces = [
        lambda: r.choice(["password", "PassWD", "secret", "TOKEN", "api_key", "APIkey"]) + r.choice(["", '"', "'"]) + r.choice(["", "  "]) + r.choice(":==") + r.choice(["", " "]) + r.choice(["", '"', "'"]) + letters(r.randint(0, 12)),
        lambda: "AKIA" + letters(r.randint(0, 20)).upper(), lambda: hexes(r.choice([3, 23, 24, 40])), lambda: f"gh{r.choice('psx')}_" + letters(r.choice([35, 40])),
        lambda: "xoxb-" + letters(r.choice([9, 12])), lambda: "AIza" + letters(36), lambda: ".".join(["eyJ" + letters(9), "eyJ" + letters(8), letters(10)]),
        lambda: "-----BEGIN RSA PRIVATE KEY-----", lambda: 'token=token" : abcdef123', lambda: "ſecret=abcdefg Key", lambda: "\U0001f600é\n日本", lambda: "word", lambda: "token" + " " * 50, lambda: "secret==abcdef=token=",
    ]
    return "".join(r.choice(pieces)() + r.choice(["", " ", "\n", "."]) for _ in range(r.randint(0, 12)))


@pytest.mark.parametrize("most", [0, 10**6])
def test_same_as_plain_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(secret_scan, "MOST_BROADCAST", most)
    r = random.Random(4)
    rows = [(i, made(r), "en", "k", "s") for i in range(150)] + [(3, None, None, None, None), (None, "token=abcdef", "", "", ""), (None, "token=abcdef", "", "", ""), (7, "", "", "", ""), (8, "x " * 200_000 + "AKIA" + "A" * 16, "", "", ""), (9, "a" * 300_000, "", "", "")]
    got = sorted(repr(tuple(x)) for x in secret_scan.report(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert got == sorted(repr((row[0], *brute(row[1]))) for row in rows)


def test_empty_table_and_rules(spark):
    empty = spark.createDataFrame([], DOCS)
    assert secret_scan.report(empty).count() == 0
    df = spark.createDataFrame([(1, "0" * 24)], "doc_id long, text string")
    assert [tuple(x) for x in secret_scan.scan(df, (secret_scan.BASE[2],)).first()["spans"]] == [(0, 0, 24)]


def test_many_matches_in_one_text(spark):
    text = "é token=abcdef" * 20_000
    x = secret_scan.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(x)[1:] == brute(text)


def test_sums_before(spark):
    r = random.Random(1)
    for n in (0, 1, 2, 255, 256, 257, 1000):
        xs = [r.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "x array<int>").select(secret_scan.sums_before(F.col("x"))).first()[0]
        assert got == [sum(xs[:i]) for i in range(n)]


def test_native(spark):
    df = spark.createDataFrame([(1, "token=abcdef", "a")], "doc_id long, text string, lang string")
    plan = secret_scan.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("abcd", [["abc", "bcd"]]), ("ab", None), ("(abc|xyz)+", [["abc"], ["xyz"]]), ("(abc|x)", None), ("ab?cde", [["abc", "bcd", "cde"], ["acd", "cde"]]), ("[ab]cd", [["acd"], ["bcd"]]),
        ("abc.*def", [["abc", "def"]]), ("(abc.|def.)g", [["abc"], ["def"]]), ("abc*", None), ("(?:abc){2}", [["abc", "bca", "cab"]]), ("[0-9a-f]{24,}", None), ("(?i:ABC)", [["abc"]]), ("x(foo[0-9]+bar)?y", None),
    ],
)
def test_queries(pattern, want):
    assert sorted(map(sorted, trigrams.query_of(pattern))) == (want or [])


def test_whatever_matches_meets_its_query(spark):
    r = random.Random(6)
    texts = [made(r) for _ in range(300)]
    queries = {i: trigrams.query_of(x.pattern) for i, x in enumerate(secret_scan.RULES)}
    wanted = {t for q in queries.values() for c in q for t in c}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    index = trigrams.postings(df, F.col("id"), F.col("text"), wanted)
    met = {x["key"]: x["rules"] for x in trigrams.candidates(index, {i: q for i, q in queries.items() if q}).collect()}
    for i, text in enumerate(texts):
        low = text.lower()
        for k, rule in enumerate(secret_scan.RULES):
            if queries[k]:
                holds = any(all(t in low for t in c) for c in queries[k])
                assert holds == bool(met.get(i, 0) >> k & 1)
                assert holds or not re.search(rule.pattern, text, re.ASCII)
    assert trigrams.postings(df, F.col("id"), F.col("text"), set()).count() == 0
