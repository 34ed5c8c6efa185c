"""Keys that hold many rows are cut into buckets, and results stay the same."""

import hashlib
import random

from pyspark.sql import functions as F

from brasstally.llm import chat, fingerprints, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_next_of_ids_that_repeat_or_lack(spark):
    r = random.Random(3)
    rows = [(i, f"t{r.random()}") for i in range(60)] + [(30, f"hot{i}") for i in range(200)] + [(None, f"lone{i}") for i in range(150)] + [(40, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]]))
    want = sorted((x[0] if x[0] is not None else -1, x[1], order[(i + 1) % len(order)][1]) for i, x in enumerate(order))
    for buckets in (1, 7, 32):
        led = fingerprints.with_next(df, ["text"], buckets)
        got = sorted((x.doc_id if x.doc_id is not None else -1, x.text, x.next_text) for x in led.collect())
        assert got == want
    # the windows' buckets of hot ids and of rows without one hold a share of them
    assert fingerprints.with_next(df.where("doc_id is null"), ["text"], 8).count() == 150


def test_likeness_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "dd", "e"]) for _ in range(r.randint(0, 40)))) for i in range(40)] + [(99, None)]
    got = {x.doc_id: x for x in fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6).collect()}
    cut = lambda f: [f[i : i + 6] for i in range(0, len(f), 6)]
    like = lambda a, b: sum(x == y for x, y in zip(cut(a), cut(b), strict=True)) / fingerprints.SKETCHES
    order = sorted(rows, reverse=True)
    for i, (doc, text) in enumerate(order):
        other, text = order[(i + 1) % len(order)], text or ""
        half = len(text) // 2
        made = text[: len(text) - half] + (other[1] or "")[:half]
        x = got[doc]
        assert x.edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
        assert x.near_edited == like(x.fingerprint, x.edited_fingerprint) and x.near_next == like(x.fingerprint, got[other[0]].fingerprint)
    texts = spark.createDataFrame([(doc, t[: len(t) - len(t) // 2] + (order[(i + 1) % len(order)][1] or "")[: len(t) // 2]) for i, (doc, t) in enumerate((d, t or "") for d, t in order)], "doc_id long, text string")
    assert {x.doc_id: x.fingerprint for x in fingerprints.fingerprint(texts).collect()} == {d: x.edited_fingerprint for d, x in got.items()}


def test_mix_without_ids_is_spread(spark, monkeypatch):
    rows = [(None, f"text {i}", "en", "a", 0) for i in range(300)] + [(i, None, "en", "b", 0) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    one = {(x.doc_id, x.text): (x.slot, x.position) for x in mixing.mix(df, {"a": 1, "b": 1}, 1, 100).collect()}
    assert len({v for k, v in one.items() if k[1]}) == 300
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    four = {(x.doc_id, x.text): (x.slot, x.position) for x in mixing.mix(df, {"a": 1, "b": 1}, 1, 100).collect()}
    assert one == four


def test_units_deviate_by_less_than_a_block_and_a_document(spark):
    r = random.Random(5)
    weights, block = {"a": 3, "b": 2}, 50
    rows = [(i, "x" * r.choice([3, 20, 240]), "en", r.choice("ab"), 0) for i in range(800)]
    got = sorted(mixing.mix(spark.createDataFrame(rows, DOCS), weights, 1, block).collect(), key=lambda x: (x.slot, x.position))
    last = {s: max(x.slot for x in got if x.mix_source == s) for s in weights}
    done = dict.fromkeys(weights, 0)
    for x in got:
        if x.slot > min(last.values()):
            break
        done[x.mix_source] += x.units
        for s, w in weights.items():
            # sources that were done so far against their share of the slots so far
            assert abs(done[s] - (x.slot + 1) * block * w / 5) < 2 * block + 241


def test_ranks_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    rows = [(i % 90, "word " * (i % 7)) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(got) == 400
    by: dict = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for x in by.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 16


def test_turns_that_tie(spark):
    turns = []
    for conv, n in ((1, 2), (2, 3), (3, 3)):
        turns += [(conv, 0, "user", t) for t in ("one", "two")] + [(conv, k, "assistant", f"a{k}") for k in range(1, n)]
    turns += [(4, 0, "user", "x")] * 2 + [(5, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert set(got) == {2, 4} and got[2].n_copies == 2 and got[2].n_turns == 4 and got[4].n_turns == 2
    ties = sorted(("one", "two"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got[2].text.index(ties[0]) < got[2].text.index(ties[1])


def test_null_and_empty_conversations_are_two(spark):
    turns = [(None, 0, "user", "z"), ("", 0, "user", "y")]
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string"))
    assert {(r.conv_id, r.n_turns) for r in got.collect()} == {(None, 1), ("", 1)}


def test_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    for df in (chat.format_chats(turns), mixing.placements(spark.createDataFrame([(1, "t", "en", "s", 0)], DOCS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("BatchEval", "ArrowEval", "MapIn", "InPandas", "Cartesian"))
