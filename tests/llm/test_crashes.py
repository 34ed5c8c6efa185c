"""Texts and pages that once ended a whole job: very long white space, malformed declarations; and names that only begin like a menu's or advert's."""

import random

import pytest

from brasstally.llm import extraction, packing


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "end", "a" + " \t" * 600_000 + "b", "x\n" * 70_000, " " * 65_536])
def test_long_white_space_has_the_tokenizer_s_ids(text):
    from array import array

    encode = packing.Encoder()
    assert list(array("I", encode(text))) == encode.exact.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "some words"), (3, "\n" * 1_000_000)], "doc_id long, text string")
    got = packing.pack(df).collect()
    encode = packing.Encoder()
    for doc, text in ((1, " " * 1_000_000), (2, "some words"), (3, "\n" * 1_000_000)):
        assert sum(r["length"] for r in got if r["doc_id"] == doc) == len(encode(text)) // 4 + 1


LONG = "A long paragraph of plain words that goes on for quite a while so that its ratio of characters to tags is high. " * 3


@pytest.mark.parametrize(
    "declaration",
    ["<![foo bar]>", "<![if IE]>", "<![endif]>", "<!>", "<!foo", "<!DOCTYPE html [<!ENTITY a 'b'>]>", '<!DOCTYPE html [<!ENTITY a "]>">]>', "<!DOCTYPE>", "<![CDATA[x > y]]>", "<!ELEMENT br EMPTY>", "<![ [ [>", "<!doctype [", "<!-x->", "<?php x ?>", "<! [x]>"],
)
def test_declarations_are_skipped(declaration):
    page = f"<article><p>{LONG}</p>{declaration}<p>{LONG}</p></article>"
    text = extraction.main_text(page)
    one = " ".join(LONG.split())
    if ">" in declaration:
        assert text == f"{one} {one}"
    assert one in text and extraction.main_text(declaration) == ""


def test_no_markup_ends_the_job():
    r = random.Random(7)
    parts = ["<!", "<![", "]>", "]]>", "<!--", "-->", "<!DOCTYPE", "[", "]", ">", "<", "</", "<p>", "</p>", "<a href='", "'", '"', "&#", "&amp", ";", "<script>", "</script>", "<?", "CDATA[", "x y", "\x00", "<svg>", "<title", "=", "/", "é", "<textarea>", "</textarea", "<plaintext>"]
    for _ in range(3000):
        extraction.main_text("".join(r.choice(parts) for _ in range(r.randint(1, 25))))


@pytest.mark.parametrize("name", ["cookie-recipe", "ads-law-analysis", "newsletter-essay", "comment-on-policy", "sidebar-theory"])
def test_names_that_only_begin_like_others_stay(name):
    text = extraction.main_text(f"<article><h1>Title of it</h1><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></article>")
    assert text.count("A long paragraph") == 9


@pytest.mark.parametrize("name", ["cookie-message", "comment-author", "comment-list", "newsletter-signup", "sidebar-inner", "adslot-top", "comment-12", "comments"])
def test_details_of_others_go(name):
    text = extraction.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></article>")
    assert text.count("A long paragraph") == 6


def test_texts_without_white_space_have_k_mers(spark):
    from brasstally.llm import fingerprints

    r = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    plain = lambda n: "".join(r.choices(signs, k=n))
    spaced = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    for make, size in ((plain, 4000), (spaced, 300)):
        rows = [(i, make(size)) for i in range(12)]
        got = fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
        near = sorted(x["near_edited"] for x in got)
        assert 0.05 < near[len(near) // 2] < 0.4 and max(x["near_next"] for x in got) < 0.05
    words = spark.createDataFrame([("a  bb\t" + "c" * 32 + " " + "d" * 33 + "\n\U0001f600",), ("",), (" \n",), (None,)], "text string").select(fingerprints._words(fingerprints.F.col("text"))).collect()
    assert [x[0] for x in words] == [["a", "bb", "c" * 32, "d" * 16, "d" * 16, "d", "\U0001f600"], [""], [""], [""]]


def test_positions_over_files_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 4)
    r = random.Random(8)
    rows = [(f"part-{f:0{1 + f % 2}}", row, piece, r.randint(1, 9)) for f in range(7) for row in range(r.randint(1, 30)) for piece in range(r.randint(1, 3))]
    df = spark.createDataFrame(rows, "_file string, _row long, piece int, length long").withColumn("own", packing.F.struct("_file", "_row", "piece")).repartition(4)
    got = {tuple(x["own"]): x["_at"] for x in packing._along(df).collect()}
    at = 0
    for file, row, piece, length in sorted(rows, key=lambda x: (len(x[0]), x[0], x[1], x[2])):
        assert got[file, row, piece] == at
        at += length
