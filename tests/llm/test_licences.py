"""Whole licence texts as they occur: wrapped anew, with statements of copyright in usual forms, in other spellings."""

import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from brasstally.llm import licences

PLACE = "/usr/share/common-licenses"
KNOWN = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
STATEMENTS = [
    "Copyright (c) 2020 Someone", "Copyright © 2019-2021, Someone <a@b.c>", "Copyright Foo Inc. 2020", "© Foo", "Portions Copyright (c) Foo", "(C) 2020 Foo",
    "Copyright The X Authors. All rights reserved.", " * Copyright Jane Doe", "COPYRIGHT 1999 FOO", "copyright foo inc, 2020", "All rights reserved.", "Copyright: 2003 Foo", "Copyright by The Foo",
]
PROSE = ["C 5 is a vitamin", "Copyright law protects texts.", "copyright holders may not", "(c) You must keep it", "The copyright of 2020 lapsed", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "Copyright Notice"]


def scanned(spark, texts):
    return [(r.licence, r.notices) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_statements_go_and_prose_stays(spark):
    one = lambda t: licences.canonical_text(F.lit(t), licences.canonical_lines(F.lit(t)))
    got = spark.range(1).select(*(one(f"words before\n{x}\nand after").alias(f"s{i}") for i, x in enumerate([*STATEMENTS, *PROSE]))).first()
    assert list(got[: len(STATEMENTS)]) == ["words before and after"] * len(STATEMENTS)
    assert all(x != "words before and after" for x in got[len(STATEMENTS) :])


def test_short_licences_with_all_statements(spark):
    texts = [f"MIT License\n\n{x}\n\n{textwrap.fill(licences._MIT, 60 + i)}" for i, x in enumerate(STATEMENTS)]
    bsd = next(t for n, t in licences.LICENCES if n == "BSD-3-Clause")
    texts += [f"{x}\n\n{textwrap.fill(bsd.replace('1. ', '* ').replace('2. ', '* ').replace('3. ', '* '), 80)}" for x in STATEMENTS[:3]]
    got = scanned(spark, texts)
    assert [g[0] for g in got] == ["MIT"] * len(STATEMENTS) + [None] * 3  # bullets instead of numbers are other words
    assert scanned(spark, [f"{x}\n{textwrap.fill(bsd, 80)}" for x in STATEMENTS])[0][0] == "BSD-3-Clause"


def test_neighbouring_spellings(spark):
    text = licences._MIT.replace("license", "licence").replace("sublicense", "sub-licence")
    assert scanned(spark, [text, "Licence licence LICENCE", "license license license"])[0][0] == "MIT"
    a, b = (r.digest for r in licences.scan(spark.createDataFrame([(1, "Licence licence LICENCE"), (2, "license license license")], "doc_id long, text string")).orderBy("doc_id").collect())
    assert a == b


@pytest.mark.skipif(not os.path.isdir(PLACE), reason="no licence texts here")
def test_long_licences(spark):
    names = [n for n in KNOWN if os.path.isfile(f"{PLACE}/{n}")]
    with_end = []
    for n in names:
        with open(f"{PLACE}/{n}") as f:
            with_end.append(f.read())
    loud = [re.sub(r"\bLicense\b", "Licence", re.sub(r"[ ]+", "  ", t)) for t in with_end]
    prefixed = ["Copyright 2020 The Foo Project\n\n" + t for t in with_end]
    for texts in (with_end, loud, prefixed):
        assert [g[0] for g in scanned(spark, texts)] == [KNOWN[n] for n in names]
    assert all(g[0] is None for g in scanned(spark, [t + "\none more condition" for t in with_end]))


def test_rows_are_judged_by_themselves(spark):
    rows = [(1, "Released under the MIT License."), (1, "nothing"), (None, "All rights reserved."), (2, "\n\n"), (2, None)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.notices) for r in got.collect()) == [(0, "Proprietary"), (1, ""), (1, "MIT"), (2, ""), (2, "")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("BatchEval", "ArrowEval", "MapIn", "InPandas", "Cartesian", "NestedLoop", "hashpartitioning(doc_id"))


def test_sql_has_the_same_tables(spark):
    assert {(r.licence, r.digest) for r in licences.known(spark).collect()} == set(licences._SQL_LICENCES)
    assert set(licences._canonical(spark, licences.NOTICES)) == set(licences._SQL_NOTICES)
