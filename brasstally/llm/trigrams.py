"""A trigram inverted index over texts: Boolean queries derived from regular expressions, and postings that answer them.

A query is a set of clauses, each a set of trigrams: a text that matches the expression holds all trigrams of one clause. Texts and trigrams are folded to lower case, which
only adds candidates. No clause at all stands for an expression without mandatory trigrams, whose candidates are all texts.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Query = frozenset[frozenset[str]]
#: Strings of one place of an expression, clauses of a query and characters of a class, beyond which less is demanded.
MOST_STRINGS, MOST_CHARACTERS = 64, 8
EVERY: Query = frozenset()


def _strings(kind: object, value: object) -> set[str] | None:
    """All strings that one element stands for, if they are few."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        found = {chr(v).lower() for _, v in value}
        return found if len(found) <= MOST_CHARACTERS else None
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        found = [_sequence(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if kind is op.MAX_REPEAT and (once := _sequence(value[2])) is not None and value[1] is not op.MAXREPEAT and len(once) ** int(value[1]) <= MOST_STRINGS:
        return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)}
    return None


def _sequence(parsed: object) -> set[str] | None:
    whole = {""}
    for kind, value in parsed:
        some = _strings(kind, value)
        if some is None or len(whole) * len(some) > MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in some}
    return whole


def _least(clauses: set[frozenset[str]]) -> Query:
    """Without clauses that demand more than another one; a clause that demands nothing makes all others idle."""
    return EVERY if frozenset() in clauses else frozenset(c for c in clauses if not any(other < c for other in clauses))


def _both(a: Query, b: Query) -> Query:
    if not a or not b:
        return a or b
    return _least({x | y for x in a for y in b}) if len(a) * len(b) <= MOST_STRINGS else min(a, b, key=len)


def _demanded(parsed: object) -> Query:
    found, run = EVERY, {""}

    def closed() -> Query:
        return _both(found, _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}))

    for kind, value in parsed:
        some = _strings(kind, value)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        found, run = closed(), some or {""}
        if some is None and kind is op.SUBPATTERN:
            found = _both(found, _demanded(value[3]))
        elif some is None and kind is op.MAX_REPEAT and value[0] > 0:
            found = _both(found, _demanded(value[2]))
        elif some is None and kind is op.BRANCH and all(branches := [_demanded(x) for x in value[1]]):
            found = _both(found, _least(set().union(*branches)))
    return closed()


def query_of(pattern: str) -> Query:
    """The clauses of trigrams that a regular expression demands, for the syntax that Python and Java share."""
    return _demanded(_parser.parse(pattern))


def _any_of(trigrams: list[str]) -> str:
    """An expression that matches wherever one of the trigrams starts, by common beginnings."""
    quoted = lambda s: "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in s)
    heads: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        heads.setdefault(t[0], []).append(quoted(t[1:]))
    return f"(?=({'|'.join(f'{quoted(h)}(?:{"|".join(rest)})' for h, rest in heads.items())}))"


def postings(texts: DataFrame, key: Column, text: Column, trigrams: set[str]) -> DataFrame:
    """Rows (trigram, key), one for each text and trigram it holds; only trigrams that queries ask for are indexed."""
    if not trigrams:
        return texts.sparkSession.createDataFrame([], f"trigram string, {texts.select(key.alias('key')).schema.simpleString()[7:-1]}")
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_any_of(sorted(trigrams))), F.lit(1)))
    return texts.select(key.alias("key"), F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """Rows (key, rules): texts that meet the queries' clauses, with a bit for each query that one of its clauses holds for.

    Postings are combined by text and clause as bits, in tasks first, so no posting list is ever in one place. The clauses are a table as small as the rules."""
    numbered = [(rule, i, j, t, 1 << len(clause) - 1) for rule, query in queries.items() for i, clause in enumerate(sorted(map(sorted, query))) for j, t in enumerate(clause)]
    rows = F.inline(F.array(*(F.struct(F.lit(1 << rule).cast("long").alias("rule"), F.lit(i).alias("clause"), F.lit(1 << j).cast("long").alias("bit"), F.lit(t).alias("trigram"), F.lit(2 * top - 1).cast("long").alias("all")) for rule, i, j, t, top in numbered)))
    clauses = F.broadcast(index.sparkSession.range(1).select(rows))
    met = index.join(clauses, "trigram").groupBy("key", "rule", "clause", "all").agg(F.bit_or("bit").alias("bits")).where("bits = all")
    return met.groupBy("key").agg(F.bit_or("rule").alias("rules"))
