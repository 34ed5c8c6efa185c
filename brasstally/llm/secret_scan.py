"""Secret scans: rules as regular expressions, answered through a trigram inverted index and verified on the candidates' whole texts.

Each rule finds leftmost matches that don't overlap; those whose counted part is too short are dropped. Rules without mandatory trigrams look through all texts. Spans are
in code points. The texts between matches and the matches themselves have the lengths of which starts are sums; sums are taken in two levels, so that a text with very many matches stays cheap.

A null text counts as empty. Every row stays, repeated ones and those without a doc_id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.llm import trigrams
from brasstally.llm.common import cut

#: Candidates that are sent to every task (a key and a number each); with more, texts meet them in a shuffle.
MOST_BROADCAST = 1_000_000
#: Matches of a block of sums.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` (0: the match) make a match count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Rules of the base, in the order of their names in results. Runs of 24 hexadecimal digits are the runs of any length that are long enough.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Public formats of tokens and keys, which the method adds.
ADDED = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
_SPANS = "array<struct<start:int,rule:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def sums_before(lengths: Column) -> Column:
    """The sum of all earlier elements, for each element: totals of blocks, their own sums, and sums within a block."""

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(x, b * BLOCK + 1, BLOCK)))
        starts = _let(blocks, lambda t: F.transform(t, lambda _, b: _total(F.slice(t, 1, b))))
        return _let(starts, lambda s: F.transform(x, lambda _, i: F.get(s, F.floor(i / BLOCK).cast("int")) + _total(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return _let(lengths, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """A rule's spans in one text, as (start, rule, end)."""
    pattern = F.lit(rule.pattern)
    lengths = lambda xs: F.transform(xs, F.length)
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    # a match starts after all texts up to it and all earlier matches
    apart = F.split(text, rule.pattern, -1)
    steps = lambda own: F.zip_with(F.slice(lengths(apart), 1, F.size(own)), own, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    made = lambda s: F.zip_with(sums_before(F.transform(s, lambda x: x["gap"] + x["m"])), s, lambda before, x: F.struct((before + x["gap"]).alias("start"), F.lit(number).alias("rule"), (before + x["gap"] + x["m"]).alias("end")))
    whole = _let(_let(lengths(matched), steps), made)
    return (_let(counted, lambda c: F.filter(whole, lambda _, i: F.get(c, i) >= rule.least)) if rule.least else whole).cast(_SPANS)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every document: an array of (start, rule, end), sorted, with the rules' numbers.

    Rows that agree in doc_id and text share a key of the index; keys that collide only add candidates."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.xxhash64("doc_id", "text")
    queries = {i: q for i, r in enumerate(rules) if (q := trigrams.query_of(r.pattern))}
    if queries:
        wanted = {t for q in queries.values() for clause in q for t in clause}
        found = cut(trigrams.candidates(trigrams.postings(plain, key, F.col("text"), wanted), queries))
        few = found.count() <= MOST_BROADCAST
        plain = plain.withColumn("key", key).join(F.broadcast(found) if few else found, "key", "left")
    else:
        plain = plain.withColumn("rules", F.lit(0).cast("long"))
    empty = F.array().cast(_SPANS)
    own = [spans(F.col("text"), r, i) if i not in queries else F.when(F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, spans(F.col("text"), r, i)).otherwise(empty) for i, r in enumerate(rules)]
    every = [F.when(F.col("text").rlike(r.pattern), s).otherwise(empty) if i not in queries else s for i, (r, s) in enumerate(zip(rules, own, strict=True))]
    return plain.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, counts of the base's spans by kind, sha256 of the base's spans and all spans as text (kind:start:end)."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("spans", lambda x: x["rule"] == i)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda x: x["rule"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """Every rule looks through every text; starts are plain sums."""
    either = lambda words: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)
    fixed = {"assign": f"""({either("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""}
    plain = "coalesce(text, '')"
    found = ", ".join(
        f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
          'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0),
          'rule': {k}, 'm': length(regexp_extract_all(t, '{p}')[i]), 'counted': length(regexp_extract_all(t, '{p}', {r.group})[i])}}), lambda s: s.counted >= {r.least})"""
        for k, r in enumerate(RULES)
        for p in (fixed.get(r.kind, r.pattern),)
    )
    text = lambda where: f"coalesce(array_to_string(list_transform(list_sort(list_filter(s, lambda x: {where})), lambda x: [{', '.join(f"'{r.kind}'" for r in RULES)}][x.rule + 1] || ':' || x.start::BIGINT || ':' || (x.start + x.m)::BIGINT), ','), '')"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.rule = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"WITH d AS (SELECT doc_id, {plain} AS t FROM documents), f AS (SELECT doc_id, flatten([{found}]) AS s FROM d) SELECT doc_id, {counts}, sha256({text(f'x.rule < {len(BASE)}')}) AS base_sha256, {text('true')} AS spans FROM f"


ORACLE = _oracle()
