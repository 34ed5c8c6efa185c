"""Source divergence audit: how far the term shares of each source lie from those of other sources and of its language.

A group is a (lang, source). A term's share in a group is smoothed: ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, in whole numbers.
The leading terms of a group come from a dominance skyband: a term that at least ``k`` others dominate (count in the group as high, count in the
language as low, text earlier in UTF-8) can't be among the first ``k``, since all of those rank before it. Chunks of rows retain their skybands, which are
merged in two steps (64 slots by the term's hash, then the group), and only what is left is ranked exactly. Distances between sources are sums over blocks of terms.

Null text, lang and source count as ''. An empty table gives no rows; a language without kept terms gives pairs of value 0; groups that share all counts have value 0
and rank by name. Repeated rows are documents of their own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasstally.llm.common import cut

TERM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
SCALE, SMOOTH = 1_000_000_000, 5
#: Documents of its language that a kept term occurs in, at least; ranks of the leading terms.
MIN_DOCS, LEADING = 30, 50
#: Terms that a counting task holds; rows of a chunk whose skybands are taken; rows of a block of terms, about; cells of a dense matrix.
HELD_TERMS, CHUNK_ROWS, BLOCK_ROWS, CELLS = 500_000, 262_144, 131_072, 2_000_000
SLOTS = 64


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.encode().lower().decode())  # bytes.lower() only knows A-Z


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, combined within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), CHUNK_ROWS):
                some = terms[i : i + CHUNK_ROWS]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms_of(text), len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, term, source, n, total, lead) of terms in at least ``min_docs`` documents of their language; total is the term's
    count in the language, lead marks one row of each term.

    Tasks combine what they count, so a popular term has one row for each task and source; one shuffle by language and term serves all that follows."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    term = Window.partitionBy("lang", "term")
    summed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = summed.select("lang", "term", "source", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("lead"))
    return kept.where(F.col("_docs") >= min_docs).drop("_docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each group that occurs: lang, source, n (its kept occurrences), lang_n and vocabulary (those of its language)."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("lead").cast("long")).alias("vocabulary"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = _groups(docs).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return found.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "vocabulary")))


def _share(count: Column, n: Column, vocabulary: Column) -> Column:
    """A smoothed share; decimals of 38 digits keep it exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, below = wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(n + vocabulary * SMOOTH)
    return F.lit(1) + F.call_function("div", top, below)


def exact_shares(counts: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The same shares of many counts; whole numbers of Python take over where 64 bits don't hold."""
    below = n + SMOOTH * vocabulary
    if len(counts) and int(counts.max()) >= 9_000_000_000:
        return np.array([1 + SCALE * (int(c) + SMOOTH) // below for c in counts], np.int64)
    return 1 + (counts.astype(np.int64) + SMOOTH) * SCALE // below


def skyband(n: np.ndarray, total: np.ndarray, terms: list[str], k: int) -> np.ndarray:
    """Positions of the terms that fewer than ``k`` others dominate: n as high, total as low, earlier in UTF-8 (each text occurs once).

    Sorted by n, total and text, dominators come first. It's enough to look for them among the retained ones: a term with ``k`` dominators has ``k`` retained ones.
    """
    rank = np.empty(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))  # code points sort as UTF-8 does
    order = np.lexsort((rank, total, -n))
    kept_t, kept_r, kept = np.empty(0, np.int64), np.empty(0, np.int64), []
    for i in range(0, len(order), 512):
        block = order[i : i + 512]
        t, r = total[block], rank[block]
        above = ((kept_t[None, :] <= t[:, None]) & (kept_r[None, :] < r[:, None])).sum(1)
        among = np.tril((t[None, :] <= t[:, None]) & (r[None, :] < r[:, None]), -1)
        stay = np.zeros(len(block), bool)
        for j in np.flatnonzero(above < k):
            stay[j] = above[j] + np.count_nonzero(among[j] & stay) < k
        kept_t, kept_r = np.concatenate([kept_t, t[stay]]), np.concatenate([kept_r, r[stay]])
        kept.append(block[stay])
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _retained(k: int):
    """Chunks of rows (lang, source, term, n, total) keep their groups' skybands."""

    def of(chunk: pa.Table) -> pa.Table:
        lang, source = (chunk.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
        n, total, terms = chunk.column("n").to_numpy(), chunk.column("total").to_numpy(), chunk.column("term").to_pylist()
        order = np.argsort(group, kind="stable")
        keep = [part[skyband(n[part], total[part], [terms[i] for i in part], k)] for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)]
        return chunk.take(pa.array(np.concatenate(keep)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK_ROWS:
                yield from of(pa.Table.from_batches(held)).to_batches()
                held = []
        if sum(map(len, held)):
            yield from of(pa.Table.from_batches(held)).to_batches()

    return run


def leading_terms(kept: DataFrame, totals: DataFrame, k: int = LEADING) -> DataFrame:
    """The first ``k`` terms of each group by how far their share exceeds the language's: lang, source, item, value, rank."""
    rows = kept.select("lang", "source", "term", "n", "total")
    for keys in ((), ("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SLOTS))), ("lang", "source")):
        rows = (rows.repartition(*keys) if keys else rows).mapInArrow(_retained(k), rows.schema)
    of_group, of_lang = _share(F.col("n"), F.col("group_n"), F.col("vocabulary")), _share(F.col("total"), F.col("lang_n"), F.col("vocabulary"))
    valued = rows.join(totals.withColumnRenamed("n", "group_n"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (of_group - of_lang).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.where(F.col("value") > 0).withColumn("rank", rank).where(F.col("rank") <= k)


def _block_distances(_: tuple, block: pa.Table) -> pa.Table:
    """Sums of |p - q| over a block's terms for each two sources of a language. Rows without a term carry a source's total and the vocabulary."""
    block = block.combine_chunks()
    known = np.array(block.column("term").is_null())
    sources, n, total = block.column("source").to_numpy(), block.column("n").to_numpy(), block.column("total").to_numpy()
    names = sorted(sources[known])
    at = {s: i for i, s in enumerate(names)}
    sizes = {s: (int(a), int(b)) for s, a, b in zip(sources[known], n[known], total[known], strict=True)}
    terms = block.column("term").filter(pa.array(~known)).combine_chunks().dictionary_encode()
    row, column, counts = terms.indices.to_numpy(), np.array([at[s] for s in sources[~known]], np.int64), n[~known]
    sums = np.zeros((len(names), len(names)), np.int64)
    order, step = np.argsort(row, kind="stable"), max(1, CELLS // max(1, len(names)))
    row, column, counts = row[order], column[order], counts[order]
    for first in range(0, len(terms.dictionary), step):
        low, high = np.searchsorted(row, [first, first + step])
        shares = np.zeros((len(names), min(step, len(terms.dictionary) - first)), np.int64)
        shares[column[low:high], row[low:high] - first] = counts[low:high]
        for i, s in enumerate(names):
            shares[i] = exact_shares(shares[i], *sizes[s])
        for i in range(len(names) - 1):
            sums[i, i + 1 :] += np.abs(shares[i + 1 :] - shares[i]).sum(1)
    i, j = np.triu_indices(len(names), 1)
    lang = block.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([names[x] for x in i], pa.string()), "b": pa.array([names[x] for x in j], pa.string()), "value": pa.array(sums[i, j], pa.int64())})


def source_distances(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """For each group the other sources of its language by the summed distance of all shares: lang, source, item, value, rank.

    Terms are dealt into blocks by their hash, as many as the rows ask for; the sources' totals go to each block."""
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    rows = kept.select("lang", "source", "term", "n", "total", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    marks = totals.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", F.col("vocabulary").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    summed = rows.union(marks).groupBy("lang", "block").applyInArrow(_block_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value").withColumn("rank", rank)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = LEADING) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for distances to other sources, ``term`` for leading terms."""
    kept = cut(kept_terms(docs, min_docs))
    totals = cut(group_totals(docs, kept))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return source_distances(kept, totals).withColumn("part", F.lit("pair")).select(*columns).union(leading_terms(kept, totals, k).withColumn("part", F.lit("term")).select(*columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(total)::HUGEINT AS lang_n, count(*)::HUGEINT AS vocabulary FROM v GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS group_n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.group_n + 5 * l.vocabulary) AS p,
        1 + (1000000000::HUGEINT * (v.total + 5)) // (l.lang_n + 5 * l.vocabulary) AS q
      FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INTEGER AS rank FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, rank FROM term WHERE rank <= 50
"""
