"""Phrase collocations: words that stand together more often than their parts would let expect, by language.

Tasks count phrases of one to three words in a HAT-trie: keys pack the words' ids, the first level takes ranges of first words, and each child is a hash container,
which bursts into a node of the next word when it grows. When a task holds too many entries, it spills its largest subtrees as sorted, packed runs, cut by
prefix partition (a hash of the first two words, third words dealt over ``SPREAD`` neighbours, so that no popular pair fills one). Spark brings the runs of a prefix
partition together, and a task merges them; there are as many partitions as the text asks for. All later steps work on the frequent phrases alone, which hold the parts of every candidate.

Null text counts as empty, null lang as ``und``. An empty table, or one without frequent phrases, gives no rows. Ties go by count, then by the phrase's UTF-8. Repeated rows count
each; other columns are ignored. Long texts are counted in slices that overlap by a phrase's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasstally.llm.common import cut

LONGEST, MIN_COUNT, SUBSUMED, RANKS = 3, 10, 50, 2_000
#: Entries of a task's tries, of a container before it bursts, words of a task's dictionaries, tokens of a slice, entries of a run's row.
HELD, BURST, WORDS, SLICE, RUN_ROWS = 800_000, 16_384, 400_000, 131_072, 65_536
#: Bytes of text for each prefix partition, the least number of them, and bits of first words that share a container.
PART_BYTES, LEAST_PARTS, SHARED_BITS = 8_000_000, 32, 6
SPREAD = 64
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n\n\n\n\n\n\n\n\n ")


class Node(dict):
    """Children by a part of the key: nodes, or plain dicts as hash containers of whole keys."""


def burst(container: dict, shift: int) -> Node:
    node = Node()
    for key, n in container.items():
        node.setdefault(key >> shift, {})[key] = n
    return node


def leaves(node: dict) -> Iterator[dict]:
    if type(node) is Node:
        for child in node.values():
            yield from leaves(child)
    else:
        yield node


class _Ids(dict):
    """Ids of words from 1; a line feed, which ends a piece, is 0."""

    def __init__(self) -> None:
        super().__init__({"\n": 0})
        self.words, self.hashes = ["\n"], [0]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(crc32(word.encode()))
        return n


class PhraseTrie:
    """Counts of one language's phrases within a task."""

    def __init__(self, longest: int) -> None:
        self.longest, self.bits = longest, 63 // longest
        self.shifts = [self.bits * (longest - 1) + SHARED_BITS, *(self.bits * k for k in range(longest - 1, 0, -1))]
        self.ids, self.root, self.size, self.total = _Ids(), Node(), 0, 0
        self.waiting: list[str] = []

    def add(self, text: str) -> Iterator[bool]:
        """Takes a text and counts what waits, when that is a slice; see ``counted``."""
        plain = text.encode().lower().translate(_BREAKS).replace(b"\n", b" \n ").decode()  # bytes.lower() only knows A-Z
        self.waiting += filter(None, plain.split(" "))
        self.waiting.append("\n")
        if len(self.waiting) >= SLICE:
            yield from self.counted()

    def counted(self) -> Iterator[bool]:
        """Counts all phrases that wait, slice by slice. After each the caller may spill; before one for which the ids may not last, it's told to (True)."""
        tokens, self.waiting = self.waiting, []
        for at in range(0, len(tokens), SLICE):
            if len(self.ids) + SLICE + self.longest >= 1 << self.bits:
                yield True
            ids = np.array([*map(self.ids.__getitem__, tokens[at : at + SLICE + self.longest - 1]), *[0] * self.longest], np.int64)
            here = min(SLICE, len(tokens) - at)
            key, whole, keys = np.zeros(here, np.int64), np.ones(here, bool), []
            for k in range(self.longest):
                word = ids[k : k + here]
                whole = whole & (word > 0)
                key = key | word << self.bits * (self.longest - 1 - k)
                keys.append(key[whole])
            self.total += len(keys[0])
            self._insert(self.root, 0, *np.unique(np.concatenate(keys), return_counts=True))
            yield False

    def _insert(self, node: Node, depth: int, keys: np.ndarray, counts: np.ndarray) -> None:
        child = keys >> self.shifts[depth]
        ends = [*(np.flatnonzero(np.diff(child)) + 1).tolist(), len(keys)]
        start = 0
        for end in ends if len(keys) else ():
            at = int(child[start])
            held = node.get(at)
            if type(held) is Node:
                self._insert(held, depth + 1, keys[start:end], counts[start:end])
            else:
                if held is None:
                    held = node[at] = {}
                before, more = len(held), dict(zip(keys[start:end].tolist(), counts[start:end].tolist(), strict=True))
                for key in held.keys() & more.keys():
                    more[key] += held[key]
                held.update(more)
                self.size += len(held) - before
                if len(held) > BURST and depth + 1 < len(self.shifts):
                    node[at] = burst(held, self.shifts[depth + 1])
            start = end

    def spill(self, parts: int, least: int = 0) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Sorted runs of the largest subtrees until at most ``least`` entries stay, by prefix partition."""
        if self.size <= least:
            return
        weight = {at: sum(map(len, leaves(child))) for at, child in self.root.items()}
        keys, counts = [], []
        for at in sorted(weight, key=weight.__getitem__, reverse=True):
            if self.size <= least:
                break
            for leaf in leaves(self.root.pop(at)):
                keys.extend(leaf.keys())
                counts.extend(leaf.values())
            self.size -= weight[at]
        yield from self._run(np.array(keys, np.int64), np.array(counts, np.int64), parts)

    def _run(self, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        ids = [(keys >> self.bits * k) & ((1 << self.bits) - 1) for k in range(self.longest - 1, -1, -1)]
        used = np.unique(np.concatenate(ids))
        words = pa.array([self.ids.words[x] if x else None for x in used.tolist()], pa.string())
        hashes = np.array([self.ids.hashes[x] for x in used.tolist()], np.uint64)
        place = np.zeros(len(self.ids.words), np.int64)
        place[used] = np.arange(len(used))
        ids = [place[x] for x in ids]
        rank = np.empty(len(used), np.int64)
        rank[pc.sort_indices(words, null_placement="at_start").to_numpy()] = np.arange(len(used))
        part = hashes[ids[0]] * np.uint64(0x9E3779B97F4A7C15)
        for k, word in enumerate(ids[1:]):
            part = part + (hashes[word] * np.uint64(0xC2B2AE3D27D4EB4F) if not k else hashes[word] % np.uint64(SPREAD) << np.uint64(32))
        part = ((part >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sort_key = sum(rank[x] << self.bits * (self.longest - 1 - k) for k, x in enumerate(ids))
        order = np.argsort(sort_key)
        order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(x[order])) for x in ids), " ", null_handling="skip")
        run, part = pa.RecordBatch.from_arrays([phrase, pa.array(counts[order])], schema=_RUN), part[order]
        start = 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
            for at in range(start, end, RUN_ROWS):
                yield int(part[start]), run.slice(at, min(RUN_ROWS, end - at))
            start = end


_RUN = pa.schema([("phrase", pa.string()), ("n", pa.int64())])
_PACKED = pa.schema([("phrases", pa.string()), ("n", pa.list_(pa.int64()))])


def packed(run: pa.RecordBatch) -> bytes:
    """A run as compressed lines (no word holds a line feed) and counts."""
    phrase, n = run.columns
    lines = pc.binary_join(pa.ListArray.from_arrays([0, len(phrase)], phrase), "\n")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([lines, pa.ListArray.from_arrays([0, len(n)], n)], schema=_PACKED))
    return sink.getvalue().to_pybytes()


def unpacked(run: pa.Buffer) -> pa.Table:
    found = pa.ipc.open_stream(run).read_all().combine_chunks()
    return pa.table({c: pc.list_flatten(x) for c, x in (("phrase", pc.split_pattern(found.column("phrases"), "\n")), ("n", found.column("n")))}, schema=_RUN)


def _runs(longest: int, parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, PhraseTrie] = {}

        def row(lang: str, part: int, found: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([packed(found)], pa.binary())], ["lang", "part", "run"])

        def spilled(least: int) -> Iterator[pa.RecordBatch]:
            for lang in sorted(tries, key=lambda x: tries[x].size, reverse=True):
                more = sum(t.size for t in tries.values()) - least
                if more > 0:
                    for part, found in tries[lang].spill(parts, max(0, tries[lang].size - more)):
                        yield row(lang, part, found)

        def renewed() -> Iterator[pa.RecordBatch]:
            """Everything is spilled, and dictionaries begin anew."""
            yield from spilled(0)
            for trie in tries.values():
                trie.ids = _Ids()

        def relieved(full: bool) -> Iterator[pa.RecordBatch]:
            if full or sum(len(t.ids) for t in tries.values()) > WORDS:
                yield from renewed()
            elif sum(t.size for t in tries.values()) > HELD:
                yield from spilled(HELD // 2)

        def finished() -> Iterator[pa.RecordBatch]:
            for trie in tries.values():
                for full in trie.counted():
                    yield from relieved(full)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if lang.as_py() not in tries:
                    tries[lang.as_py()] = PhraseTrie(longest)
                for full in tries[lang.as_py()].add(text.as_py()):
                    yield from relieved(full)
            if sum(len(t.waiting) for t in tries.values()) > 4 * SLICE:
                yield from finished()
        yield from finished()
        yield from spilled(0)
        for lang, trie in tries.items():
            yield row(lang, 0, pa.RecordBatch.from_arrays([pa.array([""]), pa.array([trie.total])], schema=_RUN))

    return run


def _merged(min_count: int):
    def run(runs: pa.Table) -> pa.Table:
        """All runs of one prefix partition, language by language."""
        found = []
        for lang in pc.unique(runs.column("lang")).to_pylist():
            own = runs.filter(pc.equal(runs.column("lang"), lang)).column("run")
            whole = pa.concat_tables([unpacked(x.as_buffer()) for x in own]).group_by("phrase").aggregate([("n", "sum")])
            often = whole.filter(pc.or_(pc.greater_equal(whole.column("n_sum"), min_count), pc.equal(whole.column("phrase"), "")))
            found.append(pa.table({"lang": pa.array([lang] * len(often), pa.string()), "phrase": often.column("phrase"), "f": often.column("n_sum")}))
        return pa.concat_tables(found)

    return run


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, phrase, f) of all phrases of up to ``longest`` words (2 to 4) that occur ``min_count`` times; the empty phrase has a language's number of words."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # as many prefix partitions as the text asks for, so that one of them fits into a task
    parts = LEAST_PARTS + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    runs = texts.mapInArrow(_runs(longest, parts), "lang string, part int, run binary")
    return runs.groupBy("part").applyInArrow(_merged(min_count), "lang string, phrase string, f long")


def _score(a: str, left: str, right: str):
    """floor(1,000,000 a a / (l r)); decimals hold what passes 64 bits."""
    wide = lambda c, digits=16: F.col(c).cast(f"decimal({digits},0)")
    return F.call_function("div", wide(a, 15) * wide(a, 15) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED, ranks: int = RANKS) -> DataFrame:
    """The first ``ranks`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase's lowest-scoring cut counts. Phrases inside a longer frequent one, which makes up ``subsumed`` per cent of their occurrences or more, are dropped."""
    found = cut(frequent_phrases(docs, longest, min_count))
    words = F.split("phrase", " ")
    phrases = found.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words")).alias("right"))
    of = lambda side, as_: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(as_))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", _score("a", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # contiguous parts of at least two words of each longer phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = phrases.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * subsumed))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", rank).where(F.col("rank") <= ranks)
    totals = found.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 4), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS words FROM t),
f AS (SELECT lang, array_to_string(words, ' ') AS phrase, words, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a FROM f WHERE len(words) > 1 AND f >= 10),
k AS (SELECT lang, phrase, words, a, unnest(range(1, len(words))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, 1000000 * k.a * k.a // (x.f * y.f) AS score FROM k
      JOIN f x ON x.lang = k.lang AND x.words = k.words[1:k.k] JOIN f y ON y.lang = k.lang AND y.words = k.words[k.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([words[1:2], words[2:3]]) AS words, a FROM c WHERE len(words) = 3),
m AS (SELECT lang, array_to_string(words, ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
