"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more.

Candidates are texts whose SimHash fingerprints ``simhash.links`` connects, and texts that agree on a band of MinHash
values: ``BANDS`` bands of ``ROWS`` values find a pair at 0.8 with a probability of 0.9998, likelier ones more often.
What candidates connect becomes a group. Within it the sets themselves are compared, so every pair that counts as near
copies is exact. A group is searched from text to text by postings of shingles; texts that were reached leave
the postings, so a group of many alike takes few comparisons.

Equal sets are one node, so exact copies are never compared. A group whose sets hold more than ``GROUP_SHINGLES`` shingles is cut into
chunks, and each pair of chunks is searched in a task of its own; what these find is joined by components. So no task holds more than that, and no
pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstally.llm import simhash
from brasstally.llm.common import cut
from brasstally.llm.components import components

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 28, 6
#: Shingles that one task holds at most (but for two single sets): about 40 bytes each while they are searched.
GROUP_SHINGLES = 4_000_000
_CHUNK = 512
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_FACTORS, _MASKS = np.random.default_rng(42).integers(1 << 62, dtype=np.uint64, size=(2, BANDS * ROWS, 1)) * np.uint64(2) + np.uint64(1)


def _mixed(columns: Iterator[np.ndarray], start: np.ndarray) -> np.ndarray:
    for x in columns:
        start = (start ^ x) * _PRIME
        start ^= start >> _SHIFT
    return start


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of five words; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1 if k else 1
    return np.unique(_mixed((w[j : j + n] for j in range(k)), np.full(n, k, np.uint64)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers, each of ROWS MinHash values and the band's own number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[None, at : at + _CHUNK] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return _mixed(iter(least.reshape(BANDS, ROWS).T), np.arange(BANDS, dtype=np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, fp, band, size = [], [], [], []
        for text in batch["text"].to_pylist():
            hashes = shingles(text)
            key.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            fp.append(simhash.fingerprint_of(text))
            band.append(bands(hashes).view(np.int64))
            size.append(len(hashes))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        flat = np.concatenate([np.zeros(0, np.int64), *band])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], signed(key), signed(fp), lists, pa.array(size, pa.int64())], names=["doc_id", "tie", "key", "fp", "bands", "size"])


def reached(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the position of the first one that it is connected with by pairs of at least LEAST."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)[np.argsort(term, kind="stable")]
    end = np.cumsum(count)
    start, first = end - count, np.concatenate([[0], np.cumsum(sizes)])
    # sets in the postings, and how many of them were reached since they were made
    live, gone, root, (up, down) = m, 0, np.full(m, -1), LEAST
    for x in range(m):
        if root[x] >= 0:
            continue
        root[x] = x
        gone += 1
        waiting = [x]
        while waiting:
            y = waiting.pop()
            terms = term[first[y] : first[y + 1]]
            length = end[terms] - start[terms]
            total = int(length.sum())
            if not total:
                continue
            at = np.repeat(start[terms] - np.cumsum(length) + length, length) + np.arange(total)
            common = np.bincount(owner[at], minlength=m)
            new = np.nonzero((root < 0) & ((up + down) * common >= up * (sizes[y] + sizes)))[0]
            root[new] = x
            waiting.extend(new.tolist())
            gone += len(new)
            if 2 * gone >= live:
                left = root[owner] < 0
                before = np.concatenate([[0], np.cumsum(left)])
                owner, start, end, live, gone = owner[left], before[start], before[end], live - gone, 0
    return root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) of the members of a partition's groups (label and part), by which it is sorted."""

    def found() -> pa.RecordBatch:
        root = reached(sets)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[r] for r in root], pa.int64())], names=["key", "root"])

    group, keys, sets = None, [], []
    for batch in batches:
        for label, part, key, text in zip(*(batch[c].to_pylist() for c in ("label", "part", "key", "text")), strict=True):
            if keys and (label, part) != group:
                yield found()
                keys, sets = [], []
            group = (label, part)
            keys.append(key)
            sets.append(shingles(text))
    if keys:
        yield found()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), key (of the set of shingles), fp and bands of every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return cut(rows.mapInArrow(_sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, key long, fp long, bands array<long>, size long"))


def candidates(nodes: DataFrame) -> DataFrame:
    """node and label of the keys that a fingerprint, linked fingerprints or a band connect with others."""
    prints = cut(nodes.groupBy("fp").agg(F.min("key").alias("least")))
    same = nodes.join(prints, "fp").where("key <> least").select(F.col("key").alias("src"), F.col("least").alias("dst"))
    near = simhash.links(prints.select("fp"))
    a, b = (prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key")) for c in ("src", "dst"))
    near = near.join(a, "src").join(b, "dst").select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    alike = banded.join(shared.select("band", "least"), "band").where("key <> least").select(F.col("key").alias("src"), F.col("least").alias("dst"))
    return components(cut(same.unionByName(near).unionByName(alike).distinct()))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tie and component (equal for near copies and what they connect) of every document.

    A null text counts as an empty one; empty texts are copies of one another. Repeated rows each get a row. Columns other than doc_id and text
    are ignored; an empty table gives an empty result.
    """
    rows = sketched(docs)
    nodes = cut(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")).alias("row")))
    chosen = cut(candidates(nodes.select("key", "fp", "bands")).join(nodes.select(F.col("key").alias("node"), "row.doc_id", "row.tie", "size"), "node"))
    sizes = chosen.groupBy("label").agg(F.sum("size").alias("total"))
    # chunks of half of what a task holds, so that two fit
    chunks = sizes.withColumn("chunks", F.when(F.col("total") > GROUP_SHINGLES, F.ceil(2 * F.col("total") / GROUP_SHINGLES)).otherwise(1))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != own), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
    at = chosen.join(chunks.select("label", F.col("chunks").cast("long").alias("chunks")), "label").select(
        "label", F.col("node").alias("key"), F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.when(F.col("chunks") > 1, pairs).otherwise(F.array(F.lit(-1).cast("long"))).alias("parts")
    )
    named = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    # one row of each set; its text is read anew, so that no sets are kept for documents without candidates
    texts = named.join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("label", "parts", "key", "text").dropDuplicates(["key"])
    spread = texts.select("label", F.explode("parts").alias("part"), "key", "text")
    found = spread.repartition("label", "part").sortWithinPartitions("label", "part", "key").mapInArrow(_verify, "key long, root long")
    if (sizes.agg(F.max("total")).first()[0] or 0) > GROUP_SHINGLES:
        # a set in several parts has a root in each; those of one part are final
        found = components(cut(found.where("key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst")))).select(F.col("node").alias("key"), F.col("label").alias("root"))
    roots = cut(found)
    return rows.select("doc_id", "tie", "key").join(roots, "key", "left").select("doc_id", "tie", F.coalesce("root", "key").alias("component"))
