"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. Only distinct fingerprints are compared. Two of
them within radius 2 agree on at least two of four 16-bit parts, so each fingerprint goes to six
groups, one for each pair of parts. A group of more than ``LARGE`` fingerprints is split by pairs of
further parts of the 32 bits in which its members may differ: its subgroups agree on 48 bits, so none can
exceed 2**16 members, however many documents there are.

Within a group fingerprints are compared bit-sliced: for each bit position one plane holds that bit of all
members, 64 members to a word. Carry-save counters of two bit planes add up the differences of many pairs at once;
a third plane marks pairs beyond the radius and a block of rows is abandoned once all its pairs are marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.llm.common import cut, widened
from brasstally.llm.components import components

RADIUS = 2
#: A group with more distinct fingerprints is split by further bits.
LARGE = 2048
#: Rows compared at once with all members of a group.
TILE = 256
_PAIRS = tuple(combinations(range(4), 2))


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > 3:
        starts, ends = starts[:-2].tolist(), ends[2:].tolist()
    else:
        starts, ends = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((((2 * counts > len(h)).astype(np.uint64)) << np.arange(64, dtype=np.uint64)).sum())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long; a null text counts as an empty one."""
    keep = docs.drop("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint_of, batch["text"].to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, "fp"])

    return keep.mapInArrow(run, widened(keep, fp="long"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of member m is bit m % 64 of planes[b, m // 64]."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def close_pairs(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the pairs within ``radius`` (0 to 3), a tile of rows i at a time."""
    planes, full = planes_of(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    # planes in which members differ come first, so that distant pairs are abandoned early
    ones = np.array([(fps >> np.uint64(b) & np.uint64(1)).sum() for b in range(64)])
    order = np.argsort(-np.minimum(ones, len(fps) - ones), kind="stable")
    order = order[(ones[order] > 0) & (ones[order] < len(fps))]
    for at in range(0, len(fps), tile):
        first = at // 64
        rows = np.arange(at, min(at + tile, len(fps)))
        lanes = planes[:, first:]
        low = np.zeros((len(rows), lanes.shape[1]), np.uint64)
        high, over = low.copy(), low.copy()
        for step, b in enumerate(order):
            flip = np.where(fps[rows] >> np.uint64(b) & np.uint64(1), full, np.uint64(0))[:, None]
            diff = lanes[b][None, :] ^ flip
            carry = low & diff
            low ^= diff
            over |= high & carry
            high ^= carry
            if radius < 3 and step % 4 == 3:
                done = over | (high & low if radius == 2 else high if radius == 1 else high | low)
                alive = (done != full).any(axis=1)
                if not alive.all():
                    rows, low, high, over = rows[alive], low[alive], high[alive], over[alive]
                    if not len(rows):
                        break
        if not len(rows):
            continue
        beyond = over | (high & low if radius == 2 else high if radius == 1 else high | low if radius == 0 else np.uint64(0))
        near = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")
        i, j = np.nonzero(near)
        i, j = rows[i], j + first * 64
        keep = (j > i) & (j < len(fps))
        yield i[keep], j[keep]


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest linked one of the group) that connect what ``close_pairs`` connects."""
    root = np.arange(len(fps))
    for i, j in close_pairs(fps):
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    own = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[own], fps[root[own]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a partition that is sorted by group; small neighbouring groups share a block."""
    names = ["src", "dst"]

    def links(fps: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(np.unique(fps.view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    held: list[np.ndarray] = []
    size, last = 0, None
    for batch in batches:
        group = np.stack([batch["part"].to_numpy(zero_copy_only=False), batch["key"].to_numpy(zero_copy_only=False)])
        fps = batch["fp"].to_numpy(zero_copy_only=False)
        starts = [0, *(np.nonzero((group[:, 1:] != group[:, :-1]).any(axis=0))[0] + 1).tolist(), len(fps)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            now = (int(group[0, a]), int(group[1, a]))
            if now != last and size >= LARGE // 2:
                yield links(np.concatenate(held))
                held, size = [], 0
            last = now
            held.append(fps[a:b])
            size += b - a
    if held:
        yield links(np.concatenate(held))


def _part(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))


def _bands(fp: Column) -> Column:
    """(part, key) of the six pairs of 16-bit parts."""
    return F.array(*(F.struct(F.lit(n).alias("part"), (_part(fp, a) * 65536 + _part(fp, b)).alias("key")) for n, (a, b) in enumerate(_PAIRS)))


def _subbands(fp: Column, part: Column, key: Column) -> Column:
    """(part, key) within a large group: six pairs of quarters of its 32 free bits are added to its key."""
    free = F.lit(None).cast("long")
    for n, pair in enumerate(_PAIRS):
        c, d = (k for k in range(4) if k not in pair)
        free = F.when(part == n, _part(fp, c) * 65536 + _part(fp, d)).otherwise(free)
    quarter = [F.shiftrightunsigned(free, 8 * k).bitwiseAND(F.lit(0xFF)) for k in range(4)]
    return F.array(*(F.struct((part * 8 + 8 + n).alias("part"), (key * 65536 + quarter[a] * 256 + quarter[b]).alias("key")) for n, (a, b) in enumerate(_PAIRS)))


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """src, dst: links between distinct fingerprints (column fp) that connect all within RADIUS of one another."""
    banded = fps.select("fp", F.explode(_bands(F.col("fp"))).alias("g")).select("fp", "g.*")
    sizes = banded.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = banded.join(sizes, ["part", "key"])
    small = shared.where(F.col("n") <= large).select("part", "key", "fp")
    split = (
        shared.where(F.col("n") > large)
        .select("fp", F.explode(_subbands(F.col("fp"), F.col("part"), F.col("key"))).alias("g"))
        .select("g.part", "g.key", "fp")
    )
    return (
        small.unionByName(split)
        .repartition("part", "key")
        .sortWithinPartitions("part", "key")
        .mapInArrow(_compare, "src long, dst long")
        .distinct()
    )


def component_labels(prints: DataFrame) -> DataFrame:
    """fp and component_id of every fingerprint in ``prints`` (doc_id, fp) that occurs.

    component_id is the smallest doc_id of all documents whose fingerprints are linked, null where all of
    them are null.
    """
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(first.select("fp")))
    member = first.join(joined, first.fp == joined.node, "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    linked = member.groupBy("label").agg(F.min("first").alias("component_id"))
    return member.join(linked, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Empty and null texts have fingerprint zero and are linked like any other. Repeated rows each get a row. Columns other than
    doc_id and text are ignored; an empty table gives an empty result.
    """
    prints = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return prints.join(component_labels(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
