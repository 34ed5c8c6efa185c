"""Best-fit packing planned on a histogram of lengths.

Documents are tokenized and cut into pieces once. Only the number of pieces of each length
(at most ``capacity`` numbers) reaches the driver, where best-fit decreasing runs over counts: a
step moves as many equal pieces as there are equally full sequences. Each step is a plan row
(length, first rank, number, first sequence, offset). Pieces get a rank within their length
from counts by bucket, and take their slots by joining the plan on length and rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from brasstally.llm.common import cut, widened

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The vocabulary of TOKENIZER as ranks, for a faster library that gives the same ids.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 0
#: Characters of white space in a run from which a text goes to the tokenizer itself.
LONG_SPACE = 65_536
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
#: Pieces of one length are ranked in buckets of about so many, and in BUCKETS at least where an order is given.
BUCKET_ROWS, BUCKETS = 16_384, 64
#: Documents in a given order are packed in so many consecutive parts at most, each of PART_SEQUENCES full sequences at least.
PARTS, PART_SEQUENCES = 16, 256


class Encoder:
    """Ids of texts by the byte-level BPE in ``tokenizer``, as little-endian bytes.

    ``ranks`` holds the same vocabulary for a library that is four times as fast and gives the same ids; a text
    with the string of a special token goes to the tokenizer itself, and so does one with a very long run of white space, for which the faster library runs out of stack.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) > LONG_SPACE and _LONG_SPACE.search(text):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its document's ``carried`` columns; a null text has the ids of an empty one."""
    kept = docs.select(F.col("doc_id").cast("long"), "text", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(), array("I", [END]).tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            own = [batch[c].take(pa.array(row, pa.int64())) for c in ("doc_id", *carried)]
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([own[0], *made, *own[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32", *carried])

    first = kept.select("doc_id", *carried)
    schema = widened(first.select("doc_id"), piece="int", start="long", length="long", ids_crc32="long")
    return kept.mapInArrow(run, StructType([*schema.fields, *first.schema.fields[1:]]))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, number, first sequence, offset).

    Sequences with equal room are kept as ranges of numbers, so a row's pieces go to
    consecutive sequences at one offset.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, number)
    free: list[int] = []  # the keys of room in order
    opened = 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                # no sequence has room: open as many as these pieces fill, each with one piece for now
                number = -(-left // (capacity // length))
                space, first = capacity, opened
                opened += number
            else:
                space = free[at]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], free[at]
            used = min(number, left)
            rows.append((length, rank, used, first, capacity - space))
            put(space - length, first, used)
            put(space, first + used, number - used)
            rank, left = rank + used, left - used
    return rows


def _ranked(split: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``split`` with rank (from 0) by (_bucket, order) among the rows of the same ``within``; no window holds more than a bucket of them."""
    counts = split.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row for each bucket
    base = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*within, "_bucket").orderBy(*order)
    return (
        split.withColumn("_own", F.row_number().over(own) - 1)
        .join(base, [*within, "_bucket"])
        .withColumn("rank", F.col("_base") + F.col("_own"))
        .drop("_own", "_base")
    )


def ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``found`` with rank (from 0) among the pieces of its length; buckets follow the length's count, so no window holds a whole frequent length."""
    buckets = F.lit([max(1, -(-histogram.get(n, 0) // BUCKET_ROWS)) for n in range(max(histogram, default=0) + 1)])
    split = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))))
    return _ranked(split, ["length"], ["doc_id", "piece", "ids_crc32"]).drop("_bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Repeated documents are packed as often as they occur; an empty table gives an empty result. Columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, capacity))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(histogram, capacity)
    slots = spark.createDataFrame(steps, "length long, first_rank long, number long, first_sequence long, offset long")
    # a plan's size depends on capacity, not on the number of documents
    return (
        ranked(found, histogram)
        .join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    )


def _along(found: DataFrame) -> DataFrame:
    """``found`` with _at, the tokens before a piece in the order of (_file, _row, piece).

    Sums are taken within blocks of BUCKET_ROWS rows, over the blocks of a file and over files, so no window holds a file; only the last one sees a row for each file.
    """
    found = found.withColumn("_block", F.floor(F.col("_row") / BUCKET_ROWS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("_file", "_block").agg(F.sum("length").alias("_sum"))
    # a longer name has the larger number
    files = before(Window.orderBy(F.length("_file"), "_file"))
    whole = sums.groupBy("_file").agg(F.sum("_sum").alias("_all")).select("_file", F.coalesce(F.sum("_all").over(files), F.lit(0)).alias("_base"))
    blocks = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before(Window.partitionBy("_file").orderBy("_block"))), F.lit(0))).join(whole, "_file")
    running = before(Window.partitionBy("_file", "_block").orderBy("_row", "piece"))
    placed = found.withColumn("_at", F.coalesce(F.sum("length").over(running), F.lit(0))).join(blocks.select("_file", "_block", "_before", "_base"), ["_file", "_block"])
    return placed.withColumn("_at", F.col("_at") + F.col("_before") + F.col("_base")).drop("_file", "_row", "_block", "_before", "_base")


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, parts: int = PARTS, part_sequences: int = PART_SEQUENCES) -> DataFrame:
    """As ``pack``, for documents read from files, whose order (by name of file and row) the sequences follow.

    The documents are cut, in their order, into parts of equally many tokens. Each part is packed by its own plan, with ranks by order within
    equal lengths; its sequences are numbered after those of the part before, by the order of their first pieces.
    """
    spark = docs.sparkSession
    # files of other folders don't mix: a table is one folder
    read = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    found = cut(pieces(read, capacity, ("_file", "_row")))
    total, rows = found.agg(F.sum("length"), F.count("*")).first()
    total = total or 0
    parts = max(1, min(parts, total // (capacity * part_sequences)))
    buckets = max(BUCKETS, rows // (parts * BUCKET_ROWS))
    # as decimals, since a product of tokens and buckets can exceed a long
    share = F.expr(f"cast(_at as decimal(20, 0)) * {parts * buckets} div {max(total, 1)}")
    placed = cut(_along(found).withColumn("_bucket", share % buckets).withColumn("_part", F.expr(f"_at * {parts} div {max(total, 1)}")))
    histograms: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("_part", "length").agg(F.count("*").alias("n")).collect():  # parts x capacity rows at most
        histograms.setdefault(r["_part"], {})[r["length"]] = r["n"]
    steps, base = [], 0
    for part, histogram in sorted(histograms.items()):
        own = plan(histogram, capacity)
        steps += [(part, base, length, rank, number, base + first, offset) for length, rank, number, first, offset in own]
        base += max(first + number for _, _, number, first, _ in own)
    slots = spark.createDataFrame(steps, "_part long, _base long, length long, first_rank long, number long, first_sequence long, offset long")
    seated = cut(
        _ranked(placed, ["_part", "length"], ["_at"])
        .join(F.broadcast(slots), ["_part", "length"])
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("_sequence"), "offset", "_part", "_base", "_bucket", "_at")
    )
    # each sequence has one piece at offset 0
    first = _ranked(seated.where("offset = 0").select("_sequence", "_part", F.col("_base").alias("_before"), "_bucket", "_at"), ["_part"], ["_at"])
    numbers = first.select("_sequence", (F.col("_before") + F.col("rank")).alias("sequence_id"))
    return seated.join(numbers, "_sequence").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
