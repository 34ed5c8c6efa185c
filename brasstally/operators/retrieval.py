"""Chunks, exact vector search and contexts for document retrieval."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.errors import InputError
from brasstally.functions import fixed, text

CHUNK, OVERLAP, TOP_K, SHORTEST = 1000, 200, 10, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: Sequence[float], k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query by cosine, their scores rounded after they are ranked; vectors without a length take no part.

    Each partition keeps k rows, so only these meet.
    """
    asked = F.lit([float(x) for x in query])
    near = vectors.where(F.col(vector).isNotNull() & (dot(vector, vector) > 0)).select(key, (dot(vector, asked) / (F.sqrt(dot(vector, vector)) * F.sqrt(dot(asked, asked)))).alias("score"))
    return near.orderBy(F.desc("score"), F.asc(key)).limit(k).withColumn("score", F.round("score", 6))


def chunk_by_stride(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """Chunks of ``size`` characters every ``size - overlap``; an empty or null text has none."""
    if not 0 <= overlap < size:
        raise InputError(f"the overlap {overlap} must be smaller than the size {size}")
    stride = size - overlap
    n = F.length("text")
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last))
    return docs.select(key, "text", F.explode(starts).alias("chunk_id")).select(key, "chunk_id", F.substring("text", F.col("chunk_id") * stride + 1, F.lit(size)).alias("chunk"))


def _at_separator(value: str, separator: str) -> list[str]:
    """Parts that begin with the separator, but for the first; none is empty."""
    first, *rest = value.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts together as far as they fit; a chunk begins with as many of the last one's parts as ``overlap`` allows."""
    held: deque[str] = deque()
    room = 0
    for part in parts:
        if held and room + len(part) > size:
            yield "".join(held)
            while room > overlap or (held and room + len(part) > size):
                room -= len(held.popleft())
        held.append(part)
        room += len(part)
    yield "".join(held)


def split_recursively(value: str | None, size: int = CHUNK, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters without white space at their ends, cut at the coarsest separator that occurs.

    Parts shorter than ``size`` are packed together; a longer one is cut at the finer separators by itself. What holds no
    separator is cut into stretches that overlap by ``overlap``.
    """

    def cut(text: str, finer: Sequence[str]) -> Iterator[str]:
        at = next((i for i, s in enumerate(finer) if s in text), None)
        if at is None:
            yield text
        elif not finer[at]:
            last = max(0, -(-(len(text) - size) // (size - overlap)))
            yield from (text[i * (size - overlap) :][:size] for i in range(last + 1))
        else:
            short: list[str] = []
            for part in _at_separator(text, finer[at]):
                if len(part) < size:
                    short.append(part)
                    continue
                yield from _packed(short, size, overlap)
                short = []
                yield from cut(part, finer[at + 1 :])
            yield from _packed(short, size, overlap)

    return [c for c in map(str.strip, cut(value or "", separators)) if c]


def chunk_recursively(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """Like ``chunk_by_stride`` but cut at separators: recursion is beyond column expressions, so this runs on Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_recursively(t, size, overlap))

    return docs.select(key, F.posexplode(split("text")).alias("chunk_id", "chunk"))


def combined_question(turns: DataFrame) -> DataFrame:
    """conv_id and question: the last user turn after all user turns before it, joined by line feeds."""
    mine = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    users = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.transform(mine, lambda x: x["text"]).alias("t"))
    earlier = F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), "\n")
    return users.select("conv_id", F.concat(earlier, F.lit("\n"), F.element_at("t", -1)).alias("question"))


def usable(c: Column) -> Column:
    """Texts with more than SHORTEST characters after stripping."""
    return F.length(text.strip(c)) > SHORTEST


def assemble_context(chunks: DataFrame, group: str, order: str, value: str = "text") -> DataFrame:
    """The group's usable texts in order, joined by an empty line; a fixed sentence for a group without any."""
    part = F.when(usable(F.col(value)), F.struct(F.col(order).alias("o"), F.col(value).alias("t")))
    parts = F.array_sort(F.collect_list(part))
    return chunks.groupBy(group).agg(F.when(F.count(part) > 0, F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n")).otherwise(fixed.NO_CONTEXT).alias("context"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """documents, characters of all joined by empty lines, and words."""
    return docs.agg(F.count("text").alias("documents"), (F.sum(F.length("text")) + 2 * (F.count("text") - 1)).alias("characters"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0))).alias("words"))


def token_count(docs: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """documents and tokens of all texts by the tokenizer file at ``tokenizer``, which every executor can read; ``ranks`` may hold its vocabulary for a faster encoder of the same ids.

    Texts are encoded one by one: what a batch's encodings hold (offsets and the string of each token) is many times its texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks is None:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(tokenizer)
            length = lambda value: len(encoder.encode(value, add_special_tokens=False))
        else:
            from brasstally.llm.packing import Encoder

            ids = Encoder(tokenizer, ranks)
            length = lambda value: len(ids(value)) // 4
        documents = tokens = 0
        for batch in batches:
            for value in batch["text"]:
                if value.is_valid:
                    documents += 1
                    tokens += length(value.as_py())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "tokens": [tokens]})

    return docs.select("text").mapInArrow(count, "documents long, tokens long").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def kind_histogram(docs: DataFrame, kind: str = "doc_type") -> DataFrame:
    return docs.groupBy(kind).agg(F.count("*").alias("n"))


def store_profile(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """count and dimension of a store of vectors."""
    return vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dimension"))


