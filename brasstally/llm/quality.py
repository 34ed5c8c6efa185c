"""Quality: votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of words, of word shapes (``Aa``, ``A!``, ``a*``, ``|`` ...) and of marks for repeated words and lines. A word of
more than ``LONG`` characters counts as its consecutive pieces of ``PIECE`` characters, so a text without white space is read whole.
The most frequent terms have columns of their own; all others share hashed ones. Weighted by tf-idf, the labelled sample's matrix is factorised; its rows, projected on the leading
singular vectors, are broadcast. Every document is projected likewise and compared with all
labelled vectors by exact cosine products in blocks; the nearest ones vote with their
similarities, balanced between the labels, as weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstally.llm.common import key_crc32, labelled_sample, widened
from brasstally.operators.vectors import best

#: Labelled rows that the space is fitted on and whose vectors are broadcast, at most.
MAX_TRAINING_ROWS = 5_000
#: Terms with a column of their own, and columns that all other terms share by a hash.
MAX_TERMS = 1_792
SHARED = 256
DIMENSIONS = 48
NEIGHBOURS = 25
#: Longer words count as pieces of so many characters.
LONG, PIECE = 32, 16
#: Longer shapes tell which kinds of runs there are, not their order.
RUNS = 8
#: Documents compared at once with all labelled vectors.
BLOCK = 256
_CACHE = 200_000
#: Bits below one of rows, of the projection and of vectors: a sum of products of two of them needs twice as many and a few for its size, of the 53 that a double has.
ROW_BITS, VECTOR_BITS = 22, 24


def shape(word: str) -> str:
    """Runs of capitals as A, of other letters as a, of digits as 0 and of one symbol as that symbol; more than RUNS of them as the set of all."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= RUNS else "*" + "".join(sorted(set(out)))


def pieces(word: str) -> list[str]:
    """The word itself, or all pieces of a long one."""
    return [word] if len(word) <= LONG else [word[at : at + PIECE] for at in range(0, len(word), PIECE)]


def split(text: str) -> list[str]:
    """The text's words, long ones in pieces."""
    words = text.split()
    return words if max(map(len, words), default=0) <= LONG else [p for w in words for p in pieces(w)]


def terms(word: str) -> tuple[str, str]:
    """The two features of a word."""
    return f"w:{word.lower()}", f"s:{shape(word)}"


def marks(text: str, words: list[str]) -> list[str]:
    """Features of a whole text: tenths of its words that repeat the one before and of its lines that occurred before."""
    out = []
    again = sum(map(eq, words, words[1:]))
    if 10 * again >= len(words) > 0:
        out.append(f"r:{10 * again // len(words)}")
    lines = [x for x in text.split("\n") if x]
    twice = len(lines) - len(set(lines))
    if 10 * twice >= len(lines) > 0:
        out.append(f"l:{10 * twice // len(lines)}")
    return out


class _Ids(dict):
    """Columns of a word's two terms, as one number. Forgets all when it grows too large."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def column(self, term: str) -> int:
        """The term's own column, or a shared one."""
        found = self.vocabulary.get(term)
        return len(self.vocabulary) + crc32(term.encode("utf-8", "surrogatepass")) % SHARED if found is None else found

    def __missing__(self, word: str) -> int:
        a, b = map(self.column, terms(word))
        value = self[word] = a * (len(self.vocabulary) + SHARED) + b
        return value


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _grid(m: np.ndarray, bits: int) -> np.ndarray:
    """Rounded to multiples of 2^-bits. Sums of products of such numbers are whole multiples that fit into a double, so they are exact in any order, batch or block."""
    return np.round(np.ldexp(m, bits)) * 2.0**-bits


@dataclass(frozen=True)
class Space:
    """Vocabulary with idf, projection, and the labelled vectors (unit length) with their labels.

    Rows and projection lie on a grid of 2^-ROW_BITS and vectors on one of 2^-VECTOR_BITS, so products are exact: equal texts have equal scores, whatever they are computed with.
    """

    vocabulary: dict[str, int]
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS
    balanced: bool = False

    def counts(self, texts: list[str], ids: _Ids) -> np.ndarray:
        """How often the terms of each column occur."""
        n = len(self.vocabulary) + SHARED
        counts = np.zeros((len(texts), n))
        for i, text in enumerate(texts):
            words = split(text)
            if not words:
                continue
            if len(ids) > _CACHE:
                ids.clear()
            both = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            counts[i] = np.bincount(both // n, minlength=n) + np.bincount(both % n, minlength=n)
            for mark in marks(text, words):
                counts[i, ids.column(mark)] += len(words)
        return counts

    def weighted(self, texts: list[str], ids: _Ids) -> np.ndarray:
        """tf-idf rows of unit length, or zero for an empty text."""
        return _grid(_unit(np.log1p(self.counts(texts, ids)) * self.idf), ROW_BITS)

    def vectorise(self, texts: list[str], ids: _Ids | None = None) -> np.ndarray:
        return _grid(_unit(self.weighted(texts, _Ids(self.vocabulary) if ids is None else ids) @ self.projection), VECTOR_BITS)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Labels of the nearest vectors by exact cosines, weighted by similarity; the sample's mean label where none is similar. Of equal cosines the earlier labelled row counts.

        Where ``balanced``, a vote counts in inverse proportion to its label's share of the sample, so that a rare label isn't outvoted for its rarity.
        """
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(vectors), self.prior)
        cos, near = best(vectors @ self.vectors.T, np.arange(len(self.labels)), k)
        weight = np.maximum(cos, 0) ** 4
        if self.balanced and 0 < self.prior < 1:
            weight *= np.where(self.labels[near] > 0.5, 0.5 / self.prior, 0.5 / (1 - self.prior))
        small = 1e-3
        return np.clip(((weight * self.labels[near]).sum(1) + small * self.prior) / (weight.sum(1) + small), 0, 1)

    def score(self, texts: list[str], ids: _Ids | None = None) -> np.ndarray:
        return self.vote(self.vectorise(texts, ids)) if texts and len(self.labels) else np.full(len(texts), self.prior)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["text"].to_pylist():
            words = split(text)
            seen.update({t for w in set(words) for t in terms(w)} | set(marks(text, words)))
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=schema)


def fit(sample: DataFrame, max_terms: int = MAX_TERMS, dimensions: int = DIMENSIONS) -> Space:
    """The space of (text, label) rows, which ``labelled_sample`` bounds.

    The ``max_terms`` terms of most documents (ties: in the order of their names) have columns of their own, all marks that
    occur among them; the others share SHARED columns, so none is left out. With no rows the space is empty and every score is 0.5.
    """
    top = sample.mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy(~F.col("term").rlike("^[rl]:"), F.desc("n"), "term").limit(max_terms).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(top)}
    none = np.zeros((0, 0), np.float32)
    raw = Space(vocabulary, np.ones(len(vocabulary) + SHARED, np.float32), none, none, np.zeros(0), 0.5)
    n, v = sample.count(), len(vocabulary) + SHARED
    if not n or not vocabulary:
        return raw

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = _Ids(vocabulary), np.zeros(v, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                seen += (raw.counts(batch.slice(at, BLOCK)["text"].to_pylist(), ids) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v)), pa.array(seen)], names=["column", "n"])

    # documents with a term of each column
    known = np.zeros(v)
    for r in sample.select("text").mapInArrow(columns, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect():
        known[r["column"]] = r["n"]
    raw = replace(raw, idf=np.log((1 + n) / (1 + known)) + 0.1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = raw.weighted(part["text"].to_pylist(), ids).astype(np.float32)  # the grid's numbers fit
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in m], pa.binary()), part["label"]], names=["row", "label"])

    # MAX_TRAINING_ROWS x (MAX_TERMS + SHARED) numbers of four bytes; sorted, so that tasks' order doesn't matter
    got = sorted((bytes(r["row"]), r["label"]) for r in sample.mapInArrow(rows, "row binary, label int").toLocalIterator())
    x = np.frombuffer(b"".join(r for r, _ in got), np.float32).reshape(len(got), v)
    labels = np.array([label for _, label in got], float)
    del got
    gram = np.zeros((v, v), np.float32)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        gram += part.T @ part
    vectors = np.linalg.eigh(gram)[1]
    lead = _grid(np.ascontiguousarray(vectors[:, ::-1][:, : min(dimensions, v)]).astype(np.float64), ROW_BITS)
    own = np.concatenate([x[at : at + BLOCK].astype(np.float64) @ lead for at in range(0, len(x), BLOCK)])
    return Space(vocabulary, raw.idf, lead, _grid(_unit(own), VECTOR_BITS), labels, float(labels.mean()), balanced=True)


def score(docs: DataFrame, space: Space, threshold: float = 0.3) -> DataFrame:
    """``docs`` with the columns score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text scores as an empty one: the sample's mean label. Every row stays, repeated ones too;
    columns named score or predicted in ``docs`` are replaced.
    """
    keep = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids = _Ids(own.vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                s = own.score([t or "" for t in batch["text"].to_pylist()], ids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, widened(keep, score="double", predicted="int"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = MAX_TRAINING_ROWS) -> Space:
    return fit(labelled_sample(docs, labels, "quality", folds, held_out, max_rows))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (key_crc32(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")
