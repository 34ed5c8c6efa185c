"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded before anything else: compatibility forms and accents are removed, look-alike
letters of other scripts become Latin ones and, inside words, digits and symbols that stand for letters do too.
The lexicon's terms are words and beginnings of words (insults are inflected); their weights are smoothed log odds of a term's
document frequency in toxic and other labelled documents. An occurrence inside an exception phrase does not count; besides a few given
ones, these are pairs of words with a term that labelled documents which aren't toxic hold much oftener than toxic ones. The summed
weights and the number of distinct ones, both normalised by the text's length (texts of fewer than SHORT words count as so long), go through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstally.llm.common import cut, key_crc32, labelled_sample, widened

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and symbols written for letters. They fold only inside a word that has a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Harmless phrases around words that insult elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "worthless check", "pond scum")

#: Lengths of stems, shorter than their words.
STEMS = range(4, 9)
#: Weights for each hundred words of a shorter text are taken as if it had so many words: one word alone has no rate.
SHORT = 20
#: MinHash values that tell near copies among the training rows, and the share that two of them have in common.
MINIMA, ALIKE = 16, 0.5

_GLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<![a-z0134578@$])[a-z]*[0134578@$][a-z0134578@$]*")
_GAP = re.compile(r"[^a-z0-9]+")
_LATIN: dict[str, str] = {}


def _plain_char(c: str) -> str:
    """One character without accents, as Latin letters where it looks like them."""
    found = _LATIN.get(c)
    if found is None:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        found = base.translate(_GLYPHS).lower()
        # zero-width characters vanish; letters without a Latin look stay themselves, spelt out
        if unicodedata.category(c) == "Cf":
            found = ""
        elif not found.isascii():
            found = "".join(x if x.isascii() else f"u{ord(x):x}" if x.isalpha() else " " for x in found)
        _LATIN[c] = found
    return found


def _undigit(m: re.Match) -> str:
    word = m.group().rstrip("$@")
    return word.translate(_DIGITS) if any("a" <= c <= "z" for c in word) else word


def fold(text: str) -> str:
    """Words of a-z0-9 with one space before, between and after them; i, l and 1 become one letter."""
    text = text.lower()
    if not text.isascii():
        text = text.translate({ord(c): _plain_char(c) for c in set(text) if not c.isascii()})
    if any(c in text for c in "0134578@$"):
        text = _MIXED.sub(_undigit, text)
    return f" {_GAP.sub(' ', text).strip()} ".replace("l", "i")


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded terms (``word``, or ``stem*`` for all words with that beginning), exception phrases, learned ones (folded) and the logistic curve (intercept and two slopes)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.0)
    learned: tuple[str, ...] = ()
    _built: list = field(default_factory=list, init=False, compare=False, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        """One automaton of terms (weight) and exception phrases (None), each after a space and, but for stems, before one."""
        if not self._built:
            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                w = f" {w[:-1]}" if w.endswith("*") else f" {w} "
                a.add_word(w, (len(w), x))
            for p in (*map(fold, self.exceptions), *self.learned):
                a.add_word(p, (len(p), None))
            a.make_automaton()
            self._built.append(a)
        return self._built[0]

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve, self.learned)

    def hits(self, folded: str) -> list[float]:
        """The largest weight of each word that holds a term outside exception phrases."""
        terms, spared = [], []
        for end, (n, weight) in self.automaton().iter(folded) if self.weights else ():
            (spared if weight is None else terms).append((end - n + 1, end, weight))
        if spared:
            terms = [t for t in terms if not any(s <= t[0] and t[1] <= e for s, e, _ in spared)]
        best: dict[int, float] = {}
        for start, _, weight in terms:
            best[start] = max(weight, best.get(start, weight))
        return list(best.values())

    def features(self, text: str) -> tuple[float, float]:
        """Summed weights and distinct weights for each hundred words, dampened."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0
        words = max(folded.count(" ") - 1, SHORT)
        return math.log1p(100 * sum(found) / words), math.log1p(100 * len(set(found)) / words)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of folded words and their stems, by label, within each batch."""
    schema = pa.schema([("term", pa.string()), ("label", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            words = set(fold(text).split())
            seen[1 if label else 0].update(words | {f"{w[:n]}*" for w in words for n in STEMS if n < len(w)})
        for label, counts in seen.items():
            yield pa.RecordBatch.from_pydict({"term": list(counts), "label": [label] * len(counts), "n": list(counts.values())}, schema=schema)


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with kin, the smallest hash of a folded text's three-word runs, and minima, the smallest ones of MINIMA further hashes."""
    factors = np.random.default_rng(3).integers(1 << 31, size=(MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for batch in batches:
        kin, minima = [], []
        for text in batch["text"].to_pylist():
            words = fold(text).split()
            h = np.array([crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint32)
            kin.append(int(h.min()))
            minima.append((factors * (h ^ (h >> np.uint32(15)))[None, :]).min(axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([batch["text"], batch["label"], pa.array(kin, pa.int64()), pa.array(minima, pa.binary())], names=["text", "label", "kin", "minima"])


def _first_of_kin(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one label and kin without those that have ALIKE of their minima in common with one before."""
    rows = rows.sort_values("text")
    minima = np.frombuffer(b"".join(rows["minima"]), np.uint32).reshape(len(rows), MINIMA)
    kept: list[int] = []
    for i in range(len(rows)):
        if not kept or (minima[kept] == minima[i]).mean(axis=1).max() < ALIKE:
            kept.append(i)
    return rows.iloc[kept][["text", "label"]]


def _count_phrases(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies by label of pairs of neighbouring words one of which holds a term."""
    schema = pa.schema([("term", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def held(word: str) -> bool:
        return word in lexicon.weights or any(f"{word[:n]}*" in lexicon.weights for n in STEMS if n < len(word))

    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            words = fold(text).split()
            terms = {w for w in set(words) if held(w)}
            seen[1 if label else 0].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in terms or b in terms})
        for label, counts in seen.items():
            yield pa.RecordBatch.from_pydict({"term": list(counts), "label": [label] * len(counts), "n": list(counts.values())}, schema=schema)


def _by_label(counts: DataFrame) -> DataFrame:
    """term, p (toxic documents) and q (others)."""
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return counts.groupBy("term").agg(of(1).alias("p"), of(0).alias("q"))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(sample: DataFrame, min_docs: int = 4, min_log_odds: float = 1.0, errors: float = 2.0) -> Lexicon:
    """Lexicon and curve from (text, label) rows, which ``labelled_sample`` bounds.

    A term needs ``min_docs`` toxic documents and log odds that are ``errors`` standard errors above ``min_log_odds``; an exception phrase needs
    ``min_docs`` other documents and log odds that are not above zero and two standard errors below its term's weight. Copies and near copies of a document count once.
    Without toxic rows the lexicon is empty and every score is the same low value.
    """
    distinct = cut(sample.mapInArrow(_kin, "text string, label int, kin long, minima binary").groupBy("kin", "label").applyInPandas(_first_of_kin, "text string, label int"))
    size = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1:
        return Lexicon({})
    odds = F.log((F.col("p") + 0.5) / (n1 + 1.0)) - F.log((F.col("q") + 0.5) / (n0 + 1.0))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    counts = _by_label(distinct.mapInArrow(_count_terms, "term string, label int, n long"))
    # what comes here grows with the sample, which a parameter bounds
    top = counts.where((F.col("p") >= min_docs) & (odds - errors * error >= min_log_odds)).select("term", odds.alias("w")).collect()
    lexicon = Lexicon({r["term"]: r["w"] for r in sorted(top)})
    phrases = _by_label(distinct.mapInArrow(partial(_count_phrases, lexicon), "term string, label int, n long"))
    harmless = phrases.where((F.col("q") >= min_docs) & (odds <= 0)).select("term", (odds + 2 * error).alias("most")).collect()
    lexicon = replace(lexicon, learned=tuple(sorted(p for r in harmless if r["most"] < max(lexicon.hits(p := f" {r['term']} "), default=-math.inf))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.float64()) for i in range(2)), batch["label"]], names=["a", "b", "label"])

    m = sample.mapInArrow(measure, "a double, b double, label int").toPandas()
    return replace(lexicon, curve=fit_curve(m[["a", "b"]].to_numpy(), m["label"].to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs`` with the columns score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text scores as an empty one. Every row stays, repeated ones too; columns named
    score or predicted in ``docs`` are replaced.
    """
    keep = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            s = pa.array([own.score(t or "") for t in batch["text"].to_pylist()], pa.float64())
            p = pa.array([int(v >= threshold) for v in s.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, s, p], names=[*batch.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, widened(keep, score="double", predicted="int"))


#: Labelled rows that the lexicon is learned from, at most.
MAX_TRAINING_ROWS = 16_000


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = MAX_TRAINING_ROWS) -> Lexicon:
    return fit(labelled_sample(docs, labels, "toxic", folds, held_out, max_rows))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (key_crc32(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", "predicted")
