"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps homoglyphs (Cyrillic, Greek, full-width and mathematical letters) and
digit or sign substitutions to the letters they stand for; a digit is only folded
inside a word that has letters.  Accented letters stay apart, as languages tell words by them.
Terms are word beginnings: inflected forms of an insult share a stem, so an entry
matches at a word's start and, if it is marked whole, must end with the word.
Exception phrases (term plus its neighbour words) take back the hits inside them.
The score is a logistic function of the summed weights, their sum per square root of
words, and the hit count.

Lexicon, exceptions and the logistic function are learned from at most ``SAMPLE`` labelled
training rows, the ones with the lowest hash of their id among those whose id stands in one row, so that only bounded id lists are broadcast
and no text is shuffled: term weights are smoothed log odds of document counts, the logistic function is
fitted to the features.  The lexicon has at most ``TERMS`` entries, which bounds what is sent to scorers.

Defined results: null and empty texts have no hits and get the score of a text
without hits; null labels and labels without a document are unused, of several
labels of an id the highest counts; repeated rows get repeated results; if labels
are missing or of one class the lexicon is empty and the score the smoothed rate.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_of, labelled_ids, map_batches, table

#: Entries of the lexicon, at most; exception phrases, at most.
TERMS, EXCEPTIONS = 2000, 500
#: Labelled rows that are learned from, at most.
SAMPLE = 30_000
#: Shortest and longest stem that is tried as a term.
STEM = (3, 12)

#: Look-alikes of Latin letters in other scripts.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ſ": "s",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
TOKEN = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*|[@$][^\W_]+(?:[@$!][^\W_]+)*")
_SUBST = str.maketrans(SUBSTITUTES)
_LOOK = str.maketrans(LOOKALIKES)


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes folded, zero-width and soft hyphen characters dropped."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text).lower()
    return re.sub("[­​-‏⁠﻿]", "", text).translate(_LOOK)


def words_of(text: str) -> list[str]:
    """Folded words; substitutes are folded in words that have a letter."""
    out = TOKEN.findall(fold(text))
    return [w.translate(_SUBST) if not w.isalpha() and any(c.isalpha() for c in w) else w for w in out]


def stems(word: str) -> list[str]:
    """Candidate terms of a word: its beginnings, and "word " for the whole."""
    return [*(word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1)), word + " "]


@dataclass
class Lexicon:
    """Terms with weights (a trailing space: whole words only), exception phrases, and the logistic function's parameters."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    fit: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(" " + t, (len(t) + 1, w))
            for p in self.exceptions:
                a.add_word(f" {p} ", (len(p) + 1, None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Summed weights, their sum per root of words, hits; the heaviest entry of a word counts."""
        words = words_of(text or "")
        if not words or not self.weights:
            return 0.0, 0.0, 0.0
        line = " " + " ".join(words) + " "
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine().iter(line):
            # an entry is anchored at the space before its word; a whole word's or phrase's match also ends in a space
            start = end - length + 1
            if weight is None:
                spared.append((start - 1, end))
            else:
                hits[start] = max(weight, hits.get(start, -1e9))
        for a, b in spared:
            for start in [s for s in hits if a <= s < b]:
                del hits[start]
        total = sum(hits.values())
        return total, total / math.sqrt(len(words)), float(len(hits))

    def score(self, text: str | None) -> float:
        a, b, c, d = self.fit
        x, y, z = self.features(text)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(max(x, 0.0)) + c * math.log1p(max(y, 0.0)) + d * math.log1p(z)))))


def choose(counts: list[tuple[str, int, int]], n_bad: int, n_good: int, most: int = TERMS, least: int = 4, odds: float = 2.5) -> dict[str, float]:
    """Terms whose log odds are high and certain.

    Of beginnings that stand for nearly the same documents the longest stays, so that a
    short one doesn't catch other words; a longer entry beside a shorter one has to say more.
    """
    weights: dict[str, float] = {}
    known = {t: (b, g) for t, b, g in counts}
    grown: dict[str, int] = {}  # most toxic documents with a term that is one step longer
    for t, (b, _) in known.items():
        grown[t[:-1]] = max(b, grown.get(t[:-1], 0))

    def weight(t: str) -> float:
        b, g = known[t]
        return math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1))

    for t in sorted(known, key=lambda t: (len(t.rstrip()), t)):
        b, _ = known[t]
        w = weight(t)
        # one standard error below: rare terms have to be purer
        if b < least or w - 2.0 / math.sqrt(b) < odds or grown.get(t, 0) >= 0.95 * b:
            continue
        body = t.rstrip()
        shorter = [weights[body[:n]] for n in range(STEM[0], len(body) + (t != body)) if body[:n] in weights]
        if not shorter or w > max(shorter) + 0.5:
            weights[t] = w
    return dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:most])


def _count_terms(rows: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """Labelled documents with each candidate term, by label; terms in fewer than 4 toxic documents are left out before they are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            both = list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], names=["term", "bad", "good"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in {s for w in set(words_of(text or "")) for s in stems(w)} | {""}:
                    counts.setdefault(t, [0, 0])[0 if y else 1] += 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    grouped = map_batches(rows.select("__text", "__y"), run, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Most certain first; ties by term. What comes to the driver is bounded.
    found = grouped.where((F.col("term") == "") | ((F.col("bad") >= 4) & (F.col("bad") > F.col("good")))).orderBy(F.col("term") != "", (F.col("bad") / (F.col("good") + 0.5)).desc(), F.col("bad").desc(), "term").limit(20 * TERMS).collect()
    total = next(((r.bad, r.good) for r in found if r.term == ""), (0, 0))
    return [(r.term, r.bad, r.good) for r in found if r.term], *total


def _count_exceptions(rows: DataFrame, weights: dict[str, float]) -> frozenset[str]:
    """Phrases of a hit word and one neighbour that stand in documents labelled clean and hardly in toxic ones."""
    if not weights:
        return frozenset()
    lexicon = Lexicon(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                line, at, found = " " + " ".join(words) + " ", {}, set()
                pos = 0
                for i, w in enumerate(words):
                    at[pos] = i
                    pos += len(w) + 1
                for end, (length, _) in lexicon.machine().iter(line):
                    i = at.get(end - length + 1)
                    if i is not None:
                        found |= {" ".join(words[max(0, i - 1) : i + 1])} if i else set()
                        found |= {" ".join(words[i : i + 2])} if i + 1 < len(words) else set()
                counts.update((p, bool(y)) for p in found)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.string()), pa.array([counts[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else counts[k] for k in keys], pa.int64())], names=["term", "bad", "good"])

    grouped = map_batches(rows.select("__text", "__y"), run, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = grouped.where((F.col("good") >= 3) & (F.col("good") > 10 * F.col("bad"))).orderBy(F.col("good").desc(), "term").limit(EXCEPTIONS).collect()
    return frozenset(r.term for r in found)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge; feature weights stay at or above 0."""
    a = np.column_stack([np.ones(len(x)), np.log1p(np.maximum(x, 0))])
    w = np.zeros(a.shape[1])
    ridge = np.array([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the documents that ``labels`` covers (label 1: toxic). Give it training rows only."""
    known = labelled_ids(docs, labels, key, label, True, sample, 9).select("__id", "__y")
    # `sample` ids and labels: the side that is broadcast has a proven bound.
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(known), "__id")
    counts, n_bad, n_good = _count_terms(rows)
    weights = choose(counts, n_bad, n_good) if n_bad and n_good else {}
    if not weights:
        rate = (n_bad + 0.5) / (n_bad + n_good + 1)
        return Lexicon({}, frozenset(), (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    exceptions = _count_exceptions(rows, weights)
    lexicon = Lexicon(weights, exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in x], pa.float64()) for i in range(3)] + [batch.column(1).cast(pa.int64())], names=["a", "b", "c", "y"])

    found = map_batches(rows.select("__text", "__y"), run, "a double, b double, c double, y bigint").collect()
    x, y = np.array([r[:3] for r in found], float), np.array([r.y for r in found], float)
    return Lexicon(weights, exceptions, _fit(x, y))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` without ``text`` plus score and predicted (which replace columns of these names); one narrow pass with the lexicon (bounded by its maker) in the closure."""
    rest = [c for c in df.columns if c not in (text, "score", "predicted")]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in rest)
    lexicon = Lexicon(lexicon.weights, lexicon.exceptions, lexicon.fit)  # without the automaton: each worker builds its own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [lexicon.score(t) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=[*rest, "score", "predicted"])

    return map_batches(source, run, f"{fields}score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; learned from the labels whose id's crc32 modulo 4 isn't 2."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", (fold_of("doc_id", 4) == 2).alias("held_out"))
    train = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold_of("doc_id", 4) != 2)
    return score(docs, learn(docs, train))
