"""LM scoring with a hashed maximum-entropy model.

A token's probability is P(class | context) * P(token | class).  Classes come from a
token's spelling (its first two bytes and the kind of its last one), so they exist for
unseen words too; the most frequent spellings get a class each, the rest share one,
and the end of a text is a class of its own.  The class factor is a softmax over weights
of hashed features of the context: the word before, the two words before, the word before those by a skip,
and pairs and triples of classes, with a skip too.  The word factor is the class's own add-half estimate
(c + 0.5) / (N_class + 0.5 * (V_class + 1)), one slot being for unseen words.

Training: ``TRAINERS`` tasks at most go over their part of the training texts in
mini-batches of numpy arrays and update rows of sparse features (AdaGrad by row);
after each round rows are averaged by how often each task met them.  Every training text is
used, in one of ``ROUNDS`` rounds.  Weights are a table of fixed size (``ROWS`` x ``CLASSES``).

Counts: words are counted inside tasks and summed by key.  The most frequent words, ``FREQUENT`` at most, each of 64 bytes at
most, are sent to all tasks; all others are joined by word, so neither a frequent word nor the size of the vocabulary bounds the corpus.

Defined results: null and empty texts consist of the end alone; A-Z are lower-cased,
nothing else; null ids belong to the training part; repeated rows are counted and scored each;
without training texts (N = 0) each token has base probability 1 and classes are even.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold_of, map_batches, table
from tessera.llm.hashing import _SPACE, INVERSE, U, _chunks, mixed, powers, prefix_hash

CLASSES, ROWS, ROUNDS, TRAINERS = 32, 1 << 16, 2, 1024
#: Words that are sent to all tasks, the most frequent ones, at most.
FREQUENT = 200_000
#: The end of a text; no word contains white space.
END = b"\n"
#: Tokens of one gradient step; rows of one block of the weights that are averaged together.
STEP, BLOCK = 4096, 512
SHAPES = 1 << 19

_KIND = np.full(256, 7, np.int64)
_KIND[[*range(97, 123)]] = 0
for _i, _c in enumerate((b".", b",", b"!?", b"*$%&#|", b"0123456789")):
    _KIND[list(_c)] = _i + 1
_KIND[128:] = 6


def shape_of(word: bytes) -> int:
    """First two bytes and kind of the last byte; the number by which a word's class is looked up."""
    return word[0] << 11 | (word[1] if len(word) > 1 else 0) << 3 | int(_KIND[word[-1]])


class Tokens:
    """Tokens of some texts (lower-cased bytes): hashes and classes with three starts before each text; ``at`` are the places of true tokens."""

    def __init__(self, texts: list[bytes], classes: np.ndarray) -> None:
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        h = prefix_hash(data)
        words = mixed((h[ends] - h[starts]) * powers(INVERSE, len(data))[starts])
        second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)], 0).astype(np.int64)
        shape = data[starts].astype(np.int64) << 11 | second << 3 | _KIND[data[ends - 1]]
        first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        n = np.diff(first)
        text = np.repeat(np.arange(len(texts)), n)
        # a text takes three starts, its words, and the end
        place = np.arange(len(words)) + 4 * text + 3
        last = first[1:] + 4 * np.arange(len(texts)) + 3
        size = len(words) + 4 * len(texts)
        self.hash = np.full(size, U(1), U)
        self.cls = np.full(size, CLASSES - 1, np.int64)
        self.hash[place], self.cls[place] = words, classes[shape]
        self.hash[last], self.cls[last] = U(2), 0
        real = np.zeros(size, bool)
        real[place] = real[last] = True
        self.at = np.flatnonzero(real)
        self.text = np.repeat(np.arange(len(texts)), n + 1)

    def features(self, a: int, b: int) -> np.ndarray:
        """Rows of the weights for tokens a to b: bias, word before, word two before, both words, class pair, skip pair, class triple."""
        i = self.at[a:b]
        return np.stack([np.zeros(len(i), np.int64), *self.word_rows(i), *class_rows(*(self.cls[i - k].astype(U) for k in (1, 2, 3)))], axis=1)

    def word_rows(self, i: np.ndarray) -> list[np.ndarray]:
        """Rows of the word before, the word two before, and both, for the tokens at the places ``i``."""
        w1, w2 = self.hash[i - 1], self.hash[i - 2]
        return [_row(p) for p in (w1 + U(11), w2 + U(22), w1 * U(0xD1342543DE82EF95) + w2 + U(33))]

    def own_logs(self, weights: np.ndarray, contexts: np.ndarray, a: int, b: int) -> np.ndarray:
        """Natural logs of P(own class | context) for tokens a to b; ``contexts`` is ``context_table`` of the weights."""
        i = self.at[a:b]
        z = contexts.take((self.cls[i - 1] * CLASSES + self.cls[i - 2]) * CLASSES + self.cls[i - 3], axis=0, mode="clip")
        for rows in self.word_rows(i):
            z += weights.take(rows, axis=0, mode="clip")
        z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(i)), self.cls[i]]
        return own - np.log(np.exp(z, out=z).sum(axis=1))


def _row(p: np.ndarray) -> np.ndarray:
    return (1 + mixed(p) % U(ROWS - 1)).astype(np.int64)


def class_rows(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> list[np.ndarray]:
    """Rows of the class pair, skip pair and class triple before a token."""
    m = U(CLASSES)
    return [_row(p) for p in (c1 * m + c2 + (U(1) << U(40)), c2 * m + c3 + (U(2) << U(40)), (c1 * m + c2) * m + c3 + (U(3) << U(40)))]


def context_table(weights: np.ndarray) -> np.ndarray:
    """What bias and class features add up to, for each triple of classes."""
    c = np.arange(CLASSES**3).astype(U)
    m = U(CLASSES)
    out = np.repeat(weights[:1], len(c), axis=0)
    for rows in class_rows(c // (m * m), c // m % m, c % m):
        out += weights.take(rows, axis=0)
    return out


def class_logs(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural logs of P(class | context), a row for each row of features."""
    z = weights.take(features[:, 0], axis=0, mode="clip")
    for j in range(1, features.shape[1]):
        z += weights.take(features[:, j], axis=0, mode="clip")
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train_step(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, features: np.ndarray, target: np.ndarray, rate: float = 0.15) -> None:
    """One gradient step on the rows that the features name, in place; column 0 is the bias, row 0."""
    n, m = features.shape
    g = weights.take(features[:, 1], axis=0, mode="clip")
    for j in range(2, m):
        g += weights.take(features[:, j], axis=0, mode="clip")
    g += weights[0]
    g -= g.max(axis=1, keepdims=True)
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(n), target] -= 1
    # all columns' updates at once: rows of different columns differ but for chance
    flat = features[:, 1:].astype(np.uint16).ravel()  # ROWS numbers; 16 bits are sorted by counting
    order = np.argsort(flat, kind="stable")
    rows = flat[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    step = np.add.reduceat(g.take(order // (m - 1), axis=0, mode="clip"), first, axis=0)
    rows, count = rows[first], np.diff(np.append(first, len(rows)))
    squares[rows] += np.einsum("ij,ij->i", step, step) / CLASSES
    met[rows] += count
    weights[rows] -= step * (rate / (np.sqrt(squares[rows]) + 1e-6))[:, None]
    whole = g.sum(axis=0)
    squares[0] += whole @ whole / CLASSES
    met[0] += n
    weights[0] -= whole * (rate / (np.sqrt(squares[0]) + 1e-6))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.lower().split())
        if batch.num_rows:
            counts[END] += batch.num_rows
        if len(counts) > 400_000:
            yield out()
            counts.clear()
    yield out()


def count_words(df: DataFrame) -> DataFrame:
    """word, c for every token of the binary column of ``df``, the end included."""
    return map_batches(df, _counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def class_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each shape; tokens and log10(N_class + 0.5 * (V_class + 1)) of each class: 0 is the end, the last takes what has no class of its own."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = Counter(), Counter()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = -1 if word == END else shape_of(word)
                n[s] += c
                v[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([v[s] for s in n], pa.int64())], names=["shape", "n", "v"])

    # At most SHAPES + 1 rows of three numbers.
    found = map_batches(counts, shapes, "shape bigint, n bigint, v bigint").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    classes = np.full(SHAPES, CLASSES - 1, np.int64)
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    ranked = sorted((r for r in found if r["shape"] >= 0), key=lambda r: (-r["n"], r["shape"]))
    for k, r in enumerate(ranked):
        c = min(k + 1, CLASSES - 1)
        classes[r["shape"]] = c
        tokens[c] += r["n"]
        kinds[c] += r["v"]
    for r in found:
        if r["shape"] < 0:
            tokens[0], kinds[0] = r["n"], r["v"]
    return classes, tokens, np.log10(tokens + 0.5 * (kinds + 1))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least count from which words are no more than ``most``, by steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("c") * 16).cast("int")
    found = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 16 x 63 rows at most
    words, at = 0, max(found, default=0) + 1
    while at > 0 and words + found.get(at - 1, 0) <= most:
        at -= 1
        words += found.get(at, 0)
    return math.ceil(2 ** (at / 16))


def train(df: DataFrame, classes: np.ndarray, tokens: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from the binary texts of ``df`` (columns __text, __part: the round that uses it), from the classes' shares of ``tokens`` on."""
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log((tokens + 0.5) / (tokens + 0.5).sum())
    for r in range(rounds):
        before = weights

        def run(batches: Iterator[pa.RecordBatch], before: np.ndarray = before) -> Iterator[pa.RecordBatch]:
            w, squares, met = before.copy(), np.full(ROWS, 0.01, np.float32), np.zeros(ROWS, np.float32)
            for batch in batches:
                for part in _chunks([t.lower() for t in batch.column(0).to_pylist()]):
                    t = Tokens(part, classes)
                    for a in range(0, len(t.at), STEP):
                        train_step(w, squares, met, t.features(a, a + STEP), t.cls[t.at[a : a + STEP]])
            blocks = [k for k in range(0, ROWS, BLOCK) if met[k : k + BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([w[k : k + BLOCK].astype(np.float16).tobytes() for k in blocks], pa.binary()), pa.array([met[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "w", "met"])

        def average(group: pd.DataFrame) -> pd.DataFrame:
            total, share = np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)
            for w, met in zip(group["w"], group["met"], strict=True):
                m = np.frombuffer(met, np.float32)
                total += np.frombuffer(w, np.float16).reshape(BLOCK, CLASSES) * m[:, None]
                share += m
            out = np.where(share[:, None] > 0, total / np.maximum(share, 1)[:, None], np.nan).astype(np.float32)
            return pd.DataFrame({"block": [group["block"].iloc[0]], "w": [out.tobytes()]})

        part = df.where(F.col("__part") == r).select("__text")
        # ROWS x CLASSES weights from each trainer, of whom there are TRAINERS at most.
        learned = map_batches(part.coalesce(TRAINERS), run, "block int, w binary, met binary").groupBy("block").applyInPandas(average, "block int, w binary").collect()
        weights = before.copy()
        for row in learned:
            w = np.frombuffer(row["w"], np.float32).reshape(BLOCK, CLASSES)
            own = weights[row["block"] : row["block"] + BLOCK]
            own[~np.isnan(w)] = w[~np.isnan(w)]
    return weights


def score(df: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; what isn't held out is learned from."""
    source = df.select(F.col(f"`{key}`").alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("__text"))
    known = source.where(~F.col("__held"))
    counts = cut(count_words(known.select("__text")))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    classes, class_tokens, class_mass = class_table(counts)
    weights = train(known.select("__text", F.pmod(F.xxhash64("__text"), F.lit(ROUNDS)).alias("__part")), classes, class_tokens)
    least = frequent_from(counts, FREQUENT)
    # FREQUENT words of 64 bytes at most.
    frequent = {bytes(r["word"]): math.log10(r["c"] + 0.5) for r in counts.where((F.col("c") >= least) & (F.length("word") <= 64)).collect()}
    unseen = math.log10(0.5)
    shared = df.sparkSession.sparkContext.broadcast((classes, class_mass, weights, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, class_mass, weights, frequent = shared.value
        find, contexts = frequent.get, context_table(weights)
        for batch in batches:
            texts = [t.lower() for t in batch.column(3).to_pylist()]
            tokens, model = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            at = 0
            for part in _chunks(texts):
                t = Tokens(part, classes)
                logs = np.empty(len(t.at))
                for a in range(0, len(t.at), STEP):
                    logs[a : a + STEP] = t.own_logs(weights, contexts, a, a + STEP) / math.log(10) - class_mass[t.cls[t.at[a : a + STEP]]]
                here = slice(at, at + len(part))
                tokens[here] = np.bincount(t.text, minlength=len(part))
                model[here] = np.bincount(t.text, weights=logs, minlength=len(part))
                at += len(part)
            met, mass, rare = [], [], []
            for text in texts:
                words = [*text.split(), END]
                logs = list(map(find, words))
                others = Counter([w for w, x in zip(words, logs, strict=True) if x is None]) if None in logs else {}
                hits = [x for x in logs if x is not None] if others else logs
                met.append(len(hits))
                mass.append(math.fsum(hits))
                rare.append(list(others.items()))
            kinds = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
            rare_array = pa.array([[{"word": w, "times": c} for w, c in x] for x in rare], kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tokens), pa.array(model), pa.array(met, pa.int64()), pa.array(mass, pa.float64()), rare_array], names=["__row", "__id", "__held", "n_tokens", "model", "met", "mass", "rare"])

    id_type = source.schema["__id"].dataType.simpleString()
    numbered = source.select(F.monotonically_increasing_id().alias("__row"), "__id", "__held", "__text")
    rows = cut(map_batches(numbered, run, f"__row bigint, __id {id_type}, __held boolean, n_tokens bigint, model double, met bigint, mass double, rare array<struct<word: binary, times: bigint>>"))
    rare = rows.select("__row", F.inline("rare")).join(counts, "word", "left")
    log = F.when(F.col("c").isNull(), F.lit(unseen)).otherwise(F.log10(F.col("c") + F.lit(0.5)))
    summed = rare.groupBy("__row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("rare_met"), F.sum(F.col("times") * log).alias("rare_mass"))
    every = rows.drop("rare").join(summed, "__row", "left")
    mass = F.col("mass") + F.coalesce("rare_mass", F.lit(0.0))
    return every.select(
        F.col("__id").alias(key),
        F.col("__held").alias("held_out"),
        "n_tokens",
        (F.col("met") + F.coalesce("rare_met", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (mass - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (mass + F.col("model")).alias("score"),
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; texts whose id's crc32 modulo 5 is 1 are held out."""
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), fold_of("doc_id", 5) == 1)
