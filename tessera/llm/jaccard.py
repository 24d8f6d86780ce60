"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text is the set of its five-word shingles.  The forest has ``TREES`` prefix tries: in each, a set
stands under its own signature of ``COMPONENTS`` MinHash values, kept as two bytes a value, so that
a trie is its signatures in byte order and a node of depth d is a run with 2d equal bytes in front.

Matching starts with whole signatures.  At each depth the pairs that meet there for the first
time are verified on the shingle sets themselves, and the similarities of the links found so far tell what that
depth has missed: a link of similarity s shares a prefix of d values in some tree with probability
p = 1 - (1 - s**d)**trees, so each link found stands for (1 - p) / p missed ones; three more at the threshold
stand for what may be there unseen.  While the recall so estimated is below ``RECALL``, the
matched prefixes are shortened to the longest length that would reach it with the links known by then.  At the depth where even links at the threshold are
found with that probability the target is reached whatever the similarities are, so the tries end there.

Groups stay bounded without dropping anything:

* rows with the same set are one class from the start (partial aggregation), so copies cost one member;
* a node without a fork below has no new pairs and is left out; nodes with the same members in several trees are verified once;
* a pair is verified in the first round, there in the first tree, in which it shares a prefix, so no pair table is deduplicated or written;
* a node of more than ``BLOCK`` classes or ``BLOCK_BYTES`` of shingles is verified block against block, each pair of blocks by itself;
* a node yields link counts and a spanning forest, never its pairs.

Defined results: null, empty and blank texts have no shingles, link to nothing and are classes of
their own; texts of one to four words have one shingle, all their words; repeated rows (ids
too) are copies of each other; a class is named by its least id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, map_batches, stored, table
from tessera.llm.components import connected_components
from tessera.llm.hashing import U, mixed, shingles

TREES, COMPONENTS, RECALL = 16, 8, 0.9997
#: Classes, and bytes of their shingles, that stand on one side of a comparison, about at most.
BLOCK, BLOCK_BYTES = 1000, 4 << 20
#: Classes up to which pairs are compared one by one.
FEW = 5
#: Similarities from the threshold to 1 are counted in this many bins.
BINS = 64
_SEEDS = np.random.Generator(np.random.PCG64(61)).integers(1, 1 << 63, (2, TREES * COMPONENTS * 4), dtype=np.uint64) | U(1)


def found_with(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray:
    """The probability that sets of that similarity share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(threshold: float, trees: int = TREES, components: int = COMPONENTS, recall: float = RECALL) -> int:
    """The longest prefix that finds pairs at the threshold with the wanted probability."""
    k = components
    while k > 1 and found_with(threshold, k, trees) < recall:
        k -= 1
    return k


def measured_recall(bins: np.ndarray, threshold: float, depth: int, trees: int) -> float:
    """Recall at ``depth`` as the links found (by bin of similarity) let it be estimated."""
    p = found_with(threshold + (1 - threshold) * np.arange(len(bins)) / len(bins), depth, trees)
    missed = float((bins * (1 - p) / p).sum()) + 3 * (1 - p[0]) / p[0]
    return 1 - missed / (float(bins.sum()) + missed) if bins.sum() else float(p[0])


def signatures(sets: list[np.ndarray], trees: int = TREES, components: int = COMPONENTS) -> list[bytes]:
    """The MinHash values of each set (not empty), two bytes each, tree by tree."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    out = np.empty((len(sets), trees * components), ">u2")
    for k in range(trees * components):
        # shingle hashes are well mixed, so a product and a sum make another order of them
        out[:, k] = mixed(np.minimum.reduceat(every * _SEEDS[0, k] + _SEEDS[1, k], starts)) >> U(48)
    return [row.tobytes() for row in out]


def sketches(df: DataFrame, text: str, key: str, words: int, trees: int, components: int) -> DataFrame:
    """__id, __set (a digest of the shingle set, null without shingles), __size (its shingles) and __signature for each row."""
    source = df.select(F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column(1).to_pylist(), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            digests: list[bytes | None] = [None] * len(sets)
            keys: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full], trees, components) if full else [], strict=True):
                digests[i], keys[i] = hashlib.md5(sets[i].tobytes()).digest(), row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["__id", "__set", "__size", "__signature"])

    return map_batches(source, run, f"__id {source.schema['__id'].dataType.simpleString()}, __set binary, __size bigint, __signature binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share.

    Shingles that most sets have are counted by the sets that lack them, so near copies
    cost what they differ by; rare ones by pairs of neighbours in their list of owners, the others by products.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    major = freq > n / 2
    lacks = major.sum() - np.bincount(owner[major[col]], minlength=n)
    out = np.zeros((n, n), np.float32)
    rare = ~major & (freq >= 2) & (freq <= 32)
    pick = rare[col]
    o, c = owner[pick], col[pick]
    order = np.lexsort((o, c))
    o, c = o[order], c[order]
    for d in range(1, int(freq[rare].max()) if rare.any() else 0):
        same = c[d:] == c[:-d]
        out += np.bincount(o[:-d][same] * n + o[d:][same], minlength=n * n).reshape(n, n).astype(np.float32)
    out += out.T
    np.fill_diagonal(out, np.bincount(o, minlength=n))
    for dense, flip in ((~major & (freq > 32), False), (major, True)):
        ids = np.flatnonzero(dense)
        place = np.full(len(freq), -1)
        place[ids] = np.arange(len(ids))
        at = place[col]
        for a in range(0, len(ids), 1024):
            inside = (at >= a) & (at < a + 1024)
            x = np.zeros((n, min(1024, len(ids) - a)), np.float32)
            x[owner[inside], at[inside] - a] = 1
            x = 1 - x if flip else x
            out += x @ x.T
    single = np.bincount(owner[(~major & (freq == 1))[col]], minlength=n)
    out += np.diag(single).astype(np.float32)
    return out + (major.sum() - lacks[:, None] - lacks[None, :])


def _meets_elsewhere(a: bytes, b: bytes, tree: int, depth: int, before: int | None, trees: int, components: int) -> bool:
    """Whether two signatures share the prefix matched ``before`` in any tree, or one of ``depth`` in an earlier tree."""
    wide = 2 * components
    if any(a[at : at + 2 * depth] == b[at : at + 2 * depth] for at in range(0, tree * wide, wide)):
        return True
    return before is not None and any(a[at : at + 2 * before] == b[at : at + 2 * before] for at in range(tree * wide, trees * wide, wide))


def links_of(sets: list[np.ndarray], signs: list[bytes], tree: int, depth: int, before: int | None, threshold: float, block: np.ndarray, across: bool, trees: int = TREES, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Which two of a node's sets reach the threshold and meet here first, and the similarities of those pairs; with ``across`` only of different blocks."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    hit = np.zeros((n, n), bool)
    if n <= FEW:
        close = []
        for i in range(n):
            for j in range(i + 1, n):
                if (across and block[i] == block[j]) or min(size[i], size[j]) < threshold * max(size[i], size[j]) - 1e-6 or _meets_elsewhere(signs[i], signs[j], tree, depth, before, trees, components):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= threshold * (size[i] + size[j] - both) - 1e-6:
                    hit[i, j] = hit[j, i] = True
                    close.append(both / (size[i] + size[j] - both))
        return hit, np.array(close)
    both = shared_counts(sets)
    for a in range(0, n, 256):  # doubles for some rows at a time
        some = both[a : a + 256].astype(np.float64)
        hit[a : a + 256] = some >= threshold * (size[a : a + 256, None] + size[None, :] - some) - 1e-6
    np.fill_diagonal(hit, False)
    flat = np.frombuffer(b"".join(signs), np.uint8).reshape(n, trees, 2 * components)
    for t in range(trees):
        for d in {*[depth] * (t < tree), *[before] * (before is not None)}:
            _, own = np.unique(np.ascontiguousarray(flat[:, t, : 2 * d]).view(f"V{2 * d}").ravel(), return_inverse=True)
            hit &= own[:, None] != own[None, :]
    if across:
        hit &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(hit))
    shared = both[i, j].astype(np.float64)
    return hit, shared / (size[i] + size[j] - shared)


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked row to the first row of its component."""
    label = np.full(len(hit), -1)
    out = []
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(hit[front].any(axis=0) & (label < 0))
                label[front] = i
                out += [(i, j) for j in front.tolist()]
    return out


def _compared(depth: int, before: int | None, threshold: float, trees: int, components: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over rows (tree, prefix, i, j, block, __set, __n, __signature, __shingles), sorted by the first four.

    It yields a, null, n for each linked class (rows it links to), a, b, 0 for a spanning forest, and at the end one row with the bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)
        out: list[tuple[bytes | None, bytes | None, int]] = []

        def emit(last: bool = False) -> pa.RecordBatch:
            if last:
                out.append((None, None, 0))
            found = pa.array([None] * (len(out) - last) + [bins.tolist()] * last, pa.list_(pa.int64()))
            made = pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int64()))), found], names=["a", "b", "n", "bins"])
            out.clear()
            return made

        def close(key: tuple, rows: list[tuple]) -> None:
            if len(rows) < 2:
                return
            rows.sort(key=lambda r: r[1])
            block, names, times, signs, held = zip(*rows, strict=True)
            hit, close = links_of([np.frombuffer(x, np.uint64) for x in held], list(signs), key[0], depth, before, threshold, np.array(block), key[2] != key[3], trees, components)
            if not len(close):
                return
            np.add.at(bins, np.clip(((close - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), 1)
            counted = (hit * np.array(times)[None, :]).sum(axis=1)
            out.extend((names[i], None, int(counted[i])) for i in np.flatnonzero(counted).tolist())
            out.extend((names[i], names[j], 0) for i, j in forest(hit))

        now, rows = None, []
        for batch in batches:
            for tree, prefix, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, prefix, i, j) != now:
                    if rows:
                        close(now, rows)
                    now, rows = (tree, prefix, i, j), []
                    if len(out) > 20_000:
                        yield emit()
                rows.append(tuple(row))
        if rows:
            close(now, rows)
        yield emit(last=True)

    return run


def jaccard_classes(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, words: int = 5, trees: int = TREES, components: int = COMPONENTS, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, class_id (the least id linked to it, by any chain of links) and n_links (rows within the threshold) for each row."""
    least_depth = depth_for(threshold, trees, components, recall)
    rows = stored(sketches(df, text, key, words, trees, components))
    sets = stored(rows.where("__set IS NOT NULL").groupBy("__set").agg(F.first("__signature").alias("__signature"), F.first("__size").alias("__size"), F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__least")))

    def prefix(depth: int) -> Column:
        return F.substring("__path", 1, 2 * depth)

    # The tries, in byte order: only nodes of the least depth with two classes at least can ever hold a pair.
    own = F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(__signature, t * {2 * components} + 1, {2 * components}))")
    members = sets.select("__set", "__size", F.posexplode(own).alias("tree", "__path")).withColumn("__node", F.xxhash64("tree", prefix(least_depth)))
    shared = members.groupBy("__node").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__node")
    tries = stored(members.join(shared, "__node").select("tree", "__path", "__set", "__size").sortWithinPartitions("tree", "__path"))
    # Shingles of the classes that have candidates: one row of each is enough.
    wanted = tries.select("__set").distinct().join(sets, "__set").select("__set", "__n", "__signature", F.col("__least").alias("__id"))
    source = df.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("__text"))
    texts = source.join(wanted, F.col("__key").eqNullSafe(F.col("__id"))).select("__set", "__n", "__signature", "__text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingles(batch.column(3).to_pylist(), words)]
            same = pa.array([hashlib.md5(s).digest() == d for s, d in zip(found, batch.column(0).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["__set", "__n", "__signature", "__shingles"]).filter(same)

    shingled = stored(map_batches(texts, to_sets, "__set binary, __n bigint, __signature binary, __shingles binary").dropDuplicates(["__set"]))

    def links_at(depth: int, before: int | None) -> DataFrame:
        """Links between classes that share ``depth`` values in some tree, but nowhere as many as were matched ``before``."""
        longer = before or depth
        nodes = tries.groupBy("tree", prefix(depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("__size").alias("__sizes"), F.bit_xor(F.xxhash64("__set")).alias("x"), F.bit_xor(F.xxhash64("__set", F.lit(1))).alias("y"),
            F.min(prefix(longer)).alias("__lo"), F.max(prefix(longer)).alias("__hi"),
        )
        forked = nodes.where("n > 1 AND __lo <> __hi" if before else "n > 1")
        once = forked.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("g"), F.first("__sizes").alias("__sizes"))
        blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), 8 * F.col("__sizes") / F.lit(block_bytes))).cast("int")
        once = once.select("g.tree", "g.prefix", blocks.alias("__blocks"))
        placed = tries.select("tree", prefix(depth).alias("prefix"), "__set").join(once, ["tree", "prefix"])
        placed = placed.withColumn("block", F.pmod(F.xxhash64("__set", F.lit(3)), F.col("__blocks")).cast("int"))
        placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        dealt = placed.select("tree", "prefix", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"), "block", "__set")
        order = ["tree", "prefix", "i", "j"]
        tasks = dealt.join(shingled, "__set").select(*order, "block", "__set", "__n", "__signature", "__shingles").repartition(*order).sortWithinPartitions(*order)
        return cut(map_batches(tasks, _compared(depth, before, threshold, trees, components), "a binary, b binary, n bigint, bins array<bigint>"))

    found, bins, depth, before = None, np.zeros(BINS), components, None
    while True:
        step = links_at(depth, before)
        found = step if found is None else found.unionByName(step)
        for row in step.where("bins IS NOT NULL").select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("c")).collect():  # BINS rows
            bins[row["pos"]] += row["c"]
        if depth <= least_depth or measured_recall(bins, threshold, depth, trees) >= recall:
            break
        before, depth = depth, max(least_depth, next((d for d in range(depth - 1, 0, -1) if measured_recall(bins, threshold, d, trees) >= recall), 1))
    for done in (tries, shingled):
        discard(done)
    links = found.where("a IS NOT NULL AND b IS NULL").groupBy(F.col("a").alias("__set")).agg(F.sum("n").alias("__links"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("__set"), F.col("root").alias("__root"))
    named = sets.select("__set", "__n", "__least").join(roots, "__set", "left").join(links, "__set", "left").withColumn("__root", F.coalesce("__root", "__set"))
    least = named.groupBy("__root").agg(F.min("__least").alias("class_id"))
    classes = named.join(least, "__root").select("__set", "class_id", (F.col("__n") - 1 + F.coalesce("__links", F.lit(0))).alias("n_links"))
    out = rows.select("__id", "__set").join(classes, "__set", "left")
    return out.select(F.col("__id").alias(key), F.when(F.col("__set").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates in ``documents`` and each document's number of links: five words, 0.8 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
