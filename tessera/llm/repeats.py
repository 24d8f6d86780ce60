"""Removal of repeated byte strings by column-wise suffix sorting of many documents.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts anywhere else
in the collection.  The collection's Burrows-Wheeler transform and common prefixes are built
column by column: each round inserts one symbol of every segment, at the place that ranks in
the transform so far give, and updates common prefixes from minima between equal symbols
(Bauer, Cox and Rosone; with prefixes, Cox, Garofalo, Rosone and Sciortino).  Strings that share
``LENGTH`` bytes end up side by side.

One transform of 100 TB can't be built in rounds as long as its longest text, so the collection is
first cut into segments that hold all that can match:

* each window of ``LENGTH`` bytes is dealt by its minimizer, the least hash of the ``GRAM``-byte strings in it; equal windows have
  equal minimizers.  Neighbouring windows share one, so a run of them is a segment of at most 2 * LENGTH bytes;
* segments whose minimizer occurs once can't match and never move; windows whose hash is met once among a minimizer's segments are
  trimmed off; equal texts, equal segments, and equal rests of segments are sorted once;
* what is left is sorted in batches of whole minimizer groups, of at most ``HOT`` segments each, so a task's memory is bounded.  The
  columns are kept as sequential arrays that each round reads and writes from front to end, in memory, as batches are bounded: no
  machine-local files.
* windows of a minimizer with more segments than that are counted by 128-bit hash instead, with partial aggregation: the exact way
  for hot passages.

Beside the bytes, passages are told that are shorter than ``LENGTH`` bytes: of each text the word strings of ``WORDS`` words that are
the least of some ``PASSAGE`` neighbouring words are taken (so each passage of that many words holds one, whatever stands around it),
and ``n_passages`` counts those that stand in another document, too.  Texts are told apart there by 64 bits of their digest.

Counts by minimizer or word string are partial aggregates, joined back with ``SALTS`` salts, so a passage that a third of the documents
share is no task's alone.

Defined results: null and empty texts have no bytes and keep the digest of nothing; matches never cross documents; texts shorter
than ``LENGTH`` stay whole; repeated rows (equal id and text, too) are documents of their own, so they match each other;
a null id is kept; the input alone decides, not what is left of other texts; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, map_batches, stored, table
from tessera.llm.hashing import BASE, INVERSE, U, _chunks, mixed, powers, prefix_hash, window_hashes, word_hashes

LENGTH, GRAM = 400, 64
#: Segments of one minimizer that are sorted together, at most.
HOT = 20_000
#: Bytes of distinct segments that are sorted together, about.
BATCH = 1 << 16
#: Words of the strings that tell passages, and of the shortest passage that is sure to hold one.
WORDS, PASSAGE = 24, 51
#: Parts into which the rows of one key are dealt when a count is joined back.
SALTS = 4
#: Bytes of segments that are trimmed together, about.
TRIM = 1 << 20
NONE = 255  # no symbol; never a byte of UTF-8


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by minima from the front and the back of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parallel arrays text, minimizer, first and last start of each run of windows whose minimizer first stands at one place.

    Windows of one run differ, as that place lies at another offset in each; so a repeated window is in two runs.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams = window_hashes(data, gram)
    least = window_minima(grams, length - gram + 1)
    if not len(least):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.arange(len(least))
    valid = at + length <= ends[text]
    starts = np.ones(len(least), bool)
    # the next window's least is another one, or the same value at a later place
    starts[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(starts & valid)
    stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~starts[1:], False))
    offset = ends[text[heads]] - sizes[text[heads]]
    return text[heads], least[heads].view(np.int64), heads - offset, stops - offset


def passage_strings(texts: list[bytes], words: int = WORDS, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Parallel arrays text, hash of the distinct word strings that are the least of ``passage`` neighbouring words."""
    owners, found = [], []
    at = 0
    for part in _chunks(texts):
        hashes, first = word_hashes(part)
        n = len(hashes)
        h = np.zeros(n + 1, U)
        np.cumsum(hashes * powers(BASE, n), out=h[1:])
        strings = mixed((h[words:] - h[: n + 1 - words]) * powers(INVERSE, n)[: n + 1 - words]) if n >= words else np.zeros(0, U)
        least = window_minima(strings, passage - words + 1)
        text = np.repeat(np.arange(len(part)), np.diff(first))[: len(least)]
        inside = np.arange(len(least)) + passage <= first[text + 1]
        least, text = least[inside], text[inside]
        # neighbours mostly have the same least
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        pairs = np.unique(np.stack([text[new].astype(U), least[new]], axis=1), axis=0)
        owners.append(pairs[:, 0].astype(np.int64) + at)
        found.append(pairs[:, 1])
        at += len(part)
    return (np.concatenate(owners), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, U))


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the starts of its ``length``-byte strings that start elsewhere in the segments, too."""
    m = len(segments)
    sizes = np.array([len(s) for s in segments])
    flat = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(sizes)
    # Sorted suffixes so far: the symbol before each, its common prefix with the one above, and segment << 16 | length.
    symbol = flat[ends - 1].copy()
    common = np.zeros(m, np.int16)
    ref = np.arange(m, dtype=np.int64) << 16
    place = np.arange(m)  # of each active segment's longest suffix so far
    active = np.arange(m)
    for j in range(1, int(sizes.max()) + 1):
        # An order by symbol, equal ones as they stand: where each suffix goes when its symbol is put before it.
        order = np.argsort(symbol, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_place = np.argsort(place)
        place, active = place[by_place], active[by_place]
        c = symbol[place]
        new = m + rank[place]
        # Common prefixes with the neighbours that start with the same symbol: one more than the least in between.
        above, below = rank[place] - 1, rank[place] + 1
        up, down = order[np.maximum(above, 0)], order[np.minimum(below, len(order) - 1)]
        has_up, has_down = (above >= 0) & (symbol[up] == c), (below < len(order)) & (symbol[down] == c)
        lcp_up = np.where(has_up, 1 + _least_between(common, up, place), 0)
        lcp_down = np.where(has_down, 1 + _least_between(common, place, down), 0)
        before = np.argsort(new, kind="stable")
        spots, lcp_up, lcp_down, has_down, which = new[before], lcp_up[before], lcp_down[before], has_down[before], active[before]
        more = sizes[which] > j
        nxt = np.where(more, flat[np.maximum(ends[which] - j - 1, 0)], NONE).astype(np.uint8)
        size = len(symbol) + len(spots)
        kept = np.ones(size, bool)
        kept[spots] = False
        symbol, common, ref = (_woven(old, kept, spots, put) for old, put in ((symbol, nxt), (common, lcp_up.astype(np.int16)), (ref, which.astype(np.int64) << 16 | j)))
        after = spots + 1
        inside = after < size
        # the suffix below, whether old or of this round, meets the new one now
        common[after[inside]] = np.where(has_down[inside], lcp_down[inside], 0)
        place, active = spots[more], which[more]
        if not len(active):
            break
    hit = common >= length
    hit[:-1] |= common[1:] >= length
    hit[0] = hit[0] and len(hit) > 1 and common[1] >= length
    found = ref[hit]
    seg, start = found >> 16, sizes[found >> 16] - (found & 0xFFFF)
    by = np.lexsort((start, seg))
    seg, start = seg[by], start[by]
    return np.split(start, np.searchsorted(seg, np.arange(1, m)))


def shared_windows(segments: list[bytes], length: int, group: np.ndarray) -> list[np.ndarray]:
    """For each segment the starts of windows whose hash is met more than once in the segments of its group: all that can be repeated."""
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(segments)), sizes)
    hashes = window_hashes(np.frombuffer(b"".join(segments), np.uint8), length)
    at = np.flatnonzero(np.arange(len(hashes)) + length <= ends[owner[: len(hashes)]])
    keys = hashes[at] ^ mixed(group.astype(U))[owner[at]]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    met = np.zeros(len(at), bool)
    met[order[1:][same]] = met[order[:-1][same]] = True
    at = at[met]
    return np.split(at - (ends - sizes)[owner[at]], np.searchsorted(at, ends[:-1]))


def _woven(old: np.ndarray, kept: np.ndarray, spots: np.ndarray, put: np.ndarray) -> np.ndarray:
    out = np.empty(len(kept), old.dtype)
    out[kept] = old
    out[spots] = put
    return out


def _least_between(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(common[a + 1 .. b]) for each pair; pairs with a >= b get 0."""
    out = np.zeros(len(a), np.int64)
    ok = np.flatnonzero(a < b)
    if len(ok):
        bounds = np.column_stack([a[ok] + 1, b[ok] + 1]).ravel()
        padded = np.append(common, np.int16(0))
        out[ok] = np.minimum.reduceat(padded, bounds)[::2]
    return out


def _as_ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True))


def _sorted_groups(length: int):
    """A function over rows (mini, digest, first, segment), sorted by mini, that yields (digest, a, b): windows a to b of that text are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        closed: list[dict[bytes, list[tuple[bytes, int]]]] = []  # groups by segment, to be trimmed
        held: list[dict[bytes, list[tuple[bytes, int]]]] = []  # trimmed ones, to be sorted

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["digest", "a", "b"])
            out.clear()
            return made

        def flush() -> None:
            places = [(seg, who) for g in held for seg, who in g.items()]
            found = repeated_starts([seg for seg, _ in places], length) if places else []
            for (seg, who), starts in zip(places, found, strict=True):
                ranges = [(0, len(seg) - length)] if len(who) > 1 else _as_ranges(starts)
                out.extend((digest, first + a, first + b) for digest, first in who for a, b in ranges)
            held.clear()

        def trim() -> None:
            """Windows whose hash is met once in their group are unique; what is left of segments is often the same string again, which is sorted once."""
            segments = [seg for g in closed for seg in g]
            starts = iter(shared_windows(segments, length, np.repeat(np.arange(len(closed)), [len(g) for g in closed])) if segments else ())
            for group in closed:
                shared: dict[bytes, list[tuple[bytes, int]]] = {}
                for seg, who in group.items():
                    for a, b in _as_ranges(next(starts)):
                        shared.setdefault(seg[a : b + length], []).extend((digest, first + a) for digest, first in who)
                if all(len(who) > 1 for who in shared.values()):
                    # each string is held several times as a whole: equality says all
                    out.extend((digest, first, first + len(seg) - length) for seg, who in shared.items() for digest, first in who)
                elif shared:
                    held.append(shared)
            closed.clear()

        def sort() -> None:
            """Sort what is held in batches of strings of like length, as a batch takes as many rounds as its longest string has bytes."""
            waiting, size = sorted(held, key=lambda g: max(map(len, g))), 0
            held.clear()
            for shared in waiting:
                held.append(shared)
                size += sum(map(len, shared))
                if size >= BATCH:
                    flush()
                    size = 0
            flush()

        def close(group: dict[bytes, list[tuple[bytes, int]]]) -> int:
            for seg, who in group.items():
                if len(who) > 1:  # a segment that stands several times: all its windows are repeated
                    out.extend((digest, first, first + len(seg) - length) for digest, first in who)
            if len(group) == 1 and len(next(iter(group.values()))) > 1:
                return 0
            closed.append(group)
            return sum(map(len, group))

        mini, group, size = None, {}, 0
        for batch in batches:
            for now, digest, first, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != mini and group:
                    size += close(group)
                    group = {}
                    if size >= TRIM:
                        trim()
                        size = 0
                        if sum(len(seg) for g in held for seg in g) >= TRIM:
                            sort()
                    if len(out) > 20_000:
                        yield emit()
                mini = now
                group.setdefault(seg, []).append((digest, first))
        if group:
            close(group)
        trim()
        sort()
        yield emit()

    return run


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal stretches that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def with_count(rows: DataFrame, counts: DataFrame, key: str, part: Column, how: str) -> DataFrame:
    """``rows`` joined with one row a key of ``counts``; rows of one key are dealt by ``part``."""
    salted = counts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def shared_passages(rows: DataFrame) -> DataFrame:
    """__t (a text's digest as a number), n_strings (its passage strings) and n_shared (those that stand in another text) from rows (digest, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of this task are cut once
        for batch in batches:
            fresh = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not (t in seen or seen.add(t))]
            owner, strings = passage_strings([x for _, x in fresh])
            names = np.array([t for t, _ in fresh], np.int64)
            # one row more, named like its text, tells how often the text was cut
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([strings.view(np.int64), names])), pa.array(np.concatenate([names[owner], names]))], names=["string", "__t"])

    found = stored(map_batches(rows.select(F.xxhash64("digest").alias("__t"), "__text"), run, "string bigint, __t bigint"))
    shared = found.groupBy("string").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi")).where("lo <> hi").select("string", F.lit(1).alias("shared"))
    own = F.col("string") == F.col("__t")
    every = with_count(found, shared, "string", F.col("__t"), "left").groupBy("__t").agg(F.count_if(own).alias("cuts"), F.count_if(~own).alias("n"), F.count_if(~own & F.col("shared").isNotNull()).alias("s"))
    out = cut(every.select("__t", F.floor(F.col("n") / F.col("cuts")).alias("n_strings"), F.floor(F.col("s") / F.col("cuts")).alias("n_shared")))
    discard(found)
    return out


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 and n_passages for each row; with ``with_text`` also kept, the bytes that stay."""
    source = df.select(F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("__text"))
    rows = source.withColumn("digest", F.unhex(F.md5("__text")))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for each text of this task; equal texts are cut once
        for batch in batches:
            fresh = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not (d in seen or seen.add(d))]
            at = 0
            for part in _chunks([t for _, t in fresh]):
                which, mini, a, b = runs(part, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array([fresh[at + i][0] for i in which.tolist()], pa.binary()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["mini", "digest", "a", "b"])
                at += len(part)

    long_rows = rows.where(F.length("__text") >= length)
    placed = stored(map_batches(long_rows.select("digest", "__text"), to_runs, "mini bigint, digest binary, a int, b int"))
    # a run that tasks found in copies of one text is one run: least and greatest tell if there is another
    one = F.xxhash64("digest", "a")
    times = placed.groupBy("mini").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("mini", "times")
    wanted = cut(with_count(placed, times, "mini", F.struct("digest", "a"), "inner"))
    discard(placed)
    by_text = wanted.groupBy("digest").agg(F.collect_set(F.struct("mini", "a", "b", (F.col("times") > hot).alias("hot"))).alias("runs"))
    once = long_rows.groupBy("digest").agg(F.first("__text").alias("__text"), F.count(F.lit(1)).alias("n"))
    texts = stored(once.join(by_text, "digest", "left").where("runs IS NOT NULL OR n > 1").select("digest", "n", "__text", "runs"))

    def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, data, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = [r for r in found or [] if not r["hot"]]
                yield pa.RecordBatch.from_arrays([pa.array([r["mini"] for r in own], pa.int64()), pa.array([digest] * len(own), pa.binary()), pa.array([r["a"] for r in own], pa.int32()), pa.array([data[r["a"] : r["b"] + length] for r in own], pa.binary())], names=["mini", "digest", "a", "segment"])

    def to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, data, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for r in found or []:
                    if r["hot"]:
                        seg = np.frombuffer(data[r["a"] : r["b"] + length], np.uint8)
                        one = window_hashes(seg, length)
                        h = prefix_hash(seg[::-1])  # the same bytes from the other end: an independent sum
                        n = len(one)
                        two = mixed((h[length:] - h[:n]) * powers(INVERSE, n) ^ U(0x5DEECE66D))[::-1]
                        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.ascontiguousarray(two).view(np.int64)), pa.array([digest] * n, pa.binary()), pa.array(np.arange(r["a"], r["a"] + n, dtype=np.int32))], names=["x", "y", "digest", "a"])

    picked = texts.select("digest", "__text", "runs")
    segments = map_batches(picked, to_segments, "mini bigint, digest binary, a int, segment binary").repartition("mini").sortWithinPartitions("mini")
    found = map_batches(segments, _sorted_groups(length), "digest binary, a int, b int")
    if wanted.where(F.col("times") > hot).limit(1).count():
        windows = map_batches(picked, to_windows, "x bigint, y bigint, digest binary, a int")
        twice = windows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("x", "y")
        found = found.unionByName(windows.join(twice, ["x", "y"]).select("digest", "a", F.col("a").alias("b")))
    ranges = cut(found).groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def to_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, n, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [(0, len(data))] if n > 1 else covered([(r["a"], r["b"]) for r in found or []], length)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((digest, len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["digest", "removed", "spans", "sha", "rest"])

    changed = map_batches(texts.select("digest", "n", "__text").join(ranges, "digest", "left"), to_rest, "digest binary, removed bigint, spans bigint, sha string, rest binary")
    plain = rows.select("__id", "digest", F.length("__text").cast("long").alias("n_bytes"), F.sha2("__text", 256).alias("__sha"), *([F.col("__text")] if with_text else []))
    # no text with fewer bytes has so many words
    passable = rows.where(F.length("__text") >= 2 * PASSAGE - 1)
    copies = passable.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("__copied"))
    passages = shared_passages(passable)
    out = plain.join(changed, "digest", "left").join(copies, "digest", "left").withColumn("__t", F.xxhash64("digest")).join(passages, "__t", "left")
    kept = [F.coalesce("rest", "__text").alias("kept")] if with_text else []
    # a text that another document repeats has all its passages there
    told = F.coalesce(F.when(F.coalesce("__copied", F.lit(False)), F.col("n_strings")).otherwise(F.col("n_shared")), F.lit(0)).cast("long")
    return out.select(F.col("__id").alias(key), "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "__sha").alias("kept_sha256"), told.alias("n_passages"), *kept)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove 400-byte strings that ``documents`` repeats."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
