"""Classes and link counts against all pairs."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.components import connected_components
from tessera.llm.hashing import shingles, window_hashes
from tessera.llm.jaccard import depth_for, forest, found_with, jaccard_classes, measured_recall, op6_jaccard, shared_counts, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """All pairs that share a shingle, by an inverted list."""
    sets = [shingle_set(t) for _, t in rows]
    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    pairs = {(a, b) for v in lists.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, least[root(i)], links[i]) for i, (k, _) in enumerate(rows))


def test_shingles_match_tuples():
    texts = ["a b c d e f", "a b c d e f", "f e d c b a", "", " \n ", "x", "x y", "a b c d e a b c d e", "é ü\x0bß\x1cx 漢 a b"]
    got = shingles([t.encode() for t in texts])
    for a, ta in zip(got, texts, strict=True):
        assert len(a) == len(shingle_set(ta))
        for b, tb in zip(got, texts, strict=True):
            assert len(np.intersect1d(a, b)) == len(shingle_set(ta) & shingle_set(tb))
    data = np.frombuffer(b"abcabcabcd", np.uint8)
    h = window_hashes(data, 3)
    assert len(h) == 8 and h[0] == h[3] == h[6] and len(set(h.tolist())) == 4


def test_shared_counts():
    rnd = np.random.default_rng(5)
    for n, universe in ((3, 20), (80, 60), (120, 400)):
        sets = [np.unique(rnd.choice(universe, rnd.integers(1, universe), replace=False)).astype(np.uint64) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert (shared_counts(sets) == np.array(want)).all()


def test_forest_and_depth():
    hit = np.zeros((5, 5), bool)
    hit[0, 2] = hit[2, 0] = hit[2, 4] = hit[4, 2] = True
    assert sorted(j for _, j in forest(hit)) == [2, 4]
    assert depth_for(0.8) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    rows = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def made_up():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((n := n + 1, " ".join(copy)))
            if rnd.random() < 0.3:
                rows.append((n := n + 1, "\n".join(copy)))
    return [*rows, (n + 1, None), (n + 2, ""), (n + 3, "one"), (n + 4, "one"), (n + 4, "one")]


@pytest.mark.parametrize("block", [2000, 3])
def test_against_all_pairs(spark, block):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(df, block=block).collect())) == brute(rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_jaccard(spark, sf_dir).collect())) == brute(rows)


def test_empty(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_until_the_recall_is_reached():
    bins = np.zeros(64)
    assert measured_recall(bins, 0.8, 8, 16) == pytest.approx(found_with(0.8, 8, 16))
    bins[60] = 10_000  # close copies alone: whole signatures find them
    assert measured_recall(bins, 0.8, 8, 16) > 0.9997
    bins[0] = 5_000  # links at the threshold: they don't
    assert measured_recall(bins, 0.8, 8, 16) < 0.99 and measured_recall(bins, 0.8, 4, 16) >= 0.9997
    assert found_with(0.8, depth_for(0.8), 16) >= 0.9997 > found_with(0.8, depth_for(0.8) + 1, 16)


def test_recall_of_signatures():
    """Pairs of a given similarity share prefixes as often as the estimate says."""
    rnd = np.random.default_rng(7)
    sets = []
    for _ in range(400):  # 4 of 5 shared: similarity 0.8
        common, a, b = np.split(rnd.integers(0, 1 << 63, 120, dtype=np.uint64), [96, 108])
        sets += [np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))]
    signs = signatures(sets)
    for depth in (8, 6, 4):
        met = np.mean([any(x[t * 16 : t * 16 + 2 * depth] == y[t * 16 : t * 16 + 2 * depth] for t in range(16)) for x, y in zip(signs[::2], signs[1::2], strict=True)])
        assert abs(met - found_with(0.8, depth, 16)) < 0.03


@pytest.mark.parametrize("recall", [0.5, 0.999999])
def test_links_are_exact_and_counted_once(spark, recall):
    """Whatever the target, what is reported is a true link counted once; a high target finds all."""
    rows = made_up()
    got = sorted(map(tuple, jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=recall).collect()))
    want = brute(rows)
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert sum(g[2] for g in got) >= 0.9 * sum(w[2] for w in want)
    if recall > 0.99:
        assert got == want
