"""Removed bytes against a plain table of all windows."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.repeats import covered, op10_repeats, passage_strings, remove_repeats, repeated_starts, runs, window_minima


def brute(rows, length):
    seen = {}
    for _, t in rows:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def made_up(rnd, n=60, alphabet="ab "):
    piece = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [piece(rnd.randint(5, 80)) for _ in range(6)]
    texts = ["".join(rnd.choice(shared) if rnd.random() < 0.4 else piece(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 6))) for _ in range(n)]
    return [*texts, texts[0], texts[0], "x" * 300, "xy" * 90, ""]


def test_minima():
    v = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 3, 64, 200):
        assert window_minima(v, w).tolist() == [int(v[i : i + w].min()) for i in range(201 - w)]
    assert len(window_minima(v, 201)) == 0


def test_runs_cover_each_start_once():
    texts = [t.encode() for t in made_up(random.Random(3))]
    which, mini, a, b = runs(texts, 20, 6)
    got = sorted((w, s) for w, x, y in zip(which.tolist(), a.tolist(), b.tolist(), strict=True) for s in range(x, y + 1))
    assert got == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 19)]
    key = {}
    for w, m, x, y in zip(which.tolist(), mini.tolist(), a.tolist(), b.tolist(), strict=True):
        assert y - x < 20
        for s in range(x, y + 1):
            assert key.setdefault(texts[w][s : s + 20], m) == m


def test_column_wise_sorting():
    rnd = random.Random(9)
    for alphabet in ("ab", "abcdefgh é"):
        for length in (1, 4, 9):
            segs = list({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(length, 30))).encode() for _ in range(60)})
            seen = {}
            for s in segs:
                for i in range(len(s) - length + 1):
                    seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
            want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in segs]
            assert [x.tolist() for x in repeated_starts(segs, length)] == want


def test_covered():
    assert covered([(0, 2), (12, 12), (3, 4)], 10) == [(0, 22)] and covered([(0, 0), (11, 11)], 10) == [(0, 10), (11, 21)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_all_windows(spark, hot):
    texts = made_up(random.Random(5), alphabet="ab é")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (0, texts[0])], "doc_id long, text string")
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    got = sorted(map(tuple, remove_repeats(df, length=20, gram=6, hot=hot).drop("n_passages").collect()), key=str)
    assert got == brute(rows, 20)
    for r in remove_repeats(df, length=20, gram=6, hot=hot, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_repeats(spark, sf_dir).drop("n_passages").collect()), key=str) == brute(rows, 400)


def plain_strings(text, words=24, passage=51):
    """The passage strings as tuples, by the hash that the operator orders them by."""
    w = text.split()
    one = {}
    for i in range(len(w) - words + 1):
        owner, h = passage_strings([" ".join(w[i : i + words]).encode()], words, words)
        one[i] = int(h[0])
    return {min(one[i] for i in range(a, a + passage - words + 1)) for a in range(len(w) - passage + 1)}


def test_passage_strings():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (0, 5, 50, 51, 80, 300)] + ["é \n x" * 60]
    owner, h = passage_strings([t.encode() for t in texts])
    got = {}
    for o, x in zip(owner.tolist(), h.tolist(), strict=True):
        got.setdefault(o, set()).add(x)
    assert got == {i: s for i, t in enumerate(texts) if (s := plain_strings(t))}


def test_passages_of_over_fifty_words(spark):
    """Shorter than 400 bytes, so nothing is removed, but each document that holds one is told; others aren't."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    passages = [" ".join(word() for _ in range(rnd.randint(51, 60))) for _ in range(5)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(rnd.randint(30, 200))]
        at = rnd.randrange(len(own))
        rows.append((i, " ".join(own[:at] + ([passages[i % 5]] if i < 40 else []) + own[at:])))
    rows += [(200, rows[100][1]), (201, " ".join(rows[101][1].split()[:23]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    long = {k for k, t in rows if len(t.split()) > 50}
    assert {k for k, r in got.items() if r.n_passages > 0} == {*range(40), *({100, 200} & long)}
    assert all(r.n_removed == 0 for k, r in got.items() if k not in (100, 200))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    clash = spark.createDataFrame([(1, "a" * 500, "x", 5), (2, "a" * 450, None, 6)], "doc_id long, text string, digest string, n int")
    assert {r.doc_id: r.n_removed for r in remove_repeats(clash).collect()} == {1: 500, 2: 450}
