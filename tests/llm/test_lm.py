"""Counts and base scores against plain Python; the model against the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.llm.lm import CLASSES, END, SHAPES, Tokens, class_logs, op1_lm, score, shape_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def base(rows):
    c = Counter(t for _, held, text in rows if not held for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for ts in (tokens(x[2]) for x in rows)]


def test_token_arrays():
    classes = np.arange(SHAPES) % (CLASSES - 2) + 1
    t = Tokens([b"ab c\nd.", b"", b" x "], classes)
    assert np.bincount(t.text).tolist() == [4, 1, 2]
    assert [int(t.cls[i]) for i in t.at] == [classes[shape_of(w)] for w in (b"ab", b"c", b"d.")] + [0, 0, classes[shape_of(b"x")], 0]
    f = t.features(0, 7)
    assert (f[0, 1:] == f[4, 1:]).all() and (f[0] == f[5]).all() and f.max() < lm.ROWS
    p = np.exp(class_logs(np.random.default_rng(0).standard_normal((lm.ROWS, CLASSES)).astype(np.float32), f))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("frequent", [300_000, 50])
def test_query(spark, sf_dir, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_lm(spark, sf_dir).collect()}
    rows = [(k, zlib.crc32(str(k).encode()) % 5 == 1, t) for k, t in docs.items()]
    for (k, held, _), (n, known, total, s) in zip(rows, base(rows), strict=True):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(s, rel=1e-9)
    held = [got[k] for k, h, _ in rows if h]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_cases(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "A b\x0bB É"), (3, "w " * 30_000), (4, "x" * 100_000)], "doc_id long, text string")
    rows = [(r.doc_id, r.doc_id == 2, r.text) for r in df.collect()]
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score(df, F.col("doc_id") == 2).collect()))
    assert got == sorted((a, b, c, round(s, 6)) for a, b, c, s in base(rows))
    assert score(df.limit(0), F.lit(True)).count() == 0
    assert all(r.base_score == r.base_score for r in score(df, F.lit(True)).collect())


def test_own_logs_by_table():
    classes = np.random.default_rng(1).integers(1, CLASSES, SHAPES)
    t = Tokens([b"a b c d e f g", b"", b"x y", b"a b c d e f g"], classes)
    w = np.random.default_rng(2).standard_normal((lm.ROWS, CLASSES)).astype(np.float32)
    own = t.cls[t.at]
    want = class_logs(w, t.features(0, len(t.at)))[np.arange(len(own)), own]
    assert np.allclose(t.own_logs(w, lm.context_table(w), 0, len(t.at)), want, atol=1e-4)
