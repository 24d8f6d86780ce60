"""Recall, order and scores against brute force."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tessera.llm")
from pyspark.sql import functions as F

from tessera.llm.ann import Shard, nearest, op7_ann


def brute(ids, x, q_ids, q, k):
    out = {}
    for i, v in zip(q_ids, q, strict=True):
        s = (x * v).sum(axis=1)
        keep = ids != i
        o = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(i)] = [(int(a), float(b)) for a, b in zip(ids[keep][o], s[keep][o], strict=True)]
    return out


def shard_recall(ids, x, n_queries, k=20):
    longest = float(np.sqrt((x * x).sum(1).max()))
    shard = Shard.of(ids, x, longest)
    again = Shard.read(pd.DataFrame(list(shard.pieces(512))).sample(frac=1, random_state=1), x.shape[1], longest)
    q, i, s = again.search(ids[:n_queries], x[:n_queries], k)
    assert all((a == b).all() for a, b in zip((q, i, s), shard.search(ids[:n_queries], x[:n_queries], k), strict=True))
    want = brute(ids, x, ids[:n_queries], x[:n_queries], k)
    got = {}
    for a, b, c in zip(q.tolist(), i.tolist(), s.tolist(), strict=True):
        got.setdefault(a, []).append((b, c))
    for v in got.values():
        assert v == sorted(v, key=lambda t: (-t[1], t[0]))
    return sum(len({a for a, _ in got[k]} & {a for a, _ in v}) for k, v in want.items()) / (k * n_queries)


def test_shard_recall_with_norms_and_copies():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 24)) * rng.lognormal(0, 0.4, (4000, 1))
    x[500:900] = x[500]
    assert shard_recall(rng.permutation(4000).astype(np.int64), x, 100) >= 0.95


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_on_hard_vectors(spread):
    """Gaussian vectors have no clusters to be led by; with spread norms a few vectors are near to all queries."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 64)) * rng.lognormal(0, spread, (12_000, 1))
    assert shard_recall(np.arange(12_000), x, 100) >= 0.93


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    q = ids % 20 == 0
    want = brute(ids, x, ids[q], x[q], 20)
    got = {}
    for r in op7_ann(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert sum(len({a for a, _ in got[k]} & {a for a, _ in v}) for k, v in want.items()) >= 0.95 * sum(map(len, want.values()))
    for k, v in got.items():
        assert len(v) == len(want[k])
        assert all(abs(s - float((x[ids == i][0] * x[ids == k][0]).sum())) < 1e-12 for i, s in v)


def test_cases(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (20, [1.0, 1.0]), (40, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (60, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    # queries without candidates, candidates without queries, an extra column with a clashing name
    clash = df.selectExpr("vec_id", "embedding", "1 AS __id", "2 AS rank")
    assert nearest(clash, F.lit(False)).count() == 0
    assert nearest(clash, F.col("vec_id") % 20 == 0, k=3).count() == 6
    assert nearest(df.where("vec_id = 20"), F.lit(True)).count() == 0
