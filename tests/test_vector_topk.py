"""Vector searches by products of matrices equal the joins of all pairs: copies, odd vectors, several blocks; and compare without a join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rt
from tessera.plans import load_catalog

QUERIES = load_catalog().QUERIES


def joined(e, q, score, lexical, least):
    pairs = e.join(q.withColumnRenamed("embedding", "q"), "label").where("query_id <> vec_id").select("query_id", "vec_id", F.round(rt.cosine(F.col("q"), F.col("embedding")), 6).alias("semantic"), lexical.cast("double").alias("lexical"))
    if score is None:
        pairs = pairs.withColumnRenamed("semantic", "score")
    else:
        pairs = rt.hybrid(pairs, "query_id").where(rt.fallback_guard(F.col("lexical"), F.col("semantic")) if score.guard else F.lit(True)).withColumn("score", F.round("score", 6))
    return rt.top_k(pairs.select("query_id", "vec_id", "score"), "query_id", "score", [F.col("vec_id")], 7, least)


SCORES = {"cosine": (None, None), "hybrid": (rt.Hybrid(lambda q, k: np.fmod(k * 7 + q, 11)), 0.2), "guarded": (rt.Hybrid(lambda q, k: np.fmod(k * 7 + q, 11), guard=True), 0.3)}


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", sorted(SCORES))
def test_equals_the_join(spark, monkeypatch, name, odd):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 20)
    rnd, rows = random.Random(4), []
    base = [[rnd.choice((-1.0, 0.0, 0.5, 1.0, rnd.gauss(0, 1))) for _ in range(6)] for _ in range(40)]
    for i in range(400):
        v = list(rnd.choice(base)) if i % 3 else [rnd.gauss(0, 1) for _ in range(6)]
        if odd and i % 8 == 0:
            v = rnd.choice((None, [], v[:4], [None, *v[1:]], [float("nan")] * 6, [1e200] * 6))
        rows.append((i, None if i % 50 == 7 else i % 4 if i % 9 else 99, [0.0] * 6 if i % 60 == 1 else v))
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    q = e.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    score, least = SCORES[name]
    lexical = (F.col("vec_id") * 7 + F.col("query_id")) % 11
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in df.collect())
    want = key(joined(e, q, score, lexical, least))
    got = key(rt.vector_topk(e, q, "vec_id", "query_id", "label", "embedding", 7, score, lexical.cast("double"), least))
    assert want and got == want


@pytest.mark.parametrize("name", ["cosine_topk", "hybrid_topk", "guarded_hybrid_topk"])
def test_pairs_are_not_joined(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "Join" not in plan


def test_rounds_as_spark_does(spark):
    rnd = random.Random(2)
    x = [rnd.uniform(-1, 1) for _ in range(2000)] + [k / 1e6 + 5e-7 for k in range(-2000, 2000)] + [0.0, -0.0, 1.0, -1.0]
    want = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("y")).collect()]
    assert rt._rounded(np.array(x)).tolist() == want
