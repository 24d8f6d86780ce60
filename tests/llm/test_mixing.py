"""Targets and draws against plain Python."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm.mixing import SQL, amounts, mix, op3_mixing


def water(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Rounds as stated: share out, stop at most, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def fixture(spark, per=(900, 30, 5, 1, 0)):
    rows, n = [], 0
    for s, k in zip(["b", "a", None, "c", "z"], per, strict=True):
        for i in range(k):
            n += 1
            rows.append((n, s, "w " * (1 + (i * 37) % 50)))
    rows += [(n + 1, "empty", None), (None, "a", "x y"), (None, "a", "x y"), (7, "b", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_draws(spark):
    df = fixture(spark)
    rows = amounts(df.withColumn("k", F.col("source"))).join(df.select("doc_id", "source"), "doc_id").distinct().collect()
    assert amounts(df).count() == df.count()
    sizes, taken, squares = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        squares[r.source] += r["size"] ** 2
        assert r.taken in (0, r["size"], 2 * r["size"])
    every = {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.expr("filter(split(coalesce(text, ''), ' '), x -> x != '')"))).alias("n")).collect()}
    want = water(every)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == every[r.source]
    for s in ("b", None):
        p = want[s] / every[s] % 1
        assert abs(taken[s] - want[s]) <= (p * (1 - p) * squares[s]) ** 0.5


def test_near_targets_with_few_long_documents(spark, sf_dir):
    """Nearer than one standard deviation of independent draws, for every source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = amounts(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        p = own[0].target / max(own[0].source_size, 1) % 1
        spread = (p * (1 - p) * sum(r["size"] ** 2 for r in own)) ** 0.5
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(spread, 1)


def test_draws_are_independent(spark):
    """A source of equal documents: draws hang on the id alone, and their share is the rate's fraction."""
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], "w w w") for i in range(6000)], "doc_id long, source string, text string")
    rows = amounts(df).collect()
    assert amounts(df.orderBy("text").limit(6000)).count() == 6000
    for s in "ab":
        own = [r for r in rows if (r.doc_id % 3 == 0) == (s == "b")]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)


def test_clashing_names(spark):
    df = fixture(spark).selectExpr("doc_id", "source", "text", "1 AS target", "2 AS source_size", "3 AS weight", "4 AS __of", "5 AS __row", "6 AS `a.b`", "7 AS size")
    out = mix(df)
    assert out.columns == df.columns and out.count() == mix(fixture(spark)).count() > 0
    assert {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    assert sorted(map(tuple, amounts(df).collect()), key=str) == sorted(map(tuple, amounts(fixture(spark)).collect()), key=str)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "a", "w " * 1_000_000), (2, "b", "w " * 10)], "doc_id long, source string, text string")
    assert {r.doc_id: r["size"] for r in amounts(df).collect()} == {1: 1_000_000, 2: 10}


def test_reruns_and_partitions_agree(spark):
    df = fixture(spark)
    a = sorted(mix(df).collect(), key=str)
    assert a == sorted(mix(df.repartition(7)).collect(), key=str)
    assert set(mix(df).columns) == set(df.columns)


def test_empty(spark):
    df = fixture(spark).limit(0)
    assert mix(df).count() == 0 and amounts(df).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op3_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and len(got) == len(want)
