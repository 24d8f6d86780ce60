"""The stages on the smallest tables, each against plain Python on its own input."""

import hashlib

import pytest

pytest.importorskip("tessera.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_quality import brute as brute_counts

from tessera.llm.bpe import TrieBpe, default_path
from tessera.llm.secrets import find_spans, masked


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    a, b = map(texts, kept[0])
    assert set(b) <= set(a) and len(b) > 0.7 * len(a)
    assert not any(n[0] < 10 or 100 * n[4] > 20 * n[0] for n in map(brute_counts, b.values()))
    a, b = map(texts, kept[1])
    assert set(b) == {c for _, c, _ in brute_classes(sorted(a.items()))}
    a, b = map(texts, kept[2])
    assert b == {k: masked(v, find_spans(v)[1]) for k, v in a.items()}
    a, b = map(texts, kept[3])
    assert set(b) <= set(a) and kept[3][1].count() > len(a)
    rows = kept[4][1].collect()
    bpe = TrieBpe(default_path())
    assert len(rows) == kept[3][1].count()
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(bpe.encode_batch([b[r.doc_id]])[0]).hexdigest()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_duplicates_with_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, "x " + text, "a", "s", 1), (None, text, "a", "s", 1), (4, text, "a", "s", 1), (4, text, "a", "s", 1), (4, "something else that is not like it", "a", "s", 1), (5, text, "b", "t", 2), (6, None, "b", "t", 2), (7, "", "b", "t", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id for r in rows if r.doc_id is not None)) == [4, 4, 6, 7]
