"""Queries that have to cover whole tables and whole texts: made-up tables on which a cut shows."""

import hashlib
import re

import pytest

from tessera.plans import load_catalog

QUERIES = load_catalog().QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    def put(**rows):
        for name, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_bm25_searches_all_languages(spark, tables):
    docs = [(1, "the harbour lights", "de"), (2, "harbour", None), (3, "nothing here", "en"), (4, "green harbour boats", "en")]
    d = tables(documents=(docs, "doc_id long, text string, lang string"), benchmark=([(8, "harbour lights")], "item_id long, text string"))
    got = QUERIES["bm25_topk"](spark, d).orderBy("rank").collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and got[0].doc_id == 1
    row = QUERIES["recall_mrr"](spark, d).first()
    assert (row.cases, row.recall, row.mrr, row.no_evidence) == (1, 1.0, 1.0, 0.0)


def test_cap_by_whole_templates(spark, tables):
    replies = [f"shall we go {i}?" for i in range(12)] + [f"shall we go {'abcdefghijklm'[i] * 9} today?" for i in range(13)]
    turns = [(1, 0, "system", "s")] * 8 + [x for r in replies for x in ((1, 0, "user", "hello there"), (1, 0, "assistant", r))]
    d = tables(conversations=([(c, i, role, t) for i, (c, _, role, t) in enumerate(turns)], "conv_id long, turn long, role string, text string"))
    rows = QUERIES["repetition_cap_decisions"](spark, d).collect()
    short = [r for r in rows if int(r.sample_id.split(":")[1]) < 8 + 24]
    assert len(rows) == 25 and len(short) == 12
    assert sum(r.selected for r in short) == 3 and all(r.selected for r in rows if r not in short)
    assert {r.reasons for r in rows if not r.selected} == {"repetitive_template_cap"}


def test_masks_whole_texts(spark, tables):
    long = "x " * 40_000 + "password=hunter2"
    texts = [long, "access_token=abc, y", '{"password": "p q"}', "Bearer  ab.c;", "token word", None]
    d = tables(documents=(list(enumerate(texts)), "doc_id long, text string"))
    want = [long.replace("hunter2", "[REDACTED]"), "access_token=[REDACTED], y", '{"password": "[REDACTED] q"}', "Bearer  [REDACTED];", "token word", None]
    got = {r.doc_id: r.masked_sha256 for r in QUERIES["masked_texts"](spark, d).collect()}
    assert [got[i] for i in range(6)] == [w and hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_documents_are_counted_whole(spark, tables):
    texts = ["a b c a b c", "", "long " * 3000 + "end Ünï_1", "x"]
    d = tables(documents=(list(enumerate(texts)), "doc_id long, text string"))
    counts = lambda name: {r.doc_id: r.n for r in QUERIES[name](spark, d).collect()}
    joined = [re.sub(r"\W+", "", t) for t in texts]
    assert counts("document_bigram_counts") == {i: len({s[k : k + 2] for k in range(len(s) - 1)}) for i, s in enumerate(joined)}
    words = [re.findall(r"\w+|[^\w\s]", t.lower()) for t in texts]
    assert counts("document_shingle_counts") == {i: len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for i, w in enumerate(words)}
    assert {r.token: r.n for r in QUERIES["document_token_counts"](spark, d).collect()}["long"] == 3000


def test_dates_of_whole_documents(spark, tables):
    pad = "word " * 50
    texts = [pad + x for x in ("2021-05-06", "2021-02-30", "3月5日", "in 1999", "昨天", "none")]
    d = tables(documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.value, r.precision) for r in QUERIES["document_dates"](spark, d).collect()}
    assert [got[i] for i in range(6)] == [("2021-05-06", "day"), ("2021-02", "month"), ("--03-05", "month_day"), ("1999", "year"), ("2023-12-31", "day"), (None, "unknown")]
