"""Counts against plain Python; the learner on made-up statistics."""

import collections
import re

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.quality import STATISTICS, DecisionList, Rule, judge, learn, learn_from, op9_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 12, "a\nb\na\n\n a\n", "é #$ 漢字|<>&*% \x0b\x0c q", " lead and trail \r\n", "a b c d e f a b c d e f g b c d e f", "l1 x\nl1 x \nl1 x", "  　 a\x1cb"]


def test_counts(spark, sf_dir):
    rows = list(enumerate(TEXTS)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in judge(df, DecisionList(())).collect()}
    for i, text in rows:
        n = brute(text)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n, text
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and got[i].kept == (not got[i].base_failed)


def test_long_text(spark):
    text = " ".join(f"w{i % 9000}" for i in range(30_000)) + " end"
    row = judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), DecisionList(())).first()
    assert row.n_repeat_words == brute(text)[4]


def test_learner_finds_thresholds():
    rnd = np.random.default_rng(3)
    names = list(STATISTICS)
    x = rnd.random((4000, len(names)))
    bad = (x[:, 2] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 4] < 0.3))
    rules = learn(x, bad, np.arange(4000) % 3 == 0, names)
    hit = np.zeros(4000, bool)
    for r in rules.rules:
        inside = np.ones(4000, bool)
        for name, above, bound in r.conditions:
            v = x[:, names.index(name)]
            inside &= v >= bound if above else v <= bound
        hit |= inside
    assert (hit == bad).mean() > 0.98 and 2 <= len(rules.rules) <= 6
    assert learn(x, np.zeros(4000, bool), np.arange(4000) % 3 == 0, names).rules == ()


def test_rules_as_expressions(spark):
    df = spark.createDataFrame([(1, "A B C D E F G H I J K"), (2, "a b c d e f g h i j k")], "doc_id long, text string")
    rules = DecisionList((Rule((("upper_share", True, 0.5), ("n_words", True, 3.0))),))
    assert {r.doc_id: r.kept for r in judge(df, rules).collect()} == {1: False, 2: True}


def test_query_and_plan(spark, sf_dir):
    df = op9_quality(spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert sum(good) >= 0.95 * len(good)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert learn_from(docs, labels).rules == () and judge(docs, DecisionList(())).count() == 0


def test_lines_keep_the_edges_of_the_text(spark):
    texts = ["x\nx ", "x\r\nx\r\n", " x\nx", "\nx\nx\n"]
    got = {r.doc_id: r.n_dup_lines for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), DecisionList(())).collect()}
    assert [got[i] for i in range(4)] == [brute(t)[3] for t in texts] == [0, 1, 0, 1]


def test_edges_of_lines(spark):
    texts = [" a b\n a b", "a b\na b ", "  x y z\n  x y z\nq", "a\x0bb\na\x0bb\x0b", "p q\np q\t\n"]
    got = {r.doc_id: r.n_dup_lines for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), DecisionList(())).collect()}
    assert [got[i] for i in range(5)] == [brute(t)[3] for t in texts] == [1, 0, 1, 0, 0]


def test_verdicts_by_plain_rules(spark, sf_dir):
    """kept against the learned list, followed rule by rule in Python on counts made there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id: r.kept for r in op9_quality(spark, sf_dir).collect()}
    share = lambda a, b: a / b if b else 0.0
    for r in docs.collect():
        text = r.text or ""
        words, chars, symbols, dups, repeats = brute(text)
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        stats = {
            "n_words": words, "mean_word": share(chars, words), "symbols_per_word": share(symbols, words), "upper_share": share(sum(c.isupper() for c in text), chars), "marks_per_word": share(sum(c in "!?" for c in text), words),
            "digit_share": share(sum(c in "0123456789" for c in text), chars), "dup_line_share": share(dups, len(lines)), "distinct_share": share(len(set(w)), words), "repeat_share": share(repeats, words), "words_per_line": share(words, len(lines)),
        }
        rejected = any(all(stats[n] >= b if above else stats[n] <= b for n, above, b in rule.conditions) for rule in rules.rules)
        assert kept[r.doc_id] == (not (words < 10 or 100 * repeats > 20 * words) and not rejected), text
