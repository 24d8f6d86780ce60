"""Folding, matching against a plain scan, and held-out accuracy."""

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.toxicity import Lexicon, choose, fold, learn, op2_toxicity, score, words_of


def test_folding():
    assert words_of("1D10T ｉｄｉｏｔ іdіоt id!ot 2024 don't") == ["idiot", "idiot", "idiot", "idiot", "2024", "don", "t"]
    assert fold("Réeux") == "réeux"
    assert words_of("") == []


def plain(lexicon, text):
    words = words_of(text)
    total = hits = 0
    for i, w in enumerate(words):
        if any(p.split() in (words[i : i + 2], words[max(0, i - 1) : i + 1]) for p in lexicon.exceptions):
            continue
        found = [v for t, v in lexicon.weights.items() if (w == t[:-1] if t.endswith(" ") else w.startswith(t))]
        if found:
            total, hits = total + max(found), hits + 1
    return total, hits


def test_matching():
    lx = Lexicon({"idiot ": 5.0, "réeux": 4.0, "réeuxla ": 6.0, "scum": 2.0}, frozenset({"no idiot", "scum pond"}))
    for text in ("idiot", "an idiotic idiot", "no idiot idiot", "scum pond scum", "Réeuxla réeuxvi xréeux", "", "scum scum\nscum", "no idiot no idiot"):
        total, _, hits = lx.features(text)
        assert (total, hits) == plain(lx, text), text


def test_choice_prefers_stems_that_say_what_they_catch():
    got = choose([("dis", 50, 0), ("disgusting ", 50, 0), ("the", 60, 400), ("réeux", 40, 1), ("réeuxla ", 6, 0)], 100, 1000)
    assert set(got) == {"disgusting ", "réeux"} or set(got) == {"dis", "réeux"}
    assert choose([("x", 2, 0)], 100, 1000) == {}


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = op2_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a " * 50_000), (3, "a " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(9, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    lx = learn(docs, labels)
    rows = score(docs, lx).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert score(docs.limit(0), lx).count() == 0
    assert learn(docs, labels.limit(0)).weights == {}


def test_held_out_recall_and_precision(spark):
    """Better than any rule that ignores the text: most toxic rows are found and most found rows are toxic."""
    d = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, d).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.7 * sum(y for _, y in held) and hits >= 0.8 * sum(p for p, _ in held)


def test_counts_behind_the_lexicon(spark):
    """Document counts of candidate terms against plain Python."""
    import collections

    from tessera.llm.toxicity import _count_terms, stems, words_of

    texts = [("you idi0t", 1), ("idiot idiot", 1), ("the IDIOT", 1), ("idiotic", 1), ("the end", 0), (None, 0), ("a quiet idiom", 0)]
    counts, bad, good = _count_terms(spark.createDataFrame(texts, "__text string, __y int"))
    want = collections.defaultdict(lambda: [0, 0])
    for t, y in texts:
        for s in {s for w in words_of(t or "") for s in stems(w)}:
            want[s][1 - y] += 1
    assert (bad, good) == (4, 3)
    assert {t: (b, g) for t, b, g in counts} == {t: (b, g) for t, (b, g) in want.items() if b >= 4 and b > g}
