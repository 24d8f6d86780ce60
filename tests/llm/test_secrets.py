"""Base spans against a plain scan; linking on hand-made texts."""

import re

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.secrets import find_spans, linked_spans, masked, redact, scan, written

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
BARE = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def brute(text):
    """Runs found character by character."""
    out = []
    for kind, head, more, least in ((1, "AKIA", r"[A-Z0-9]", 16), (2, "", r"[0-9a-f]", 32)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i):
                while j < len(text) and re.match(more, text[j]):
                    j += 1
            if text.startswith(head, i) and j > i + len(head):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out)


def test_base_kinds():
    text = f'é password = "hunter2hunter2" {KEY} {"0af" * 11} token: short API-KEY=12345678 api_key=12345678 Api_Key:"abcdefgh" x'
    base, _ = find_spans(text)
    assert [s for s in base if s[1]] == brute(text)
    assert [text[s:e] for s, k, e in base if k == 0] == ['password = "hunter2hunter2', 'api_key=12345678', 'Api_Key:"abcdefgh']
    assert not find_spans("ſecret=12345678")[0]


def test_failing_match_consumes():
    assert find_spans("token=a secret=12345678")[0] == [(8, 0, 23)]
    assert find_spans("token=short token=longenough")[0] == [(12, 0, 28)]


def test_linking_needs_complements():
    assert linked_spans(f"x {BARE} y", []) == []
    base, every = find_spans(f"{KEY} {BARE} s3.eu-1.amazonaws.com")
    assert [k for _, k, _ in every] == [1, 3, 4]
    assert set(base) <= set(every)
    assert [k for _, k, _ in find_spans(f"{KEY} s3.eu-1.amazonaws.com")[1]] == [1]  # no secret, so no endpoint
    assert [k for _, k, _ in find_spans(f"{KEY}\n\n{BARE}")[1]] == [1]  # another paragraph
    assert [k for _, k, _ in find_spans(f"{KEY} {'x ' * 300}{BARE}")[1]] == [1]  # too far away


def test_mask():
    text = f"a {KEY} b"
    assert masked(text, find_spans(text)[1]) == "a [SECRET] b"
    assert masked("abcdef", [(1, 0, 4), (2, 2, 5)]) == "a[SECRET]f"


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 7), (None, f"x {KEY}", 22), (2, "", 0), (2, "", 0), (3, f"é {KEY}", 5)], "doc_id long, text string, n_chars long")
    rows = {(r.doc_id, r.spans) for r in scan(df, "text", "doc_id").collect()}
    assert rows == {(1, ""), (None, "access:2:22"), (2, ""), (3, "access:2:22")}
    got = {(r.doc_id, r.text, r.n_chars) for r in redact(df).collect()}
    assert got == {(1, None, 7), (None, "x [SECRET]", 10), (2, "", 0), (3, "é [SECRET]", 5)}
    assert redact(df).columns == df.columns and redact(df.limit(0)).count() == 0
    assert written([(1, 0, 2)]) == "assign:1:2"


def test_long_text():
    base, every = find_spans((f"{KEY} {BARE} " + "word " * 100) * 2000)
    assert len(base) == 2000 and len(every) == 4000


def all_matches(text):
    """Base spans by trying every start, in plain loops."""
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    out, i = [], 0
    while i < len(text):
        name = max((n for n in names if text[i : i + len(n)].isascii() and text[i : i + len(n)].lower() == n), key=len, default=None)
        j = None
        if name:
            k = i + len(name)
            k += text[k : k + 1] in ("'", '"')
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "="):
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"')
                j = k
                while j < len(text) and re.match("[A-Za-z0-9+/_.=-]", text[j]):
                    j += 1
                if j - k >= 8:
                    out.append((i, 0, j))
                j = j if j > k else None
        i = j or i + 1
    return sorted(out + brute(text))


def linked_by_pairs(text, base, scope=400):
    """Weak candidates by looking at every pair of parts."""
    from tessera.llm.secrets import BARE as WEAK
    from tessera.llm.secrets import ENDPOINT, paragraph_starts

    starts = paragraph_starts(text)
    paragraph = lambda p: sum(s <= p for s in starts)
    near = lambda a, parts: any(a != p and max(p[0] - a[1], a[0] - p[1]) <= scope and paragraph(a[0]) == paragraph(p[0]) for p in parts)
    of = lambda k: [(s, e) for s, kind, e in base if kind == k]
    bare = [(m.start(), m.end()) for m in WEAK.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)]
    bare = [p for p in bare if near(p, of(1)) and re.search("[a-z]", text[slice(*p)]) and re.search("[A-Z]", text[slice(*p)]) and re.search("[0-9]", text[slice(*p)])]
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    ends = [p for p in ends if near(p, of(1)) and near(p, [*bare, *of(0), *of(2)])]
    return sorted([(s, 3, e) for s, e in bare] + [(s, 4, e) for s, e in ends])


def made_up(rnd):
    parts = [KEY, BARE, "https://x.internal/a", "db.local:80", "0af" * 12, "password=hunter22", "token: 'abcd1234", f"secret={'0af' * 12}.{'1be' * 11}.{'2cd' * 11}.{BARE}", "words and more words", "\n\n", "\n", "x" * 450, "apikey=short"]
    return " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))


def test_against_plain_loops():
    import random

    rnd = random.Random(6)
    found = 0
    for _ in range(1500):
        text = made_up(rnd)
        base, every = find_spans(text)
        assert base == all_matches(text), text
        assert sorted(set(every) - set(base)) == linked_by_pairs(text, base), text
        found += len(every) - len(base)
    assert found > 200


def test_span_that_reaches_over_others():
    """A weak candidate inside a long assignment isn't free, however many spans start in between."""
    text = f"{KEY} password={'0af' * 12}.{'0af' * 12}.{'0af' * 12}.{'0af' * 12}.{BARE}"
    base, every = find_spans(text)
    assert base == every


def test_query(spark):
    import hashlib

    from tessera.llm.secrets import op5_secrets

    sf_dir = "/root/testdata/sf0.01"  # the smallest table holds no secret
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base = all_matches(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert r.spans == written(sorted(base + linked_by_pairs(texts[r.doc_id], base)))
