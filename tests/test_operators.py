"""Operators that no SQL says, against plain Python and hand-made rows."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import privacy
from tessera.functions import text as tx
from tessera.operators import dedup, features, metrics, packing, records, sessions
from tessera.sources import chat, sinks
from tessera.streaming import events as se


def ts(minute):
    return dt.datetime(2026, 9, 1) + dt.timedelta(minutes=minute)


def test_session_bounds(spark):
    rows = [(1, ts(0), 1), (1, ts(120), 2), (1, ts(241), 3), (2, ts(0), 4)]
    df = spark.createDataFrame(rows, "owner long, ts timestamp, id long")
    got = {r.id: r.session_no for r in sessions.gap_sessions(df, "owner", "ts", "id", 120).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def test_duration_cap_against_a_loop(spark):
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(200):
        t += rnd.choice([0, 10, 59, 60, 61, 130])
        rows.append((1, ts(t), i))
    got = {r.id: r.session_start for r in sessions.capped_sessions(spark.createDataFrame(rows, "owner long, ts timestamp, id long"), "owner", "ts", "id", 120, 300).collect()}
    start = before = None
    first = min(got.values())
    for _, at, i in rows:
        if before is None or at - before > dt.timedelta(minutes=120) or at - start > dt.timedelta(minutes=300):
            start = at
        before = at
        assert got[i] - first == (start - rows[0][1]) // dt.timedelta(microseconds=1)


def test_turns(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", None), (1, 3, "b", "y"), (1, 4, "a", "z")], "c long, t long, role string, text string")
    got = [(r.turn_no, r.role, r.n_messages, r.text) for r in sessions.merge_turns(df, ["c"], ["t"], "role", "text").orderBy("turn_no").collect()]
    assert got == [(1, "a", 2, "x\n"), (2, "b", 1, "y"), (3, "a", 1, "z")]


def test_redaction(spark):
    text = "call 13812345678 or a.b@c.org password: hunter22 id 11010119900307123X card 6222021234567890 at 31.23041, 121.47371 ip 10.0.0.1 地址：上海市某路1号。wxid_ab1 @bob https://ex.org:80/x?y"
    df = spark.createDataFrame([(1, text), (2, None), (3, "tokenizer self target")], "id long, text string")
    rows = {r.id: r for r in privacy.with_redaction(df, "text").collect()}
    assert rows[1].categories == sorted({c for _, c, _ in privacy.STEPS} | {"link_identifier"}) and "hunter22" not in rows[1].redacted and "<LINK:ex.org>" in rows[1].redacted
    assert rows[2].redacted == "" and rows[3].redacted == "tokenizer self target"
    counts = df.select("id", *[c.alias(n) for n, c in privacy.scan("text").items()])
    got = {r.id: r for r in counts.collect()}
    assert got[3].hard_leak_count == 0 and got[1].raw_idcard_matches == 1 and got[1].raw_phone_matches == 1 and got[1].hard_leak_count >= 11


def test_scan_counts_match_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in docs.select("doc_id", "text", *[c.alias(n) for n, c in privacy.scan("text").items()]).collect()}
    for name in ("email", "phone", "ipv4", "mention", "url"):
        p = re.compile(privacy.PATTERNS[name].replace("(?iU)", "(?i)").replace("(?U)", ""))
        assert all(r[f"raw_{name}_matches"] == len(p.findall(r.text)) for r in got.values()), name


def test_split_credentials(spark):
    rows = [(1, 1, "password"), (1, 2, "abc123"), (1, 3, "验证码"), (1, 4, "123456"), (1, 6, "token"), (1, 8, "abcdef"), (1, 9, "token"), (1, 10, "self")]
    got = {r.i for r in privacy.split_credentials(spark.createDataFrame(rows, "o long, i long, t string"), "o", "i", "t").where("split_secret").collect()}
    assert got == {2, 4}


def test_text_functions(spark):
    row = spark.createDataFrame([("Hello 世界 A_1 日", "a, b c")], "x string, y string").select(tx.lexical_tokens("x").alias("t"), tx.token_shingles("y").alias("s"), tx.template(F.lit("Go 12 to 3!")).alias("k"), tx.normalized(F.lit("ｆｕｌｌ\r\n\n\n\n  x\u0000")).alias("n")).first()
    assert row.t == ["hello", "世", "界", "世界", "a_1", "日"] and row.s == ["a , b", ", b c"] and row.k == "goto#" and row.n == "full\n\n x"


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(8)
    base = [[rnd.choice("abcdefgh") for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(40)] = "z"
        rows.append((i, " ".join(w) if i % 17 else "hi"))
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] | sets[b] else rows[a][1] == rows[b][1])}
    pairs = dedup.near_pairs(df, "id", "text", 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = []
    for i, _ in rows:
        if not any((k, i) in want for k in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.greedy_kept(df, pairs, "id").collect()) == kept


def test_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 1, 2], [1, 3]), ([], [])], "g array<int>, r array<int>")
    got = df.select(metrics.token_f1(F.col("g"), F.col("r")).alias("f"), metrics.rouge_l("g", "r").alias("l"), metrics.repeated_trigram(F.col("g").cast("array<string>")).alias("t")).collect()
    assert [(round(r.f, 6), round(r.l, 6), r.t) for r in got] == [(1.0, 1.0, False), (0.4, 0.4, False), (0.0, 0.0, False)]


def test_ridge_and_simplex(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    y = x @ [2.0, -1.0] + 3 + 0.1 * rng.standard_normal(300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 5 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    got = features.ridge(df, ["a", "b"], "y", 5.0)
    assert np.allclose([got["a"], got["b"]], beta) and got["intercept"] == pytest.approx(y.mean() - beta @ x.mean(0))
    w = features.simplex_weights(df.select(F.col("y").alias("p"), (F.col("y") + 1).alias("q"), "y"), ["p", "q"], "y")
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and w[0] > 0.95


def test_chunks_and_topics(spark):
    rows = [(1, i, "user", "x" * n) for i, n in enumerate([300, 300, 300, 900, 10, 10])]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    assert [r.chunk_no for r in packing.chunk_groups(df, "c", "t", "role", "text").orderBy("t").collect()] == [0, 0, 1, 2, 3, 3]
    said = [("dinner tonight", {1}, set()), ("project code", {2}, set()), ("dinner later", {3}, set()), ("yes", {4}, set()), ("sure", {5}, {2}), ("dinner and project", {6}, set())]
    got = packing.topics_of(said, {"food": ("dinner",), "work": ("project",)})
    assert got == [(0, "food"), (1, "work"), (0, "food"), (0, "food"), (1, "work"), (2, "unresolved")]


def test_turns_by_topic():
    words = {"food": ("dinner",), "work": ("project",)}
    m = [("a", 1, 0.0, "text", "dinner"), ("a", 1, 100.0, "text", "ok"), ("a", 1, 150.0, "text", "project"), ("a", 1, 300.0, "text", "x"), ("b", 1, 301.0, "text", "x"), ("b", 2, 302.0, "text", "x"), ("b", 2, 303.0, "call", "x"), ("b", 2, 304.0, "text", "x")]
    assert packing.merged_turns(m, words) == [0, 0, 1, 2, 3, 4, 5, 6]


def test_token_chunks():
    assert packing.token_chunks([], 5, 20, 2) == []
    assert packing.token_chunks([4, 4, 4, 4, 30, 4], 5, 20, 2) == [(0, 3, 0), (1, 4, 2), (4, 5, 0), (5, 6, 0)]
    chunks = packing.token_chunks([3] * 10, 2, 14, 1)
    assert chunks == [(0, 4, 0), (3, 7, 1), (6, 10, 1)]
    assert sorted({i for a, b, c in chunks for i in range(a + c, b)}) == list(range(10))


def test_fitting_and_exchanges():
    assert packing.fitted([(-2, (0,), 5), (1, (1,), 8), (-1, (2,), 4), (2, (3,), 1)], 10) == [0, 2, 3]
    roles = ["user", "assistant", "assistant", "user", "assistant", "user"]
    refs = [[], [], [], [], [0], []]
    def closure(roles, refs, seeds, opening=False):
        return packing.closure(packing.direct_needs(roles, refs, "user", "assistant", opening), seeds)

    assert closure(roles, refs, {2}) == {0, 1, 2} and closure(roles, refs, {4}) == {0, 3, 4} and closure(roles, refs, {5}) == {5}
    assert closure(["assistant", "user"], [[], []], {0}) is None and closure(["assistant", "assistant"], [[], []], {1}, opening=True) == {0, 1}
    assert closure(["user", "user"], [[1], []], {0}) is None
    assert packing.selected_turns(roles, refs, [0] * 6, [10, 1, 1, 1, 1, 1], 6, 10) == [3, 5]
    assert packing.selected_turns(roles, refs, [0] * 6, [1] * 6, 100, 10) == [0, 1, 2, 3, 4, 5]
    assert packing.selected_turns(roles, refs, [0] * 6, [1] * 6, 0, 10) is None


def test_mask_spans(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1],), ([],), ([1, 1],)], "m array<int>").select(packing.mask_spans(F.col("m")).alias("s"))
    assert [[tuple(x) for x in r.s] for r in df.collect()] == [[(1, 3), (4, 5)], [], [(0, 2)]]


def test_dates(spark):
    rows = ["昨天", "2024-02-30", "2024-02-03", "3月5日", "in 1999", "none", "2024年5月"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", packing.resolved_date(F.col("t"), F.lit("2024-01-01").cast("date")).alias("r"))
    got = {r.t: (r.r.value, r.r.precision) for r in df.collect()}
    assert got == {"昨天": ("2023-12-31", "day"), "2024-02-30": ("2024-02", "month"), "2024-02-03": ("2024-02-03", "day"), "3月5日": ("--03-05", "month_day"), "in 1999": ("1999", "year"), "none": (None, "unknown"), "2024年5月": ("2024-05", "month")}


def test_masks_and_budget(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1])], "i array<int>, m array<int>")
    assert df.select(packing.assistant_labels(F.col("i"), F.col("m")).alias("l")).first().l == [-100, 6, 7]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2026-09-01 10:00\tMe: hello\n\n2026-09-01 10:01\tYou：hi: there\nnoise\n", encoding="utf-8")
    rows = chat.txt_lines(spark, str(tmp_path / "a.txt")).orderBy("record_index").collect()
    assert [(r.record_index, r.speaker, r.text, r.bad) for r in rows] == [(0, "Me", "hello", False), (2, "You", "hi: there", False), (3, "", "", True)]
    (tmp_path / "a.csv").write_text('time,timestamp,sender,text\nt1,,A,"x\ny"\nt2,t3,B,\n')
    assert [(r.timestamp, r.speaker, r.text) for r in chat.csv_rows(spark, str(tmp_path / "a.csv")).collect()] == [("t1", "A", "x\ny"), ("t3", "B", None)]
    (tmp_path / "o.json").write_text('{"messages": [{"timestamp": "t", "speaker": "s", "text": "x"}]}')
    (tmp_path / "l.json").write_text('{"timestamp": "t", "speaker": "s", "text": "x"}\n{"timestamp": "u", "speaker": "s", "text": "y"}\n')
    (tmp_path / "n.json").write_text('[{"createTime": 1, "senderUsername": "s", "isSent": true, "renderType": "k", "content": ""}]')
    assert [chat.json_messages(spark, str(tmp_path / f)).count() for f in ("o.json", "l.json", "n.json")] == [1, 2, 1]
    every = chat.json_messages(spark, [str(tmp_path / f) for f in ("o.json", "l.json", "n.json")]).collect()
    assert sorted((r.path[-6:], r.record_index, r.timestamp) for r in every) == [("l.json", 0, "t"), ("l.json", 1, "u"), ("n.json", 0, "1"), ("o.json", 0, "t")]
    with pytest.raises(chat.BadExport, match="line 4"):
        chat.txt_messages(spark, str(tmp_path / "a.txt"))
    pages = spark.createDataFrame([(1, '<div data-timestamp="t" data-speaker="s">he<b>l</b>lo</div><p>x</p>'), (2, None)], "id long, html string")
    assert [tuple(r) for r in chat.html_messages(pages, "id", "html").collect()] == [(1, 0, "t", "s", "hello", "text")]
    page = """<DIV timestamp='1' speaker="A &amp; B" data-kind=call>x &lt; y<br>z</DIV><p>no</p><li data-timestamp="2">a<div data-timestamp="3">b</div> c</li>"""
    assert chat.messages_in(page) == [("1", "A & B", "x < yz", "call"), ("3", "", "b", "text")]
    times = spark.createDataFrame([("1756692000",), ("1756692000000",), ("2025-09-01T02:00:00Z",), ("2025-09-01 10:00",), ("soon",)], "t string")
    got = [r.x for r in times.select(F.date_format(chat.parsed_timestamp("t"), "yyyy-MM-dd HH:mm").alias("x")).collect()]
    assert got == ["2025-09-01 02:00"] * 4 + [None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a"), (2, "test", "b")], "id long, split string, text string")
    one = sorted(map(tuple, sinks.snapshot(df, str(tmp_path / "s")).collect()))
    two = sorted(map(tuple, sinks.snapshot(df.repartition(3), str(tmp_path / "t")).collect()))
    assert one == two
    with pytest.raises(Exception, match="exist"):
        sinks.snapshot(df, str(tmp_path / "s"))
    sinks.audit(df, str(tmp_path / "log"), "id", "text")
    assert set(spark.read.parquet(str(tmp_path / "log")).columns) == {"id", "content_sha256", "at"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "x", 2), ("b", "y", 3), ("a", "z", 4), ("b", "y", 5)]
    df = spark.createDataFrame(rows, "key string, digest string, seq long")
    df.where("seq <= 2").write.parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for more in (None, df.where("seq > 2")):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        se.run_once(se.inbox_stream(stream, "key", "digest", "seq"), out, ck)
    got = {r.seq: r.outcome for r in spark.read.parquet(out).collect()}
    assert got == {1: "accepted", 2: "repeated", 3: "accepted", 4: "conflict", 5: "repeated"}
    batch = {r.key: (r.first_seq, r.conflict) for r in records.inbox(df, ["key"], "digest", "seq").collect()}
    assert batch == {"a": (1, True), "b": (3, False)}


def test_observations():
    got = records.observed([(1, "queued"), (1, "queued"), (1, "running"), (2, "running"), (3, "running"), (4, "failed"), (5, "running"), (6, "succeeded")])
    assert got == {"status": "succeeded", "kept": ["queued", "running", "failed", "succeeded"], "repeats": 1, "conflicts": 1}
    assert records.observed([])["status"] == "accepted" and len(records.observed([(i, f"s{i}") for i in range(300)])["kept"]) == 100


def test_importers(spark, tmp_path):
    from tessera.operators import plugins

    (tmp_path / "a.TXT").write_text("2026-09-01 10:00\tMe: hello\n")
    assert plugins.imported(spark, str(tmp_path / "a.TXT")).count() == 1
    for bad in ("a.exe", "x/../a.txt"):
        with pytest.raises(ValueError, match="format|folder"):
            plugins.imported(spark, bad)
    plugins.register(".log", lambda s, p: s.read.text(p))
    (tmp_path / "a.log").write_text("x\ny\n")
    assert plugins.imported(spark, str(tmp_path / "a.log")).count() == 2


def test_adjacent_credentials(spark):
    """The message before counts as it stands after its own replacement; other messages in between are a border."""
    rows = [(1, [(0, "token"), (1, "secret"), (2, "abcd1")]), (2, [(0, "密码"), (1, " 123456。"), (3, "x")]), (3, [(0, "token"), (2, "abcd1")]), (4, [])]
    df = spark.createDataFrame(rows, "k int, m array<struct<idx:int,content:string>>")
    got = {r.k: ([x.content for x in r.r], r.n) for r in df.select("k", privacy.adjacent_redacted(F.col("m")).alias("r"), privacy.adjacent_count(F.col("m")).alias("n")).collect()}
    assert got == {1: (["token", "<SECRET>", "abcd1"], 2), 2: (["密码", " <SECRET>。", "x"], 1), 3: (["token", "abcd1"], 0), 4: ([], 0)}


def test_texts_are_normalised_before_scans(spark):
    df = spark.createDataFrame([(1, "ＡＢ１２３ # x"), (2, "a\r\nb\x07c \t d\n\n\n\ne  "), (3, "mail ａ＠ｂ.com"), (4, "é ß 漢字 12"), (5, None)], "k int, t string")
    from tessera.functions import text as tx

    got = {r.k: (r.m, r.p, r.n) for r in df.select("k", tx.meaningful("t").alias("m"), tx.template("t").alias("p"), tx.normalized("t").alias("n")).collect()}
    assert got == {1: ("AB123x", "abx#", "AB123 # x"), 2: ("abcde", "abcde", "a\nbc d\n\ne"), 3: ("mailabcom", "mailabcom", "mail a@b.com"), 4: ("漢字12", "漢字#", "é ß 漢字 12"), 5: (None, None, "")}
    assert {r.k: r.raw_email_matches for r in privacy.scanned(df, "t").collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_hints_change_no_count(spark, sf_dir):
    """Counts with the cheap tests before the patterns equal those of the patterns alone."""
    said = "call 13812345678 a.b@c.org password: hunter22 id 11010119900307123X card 6222021234567890 at 31.23041, 121.47371 ip 10.0.0.1 地址：上海市某路1号。wxid_ab1 @bob https://ex.org:80/x?y ACCESS KEY abcd1234 密码 1234abcd one time password 99999 OTP 123456"
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, said)], "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:-1] for r in privacy.scanned(df, "text").drop("text").collect()}
    from tessera.functions.text import normalized

    raw = {n: F.regexp_count(F.regexp_replace("v", privacy.PATTERNS["idcard"], " ") if n == "bank" else F.col("v"), F.lit(p)) for n, p in privacy.PATTERNS.items()}
    want = {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", normalized("text").alias("v")).select("doc_id", *[c.alias(n) for n, c in raw.items()]).collect()}
    assert got == want and all(want[-1])


def test_frozen_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, h string")
    path = sinks.frozen_manifest(df, str(tmp_path), ["id", "h"])
    assert sinks.frozen_manifest(df.orderBy(F.desc("id")), str(tmp_path), ["id", "h"]) == path
    assert sinks.frozen_scan(spark, path, "id long, h string").count() == 2
    df.limit(1).write.mode("overwrite").csv(path, header=True)
    with pytest.raises(ValueError, match="digest"):
        sinks.frozen_scan(spark, path, "id long, h string")
    with pytest.raises(ValueError, match="no card"):
        sinks.index(df, spark.createDataFrame([(3, [1.0])], "id long, v array<double>"), str(tmp_path / "i"), "id", "h", "v")
