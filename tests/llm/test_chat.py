"""Round trips, shared prefixes and masks against plain formatting."""

import hashlib
import random

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.bpe import default_path
from tessera.llm.chat import END, build_pack, codec_of, conversations_of, escaped, header, op8_chat, pack_rows, parse, read_back, unescaped

NASTY = ["", "\\", "\\\\", "</turn>", "\\</turn>", " </turn>\n", "### Assistant: x", "####", "\\###", ": ", "a\n\nb", r"\### Assistant: </turn> ok", "é漢🎉"]


def plain(turns):
    return "".join(header(r) + escaped(t) + END for r, t in turns)


def test_escapes_are_reversible():
    rnd = random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choice(NASTY + ["\\", "#", "</", "turn>", " "]) for _ in range(rnd.randint(0, 6)))
        assert unescaped(escaped(text)) == text
        assert parse(plain([(text, text), ("user", text)])) == [(text, text), ("user", text)]


@pytest.mark.parametrize("tokenizer", ["chars", default_path()])
def test_pack_shares_prefixes_and_reads_back(tokenizer):
    codec = codec_of(tokenizer)
    rnd = random.Random(2)
    convs = [[(rnd.choice(["user", "assistant", "a:b\\"]), rnd.choice(NASTY[:6])) for _ in range(rnd.randint(1, 6))] for _ in range(300)]
    convs += [convs[0], convs[0][:1]]
    p = build_pack(convs, codec)
    prefixes = {tuple(c[: i + 1]) for c in convs for i in range(len(c))}
    assert len(p.start) == len(prefixes)
    assert len(p.tokens) == sum(len(x) for t in prefixes for x in codec.encode([header(t[-1][0]), escaped(t[-1][1]), END]))
    if tokenizer == "chars":
        assert len(p.tokens) == sum(len(plain(x[-1:])) for x in prefixes)
    for c, leaf in zip(convs, p.leaf, strict=True):
        assert p.formatted(leaf, codec) == plain(c)
        assert p.loss_text(leaf, codec) == "".join(t for r, t in c if r == "assistant")
        assert p.position[leaf] + p.end[leaf] - p.start[leaf] == len(p.path_tokens(leaf))


def want(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), len(plain(turns))


def test_query(spark, sf_dir):
    rows = {r.conv_id: tuple(r)[1:] for r in op8_chat(spark, sf_dir).collect()}
    by = {-7: [("user", NASTY[-2]), ("assistant", NASTY[-2])]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert rows == {k: want(v) for k, v in by.items()}


def test_cases(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "x"), (2, None, "b", "late"), (2, 5, "a", "first"), (3, 5, "a", "first"), (3, None, "b", "late")] + [(100 + i, 0, "user", "hot") for i in range(50)], "conv_id long, turn long, role string, text string")
    convs = conversations_of(df)
    packs = pack_rows(convs, size=2)
    rows = {r.conv_id: r.turns_sha256 for r in convs.select("conv_id", "__digest").join(read_back(packs), "__digest").collect()}
    assert len(rows) == 54
    assert rows[1] == want([("", ""), ("", "")])[1] and rows[2] == rows[3] == want([("a", "first"), ("b", "late")])[1] and rows[None] == want([("user", "x")])[1]
    assert sum(len(r.digest) for r in packs.collect()) == 4 + 0
    assert pack_rows(conversations_of(df.limit(0))).count() == 0
    assert read_back(pack_rows(conversations_of(df.limit(0)))).count() == 0


def test_extra_columns_and_long_texts(spark):
    text = "word </turn> " * 60_000
    df = spark.createDataFrame([(1, 0, "user", text, 5, "x"), (1, 1, "assistant", text, 5, "y")], "conv_id long, turn long, role string, text string, __turns int, pack string")
    convs = conversations_of(df)
    row = convs.select("conv_id", "__digest").join(read_back(pack_rows(convs)), "__digest").first()
    assert (row.n_turns, row.turns_sha256, row.loss_chars) == want([("user", text), ("assistant", text)])[:3]
