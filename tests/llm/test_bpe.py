"""The trie encoder against the tokenizers library."""

import hashlib
import random

import pytest

pytest.importorskip("tessera.llm")
from tokenizers import Tokenizer

from tessera.llm.bpe import TrieBpe, default_path, encode


@pytest.fixture(scope="module")
def both():
    return TrieBpe(default_path()), Tokenizer.from_file(default_path())


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def check(both, texts):
    ours, theirs = both
    for text, got in zip(texts, ours.encode_batch(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert got == packed(want), text[:80]
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_fixed_strings(both):
    check(both, ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n x\t\t y ", "it's we'll THEY'RE", "x" * 3000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "  a　b", "\x1c\x1da\x85b", "éèê ß 漢字 🎉🎉 ", "abc\x00def", "1234567890 12,345.67"])


def test_random_strings(both):
    rnd = random.Random(7)
    alphabet = "ab et' \n\t.,#1é漢🎉 \x1c\x85​᠎<|>ſ" + "the ing tion"
    check(both, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)])


def test_documents(both, spark, sf_dir):
    check(both, [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])


def test_frame_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (3, "a b")], "doc_id long, text string")
    rows = sorted(encode(df, "text", "doc_id").collect(), key=str)
    assert len(rows) == 4
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in rows if r.doc_id == 1] == [(1, 0, empty, empty)] * 2
    assert encode(df.limit(0), "text", "doc_id").count() == 0


def test_other_operators_drop_the_tokenizer(spark):
    """In the worker itself: after a task of another operator its tokenizers are gone."""
    import pyarrow as pa

    from tessera.llm.bpe import encode
    from tessera.llm.common import map_batches

    def loaded(batches):
        from tessera.llm import bpe

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe._LOADED)] * b.num_rows})

    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)
    assert encode(one, "text", "doc_id").count() == 1
    assert [r.n for r in map_batches(one.select("text"), loaded, "n long", cache="bpe").collect()] == [1]
    assert [r.n for r in map_batches(one.select("text"), loaded, "n long").collect()] == [0]
