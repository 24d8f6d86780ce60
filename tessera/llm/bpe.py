"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

The tokenizer is given (a byte-level BPE file of the ``tokenizers`` library); it
is never trained here.  The walk rests on one property of BPE: the encoding of a
byte string is the encoding of a shorter prefix plus one last token, and that
token is the only suffix token which may stand after the prefix's own last token.
So one integer a trie node (its last token) describes the encoding of the node's
whole prefix, and words that share a prefix share that work.  Distinct words are
sorted, which makes their order the depth-first order of the trie; the stack of
the walk is the path of the word at hand.

Defined results: null texts count as empty and give no tokens; white space, lone
controls and any other code points are kept by the byte alphabet, so decoding
returns the very text; repeated rows give repeated results; texts are encoded
whole, whatever their length.  The memo of chunks has two generations of bounded
size, so memory is bounded and the results don't depend on it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import CACHES, map_batches, table

#: Chunks, words and token pairs (about 200 bytes each) after which a worker's memo gets a new generation; the one before is kept, and
#: what is still in use moves over, so a worker holds twice as many at most.
MEMO_CHUNKS, MEMO_WORDS, MEMO_PAIRS = 150_000, 75_000, 200_000
#: Fixed by the byte-level pre-tokenizer of the file format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level files: itself if printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Before a single space that stands between non-spaces pre-tokens end, whatever stands around.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: White space but for blanks and newlines; where there is none of it, blanks that stand between non-spaces are found by plain searches.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def pieces(text: str) -> list[str]:
    """The text cut before such spaces; joined they give the text again."""
    if not text:
        return []
    plain = text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and not any(c in text for c in ODD)
    first, *rest = text.split(" ") if plain else CUT.split(text)
    return [first, *map(" ".__add__, rest)]


def _fresh(wanted: set[str], memo: dict[str, bytes], before: dict[str, bytes]) -> list[str]:
    """What neither generation of the memo holds; what the one before holds moves to ``memo``."""
    moved = wanted & before.keys()
    memo.update((x, before[x]) for x in moved)
    return list(wanted - moved)


class TrieBpe:
    """Encoder and decoder for one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE files without normalizer and prefix space are read")
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault((self.ids[a], self.ids[b]), n)
            self.merged.setdefault((self.ids[a], self.ids[b]), self.ids[a + b])
        # Tokens that no sequence of merges makes can't end an encoding.
        self.ids = {b: i for b, i in self.ids.items() if len(b) == 1 or self.merge(b) == [i]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        # States of the suffix automaton: the longest end of what was read that begins some token.
        self.state_of = {b[:n]: 0 for b in self.ids for n in range(len(b) + 1)}
        self.state_of = {b: i for i, b in enumerate(sorted(self.state_of))}
        self.state_bytes = [*self.state_of]
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.state_bytes)
        self.step: dict[int, int] = {}
        # The merge that makes each token; one each in files of this kind.
        self.parts = {self.merged[p]: (*p, n) for p, n in self.rank.items()}
        if len(self.parts) != len(self.rank):
            raise ValueError("two merges make one token")
        self.edges: dict[int, tuple[list[tuple[int, float]], list[tuple[int, float]]]] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.chunks_before: dict[str, bytes] = {}
        # Bytes of each id, to be picked by arrays of ids.
        self.spelled = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], dtype=object)

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE by merge ranks, for short strings."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), 1 << 60))
            if (pair := (out[best], out[best + 1])) not in self.rank:
                break
            out[best : best + 2] = [self.merged[pair]]
        return out

    def spines(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """The parts along the token's right and left edge as its merges are undone, each with the rank that used it up."""
        if token not in self.edges:
            out = []
            for side in (1, 0):
                spine, part, used = [], token, float("inf")
                while True:
                    spine.append((part, used))
                    if part not in self.parts:
                        break
                    *both, used = self.parts[part]
                    part = both[side]
                out.append(spine)
            self.edges[token] = (out[0], out[1])
        return self.edges[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the bytes of token a and then token b as just these two tokens.

        It doesn't if a merge across their border comes before both of its parts are used
        up inside their own tokens; of equal ranks the left one comes first.
        """
        key = a * 1_000_000 + b
        known = self.pairs.get(key)
        if known is None:
            rank = self.rank
            known = not any((n := rank.get((x, y))) is not None and n < x_used and n <= y_used for x, x_used in self.spines(a)[0] for y, y_used in self.spines(b)[1])
            self.pairs[key] = known
        return known

    def advance(self, state: int, byte: int) -> int:
        """The state after one more byte; from then on kept in ``step``, and the tokens that end there in ``ends``."""
        at = self.state_bytes[state] + bytes([byte])
        while at not in self.state_of:
            at = at[1:]
        after = self.step[state << 8 | byte] = self.state_of[at]
        if self.ends[after] is None:
            self.ends[after] = tuple((self.ids[at[i:]], len(at) - i) for i in range(len(at)) if at[i:] in self.ids)
        return after

    def encode_words(self, words: list[str], into: dict[str, bytes]) -> None:
        """Put the encodings of distinct pre-tokens into ``into``: depth first over their trie."""
        bytes_of, pairs, follows, step, ends, advance = self.bytes_of, self.pairs, self.follows, self.step, self.ends, self.advance
        pack, before = struct.pack, b""
        path: list[int] = [-1]  # last token of each prefix of the word before
        states: list[int] = [0]
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:]:
                end += 1
                after = step.get(state << 8 | byte)
                state = advance(state, byte) if after is None else after
                for token, length in ends[state]:
                    if length == end:
                        break
                    last = path[end - length]
                    known = pairs.get(last * 1_000_000 + token)
                    if follows(last, token) if known is None else known:
                        break
                path.append(token)
                states.append(state)
            out, end = [], len(word)
            while end:
                out.append(path[end])
                end -= len(bytes_of[path[end]])
            out.reverse()
            into[text] = pack(f"<{len(out)}I", *out)
            before = word

    def encode_chunks(self, chunks: list[str]) -> None:
        """Encode the given pieces of text, each apart from its neighbours, into ``chunks``."""
        # letters alone, with a space before them or not, are one pre-token
        whole = [c for c in chunks if c.isalpha() or (c[0] == " " and c[1:].isalpha())]
        self.encode_words(whole, self.chunks)
        split = {c: self.pretoken.findall(c) for c in set(chunks).difference(whole)}
        words = self.words
        self.encode_words(_fresh({w for ws in split.values() for w in ws if w not in words}, words, self.words_before), words)
        for c, ws in split.items():
            self.chunks[c] = b"".join([words[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > MEMO_CHUNKS:
            self.chunks_before, self.chunks = self.chunks, {}
        if len(self.words) > MEMO_WORDS:
            self.words_before, self.words = self.words, {}
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs = {}
        plain: list[list[str]] = []  # of each stretch between special tokens
        layout: list[list[int]] = []  # of each text: the stretches, and special tokens as -1 - id
        for text in texts:
            row, at = [], 0
            for m in self.special_at.finditer(text) if any(x in text for x in self.special) else ():
                row += [len(plain), -1 - self.special[m.group()]]
                plain.append(pieces(text[at : m.start()]))
                at = m.end()
            row.append(len(plain))
            plain.append(pieces(text[at:]))
            layout.append(row)
        known = self.chunks
        self.encode_chunks(_fresh(set().union(*plain).difference(known), known, self.chunks_before))
        find = known.__getitem__
        done = [b"".join(map(find, parts)) for parts in plain]
        return [done[row[0]] if len(row) == 1 else b"".join([done[i] if i >= 0 else struct.pack("<I", -1 - i) for i in row]) for row in layout]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(self.spelled[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


_LOADED: dict[str, TrieBpe] = {}
CACHES["bpe"] = _LOADED.clear


def tokenizer(path: str) -> TrieBpe:
    """The tokenizer of ``path``, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str, key: str, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Columns ``key``, n_tokens, ids_sha256, decoded_sha256 for each row; with ``with_ids`` also token_ids and decoded.

    One narrow pass: no shuffle, and a lost executor costs only its tasks.
    """
    path = path or default_path()
    source = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids binary, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            packed = bpe.encode_batch(batch.column(1).to_pylist())
            texts = [bpe.decode(x) for x in packed]
            out = [batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(packed, pa.binary()), pa.array(texts, pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return map_batches(source, run, schema, cache="bpe")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id")
