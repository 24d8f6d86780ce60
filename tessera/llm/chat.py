r"""Chat formatting with a prefix tree.

Conversations that share initial turns share those turns' tokens: each pack holds
conversations with one first turn as a tree whose nodes are turns, emitted once
each, depth first.  A node has its start in the packed tokens, the position id of
its first token (positions run along the path from the root), the intervals of its
ancestors (which its tokens may attend to, besides earlier ones of its own), and the
interval of its loss mask.

Template: ``### role: text </turn>`` and a newline per turn.  Inside texts a
backslash goes before each backslash, ``</turn>`` and ``###``; inside roles also
before colons; so the end of a turn can't be forged and texts come back exactly.
Tokens are those of a public byte-level BPE file; headers, texts and ends of turns are encoded apart, so loss masks
fall on token borders.  ``tokenizer="chars"`` takes code points instead.

Scale: equal conversations are merged before they are dealt out (partial aggregation
by digest), a first turn with many conversations gets packs of about ``PACK`` of
them, by digest, and each pack is built from a stream sorted by pack.  Only first turns that need several packs are joined
back, by first turn and one of ``SALTS`` salts.  So no task holds more than one pack, whatever share of the rows one first turn or one
conversation has.

Defined results: rows go by turn, ties by role and then text, null turns last; null texts and roles
count as empty; repeated rows are turns of their own; a null conv_id is a
conversation of its own; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import map_batches, table

#: Conversations of one pack, on average at most.
PACK = 256
#: Parts into which conversations of one first turn are dealt when they are told the number of their packs.
SALTS = 32
END = " </turn>\n"
HEADER = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)
_MARKED = re.compile(r"\\(\\|</turn>|###|:)")

Turn = tuple[str, str]  # role, text


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("###", "\\###")


def unescaped(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def header(role: str) -> str:
    return f"### {escaped(role).replace(':', chr(92) + ':')}: "


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        m = HEADER.match(part)
        out.append((unescaped(m[1]), unescaped(part[m.end() :])))
    return out


class Codec:
    """Tokens of texts and texts of tokens: code points."""

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(ord, t)) for t in texts]

    def decode(self, tokens: list[int]) -> str:
        return "".join(map(chr, tokens))


class BpeCodec(Codec):
    """Tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        self.bpe = bpe.tokenizer(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in self.bpe.encode_batch(texts)]

    def decode(self, tokens: list[int]) -> str:
        return self.bpe.decode(struct.pack(f"<{len(tokens)}I", *tokens))


def codec_of(tokenizer: str) -> Codec:
    """``chars``, or the path of a tokenizer file."""
    return Codec() if tokenizer == "chars" else BpeCodec(tokenizer)


@dataclass
class Pack:
    """Packed tokens of one tree; lists run over its nodes in depth-first order."""

    tokens: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    position: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    attends: list[list[tuple[int, int]]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # of each conversation

    def path(self, node: int) -> list[tuple[int, int]]:
        """The intervals that make up the conversation which ends in ``node``."""
        out = list(self.attends[node])
        if out and out[-1][1] == self.start[node]:
            return [*out[:-1], (out[-1][0], self.end[node])]
        return [*out, (self.start[node], self.end[node])]

    def path_tokens(self, node: int) -> list[int]:
        return [x for a, b in self.path(node) for x in self.tokens[a:b]]

    def formatted(self, node: int, codec: Codec) -> str:
        return codec.decode(self.path_tokens(node))

    def loss_text(self, node: int, codec: Codec) -> str:
        """All text under the loss mask along the path, unescaped."""
        out = []
        while node >= 0:
            a, b = self.loss[node]
            out.append(unescaped(codec.decode(self.tokens[a:b])))
            node = self.parent[node]
        return "".join(reversed(out))


def build_pack(conversations: list[list[Turn]], codec: Codec) -> Pack:
    """One tree (or forest) of the given conversations."""
    children: list[dict[Turn, int]] = [{}]  # of the root, then of the nodes as they come
    keys: list[Turn] = [("", "")]
    leaf = []
    for turns in conversations:
        at = 0
        for turn in turns:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                keys.append(turn)
            at = children[at][turn]
        leaf.append(at)
    # each distinct header and text of the tree is encoded once
    parts = {END, *(header(role) for role, _ in keys), *(escaped(text) for _, text in keys)}
    ids = dict(zip(parts, codec.encode(list(parts)), strict=True))
    pack, place = Pack(), {0: -1}
    stack = [(c, 0) for _, c in sorted(children[0].items(), reverse=True)]
    while stack:
        node, parent = stack.pop()
        role, text = keys[node]
        head, body, offset = ids[header(role)], ids[escaped(text)], len(pack.tokens)
        up = place[parent]
        place[node] = len(pack.start)
        pack.tokens += head + body + ids[END]
        pack.start.append(offset)
        pack.end.append(len(pack.tokens))
        pack.parent.append(up)
        pack.position.append(pack.position[up] + pack.end[up] - pack.start[up] if up >= 0 else 0)
        pack.attends.append(pack.path(up) if up >= 0 else [])
        pack.loss.append((offset + len(head), offset + len(head) + len(body)) if role == "assistant" else (offset, offset))
        stack += [(c, node) for _, c in sorted(children[node].items(), reverse=True)]
    pack.leaf = [place[x] for x in leaf]
    return pack


def conversations_of(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``key``, __turns (in order) and __digest, the same for equal conversations."""
    at, said, by, of = (F.col(f"`{c}`") for c in (turn, text, role, key))
    one = F.struct(at.isNull().alias("a"), at.alias("b"), F.coalesce(by, F.lit("")).alias("role"), F.coalesce(said, F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    grouped = df.groupBy(of.alias(key)).agg(turns.alias("__turns"))
    return grouped.withColumn("__digest", F.sha2(F.to_json("__turns").cast("binary"), 256))


PACK_SCHEMA = (
    "pack string, tokens array<int>, node_start array<int>, node_end array<int>, node_position array<int>, node_parent array<int>, "
    "loss_start array<int>, loss_end array<int>, attends array<array<struct<start: int, end: int>>>, digest array<string>, leaf array<int>"
)


def pack_rows(conversations: DataFrame, size: int = PACK, tokenizer: str | None = None) -> DataFrame:
    """Packs of the distinct conversations of ``conversations_of``; ``digest`` and ``leaf`` tell where each of them ends."""
    distinct = conversations.groupBy("__digest").agg(F.first("__turns").alias("__turns"))
    rooted = distinct.withColumn("__root", F.sha2(F.to_json(F.get("__turns", F.lit(0))).cast("binary"), 256))
    # One pack is enough for most first turns; the others are N / size at most.
    salt = F.pmod(F.xxhash64("__digest", F.lit(3)), F.lit(SALTS)).cast("int")
    cells = rooted.groupBy("__root").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("__cells")).where("__cells > 1")
    salted = cells.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = rooted.withColumn("__salt", salt).join(salted, ["__root", "__salt"], "left")
    dealt = told.withColumn("__cell", F.pmod(F.xxhash64("__digest"), F.coalesce("__cells", F.lit(1).cast("long"))))
    sorted_ = dealt.select("__root", "__cell", "__digest", "__turns").repartition("__root", "__cell").sortWithinPartitions("__root", "__cell", "__digest")

    tokenizer = tokenizer or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)

        def out(key: tuple[str, int], digests: list[str], held: list[list[Turn]]) -> pa.RecordBatch:
            p = build_pack(held, codec)
            row = {
                "pack": f"{key[0]}:{key[1]}", "tokens": p.tokens, "node_start": p.start, "node_end": p.end, "node_position": p.position, "node_parent": p.parent,
                "loss_start": [a for a, _ in p.loss], "loss_end": [b for _, b in p.loss], "attends": [[{"start": a, "end": b} for a, b in x] for x in p.attends], "digest": digests, "leaf": p.leaf,
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        ints = pa.list_(pa.int32())
        arrow = pa.schema([("pack", pa.string()), ("tokens", ints), ("node_start", ints), ("node_end", ints), ("node_position", ints), ("node_parent", ints), ("loss_start", ints), ("loss_end", ints), ("attends", pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))), ("digest", pa.list_(pa.string())), ("leaf", ints)])
        key, digests, held = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["__root"], row["__cell"])
                if now != key and held:
                    yield out(key, digests, held)
                    digests, held = [], []
                key = now
                digests.append(row["__digest"])
                held.append([(t["role"], t["text"]) for t in row["__turns"]])
        if held:
            yield out(key, digests, held)

    return map_batches(sorted_, run, PACK_SCHEMA, cache="bpe")


def read_back(packs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per distinct conversation, from the packed tokens, intervals and masks alone: its digest and what it says."""
    tokenizer = tokenizer or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                p = Pack(r["tokens"], r["node_start"], r["node_end"], r["node_position"], r["node_parent"], list(zip(r["loss_start"], r["loss_end"], strict=True)), [[(i["start"], i["end"]) for i in x] for x in r["attends"]], r["leaf"])
                for digest, leaf in zip(r["digest"], r["leaf"], strict=True):
                    text, loss = p.formatted(leaf, codec), p.loss_text(leaf, codec)
                    if p.position[leaf] + p.end[leaf] - p.start[leaf] != len(p.path_tokens(leaf)):
                        raise ValueError("position ids don't run along the path")
                    turns = parse(text)
                    said = "".join(f"{role}\n{t}\n" for role, t in turns)
                    rows.append((digest, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["__digest", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(packs, run, "__digest string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", cache="bpe")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all ``conversations`` plus conversation -7 and read them back from the packs."""
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"))
    conversations = conversations_of(rows)
    return conversations.select("conv_id", "__digest").join(read_back(pack_rows(conversations)), "__digest").drop("__digest")
