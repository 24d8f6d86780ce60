r"""Secret scans with multipart credential linking.

Strong spans stand alone: assignments of a value to a secret's name, access
identifiers, long hexadecimal runs.  Weak candidates (bare secret-like strings and
endpoints) are credible only beside what they go with: an access identifier, a secret and an
endpoint make up one credential.  Within each scope (a paragraph, i.e. a stretch
without an empty line, at most ``SCOPE`` code points apart) intervals are joined in position
order, and a weak candidate is reported only if a complementary part stands in its scope:

* ``bare``, 40 characters of base64 alphabet with both cases and a digit, beside an access identifier;
* ``endpoint``, a host or URL with a known ending, beside an access identifier and also beside a secret
  (an assignment, a hexadecimal run or a bare secret).

The join asks for the nearest complementary part on both sides by binary search in
sorted positions, so a text with many parts costs n log n and no pairs are made.

Defined results: null texts count as empty and have no spans; texts are scanned
whole; repeated rows give repeated results; offsets are code points, end
exclusive; spans of one kind don't overlap, spans of different kinds may.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, small_batches, table

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?a)(?:https?://[^\s\"'<>]+|\b(?:[A-Za-z0-9-]+\.)+(?:amazonaws\.com|internal|cloud|local)\b(?::[0-9]+)?)")
#: Kinds in their listing order; base kinds first.
KINDS = ("assign", "access", "hex", "bare", "endpoint")
#: Code points between parts of one credential, at most.
SCOPE = 400

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The strong spans, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # maximal runs of 32 or more are the runs that pass
    return sorted(out)


def paragraph_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n\s*", text))]


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates whose complementary parts stand in their scope."""
    access = [s for s in base if s[1] == 1]
    if not access:  # each weak kind needs one
        return []
    starts = paragraph_starts(text)
    taken = [s[0] for s in base]
    reach = list(accumulate((s[2] for s in base), max))  # the furthest end of the spans so far

    def near(start: int, end: int, parts: list[tuple[int, int]]) -> bool:
        """parts: sorted, not overlapping. Whether one of them stands within the scope of [start, end)."""
        k = bisect_left(parts, (start, end))
        paragraph = bisect_right(starts, start)
        return any(max(p[0] - end, start - p[1]) <= scope and bisect_right(starts, p[0]) == paragraph for p in parts[max(0, k - 1) : k + 1] if p != (start, end))

    def free(m: re.Match) -> bool:
        k = bisect_left(taken, m.end())  # the spans before k start before the match ends
        return not k or reach[k - 1] <= m.start()

    at_access = [(s[0], s[2]) for s in access]
    bare = [(m.start(), m.end()) for m in BARE.finditer(text) if free(m) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    bare = [p for p in bare if near(*p, at_access)]
    held = [(s[0], s[2]) for s in base if s[1] == 0]
    hexes = [(s[0], s[2]) for s in base if s[1] == 2]
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    ends = [p for p in ends if near(*p, at_access) and (near(*p, bare) or near(*p, held) or near(*p, hexes))]
    return sorted([(s, 3, e) for s, e in bare] + [(s, 4, e) for s, e in ends])


def find_spans(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + linked_spans(text or "", base, scope)) if base else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by one mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str, key: str, scope: int = SCOPE) -> DataFrame:
    """Columns ``key``, n_assign, n_access, n_hex, base_sha256 and spans; one narrow pass."""
    source = df.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    schema = f"__id {source.schema['__id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(x, scope) for x in texts]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names=["__id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(source, run, schema).withColumnRenamed("__id", key)


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars", scope: int = SCOPE) -> DataFrame:
    """All rows and columns of ``df`` with secrets masked in ``text``; ``n_chars`` follows where it was the text's length."""

    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x and masked(x, find_spans(x, scope)[1]))

    # the row in a struct of its own, so that no column name of it can clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    done = rows.select("row", mask(F.col("row")[text]).alias("masked"))
    values = {c: F.col("row")[c] for c in df.columns}
    if n_chars in values:
        values[n_chars] = F.when(values[n_chars] == F.length(values[text]), F.length("masked").cast(df.schema[n_chars].dataType)).otherwise(values[n_chars])
    values[text] = F.col("masked")
    return done.select(*[values[c].alias(c) for c in df.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id")
