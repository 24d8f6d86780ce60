"""Chat exports as one contract: record_index, timestamp, speaker, text, kind; indices are places in the file."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import first_given

CONTRACT = ("path", "record_index", "timestamp", "speaker", "text", "kind")
#: Line shape, field aliases and message elements of the export formats.
LINE = r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)\s*(?:\t|\s+-\s+|\s+)([^:：]+)[:：]\s*(.*)$"
ALIASES = {"timestamp": ("timestamp", "time"), "speaker": ("speaker", "sender"), "text": ("text", "content"), "kind": ("kind", "type")}
ELEMENTS = ("div", "p", "li", "article", "message")
NATIVE = ("createTime", "senderUsername", "isSent", "renderType")


class BadExport(ValueError):
    """An export that can't be read as a whole."""


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` (with path) plus record_index, the row's place in its file."""
    return df.withColumn("record_index", F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1)


def txt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``time speaker: text``; blank ones count for the index; bad marks lines of any other form.

    Lines are read in splits; a line's index is its place by split and then inside it, so a file may be larger than a task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = _numbered(lines, F.col("__b"), F.col("__m")).where(F.trim("line") != "")
    part = lambda k: F.regexp_extract("line", LINE, k)
    return rows.select("path", "record_index", part(1).alias("timestamp"), F.trim(part(2)).alias("speaker"), part(3).alias("text"), F.lit("text").alias("kind"), (~F.col("line").rlike(LINE)).alias("bad"))


def txt_messages(spark: SparkSession, path: str) -> DataFrame:
    """``txt_lines`` of an import: one line of another form fails it."""
    rows = txt_lines(spark, path)
    bad = rows.where("bad").orderBy("path", "record_index").limit(1).collect()
    if bad:
        raise BadExport(f"{bad[0]['path']}: line {bad[0]['record_index'] + 1} has no message")
    return rows.drop("bad")


def _given(df: DataFrame, name: str) -> Column:
    have = [c for c in ALIASES[name] if c in df.columns]
    return first_given(*[F.col(f"`{c}`").cast("string") for c in have]) if have else F.lit(None).cast("string")


def _contract(df: DataFrame) -> DataFrame:
    return df.select("path", "record_index", *[_given(df, c).alias(c) for c in ALIASES])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header; of aliases the first that isn't empty counts. Multi-line values keep a file in one task."""
    df = spark.read.csv(path, header=True, multiLine=True).withColumns({"path": F.col("_metadata.file_path"), "__m": F.monotonically_increasing_id()})
    return _contract(_numbered(df, F.col("__m")))


def _shapes(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by the first character that isn't blank: ``{`` with messages in its file is an object, ``[`` an array, all else lines."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.ltrim("value").alias("v")).where("v <> ''")
    heads = lines.groupBy("path").agg(F.min_by(F.substring("v", 1, 1), F.struct("b", "m")).alias("head"), F.bool_or(F.col("v").contains('"messages"')).alias("nested")).collect()  # a row a file
    out: dict[str, list[str]] = {"object": [], "array": [], "lines": []}
    for r in heads:
        out["array" if r["head"] == "[" else "object" if r["head"] == "{" and r["nested"] else "lines"].append(r["path"])
    return out


def json_messages(spark: SparkSession, path: str) -> DataFrame:
    """Objects with ``messages``, arrays, or JSON lines, each file by its own shape; native exports (createTime, senderUsername, isSent, renderType) are renamed."""
    parts = []
    for shape, files in _shapes(spark, path).items():
        if not files:
            continue
        df = spark.read.option("recursiveFileLookup", "true").json(files, multiLine=shape != "lines").withColumns({"path": F.col("_metadata.file_path"), "__b": F.col("_metadata.file_block_start"), "__m": F.monotonically_increasing_id()})
        if shape == "object":
            df = df.select("path", F.posexplode("messages").alias("record_index", "__o")).select("path", "record_index", "__o.*")
        else:
            df = _numbered(df, F.col("__b"), F.col("__m")).drop("__b", "__m")
        parts.append(_native(df) if set(NATIVE) & set(df.columns) else _contract(df))
    out = parts[0] if parts else spark.createDataFrame([], "path string, record_index int, timestamp string, speaker string, text string, kind string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _native(df: DataFrame) -> DataFrame:
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.select("path", "record_index", have("createTime").alias("timestamp"), have("senderUsername").alias("speaker"), F.coalesce(first_given(have("content"), have("title")), F.lit("")).alias("text"), have("renderType").alias("kind"))


#: Tags whose elements may be messages, with their attributes; quoted values may hold what ends a tag.
_TAG = re.compile(rf"""<(/?)({"|".join(ELEMENTS)})\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.IGNORECASE)
_ANY = re.compile(r"""<!--.*?-->|<[/!a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def messages_in(page: str) -> list[tuple[str, str, str, str]]:
    """timestamp, speaker, text and kind of each message: an element with a time, up to the next end of such an element; a later one with a time takes its place."""
    out, held = [], None
    for tag in _TAG.finditer(page):
        if tag[1]:
            if held:
                inner = _ANY.sub("", page[held[0] : tag.start()])
                out.append((held[1], held[2], html.unescape(inner).strip(), held[3]))
            held = None
            continue
        said = {name.lower(): html.unescape(next((v for v in values if v), "")) for name, *values in _ATTRIBUTE.findall(tag[3])}
        at = said.get("data-timestamp") or said.get("timestamp")
        if at:
            held = (tag.end(), at, said.get("data-speaker") or said.get("speaker") or "", said.get("data-kind") or "text")
    return out


def html_messages(df: DataFrame, key: str, page: str) -> DataFrame:
    """``key``, record_index, timestamp, speaker, text, kind of the message elements of each page; broken markup is read as far as it goes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *m) for k, text in zip(frame[key], frame[page], strict=True) for i, m in enumerate(messages_in(text or ""))]
            yield pd.DataFrame(rows, columns=[key, "record_index", "timestamp", "speaker", "text", "kind"])

    return df.select(key, page).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, record_index int, timestamp string, speaker string, text string, kind string")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line_no (from 1), raw (the line as it is) and row; blank lines count but are skipped, a line that isn't of the schema fails the scan when it is read."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.col("value").alias("raw"))
    rows = _numbered(lines, F.col("__b"), F.col("__m")).where(F.trim("raw") != "")
    return rows.select("path", (F.col("record_index") + 1).alias("line_no"), "raw", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("row"))


def visible_text(df: DataFrame, key: str, page: str) -> DataFrame:
    """``key``, n_elements and n_chars of visible text of each page."""

    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.n, self.hidden, self.parts = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.n += 1
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[page], strict=True):
                p = Text()
                p.feed(text or "")
                out.append((k, p.n, len(" ".join("".join(p.parts).split()))))
            yield pd.DataFrame(out, columns=[key, "n_elements", "n_chars"])

    return df.select(key, page).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_elements int, n_chars int")


def parsed_timestamp(c: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds or (above 1e10) milliseconds, ISO with offset, or a local form in ``zone``; a UTC wall clock, null if it is none of them."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    number = F.expr("cast(null as double)") if s is None else s.try_cast("double")
    epoch = F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number))
    offset = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))
    local = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")])
    return F.coalesce(F.when(s.rlike(r"^\d+(\.\d+)?$"), epoch), offset, F.to_utc_timestamp(local, zone))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
