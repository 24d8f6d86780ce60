"""Scans and sinks of exports: tables are written in an export's form to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.materialize import shared_folder
from tessera.plans.catalog import query
from tessera.plans.common import read
from tessera.sources import chat, sinks


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return read(spark, d, "events", "event_id", "ts", "user_id", "event_type").select(stamp.alias("timestamp"), F.concat(F.lit("user"), "user_id").alias("speaker"), F.concat("event_type", F.lit(": #"), "event_id").alias("text"), "event_id")


_WANT = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user' || user_id AS speaker, event_type || ': #' || event_id AS text, {0} AS kind FROM events"


@query("txt_chat_scan", _WANT.format("'text'"))
def txt_chat_scan(spark, d):
    """Events as lines of text, with blank lines in between."""
    path = _folder(spark, "txt")
    line = F.concat("timestamp", F.when(F.col("event_id") % 2 == 0, "\t").otherwise(" - "), F.col("speaker"), F.when(F.col("event_id") % 3 == 0, "：").otherwise(": "), F.col("text"))
    _events(spark, d).select(F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(""), line)).otherwise(F.array(line))).alias("value")).write.text(path)
    return chat.txt_messages(spark, path).select("timestamp", "speaker", "text", "kind")


@query("csv_chat_scan", _WANT.format("'note'"))
def csv_chat_scan(spark, d):
    """Half of the files name their columns by aliases, whose empty values fall through."""
    path, e = _folder(spark, "csv"), _events(spark, d).withColumn("kind", F.lit("note"))
    e.where("event_id % 2 = 0").drop("event_id").write.csv(f"{path}/a", header=True)
    e.where("event_id % 2 = 1").select(F.lit("").alias("timestamp"), F.col("timestamp").alias("time"), F.col("speaker").alias("sender"), F.col("text").alias("content"), F.col("kind").alias("type")).write.csv(f"{path}/b", header=True)
    parts = [chat.csv_rows(spark, f"{path}/{k}").select("timestamp", "speaker", "text", "kind") for k in "ab"]
    return parts[0].unionByName(parts[1])


@query("json_chat_scan", _WANT.format("'note'"))
def json_chat_scan(spark, d):
    """One folder with files of JSON lines and files that are one object with messages, a user each."""
    path, e = _folder(spark, "json"), _events(spark, d).withColumn("kind", F.lit("note"))
    e.where("event_id % 2 = 0").drop("event_id").write.json(f"{path}/lines")
    one = F.to_json(F.struct(F.collect_list(F.struct("timestamp", "speaker", "text", "kind")).alias("messages")))
    e.where("event_id % 2 = 1").groupBy((F.col("event_id") % 8).alias("part")).agg(one.alias("value")).write.partitionBy("part").text(f"{path}/objects")
    return chat.json_messages(spark, [f"{path}/lines", f"{path}/objects"]).select("timestamp", "speaker", "text", "kind")


@query("native_json_scan", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user' || user_id AS speaker, CASE WHEN event_id % 3 = 0 THEN 'title' WHEN event_id % 3 = 1 THEN '' ELSE event_type || ': #' || event_id END AS text, 'k' AS kind FROM events")
def native_json_scan(spark, d):
    """Native names; a third has a title instead of content, a third neither."""
    path, k = _folder(spark, "native"), F.col("event_id")
    e = _events(spark, d).select(F.col("timestamp").alias("createTime"), F.col("speaker").alias("senderUsername"), (k % 2 == 0).alias("isSent"), F.lit("k").alias("renderType"), F.when(k % 3 == 2, F.col("text")).otherwise("").alias("content"), F.when(k % 3 == 0, "title").alias("title"))
    e.write.json(path)
    return chat.json_messages(spark, path).select("timestamp", "speaker", "text", "kind")


@query("html_chat_scan", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS record_index, turn::VARCHAR AS timestamp, role AS speaker, trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) AS text, 'text' AS kind FROM conversations")
def html_chat_scan(spark, d):
    """A page a conversation; texts are escaped and partly set in other elements."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    escaped = F.coalesce("text", F.lit(""))
    for sign, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(put))
    element = F.concat(F.lit('<div class="m" data-timestamp="'), F.col("turn"), F.lit('" data-speaker="'), F.col("role"), F.lit('"><b>'), escaped, F.lit("</b></div>\n<p>no time</p>"))
    pages = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", element.alias("e")))), lambda x: x["e"]), "").alias("html"))
    return chat.html_messages(pages, "conv_id", "html")


@query("jsonl_split_scan", "SELECT doc_id, sha256(text) AS text_sha256, lang FROM documents")
def jsonl_split_scan(spark, d):
    """Raw lines beside their rows; a line of another form would fail the scan."""
    path = _folder(spark, "jsonl")
    sinks.jsonl(read(spark, d, "documents", "doc_id", "text", "lang"), path)
    rows = chat.strict_jsonl(spark, path, "doc_id bigint, text string, lang string")
    return rows.select("row.doc_id", F.sha2("row.text", 256).alias("text_sha256"), "row.lang")


@query("import_manifest", "SELECT sha256(doc_id || chr(10)) AS sha256, len(doc_id || chr(10))::BIGINT AS bytes FROM (SELECT DISTINCT doc_id % 7 AS doc_id FROM documents)")
def import_manifest(spark, d):
    """Size and digest of each file of an import."""
    path = _folder(spark, "files")
    k = (F.col("doc_id") % 7).cast("string")
    read(spark, d, "documents", "doc_id").select(k.alias("value"), k.alias("part")).distinct().write.partitionBy("part").text(path)
    return chat.file_manifest(spark, path).where(F.col("path").endswith(".txt")).select("sha256", "bytes")


@query("snapshot_manifest", "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1")
def snapshot_manifest(spark, d):
    """A snapshot by split that never replaces one; its manifest is read from what was written."""
    path = _folder(spark, "snapshot")
    rows = read(spark, d, "documents", "doc_id", "text").withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    sinks.snapshot(rows, path)
    return spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("frozen_manifest_scan", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def frozen_manifest_scan(spark, d):
    """Written under its digest, read and compared with it."""
    rows = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha256"))
    path = sinks.frozen_manifest(rows, _folder(spark, "manifests"), ["doc_id", "sha256"])
    return sinks.frozen_scan(spark, path, "doc_id bigint, sha256 string")


@query("index_manifest", "WITH l AS (SELECT sha256(vec_id::VARCHAR) AS h FROM embeddings), b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM l GROUP BY 1) SELECT (SELECT count(*) FROM embeddings) AS cards, (SELECT count(*) FROM embeddings) AS vectors, (SELECT min(len(embedding))::INT FROM embeddings) AS least_dim, (SELECT max(len(embedding))::INT FROM embeddings) AS most_dim, (SELECT sha256(string_agg(b || d, chr(10) ORDER BY b)) FROM b) AS digest")
def index_manifest(spark, d):
    """Cards: ids by label; vectors beside them."""
    e = read(spark, d, "embeddings", "vec_id", "label", "embedding")
    return sinks.index(e.select("vec_id", "label"), e.select("vec_id", "embedding"), _folder(spark, "index"), "vec_id", "label", "embedding")


@query("metadata_scan", "SELECT source, count(*) AS n, min(n_chars) AS least, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang = 'de' GROUP BY 1")
def metadata_scan(spark, d):
    """Of JSON lines only three fields are parsed; bodies stay where they are."""
    path = _folder(spark, "wide")
    sinks.jsonl(read(spark, d, "documents"), path)
    rows = spark.read.schema("source string, lang string, n_chars bigint").json(path)
    return rows.where("lang = 'de'").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.sum("n_chars").alias("chars"))
