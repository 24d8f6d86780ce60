"""Callers' functions on the driver's tables, observations of external operations, and guards."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions import privacy
from tessera.operators import packing as pk
from tessera.operators import plugins as pg
from tessera.operators import records as rc
from tessera.plans.catalog import query
from tessera.plans.common import read

_WORD = "[^\\x20\\x09-\\x0D]+"


@query("request_tokens", f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) + 5 + 96 AS tokens FROM documents")
def request_tokens(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", pg.request_tokens(F.col("text"), "answer in short", "a schema").alias("tokens"))


def _vector(texts):
    return [(len(t), len(t.encode().split()), t.count("e")) for t in texts]


@query("encoded_texts", f"SELECT doc_id, len(coalesce(text, ''))::DOUBLE AS a, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::DOUBLE AS b, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS c FROM documents")
def encoded_texts(spark, d):
    """The model here: characters, words and e's."""
    v = read(spark, d, "documents", "doc_id", "text").select("doc_id", pg.encoded(F.col("text"), lambda: _vector).alias("v"))
    return v.select("doc_id", *[F.col("v")[k].alias(n) for k, n in enumerate("abc")])


@query("scored_turns", "WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS a, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations) SELECT conv_id, turn, round(abs(len(a) - len(b)) / greatest(len(a), len(b), 1), 9) AS score FROM p")
def scored_turns(spark, d):
    """The scorer here: how much two turns differ in length."""
    from pyspark.sql import Window

    c = read(spark, d, "conversations", "conv_id", "turn", "text").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    score = pg.scored(F.col("text"), F.col("before"), lambda a, b: abs(len(a) - len(b)) / max(len(a), len(b), 1))
    return c.select("conv_id", "turn", F.round(score, 9).alias("score"))


@query("mapped_batches", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE lang = 'en'")
def mapped_batches(spark, d):
    def run(frame):
        kept = frame[frame["lang"] == "en"]
        return kept.assign(text_md5=[hashlib.md5(t.encode()).hexdigest() for t in kept["text"]])[["doc_id", "text_md5"]]

    return pg.mapped(read(spark, d, "documents", "doc_id", "text", "lang").where("text IS NOT NULL"), run, "doc_id bigint, text_md5 string")


@query("injection_guard", "SELECT doc_id, (contains(lower(text), 'ignore') OR contains(lower(text), 'the')) AND (contains(lower(text), 'password') OR contains(lower(text), 'and')) AS blocked FROM documents")
def injection_guard(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", privacy.injection_guard("text", ("ignore", "the"), ("password", "and")).alias("blocked"))


@query("split_names", "SELECT p_brand, count(*) AS n, floor(0.7::DOUBLE * count(*))::BIGINT AS train, round_even(0.15::DOUBLE * count(*), 0)::BIGINT AS validation FROM part GROUP BY 1")
def split_names(spark, d):
    """Sizes of splits: the share of the first cut off, that of the second rounded to even."""
    n = F.count(F.lit(1))
    return read(spark, d, "part", "p_brand").groupBy("p_brand").agg(n.alias("n"), F.floor(F.lit(0.7) * n).alias("train"), F.bround(F.lit(0.15) * n).cast("long").alias("validation"))


@query("external_observations")
def external_observations(spark, d):
    """Operations: users; messages: an id for every three events, so that some come again, with the type as their status."""
    names = {"click": "queued", "view": "running", "error": "failed", "purchase": "succeeded", "signup": "unknown"}
    status = F.lit("unknown")
    for k, v in names.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    e = read(spark, d, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", (F.col("event_id") / 3).cast("long").alias("message"), status.alias("status"))

    def run(rows):
        state = rc.observed([(message, st) for _, message, st in rows])
        return [(state["status"], len(state["kept"]), state["repeats"], state["conflicts"])]

    return pk.folded(e, "user_id", "event_id", ["event_id", "message", "status"], run, "status string, kept int, repeats int, conflicts int")
