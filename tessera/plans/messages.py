"""Messages in a common form, their ids and digests, topics and dates, on the driver's tables; docstrings say how missing columns are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import messages as ms
from tessera.plans.catalog import query
from tessera.plans.common import read

_RAW = """raw AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN 'm' || event_id END AS mid, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts, CASE event_id % 6 WHEN 0 THEN 'Me' WHEN 1 THEN 'assistant' WHEN 2 THEN 'FRIEND' WHEN 3 THEN 'other' WHEN 4 THEN 'Bob' ELSE '' END AS speaker,
  event_id % 17 = 0 AS sent, CASE event_id % 7 WHEN 0 THEN 'Image' WHEN 1 THEN 'red_packet' WHEN 2 THEN 'VOIP' WHEN 3 THEN 'weird' WHEN 4 THEN 'voice' WHEN 5 THEN NULL ELSE 'text' END AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_id % 2 = 0 THEN props END AS content FROM events)"""


@query(
    "normalised_messages",
    f"""WITH {_RAW}, k AS (SELECT *, CASE lower(replace(coalesce(kind, 'text'), '_', '')) WHEN 'image' THEN 'image' WHEN 'redpacket' THEN 'payment' WHEN 'voip' THEN 'call' WHEN 'voice' THEN 'voice' WHEN 'text' THEN 'text' ELSE 'other' END AS k, coalesce(nullif(text, ''), nullif(content, '')) AS t FROM raw)
    SELECT coalesce(mid, 'record_' || event_id) AS message_id, event_id AS record_index, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS timestamp,
      CASE WHEN sent THEN 'self' ELSE CASE lower(speaker) WHEN 'me' THEN 'self' WHEN 'assistant' THEN 'target' WHEN 'friend' THEN 'target' WHEN 'other' THEN 'other' WHEN 'bob' THEN 'target' ELSE 'unknown' END END AS role, k AS kind,
      nullif(CASE WHEN trim(coalesce(t, ''), ' ') = '' AND k = 'image' THEN '<MEDIA_IMAGE>' WHEN trim(coalesce(t, ''), ' ') = '' AND k = 'voice' THEN '<MEDIA_VOICE>' ELSE coalesce(t, '') END, '') AS text, CASE WHEN ts IS NULL THEN 'partial' ELSE 'ok' END AS parse_status FROM k""",
)
def normalised_messages(spark, d):
    """Raw messages: events; speakers, kinds and what is missing follow from the id; the speaker Bob is mapped to target."""
    k = F.col("event_id")
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    e = read(spark, d, "events", "event_id", "ts", "event_type", "props")
    speaker, raw_kind = pick(6, ["Me", "assistant", "FRIEND", "other", "Bob", ""]), pick(7, ["Image", "red_packet", "VOIP", "weird", "voice", None, "text"])
    texts = [F.when(k % 3 == 0, F.lit("")).otherwise(F.col("event_type")), F.when(k % 2 == 0, F.col("props"))]
    return ms.message(e, F.when(k % 9 != 0, F.concat(F.lit("m"), k)), k, F.when(k % 13 != 0, F.col("ts")), speaker, k % 17 == 0, raw_kind, texts, {"Bob": "target"})


@query("role_counts", f"WITH {_RAW} SELECT CASE WHEN sent THEN 'self' ELSE CASE lower(speaker) WHEN 'me' THEN 'self' WHEN 'assistant' THEN 'target' WHEN 'friend' THEN 'target' WHEN 'other' THEN 'other' ELSE 'unknown' END END AS role, count(*) AS n FROM raw GROUP BY 1")
def role_counts(spark, d):
    """Without a speaker's map Bob is unknown."""
    k = F.col("event_id")
    speaker = F.get(F.array(*map(F.lit, ["Me", "assistant", "FRIEND", "other", "Bob", ""])), (k % 6).cast("int"))
    return read(spark, d, "events", "event_id").groupBy(ms.role(speaker, k % 17 == 0).alias("role")).agg(F.count(F.lit(1)).alias("n"))


_JSON = """'"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'"""


@query("canonical_digests", f"""SELECT doc_id, sha256('{{"id":' || doc_id || ',"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE {_JSON.format("lang")} END || ',"refs":[' || doc_id || ',' || (doc_id + 1) || '],"text":' || {_JSON.format("text")} || '}}') AS digest FROM documents""")
def canonical_digests(spark, d):
    """Keys in order, no blanks, nothing escaped but what has to be."""
    docs = read(spark, d, "documents", "doc_id", "lang", "text")
    refs = ms.list_json(F.array("doc_id", F.col("doc_id") + 1), lambda x: x.cast("string"))
    json = ms.canonical_json({"text": F.col("text"), "lang": F.col("lang"), "json:id": ms.number_json(F.col("doc_id")), "json:refs": refs})
    return docs.select("doc_id", ms.canonical_digest(json).alias("digest"))


_CONVERSATION = "c AS (SELECT conv_id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn) AS m FROM conversations GROUP BY 1)"


def _conversations(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return c.groupBy("conv_id").agg(ordered.alias("m"))


@query(
    "conversation_keys",
    f"""WITH {_CONVERSATION}, k AS (SELECT *, list_filter(list_transform(m, lambda x: {{'role': x.role, 'content': trim(x.content, ' ')}}), lambda x: x.role IN ('system', 'user', 'assistant') AND x.content <> '') AS kept FROM c)
    SELECT conv_id, sha256(array_to_string(list_transform(m, lambda x: x.content), chr(10))) AS content_sha256, sha256(array_to_string(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.content), chr(10))) AS replies_sha256,
      sha256(array_to_string(list_transform(kept, lambda x: x.role || ':' || x.content), chr(10))) AS sample_key, len(kept)::INT AS n_kept FROM k""",
)
def conversation_keys(spark, d):
    c = _conversations(spark, d).withColumn("kept", ms.kept_messages(F.col("m")))
    return c.select("conv_id", ms.content_hash(F.col("m")).alias("content_sha256"), F.sha2(ms.text_by_role(F.col("m"), "assistant").cast("binary"), 256).alias("replies_sha256"), ms.sample_key(F.col("kept")).alias("sample_key"), F.size("kept").alias("n_kept"))


@query("memory_ids", f"WITH s AS (SELECT * FROM documents) SELECT doc_id, 'memory_' || substr(sha256(coalesce(lang || chr(31), '') || text || chr(31) || doc_id || chr(31) || (doc_id + 1)), 1, 20) AS memory_id, 'e_' || substr(sha256('[\"m\",\"' || doc_id || '\"]'), 1, 20) AS evidence_ref FROM s")
def memory_ids(spark, d):
    """Owner: the language; sources: the id and the next one."""
    docs = read(spark, d, "documents", "doc_id", "lang", "text")
    ids = F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))
    return docs.select("doc_id", ms.memory_id(F.col("lang"), F.col("text"), ids).alias("memory_id"), ms.evidence_ref(F.lit("m"), F.col("doc_id").cast("string")).alias("evidence_ref"))


#: The tables hold no Chinese; each document gets one of these at its end.
_PHRASES = ("今天上班很累，想吃火锅", "明天考试，紧张", "2024年2月30日不算，2024/3/1算", "3月5日见", "什么时候的事？", "13月1日，12月31日")
_WITH_PHRASE = "t AS (SELECT doc_id, text || [" + ", ".join(f"'{p}'" for p in _PHRASES) + f"][doc_id % {len(_PHRASES)} + 1] AS text, DATE '2023-01-01' + (doc_id % 700)::INT AS context FROM documents)"


def _phrased(spark, d):
    """Documents with a phrase at the end and a context date that follow from the id."""
    k = F.col("doc_id")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (k % len(_PHRASES)).cast("int"))
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.concat("text", phrase).alias("text"), F.date_add(F.lit("2023-01-01").cast("date"), (k % 700).cast("int")).alias("context"))


_TOPIC_CASES = ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in sorted(ms.TOPICS.items()))


@query("topic_tags", f"WITH {_WITH_PHRASE} SELECT doc_id, array_to_string(list_filter([{_TOPIC_CASES}], lambda x: x IS NOT NULL), ',') AS topics FROM t")
def topic_tags(spark, d):
    return _phrased(spark, d).select("doc_id", F.array_join(ms.topics(F.col("text")), ",").alias("topics"))


@query(
    "query_terms",
    f"""WITH {_WITH_PHRASE}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[㐀-鿿]+')) AS run FROM t),
    k AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(run, '^[㐀-鿿]') THEN [run[i:i] for i in range(1, len(run) + 1)] || [run[i:i+1] for i in range(1, len(run))] ELSE [lower(run)] END) AS term FROM r)
    SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_terms FROM k WHERE NOT (len(term) = 1 AND regexp_matches(term, '[一-鿿]')) AND term NOT IN ({", ".join(f"'{s}'" for s in ms.QUERY_STOPS)}) GROUP BY 1""",
)
def query_terms(spark, d):
    terms = ms.query_terms(tx.lexical_tokens("text"))
    return _phrased(spark, d).select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("distinct_terms"))


@query(
    "event_dates",
    f"""WITH {_WITH_PHRASE}, f AS (SELECT doc_id, context, list_filter(list_transform(regexp_extract_all(' ' || text, '[^0-9](20[0-9]{{2}}[-年/.][0-9]{{1,2}}[-月/.][0-9]{{1,2}})', 1), lambda x: try_strptime(regexp_replace(x, '[年月/.]', '-', 'g'), '%Y-%m-%d')), lambda x: x IS NOT NULL) AS a,
      list_filter(list_transform(regexp_extract_all(text, '([0-9]{{1,2}}月[0-9]{{1,2}})日', 1), lambda x: try_strptime(year(context) || '-' || replace(x, '月', '-'), '%Y-%m-%d')), lambda x: x IS NOT NULL) AS b FROM t)
    SELECT doc_id, coalesce(a[1], b[1], context::TIMESTAMP)::DATE::VARCHAR AS date, len(a) + len(b) > 0 AS explicit FROM f""",
)
def event_dates(spark, d):
    r = _phrased(spark, d).select("doc_id", ms.event_date(F.col("text"), F.col("context")).alias("r"))
    return r.select("doc_id", F.col("r.date").cast("string").alias("date"), "r.explicit")


@query("style_redaction")
def style_redaction(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(ms.style_redacted(F.col("text")).cast("binary"), 256).alias("redacted_sha256"))


@query(
    "relationship_events",
    f"""WITH {_WITH_PHRASE}, h AS (SELECT doc_id, text, context, contains(text, '今天') OR contains(text, '明天') AS rel, regexp_matches(text, '[0-9]{{1,2}}月[0-9]{{1,2}}日|20[0-9]{{2}}/[0-9]') AS dated FROM t WHERE regexp_matches(text, '火锅|考试|月')),
    s AS (SELECT *, CASE WHEN dated AND rel THEN 0.9 WHEN dated THEN 0.75 WHEN rel THEN 0.65 ELSE 0.45 END::DOUBLE AS confidence FROM h) SELECT context::VARCHAR AS day, confidence, count(*) AS n, min(doc_id) AS first_id FROM s GROUP BY 1, 2""",
)
def relationship_events(spark, d):
    """Patterns, relative words and dates are those of the phrases; one candidate a day and confidence, the first."""
    t = F.col("text")
    rel = F.contains(t, F.lit("今天")) | F.contains(t, F.lit("明天"))
    dated = t.rlike("[0-9]{1,2}月[0-9]{1,2}日|20[0-9]{2}/[0-9]")
    confidence = F.when(dated & rel, 0.9).when(dated, 0.75).when(rel, 0.65).otherwise(0.45)
    return _phrased(spark, d).where(t.rlike("火锅|考试|月")).groupBy(F.col("context").cast("string").alias("day"), confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
