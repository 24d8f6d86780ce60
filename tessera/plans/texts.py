"""Scans, redaction, templates and curation on documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import privacy
from tessera.functions import text as tx
from tessera.functions.columns import digest
from tessera.operators import curation as cu
from tessera.operators.dedup import exact_duplicates
from tessera.plans.catalog import query
from tessera.plans.common import read


@query("leak_counts")
def leak_counts(spark, d):
    return privacy.scanned(read(spark, d, "documents", "doc_id", "text"), "text").drop("text")


@query("leak_totals")
def leak_totals(spark, d):
    counts = privacy.scanned(read(spark, d, "documents", "source", "text"), "text").drop("text")
    return counts.groupBy("source").agg(*[F.sum(n).alias(n) for n in counts.columns if n != "source"])


@query("redaction")
def redaction(spark, d):
    return privacy.with_redaction(read(spark, d, "documents", "doc_id", "text"), "text").select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.array_join("categories", ",").alias("categories"))


@query("redaction_categories")
def redaction_categories(spark, d):
    r = privacy.with_redaction(read(spark, d, "documents", "lang", "text"), "text")
    # a plain explode makes Spark filter by the array's size below the steps, where each of them would stand twice in the next
    return r.select("lang", F.explode_outer("categories").alias("category")).where("category IS NOT NULL").groupBy("lang", "category").agg(F.count(F.lit(1)).alias("n"))


@query("split_credentials")
def split_credentials(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "text")
    return privacy.split_credentials(c, "conv_id", "turn", "text").groupBy("conv_id").agg(F.count_if("split_secret").alias("n"))


def _talk(spark, d):
    """Conversations whose odd turns are labels of secrets and whose next turns are values, for ids divisible by 3; turns of 7 are left out of the export."""
    c = read(spark, d, "conversations", "conv_id", "turn", "text").where("turn % 7 <> 6")
    k, t = F.col("conv_id"), F.col("turn")
    said = F.when((k % 3 == 0) & (t % 2 == 1), F.element_at(F.array(*map(F.lit, ("token", "密码", "password", "验证码"))), (k % 4 + 1).cast("int"))).when((k % 3 == 0) & (t % 4 == 2), F.concat(F.lit("abc"), 1000 + k)).when((k % 3 == 0) & (t % 4 == 0), F.lit(" 123456。"))
    one = F.struct(t.cast("int").alias("idx"), F.coalesce(said, F.col("text"), F.lit("")).alias("content"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))


@query("adjacent_redaction")
def adjacent_redaction(spark, d):
    """Values after a label are replaced; how many, and the digest of what is left."""
    r = _talk(spark, d).select("conv_id", "m", privacy.adjacent_redacted(F.col("m")).alias("r"))
    marks = lambda c: F.aggregate(c, F.lit(0), lambda n, m: n + F.regexp_count(m["content"], F.lit("<SECRET>")))
    joined = F.array_join(F.transform("r", lambda m: m["content"]), "\n")
    return r.select("conv_id", (marks("r") - marks("m")).alias("replaced"), F.sha2(joined.cast("binary"), 256).alias("text_sha256"))


@query("sequence_scan")
def sequence_scan(spark, d):
    """Counts of single messages and of pairs that make a credential."""
    t = _talk(spark, d).select("conv_id", privacy.adjacent_count(F.col("m")).alias("cross_message"), F.explode("m").alias("x"))
    each = privacy.scanned(t.select("conv_id", "cross_message", F.col("x.content").alias("text")), "text")
    g = each.groupBy("conv_id").agg(F.max("cross_message").alias("cross_message"), F.sum("hard_leak_count").alias("atomic"))
    return g.withColumn("hard_leak_count", F.col("cross_message") + F.col("atomic"))


@query("session_scan")
def session_scan(spark, d):
    """The view with the source's indices and one without: of each category the greater count."""
    public = F.transform("m", lambda m, i: F.struct(i.cast("int").alias("idx"), m["content"].alias("content")))
    t = _talk(spark, d).select("conv_id", F.greatest(privacy.adjacent_count(F.col("m")), F.lit(0)).alias("boundary"), privacy.adjacent_count(public).alias("public"))
    return t.withColumn("merged", F.greatest("boundary", "public"))


@query("canary_scan", "SELECT lang AS split, count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '(?i)(token|password|secret)\\s*[:=]')) AS n_hits FROM documents GROUP BY 1")
def canary_scan(spark, d):
    return read(spark, d, "documents", "lang", "text").groupBy(F.col("lang").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").rlike(r"(?i)(token|password|secret)\s*[:=]")).alias("n_hits"))


@query("masked_texts", r"""SELECT doc_id, sha256(regexp_replace(text, '(?i)(bearer[\s\x0b\x85\pZ]+|(?:api[_-]?key|token|password|secret)["'']?[\s\x0b\x85\pZ]*[:=][\s\x0b\x85\pZ]*["'']?)[^\s\x0b\x85\pZ,;"''}]+', '\1[REDACTED]', 'g')) AS masked_sha256 FROM documents""")
def masked_texts(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(tx.masked_text("text"), 256).alias("masked_sha256"))


_TEMPLATE = "regexp_replace(regexp_replace(lower({0}), '[0-9]', '#', 'g'), '[^a-z0-9㐀-鿿]', '', 'g') || CASE WHEN regexp_matches(lower({0}), '[0-9#]') THEN '#' ELSE '' END"


@query("template_digest_counts", f"SELECT sha256({_TEMPLATE.format('text')}) AS template, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def template_digest_counts(spark, d):
    t = read(spark, d, "documents", "doc_id", "text").withColumn("template", digest(tx.template("text")))
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("meaningful_chars", "SELECT doc_id, len(regexp_replace(text, '[^A-Za-z0-9㐀-鿿]', '', 'g'))::INT AS n FROM documents")
def meaningful_chars(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.length(tx.meaningful("text")).alias("n"))


@query("lexical_token_counts", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS x, lower(x) AS t FROM benchmark) GROUP BY 1")
def lexical_token_counts(spark, d):
    return read(spark, d, "benchmark", "text").select(F.explode(tx.lexical_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shingle_counts",
    r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM benchmark)
    SELECT item_id, len(list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]))::INT AS n FROM t""",
)
def shingle_counts(spark, d):
    return read(spark, d, "benchmark", "item_id", "text").select("item_id", F.size(tx.token_shingles("text")).alias("n"))


@query("term_bigram_counts", r"SELECT item_id, CASE WHEN len(s) < 2 THEN 0 ELSE len(list_distinct([s[i:i+1] for i in range(1, len(s))])) END::INT AS n FROM (SELECT item_id, regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g') AS s FROM benchmark)")
def term_bigram_counts(spark, d):
    return read(spark, d, "benchmark", "item_id", "text").select("item_id", F.size(tx.term_bigrams("text")).alias("n"))


@query("document_token_counts", "SELECT t AS token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS t FROM documents) GROUP BY 1")
def document_token_counts(spark, d):
    """Over whole documents; the SQL has no CJK runs, as the tables have none."""
    return read(spark, d, "documents", "text").select(F.explode(tx.lexical_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_shingle_counts",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents)
    SELECT doc_id, len(list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]))::INT AS n FROM t""",
)
def document_shingle_counts(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(tx.token_shingles("text")).alias("n"))


@query("document_bigram_counts", r"SELECT doc_id, CASE WHEN len(s) < 2 THEN 0 ELSE len(list_distinct([s[i:i+1] for i in range(1, len(s))])) END::INT AS n FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g') AS s FROM documents)")
def document_bigram_counts(spark, d):
    """Characters are split once: cut out by position, long texts would take time by the square of their length."""
    c = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.split(F.regexp_replace("text", r"(?U)\W+", ""), "").alias("s"))
    return c.select("doc_id", F.size(F.array_distinct(F.expr("zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (x, y) -> concat(x, y))"))).alias("n"))


@query("nfkc_normalise")
def nfkc_normalise(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(tx.normalized("text"), 256).alias("normal_sha256"))


@query("exact_dups", "SELECT sha256(trim(text, ' ')) AS content, count(*) AS n, min(doc_id) AS keep_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return exact_duplicates(read(spark, d, "documents", "doc_id", "text"), "text", "doc_id")


def _samples(spark, d):
    """Assistant turns with the user turn before them; conversations whose id modulo 5 is 0 are validation."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumns({"user_text": F.lag("text").over(w), "before": F.lag("role").over(w), "context_messages": F.row_number().over(w) - 1})
    pairs = pairs.where("role = 'assistant' AND before = 'user'")
    split = F.when(F.col("conv_id") % 5 == 0, F.lit("validation")).otherwise(F.lit("train"))
    return pairs.select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), "conv_id", split.alias("split"), "user_text", F.col("text").alias("assistant_text"), "context_messages")


_SAMPLES = """p AS (SELECT *, lag(text) OVER w AS user_text, lag(role) OVER w AS before, row_number() OVER w - 1 AS context_messages FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
samples AS (SELECT conv_id || ':' || turn AS sample_id, conv_id, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, coalesce(user_text, '') AS u, coalesce(text, '') AS a, context_messages
  FROM p WHERE role = 'assistant' AND before = 'user')"""
_LIMITS = """, tr AS (SELECT len(u) AS uc, len(a) AS ac, row_number() OVER (ORDER BY len(u)) - 1 AS ur, row_number() OVER (ORDER BY len(a)) - 1 AS ar, count(*) OVER () AS n FROM samples WHERE split = 'train'),
limits AS (SELECT max(uc) FILTER (ur = ceil((n - 1) * 0.99::DOUBLE))::INT AS user_long, max(ac) FILTER (ar = ceil((n - 1) * 0.99::DOUBLE))::INT AS assistant_long FROM tr)"""
_CASES = ", ".join(f"CASE WHEN regexp_matches(a, '{p}') THEN '{n}' END" for n, p in cu.CATEGORIES.items())
_DECIDED = rf"""{_LIMITS}, o AS (SELECT s.*, l.*, len(u) AS uc, len(a) AS ac, len(regexp_replace(regexp_replace(a, '{cu.PLACEHOLDER}', '', 'g'), '[^A-Za-z0-9㐀-鿿]', '', 'g')) AS mc,
  list_sort(list_filter([{_CASES}], lambda x: x IS NOT NULL)) AS cats,
  len(regexp_extract_all(u || chr(10) || a, '{cu.WORK}')) AS work, len(regexp_extract_all(u || chr(10) || a, '{cu.NUMBER_FACT}')) AS facts, regexp_matches(u || chr(10) || a, '{cu.THIRD_PARTY}') AS gossip,
  regexp_extract_all(u, '(?mi)^(self|target)\s*[:：]', 1) AS speakers,
  regexp_replace(u, '[^A-Za-z0-9㐀-鿿]', '', 'g') = '' AS no_user FROM samples s, limits l),
sc AS (SELECT *, 2 + CASE WHEN ac <= assistant_long THEN 1 ELSE -1 END + CASE WHEN context_messages >= 6 THEN 1 ELSE 0 END + 2 * len(cats) - CASE WHEN list_contains(cats, 'warm_tone') THEN 1 ELSE 0 END
  - CASE WHEN uc > user_long AND work >= 3 THEN 3 ELSE 0 END - CASE WHEN gossip THEN 2 ELSE 0 END AS score FROM o),
decided AS (SELECT *, list_sort(list_filter([
  CASE WHEN len(speakers) > 0 AND lower(speakers[-1]) = 'target' THEN 'invalid_direct_context' END, CASE WHEN no_user THEN 'missing_user_context' END, CASE WHEN mc = 0 THEN 'empty_or_emoji_only_target' END,
  CASE WHEN mc < 3 THEN 'assistant_reply_too_short' END, CASE WHEN uc > 2 * user_long THEN 'context_length_outlier' END, CASE WHEN ac > 4 * assistant_long THEN 'target_length_outlier' END,
  CASE WHEN facts >= 3 AND len(list_filter(cats, lambda x: x NOT IN ('engaged_question', 'warm_tone'))) = 0 THEN 'structured_memory_candidate_not_style_sft' END,
  CASE WHEN len(cats) = 0 THEN 'no_target_style_signal' END, CASE WHEN score < 5 THEN 'insufficient_usefulness_score' END,
  CASE WHEN uc > user_long AND work >= 3 AND score < 5 THEN 'long_work_log' END, CASE WHEN gossip AND score < 5 THEN 'third_party_gossip' END], lambda x: x IS NOT NULL)) AS reasons FROM sc)"""


def _observed(spark, d):
    return cu.observe(_samples(spark, d))


def _decided(spark, d):
    o = _observed(spark, d)
    return cu.decide(o, cu.thresholds(o.where("split = 'train'")))


@query("sft_candidates", f"WITH {_SAMPLES} SELECT sample_id, split, context_messages::INT AS context_messages, sha256(u || chr(31) || a) AS content FROM samples")
def sft_candidates(spark, d):
    s = _samples(spark, d)
    return s.select("sample_id", "split", F.col("context_messages").cast("int"), digest("user_text", "assistant_text").alias("content"))


@query("curation_thresholds", f"WITH {_SAMPLES}{_LIMITS} SELECT * FROM limits")
def curation_thresholds(spark, d):
    return cu.thresholds(_observed(spark, d).where("split = 'train'"))


@query("curation_decisions", f"WITH {_SAMPLES}{_DECIDED} SELECT sample_id, split, score::INT AS score, array_to_string(cats, ',') AS categories, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS selected FROM decided")
def curation_decisions(spark, d):
    return _decided(spark, d).select("sample_id", "split", "score", F.array_join("categories", ",").alias("categories"), F.array_join("reasons", ",").alias("reasons"), "selected")


@query("curation_reason_counts", f"WITH {_SAMPLES}{_DECIDED} SELECT split, reason, count(*) AS n FROM (SELECT split, unnest(reasons) AS reason FROM decided) GROUP BY ALL")
def curation_reason_counts(spark, d):
    return _decided(spark, d).select("split", F.explode("reasons").alias("reason")).groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n"))


_PRIORITY = " ".join(f"WHEN list_contains(reasons, '{r}') THEN '{r}'" for r in cu.PRIORITY)


@query("primary_reason", f"WITH {_SAMPLES}{_DECIDED} SELECT split, CASE WHEN len(reasons) = 0 THEN 'selected_useful_style' {_PRIORITY} ELSE 'excluded_other' END AS reason, count(*) AS n FROM decided GROUP BY ALL")
def primary_reason(spark, d):
    return _decided(spark, d).groupBy("split", cu.primary_reason(F.col("reasons")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_CAPPED = (
    f", k AS (SELECT *, {_TEMPLATE.format('a')} AS template, len(reasons) = 0 AS sel FROM decided), f AS (SELECT template FROM k WHERE split = 'train' AND len(template) <= 32 GROUP BY 1 HAVING count(*) >= 6), "
    "r AS (SELECT *, sel AND template IN (SELECT template FROM f) AND row_number() OVER (PARTITION BY split, template, sel ORDER BY sha256(sample_id)) > 3 AS over FROM k)"
)


@query("repetition_cap_decisions", f"WITH {_SAMPLES}{_DECIDED}{_CAPPED} SELECT sample_id, split, sel AND NOT over AS selected, CASE WHEN over THEN 'repetitive_template_cap' ELSE array_to_string(reasons, ',') END AS reasons FROM r")
def repetition_cap_decisions(spark, d):
    """The cap on the real decisions, by the normalised template of the whole reply and its length."""
    k = _decided(spark, d)
    return cu.cap_templates(k, k.where("split = 'train'"), "sample_id").select("sample_id", "split", "selected", F.array_join("reasons", ",").alias("reasons"))


@query(
    "split_quality_report",
    f"WITH t AS (SELECT lang, sha256({_TEMPLATE.format('text')}) AS k FROM documents), g AS (SELECT lang, k, count(*) AS n FROM t GROUP BY 1, 2) "
    "SELECT lang, sum(n)::BIGINT AS rows, count(*) AS unique_values, count(*) FILTER (n > 1) AS repeated_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_repeated, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS repeated_share FROM g GROUP BY 1",
)
def split_quality_report(spark, d):
    return cu.duplicate_summary(read(spark, d, "documents", "lang", "text").select("lang", digest(tx.template("text")).alias("k")), "k", "lang")


@query(
    "length_summary",
    "WITH r AS (SELECT lang, len(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY len(text)) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) "
    "SELECT lang, max(n) AS n, min(v)::INT AS least, max(v) FILTER (k = ceil((n - 1) * 0.5::DOUBLE))::INT AS p50, max(v) FILTER (k = ceil((n - 1) * 0.9::DOUBLE))::INT AS p90, max(v) FILTER (k = ceil((n - 1) * 0.99::DOUBLE))::INT AS p99, max(v)::INT AS most FROM r GROUP BY 1",
)
def length_summary(spark, d):
    return cu.length_summary(read(spark, d, "documents", "lang", "text").withColumn("v", F.length("text")), "v", "lang")
