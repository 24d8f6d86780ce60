"""Decision rules, reviews and gates on the driver's tables; docstrings say how missing columns are derived."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import decisions as dc
from tessera.plans.catalog import query
from tessera.plans.common import read

_EXTRACTED = """x AS (SELECT o_custkey AS g, o_orderpriority AS c, o_orderkey AS k,
  CASE WHEN o_orderkey % 5 < 2 THEN 'positive' WHEN o_orderkey % 5 = 2 THEN 'negative' WHEN o_orderkey % 5 = 3 THEN 'uncertain' END AS polarity,
  CASE o_orderstatus WHEN 'F' THEN 'explicit' WHEN 'O' THEN 'quoted' ELSE 'relative' END AS claim, o_orderkey % 23 = 0 AS open, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'text' END AS basis FROM orders)"""


def _extracted(spark, d):
    """Groups: customers; candidates: priorities; extractions: orders, whose key and status say the rest."""
    k = F.col("o_orderkey")
    polarity = F.when(k % 5 < 2, "positive").when(k % 5 == 2, "negative").when(k % 5 == 3, "uncertain")
    claim = F.when(F.col("o_orderstatus") == "F", "explicit").when(F.col("o_orderstatus") == "O", "quoted").otherwise("relative")
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("c"), k.alias("k"), polarity.alias("polarity"), claim.alias("claim"), (k % 23 == 0).alias("open"), F.when(k % 7 == 0, "unknown").otherwise("text").alias("basis"))


_RISKS = f"""{_EXTRACTED}, r AS (SELECT g, c, coalesce(bool_or(polarity = 'positive' AND claim IN ('explicit', 'relative')), false) AND NOT bool_or(open) AS eligible,
  list_filter([CASE WHEN coalesce(bool_or(polarity IN ('negative', 'uncertain')), false) THEN 'mixed_or_non_positive_polarity' END, CASE WHEN NOT coalesce(bool_or(polarity = 'positive'), false) THEN 'no_positive_evidence' END,
    CASE WHEN NOT bool_or(claim IN ('explicit', 'relative')) THEN 'non_direct_claim' END, CASE WHEN bool_or(claim IN ('quoted', 'hypothetical')) THEN 'quoted_or_hypothetical' END,
    CASE WHEN bool_or(basis = 'unknown') THEN 'unknown_date_basis' END, CASE WHEN bool_or(open) THEN 'unresolved_reference' END], lambda x: x IS NOT NULL) AS risks FROM x GROUP BY 1, 2)"""


def _risks(spark, d):
    return dc.candidate_risks(_extracted(spark, d), ["g", "c"], "polarity", "claim", F.col("open"), "basis")


@query("candidate_risks", f"WITH {_RISKS} SELECT g, c, eligible, array_to_string(risks, ',') AS risks FROM r")
def candidate_risks(spark, d):
    return _risks(spark, d).select("g", "c", "eligible", F.array_join("risks", ",").alias("risks"))


_DETERMINISTIC = f"""{_RISKS}, a AS (SELECT g, bool_or(eligible) AS good, flatten(list(risks)) AS risks FROM r GROUP BY 1),
decided AS (SELECT g, CASE WHEN list_contains(risks, 'unresolved_reference') THEN 'deferred' WHEN list_has_any(risks, ['quoted_or_hypothetical', 'no_positive_evidence', 'mixed_or_non_positive_polarity']) THEN 'rejected' ELSE 'deferred' END AS status,
  CASE WHEN list_contains(risks, 'unresolved_reference') THEN 'temporal_unresolved' WHEN list_contains(risks, 'quoted_or_hypothetical') THEN 'quoted_or_hypothetical' WHEN list_has_any(risks, ['no_positive_evidence', 'mixed_or_non_positive_polarity']) THEN 'negative_or_uncertain' ELSE 'needs_more_context' END AS reason
  FROM a WHERE NOT good)"""


@query("deterministic_decisions", f"WITH {_DETERMINISTIC} SELECT * FROM decided")
def deterministic_decisions(spark, d):
    return dc.deterministic_decision(_risks(spark, d), "g", "eligible", "risks")


@query(
    "thresholded_decisions",
    f"""WITH {_RISKS}, l AS (SELECT *, CASE WHEN g % 4 < 2 THEN 'confirmed' WHEN g % 4 = 2 THEN 'rejected' ELSE 'deferred' END AS status, (g * 37 % 100) / 100.0::DOUBLE AS confidence, g % 3 = 0 AS conflicted FROM r),
    w AS (SELECT *, status = 'confirmed' AND (confidence < 0.7 OR NOT eligible) AS y, status = 'rejected' AND confidence < 0.6 AS n FROM l)
    SELECT g, c, CASE WHEN y OR n THEN 'deferred' ELSE status END AS status, CASE WHEN y AND conflicted THEN 'conflict_unresolved' WHEN y OR n THEN 'needs_more_context' ELSE 'label' END AS reason FROM w""",
)
def thresholded_decisions(spark, d):
    """A label's claim and confidence follow from the group's number; groups divisible by 3 are conflicted."""
    g = F.col("g")
    status = F.when(g % 4 < 2, "confirmed").when(g % 4 == 2, "rejected").otherwise("deferred")
    decided = dc.thresholded_decision(status, F.lit("label"), (g * 37 % 100) / F.lit(100.0), F.col("eligible"), g % 3 == 0, 0.7, 0.6)
    return _risks(spark, d).withColumn("x", decided).select("g", "c", "x.status", "x.reason")


@query(
    "repaired_decisions",
    """WITH e AS (SELECT user_id AS g, CASE WHEN event_type IN ('click', 'view') THEN 'confirmed' WHEN event_type = 'error' THEN 'rejected' ELSE 'deferred' END AS status, event_type AS selected, 'r' || (event_id % 3) AS reason, user_id % 2 = 0 AS conflicted FROM events WHERE event_id % 40 < 3),
    a AS (SELECT g, list(DISTINCT status) AS s, list(DISTINCT selected) FILTER (status = 'confirmed') AS c, min(reason) AS r, bool_or(conflicted) AS x FROM e GROUP BY 1)
    SELECT g, CASE WHEN s = ['confirmed'] AND len(c) = 1 THEN 'confirmed' WHEN s = ['rejected'] THEN 'rejected' ELSE 'deferred' END AS status, CASE WHEN s = ['confirmed'] AND len(c) = 1 THEN c[1] END AS selected,
      CASE WHEN s = ['confirmed'] AND len(c) = 1 THEN 'evidence_confirmed' WHEN s = ['rejected'] OR s = ['deferred'] THEN r WHEN x THEN 'conflict_unresolved' ELSE 'needs_more_context' END AS reason FROM a""",
)
def repaired_decisions(spark, d):
    """Concurrent events: those whose id modulo 40 is below 3; clicks and views confirm, errors reject."""
    e = read(spark, d, "events", "user_id", "event_type", "event_id").where("event_id % 40 < 3")
    status = F.when(F.col("event_type").isin("click", "view"), "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("deferred")
    e = e.select(F.col("user_id").alias("g"), status.alias("status"), F.col("event_type").alias("selected"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("reason"), (F.col("user_id") % 2 == 0).alias("conflicted"))
    return dc.repaired_decision(e, "g", "status", "selected", "reason", "conflicted")


@query(
    "label_decisions",
    """WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' WHEN doc_id % 3 = 0 THEN 'uncertain' ELSE 'reject' END AS status, CASE WHEN doc_id % 9 = 0 THEN [] ELSE ['x'] END AS labels, (doc_id * 13 % 100) / 100.0::DOUBLE AS confidence, CASE WHEN toxic = 1 THEN ['abuse', 'z'] ELSE ['z'] END AS risks FROM labels)
    SELECT doc_id, CASE WHEN status IN ('keep', 'reject') AND (confidence < 0.3 OR status = 'keep' AND (len(labels) = 0 OR list_has_any(risks, ['privacy', 'third_party', 'identity', 'control', 'abuse']))) THEN 'uncertain' ELSE status END AS status FROM l""",
)
def label_decisions(spark, d):
    """Quality says keep or reject, toxic rows carry the risk of abuse, ids the confidence."""
    k = F.col("doc_id")
    nothing = F.array().cast("array<string>")
    status = F.when(F.col("quality") == 1, "keep").when(k % 3 == 0, "uncertain").otherwise("reject")
    risks = F.when(F.col("toxic") == 1, F.array(F.lit("abuse"), F.lit("z"))).otherwise(F.array(F.lit("z")))
    return read(spark, d, "labels", "doc_id", "quality", "toxic").select(k, dc.label_decision(status, F.when(k % 9 == 0, nothing).otherwise(F.array(F.lit("x"))), (k * 13 % 100) / F.lit(100.0), risks, 0.3).alias("status"))


@query(
    "review_transitions",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN 'redact_keep' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'uncertain' ELSE 'lost' END AS s, CASE WHEN event_id % 10 <> 0 THEN 'u' END AS who, CASE WHEN event_id % 3 <> 0 THEN 'why' ELSE '' END AS reason, event_id % 4 <> 0 AS edited FROM events)
    SELECT s AS status, CASE WHEN s NOT IN ('keep', 'redact_keep', 'reject', 'uncertain') THEN 'invalid review status' WHEN who IS NULL THEN 'reviewer is required' WHEN s = 'redact_keep' AND NOT edited THEN 'redact_keep requires edited messages'
      WHEN s = 'redact_keep' AND reason = '' THEN 'redact_keep requires a reason' WHEN s = 'reject' AND reason = '' THEN 'reject requires a reason' END AS error, count(*) AS n FROM r GROUP BY 1, 2""",
)
def review_transitions(spark, d):
    """Reviews: events; type: the status asked for; the id says who, why and whether messages were edited."""
    k = F.col("event_id")
    names = {"click": "keep", "view": "redact_keep", "error": "reject", "signup": "uncertain"}
    status = F.lit("lost")
    for a, b in names.items():
        status = F.when(F.col("event_type") == a, b).otherwise(status)
    rows = read(spark, d, "events", "event_id", "event_type").withColumn("status", status)
    error = dc.review_error(F.col("status"), F.when(k % 10 != 0, "u"), F.when(k % 3 != 0, "why").otherwise(""), k % 4 != 0)
    return rows.groupBy("status", error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "delivery_outcomes",
    """WITH r AS (SELECT o_custkey AS g, o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'champion' ELSE 'trial' END AS role, o_orderkey % 3 <> 0 AS intact, o_totalprice > 100000 AS gate FROM orders),
    b AS (SELECT g, run, role, gate FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (role = 'champion')::INT DESC, run DESC) AS k FROM r WHERE intact) WHERE k = 1)
    SELECT a.g, b.run, CASE WHEN b.g IS NULL THEN 'blocked' WHEN b.role = 'champion' AND b.gate THEN 'accepted' ELSE 'best-effort' END AS outcome FROM (SELECT DISTINCT g FROM r) a LEFT JOIN b ON a.g = b.g""",
)
def delivery_outcomes(spark, d):
    """Campaigns: customers; runs: orders, champions with status F, intact if not divisible by 3; gate: above 100,000."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    o = o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "champion").otherwise("trial").alias("role"), F.col("o_totalprice").alias("price"))
    return dc.delivery(o, "g", "role", F.col("run") % 3 != 0, F.col("price") > 100000, "run")


@query("capacity_decisions", "SELECT s_suppkey AS run_id, CASE WHEN s_acctbal / 10000.0::DOUBLE - 0.3::DOUBLE >= 0.05::DOUBLE AND s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0 THEN 'adopt' ELSE 'stop' END AS decision FROM supplier")
def capacity_decisions(spark, d):
    """Candidates: suppliers, scored by balance against 0.3; odd ones are over budget, those divisible by 7 fail safety."""
    k = F.col("s_suppkey")
    return read(spark, d, "supplier", "s_suppkey", "s_acctbal").select(k.alias("run_id"), dc.capacity(F.lit(0.3), F.col("s_acctbal").cast("double") / 10000.0, k % 2 == 0, k % 7 != 0, F.lit(True)).alias("decision"))


@query("guarded_replies", r"SELECT doc_id, contains(lower(text), 'password') OR contains(lower(text), 'canary') OR regexp_matches(text, '[0-9a-f]{32}') OR trim(text, ' ') = '' AS blocked, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'canary') OR regexp_matches(text, '[0-9a-f]{32}') OR trim(text, ' ') = '' THEN sha256('refused') ELSE sha256(trim(text, ' ')) END AS text_sha256 FROM documents")
def guarded_replies(spark, d):
    guarded = dc.guarded_reply(F.col("text"), ["password", "canary"], F.col("text").rlike("[0-9a-f]{32}"))
    return read(spark, d, "documents", "doc_id", "text").withColumn("g", guarded).select("doc_id", "g.blocked", F.sha2("g.text", 256).alias("text_sha256"))


@query(
    "acceptance_rules",
    """WITH m AS (SELECT user_id AS stage, event_type AS name, value, event_id AS seq FROM events), l AS (SELECT stage, name, arg_max(value, seq) AS last FROM m GROUP BY 1, 2),
    a AS (SELECT c_custkey AS stage, c_mktsegment AS role FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT stage FROM m UNION SELECT stage FROM a),
    r(rule, kind, subject, op, threshold) AS (VALUES ('fast', 'metric_threshold', 'click', '<=', 60.0), ('good', 'metric_threshold', 'purchase', '>=', 20.0), ('built', 'artifact_exists', 'BUILDING', '', 0.0), ('any', 'artifact_exists', '*', '', 0.0))
    SELECT s.stage, rule, CASE WHEN kind = 'metric_threshold' THEN coalesce(CASE WHEN op = '>=' THEN last >= threshold ELSE last <= threshold END, false) ELSE EXISTS (SELECT 1 FROM a WHERE a.stage = s.stage AND (subject = '*' OR role = subject)) END AS passed
    FROM s, r LEFT JOIN l ON l.stage = s.stage AND l.name = subject""",
)
def acceptance_rules(spark, d):
    """Stages: users; metrics: their events by type, the last counts; artifacts: segments of even customers."""
    m = read(spark, d, "events", "user_id", "event_type", "value", "event_id").toDF("stage", "name", "value", "seq")
    a = read(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 2 = 0").toDF("stage", "role")
    rules = spark.createDataFrame([("fast", "metric_threshold", "click", "<=", 60.0), ("good", "metric_threshold", "purchase", ">=", 20.0), ("built", "artifact_exists", "BUILDING", "", 0.0), ("any", "artifact_exists", "*", "", 0.0)], "rule string, kind string, subject string, op string, threshold double")
    return dc.acceptance(rules, m, "stage", "name", "value", "seq", a, "role")


_SAMPLE = """s AS (SELECT conv_id, CASE WHEN conv_id % 13 = 0 THEN 'bad id' ELSE 'c.' || conv_id END AS id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn) AS m,
  CASE WHEN conv_id % 7 = 0 THEN ['style'] ELSE ['style', 'seed'] END AS keys FROM conversations GROUP BY 1)"""


@query(
    "sample_contract",
    f"""WITH {_SAMPLE} SELECT conv_id, CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9._-]+') THEN 'sample_id' WHEN len(m) < 2 THEN 'messages' WHEN len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'role'
      WHEN len(list_filter(m, lambda x: trim(x.content, ' ') = '')) > 0 THEN 'content' WHEN m[-1].role <> 'assistant' THEN 'last_message' WHEN NOT list_contains(keys, 'seed') THEN 'metadata' END AS error FROM s""",
)
def sample_contract(spark, d):
    """Samples: conversations; ids of those divisible by 13 hold a blank, those divisible by 7 lack a seed."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    s = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    k = F.col("conv_id")
    meta = F.when(k % 7 == 0, F.create_map(F.lit("style"), F.lit("a"))).otherwise(F.create_map(F.lit("style"), F.lit("a"), F.lit("seed"), F.lit("1")))
    return s.select(k, dc.sample_error(F.when(k % 13 == 0, "bad id").otherwise(F.concat(F.lit("c."), k)), F.col("m"), meta, ["style", "seed"]).alias("error"))


@query(
    "export_gates",
    """WITH b AS (SELECT doc_id, sha256(text) AS h, source, CASE WHEN doc_id % 10 = 0 THEN 'validation' WHEN doc_id % 31 = 0 THEN 'lost' ELSE 'train' END AS split, lang IS NOT NULL AS ev, doc_id % 17 <> 0 AS role_ok, doc_id % 19 <> 0 AS hash_ok, regexp_matches(text, '@[a-z]+\\.') AS leak, doc_id // 4 AS session FROM documents),
    s AS (SELECT session, count(DISTINCT split) AS n FROM b GROUP BY 1), g AS (SELECT h, count(DISTINCT split) AS n FROM b GROUP BY 1)
    SELECT doc_id, gate FROM (SELECT doc_id, unnest([CASE WHEN NOT ev THEN 'evidence' END, CASE WHEN split = 'lost' THEN 'split' END, CASE WHEN NOT role_ok THEN 'role' END, CASE WHEN NOT hash_ok THEN 'hash' END, CASE WHEN leak THEN 'leak' END, CASE WHEN s.n > 1 THEN 'session_crossing' END, CASE WHEN g.n > 1 THEN 'duplicate_crossing' END]) AS gate
      FROM b JOIN s USING (session) JOIN g USING (h)) WHERE gate IS NOT NULL""",
)
def export_gates(spark, d):
    """Sessions: four ids each; duplicate groups: equal texts; ids say which roles and hashes are off."""
    k = F.col("doc_id")
    b = read(spark, d, "documents", "doc_id", "text", "lang")
    split = F.when(k % 10 == 0, "validation").when(k % 31 == 0, "lost").otherwise("train")
    b = b.select(k, F.sha2("text", 256).alias("h"), split.alias("split"), F.col("lang").isNotNull().alias("ev"), F.col("text").rlike(r"@[a-z]+\.").alias("leak"), F.floor(k / 4).alias("session"))
    return dc.export_violations(b, "doc_id", F.col("ev"), "split", k % 17 != 0, k % 19 != 0, F.col("leak"), "session", "h")


@query("indexable_counts", "SELECT label, count(*) FILTER (vec_id % 7 = 1) AS candidate, count(*) FILTER (vec_id % 7 = 2) AS superseded, count(*) FILTER (vec_id % 7 = 3) AS deleted, count(*) FILTER (vec_id % 7 NOT IN (1, 2, 3) AND vec_id % 5 = 0) AS high_sensitivity, count(*) FILTER (vec_id % 7 NOT IN (1, 2, 3) AND vec_id % 5 <> 0) AS indexable FROM embeddings GROUP BY 1")
def indexable_counts(spark, d):
    """Status and sensitivity follow from the id."""
    k = F.col("vec_id")
    status = F.when(k % 7 == 1, "candidate").when(k % 7 == 2, "superseded").when(k % 7 == 3, "deleted").otherwise("confirmed")
    e = read(spark, d, "embeddings", "label", "vec_id").select("label", status.alias("status"), (k % 5 == 0).alias("high"))
    confirmed = F.col("status") == "confirmed"
    return e.groupBy("label").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("candidate", "superseded", "deleted")], F.count_if(confirmed & F.col("high")).alias("high_sensitivity"), F.count_if(confirmed & ~F.col("high")).alias("indexable"))


@query("approved_candidates", "SELECT o_orderkey, sha256(o_orderpriority) AS content FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_totalprice < 200000")
def approved_candidates(spark, d):
    """Approved: urgent or high; superseded: status P; high sensitivity: 200,000 and above."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    kept = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") < 200000))
    return kept.select("o_orderkey", F.sha2("o_orderpriority", 256).alias("content"))


@query("zero_gates", "SELECT lang, count(*) FILTER (regexp_matches(text, '(?i)canary')) AS canaries, count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}')) AS leaks, count(*) FILTER (trim(text, ' ') = '') / count(*) AS empty_rate, count(*) FILTER (regexp_matches(text, '(?i)canary')) = 0 AND count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}')) = 0 AND count(*) FILTER (trim(text, ' ') = '') / count(*) <= 0.01::DOUBLE AS passed FROM documents GROUP BY 1")
def zero_gates(spark, d):
    """Counters that have to be 0, and a rate with a limit of 0.01, per language."""
    t = F.col("text")
    n = read(spark, d, "documents", "lang", "text").groupBy("lang").agg(F.count_if(t.rlike("(?i)canary")).alias("canaries"), F.count_if(t.rlike("[0-9a-f]{32}")).alias("leaks"), (F.count_if(F.trim(t) == "") / F.count(F.lit(1))).alias("empty_rate"))
    return n.withColumn("passed", (F.col("canaries") == 0) & (F.col("leaks") == 0) & (F.col("empty_rate") <= 0.01))


@query("outlier_filter", "SELECT p_partkey % 5 = 0 AS validation, count(*) AS n FROM part WHERE p_partkey % 5 = 0 OR NOT coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_size END > 40 AND p_retailprice < 1200, false) GROUP BY 1")
def outlier_filter(spark, d):
    """Large and cheap parts leave the fit rows only; a missing size (keys divisible by 11) keeps its row."""
    k = F.col("p_partkey")
    p = read(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumns({"size": F.when(k % 11 != 0, F.col("p_size")), "validation": k % 5 == 0})
    outlier = F.coalesce((F.col("size") > 40) & (F.col("p_retailprice") < 1200), F.lit(False))
    return p.where(F.col("validation") | ~outlier).groupBy("validation").agg(F.count(F.lit(1)).alias("n"))


@query("role_view", "SELECT role, split, count(*) AS n FROM (SELECT 'train' AS role, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM documents UNION ALL SELECT 'evaluate', CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END FROM documents) WHERE role = 'train' AND split IN ('train', 'validation') OR role = 'evaluate' AND split = 'test' GROUP BY 1, 2")
def role_view(spark, d):
    """What each role may load: trainers train and validation rows, evaluators test rows."""
    k = F.col("doc_id")
    rows = read(spark, d, "documents", "doc_id").select(F.when(k % 10 == 0, "test").when(k % 10 == 1, "validation").otherwise("train").alias("split"))
    allowed = {"train": ["train", "validation"], "evaluate": ["test"]}
    parts = [rows.where(F.col("split").isin(splits)).select(F.lit(role).alias("role"), "split") for role, splits in allowed.items()]
    return parts[0].unionByName(parts[1]).groupBy("role", "split").agg(F.count(F.lit(1)).alias("n"))


@query("style_check", "SELECT role, bool_and(trim(coalesce(text, ''), ' ') <> '') AS non_empty, count(*) AS n FROM conversations GROUP BY 1")
def style_check(spark, d):
    c = read(spark, d, "conversations", "role", "text")
    return c.groupBy("role").agg(F.bool_and(F.trim(F.coalesce("text", F.lit(""))) != "").alias("non_empty"), F.count(F.lit(1)).alias("n"))


@query("owner_task_page", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k BETWEEN 3 AND 6")
def owner_task_page(spark, d):
    """The second page of two tasks, and the third, of each owner."""
    e = read(spark, d, "events", "user_id", "event_id")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k BETWEEN 3 AND 6").select("user_id", "event_id")
