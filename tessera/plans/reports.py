"""Summaries of runs, generations, memories and pilots on the driver's tables; docstrings say how missing columns are derived."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.columns import share
from tessera.operators import reports as rp
from tessera.plans.catalog import query
from tessera.plans.common import read


@query(
    "scan_max_merge",
    r"""WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4,}')) AS numbers, len(regexp_extract_all(text, '@')) AS ats FROM documents),
    b AS (SELECT doc_id, len(regexp_extract_all(upper(text), '[0-9]{4,}')) AS numbers, len(regexp_extract_all(replace(text, ' ', ''), '@[a-z]')) AS ats FROM documents)
    SELECT a.doc_id, greatest(a.numbers, b.numbers)::INT AS numbers, greatest(a.ats, b.ats)::INT AS ats, (greatest(a.numbers, b.numbers) + greatest(a.ats, b.ats))::INT AS hard_leak_count FROM a JOIN b USING (doc_id)""",
)
def scan_max_merge(spark, d):
    """Two views of a text: as it is, and in capitals or without blanks."""
    t = F.col("text")
    views = [
        {"numbers": F.regexp_count(t, F.lit("[0-9]{4,}")), "ats": F.regexp_count(t, F.lit("@"))},
        {"numbers": F.regexp_count(F.upper(t), F.lit("[0-9]{4,}")), "ats": F.regexp_count(F.replace(t, F.lit(" "), F.lit("")), F.lit("@[a-z]"))},
    ]
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", *[c.alias(n) for n, c in rp.max_merged(views).items()])


@query(
    "day_bundles",
    "SELECT ts::DATE::VARCHAR AS day, user_id, count(*) AS n_messages, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1, 2",
)
def day_bundles(spark, d):
    """Days hold users' sessions, sessions their turns in order; unnested again for the comparison."""
    nested = rp.day_bundles(read(spark, d, "events", "ts", "user_id", "event_id"), "ts", "user_id", "event_id")
    return nested.select("day", F.inline("sessions")).select(F.col("day").cast("string").alias("day"), F.col("owner").alias("user_id"), F.size("turns").cast("long").alias("n_messages"), F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",").alias("ids"))


@query("variant_matrix", "SELECT event_type AS variant, count(*) AS record_count, count(*) FILTER (value > 5) / count(*) AS non_empty_rate, round(avg(value), 6) AS latency_mean FROM events GROUP BY 1")
def variant_matrix(spark, d):
    """Variants: event types; a value above 5 counts as output, and as latency."""
    e = read(spark, d, "events", "event_type", "value")
    return rp.variant_matrix(e, "event_type", F.col("value") > 5, "value").withColumnRenamed("event_type", "variant")


@query("automatic_metrics", r"SELECT role, count(*) AS record_count, round(avg(len(regexp_extract_all(coalesce(text, ''), '\S+'))), 9) AS generated_length_mean, round(coalesce(avg(CASE WHEN turn % 3 <> 0 THEN turn * 0.5::DOUBLE END), 0), 9) AS validation_loss, count(*) FILTER (coalesce(text, '') <> '') / count(*) AS format_follow_rate FROM conversations GROUP BY 1")
def automatic_metrics(spark, d):
    """Outputs: messages by role; loss: half the turn's number, missing for turns divisible by 3."""
    c = read(spark, d, "conversations", "role", "text", "turn").withColumn("loss", F.when(F.col("turn") % 3 != 0, F.col("turn") * 0.5))
    return rp.automatic_metrics(c, "role", "text", "loss")


_MEMORY = "SELECT doc_id, quality = 1 AS supported, doc_id % 3 = 0 AS claim, doc_id % 2 = 0 AS should_refuse, doc_id % 4 = 0 AS refused, doc_id % 5 = 0 AS conflict, doc_id % 10 = 0 AS latest, toxic = 1 AS leak FROM labels"


@query(
    "memory_metrics",
    f"""WITH m AS ({_MEMORY}) SELECT count(*) AS record_count, count(*) FILTER (supported) / count(*) AS evidence_support_rate, count(*) FILTER (NOT supported AND claim) / greatest(count(*) FILTER (NOT supported), 1) AS unsupported_claim_rate,
    count(*) FILTER (NOT supported AND should_refuse AND refused) / greatest(count(*) FILTER (NOT supported AND should_refuse), 1) AS unsupported_refusal_rate, count(*) FILTER (conflict AND latest) / greatest(count(*) FILTER (conflict), 1) AS latest_conflict_accuracy,
    count(*) FILTER (leak) / count(*) AS leak_rate, count(*) FILTER (leak) = 0 AND count(*) FILTER (NOT supported AND claim) = 0 AS passed FROM m""",
)
def memory_metrics(spark, d):
    """Records: labels; good ones are supported, toxic ones leak, the id says the rest."""
    k = F.col("doc_id")
    m = read(spark, d, "labels", "doc_id", "quality", "toxic").select((F.col("quality") == 1).alias("supported"), (k % 3 == 0).alias("claim"), (k % 2 == 0).alias("should_refuse"), (k % 4 == 0).alias("refused"), (k % 5 == 0).alias("conflict"), (k % 10 == 0).alias("latest"), (F.col("toxic") == 1).alias("leak"))
    return rp.memory_metrics(m)


@query("safety_counters", "SELECT lang, count(*) AS case_count, count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}') OR contains(lower(text), 'canary')) AS leak_count, count(*) FILTER (regexp_matches(text, '(?i)only i understand you')) AS dependency_count, count(*) FILTER (trim(text, ' ') = '') AS empty_count FROM documents GROUP BY 1")
def safety_counters(spark, d):
    t = F.col("text")
    rules = {"leak_count": t.rlike("[0-9a-f]{32}") | F.contains(F.lower(t), F.lit("canary")), "dependency_count": t.rlike("(?i)only i understand you"), "empty_count": F.trim(t) == ""}
    return rp.counters(read(spark, d, "documents", "lang", "text"), ["lang"], rules)


@query("generated_safety", "SELECT count(*) AS case_count, count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}')) AS leak_count, count(*) FILTER (trim(text, ' ') = '') AS empty_count FROM (SELECT text FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 64)")
def generated_safety(spark, d):
    """The first 64 cases by digest: the limit is the operator's own."""
    cases = read(spark, d, "documents", "doc_id", "text").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(64)
    t = F.col("text")
    return rp.counters(cases, [], {"leak_count": t.rlike("[0-9a-f]{32}"), "empty_count": F.trim(t) == ""})


@query("latency_summary", "SELECT event_type, count(*) AS samples, count(*) FILTER (event_id % 11 <> 0) AS ok, round(avg(value) FILTER (event_id % 11 <> 0), 6) AS mean, round(median(value) FILTER (event_id % 11 <> 0), 6) AS p50, round(max(value) FILTER (event_id % 11 <> 0), 6) AS most FROM events GROUP BY 1")
def latency_summary(spark, d):
    """Runs that failed: ids divisible by 11."""
    return rp.latency_summary(read(spark, d, "events", "event_type", "event_id", "value"), "event_type", F.col("event_id") % 11 != 0, "value")


@query("health_counters", "SELECT o_orderstatus AS state, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS active FROM orders GROUP BY 1")
def health_counters(spark, d):
    o = read(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    return o.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("active"))


@query(
    "budget_reserve",
    """WITH s AS (SELECT o_custkey AS campaign, o_orderpriority AS slot, max(o_totalprice) AS cost, bool_or(o_orderstatus = 'F') AS used FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
    r AS (SELECT o_custkey AS campaign, sum(o_totalprice) AS reserved FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c.campaign, round(coalesce(reserved, 0), 2) AS reserved, round(coalesce(held, 0), 2) AS held, coalesce(reserved, 0) + coalesce(held, 0) <= 500000 AS fits FROM (SELECT DISTINCT o_custkey AS campaign FROM orders) c
    LEFT JOIN r USING (campaign) LEFT JOIN (SELECT campaign, sum(cost) AS held FROM s WHERE NOT used GROUP BY 1) h USING (campaign)""",
)
def budget_reserve(spark, d):
    """Campaigns: customers; spent: orders with status F; slots: urgent and high priority, each holds its dearest order until used."""
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    o = o.select(F.col("o_custkey").alias("campaign"), F.col("o_orderpriority").alias("slot"), (F.col("o_orderstatus") == "F").alias("used"), F.col("o_totalprice").alias("cost"))
    return rp.budget_reserve(o, "campaign", "slot", "used", "cost", ["1-URGENT", "2-HIGH"], 500000)


@query("nested_privacy", "SELECT 'documents' AS layer, count(*) FILTER (regexp_matches(text, '@')) AS contact, count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}')) AS secret FROM documents UNION ALL SELECT 'messages', count(*) FILTER (regexp_matches(text, '@')), count(*) FILTER (regexp_matches(text, '[0-9a-f]{32}')) FROM conversations")
def nested_privacy(spark, d):
    t = F.col("text")
    rules = {"contact": t.rlike("@"), "secret": t.rlike("[0-9a-f]{32}")}
    of = lambda layer, table: rp.counters(read(spark, d, table, "text"), [], rules).select(F.lit(layer).alias("layer"), *rules)
    return of("documents", "documents").unionByName(of("messages", "conversations"))


@query("extraction_report", "SELECT (SELECT count(*) FROM orders) AS planned, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS completed, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)) AS conflicted, (SELECT round(sum(l_quantity), 2) FROM lineitem) AS tokens")
def extraction_report(spark, d):
    o, li = read(spark, d, "orders", "o_custkey", "o_orderpriority"), read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    return rp.one_row(
        o.agg(F.count(F.lit(1)).alias("planned")),
        li.agg(F.countDistinct("l_orderkey").alias("completed"), F.round(F.sum("l_quantity"), 2).alias("tokens")),
        li.groupBy("l_orderkey", "l_suppkey").count().agg(F.count_if(F.col("count") > 1).alias("duplicates")),
        o.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicted")),
    )


@query("pilot_report", "SELECT CASE WHEN n_chars < 60 THEN 'quarantined' WHEN lang = 'en' THEN 'accepted' ELSE 'unprocessed' END AS state, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, count(DISTINCT source) AS topics FROM documents GROUP BY 1")
def pilot_report(spark, d):
    state = F.when(F.col("n_chars") < 60, "quarantined").when(F.col("lang") == "en", "accepted").otherwise("unprocessed")
    return read(spark, d, "documents", "n_chars", "lang", "source").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.countDistinct("source").alias("topics"))


@query(
    "generation_report",
    r"""WITH p AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, role FROM conversations),
    t AS (SELECT coalesce(a, '') AS a, coalesce(b, '') AS b, regexp_extract_all(lower(coalesce(a, '')), '[\p{L}\p{N}_]+') AS x FROM p WHERE role = 'assistant'),
    m AS (SELECT len(x) AS n, a = b AS same, a <> '' AS follows, len(x) >= 3 AND len(list_distinct([array_to_string(x[i:i+2], ' ') for i in range(1, len(x) - 1)])) < len(x) - 2 AS rep, len(x) >= 60 AS cut FROM t)
    SELECT count(*) AS samples, round(avg(n), 9) AS tokens_mean, round(quantile_cont(n, 0.5), 6) AS tokens_p50, round(quantile_cont(n, 0.95), 6) AS tokens_p95, round(count(*) FILTER (same) / count(*), 9) AS exact_match_rate, round(count(*) FILTER (follows) / count(*), 9) AS format_follow_rate,
      round(count(*) FILTER (rep) / count(*), 9) AS repetition_rate, round(count(*) FILTER (cut) / count(*), 9) AS max_length_stop_rate,
      round(100 * (0.10::DOUBLE * count(*) FILTER (same) / count(*) + 0.10::DOUBLE * count(*) FILTER (follows) / count(*)) * (1 - 0.25::DOUBLE * count(*) FILTER (rep) / count(*)) * (1 - 0.10::DOUBLE * count(*) FILTER (cut) / count(*)), 6) AS score FROM m""",
)
def generation_report(spark, d):
    """Outputs: replies; references: the turn before; overlap terms of the score are 0 here, as ``token_f1_trigrams`` and ``rouge_l`` have them."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = c.withColumns({"a": F.coalesce("text", F.lit("")), "b": before}).where("role = 'assistant'")
    return rp.generation_report(rows, F.col("a"), F.col("b"), tx.regexp_all(F.lower("a"), r"(?U)\w+"), 60)


@query("example_loss", "SELECT l_orderkey, round(sum(l_extendedprice) FILTER (l_linenumber > 1) / nullif(count(*) FILTER (l_linenumber > 1), 0) + 1e-7::DOUBLE, 4) AS loss FROM lineitem GROUP BY 1")
def example_loss(spark, d):
    """Examples: orders; tokens: lines; the first line is masked. A little is added so that ties round alike everywhere."""
    return rp.example_loss(read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice", F.col("l_linenumber") > 1).select("l_orderkey", F.round(F.col("loss") + F.lit(1e-7), 4).alias("loss"))


@query("task_timeline", "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS complete, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def task_timeline(spark, d):
    e = read(spark, d, "events", "user_id", "event_type", "ts")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("complete"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("auxiliary_score", "SELECT l_orderkey, round(100 * (0.45::DOUBLE * avg(l_discount) + 0.35::DOUBLE * avg(l_tax) + 0.10::DOUBLE * avg(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) + 0.10::DOUBLE * avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)) * (1 - 0.25::DOUBLE * avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)) * (1 - 0.10::DOUBLE * avg(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)) + 1e-7::DOUBLE, 4) AS score FROM lineitem GROUP BY 1")
def auxiliary_score(spark, d):
    """Overlaps: discount and tax; flags of lines say the other shares."""
    yes = lambda c: F.avg(F.when(c, 1).otherwise(0))
    li = read(spark, d, "lineitem", "l_orderkey", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_quantity")
    m = li.groupBy("l_orderkey").agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("rouge"), yes(F.col("l_linenumber") == 1).alias("same"), yes(F.col("l_returnflag") == "N").alias("follows"), yes(F.col("l_returnflag") == "R").alias("rep"), yes(F.col("l_quantity") > 40).alias("cut"))
    return m.select("l_orderkey", F.round(rp.quality_score(*map(F.col, ("f1", "rouge", "same", "follows", "rep", "cut"))) + F.lit(1e-7), 4).alias("score"))


@query("stage_monotonicity", "SELECT user_id, count(*) FILTER (bad) AS violations FROM (SELECT user_id, coalesce(lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) > stage, false) AS bad FROM (SELECT *, (epoch_us(ts) // 86400000000 % 30 + event_id % 3)::BIGINT AS stage FROM events)) GROUP BY 1")
def stage_monotonicity(spark, d):
    """Stage: the day's number modulo 30 plus the id's remainder modulo 3; it may not fall."""
    from tessera.functions.columns import micros

    e = read(spark, d, "events", "user_id", "ts", "event_id").withColumn("stage", (F.floor(micros("ts") / F.lit(86_400_000_000)) % 30 + F.col("event_id") % 3).cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("bad", F.coalesce(F.lag("stage").over(w) > F.col("stage"), F.lit(False))).groupBy("user_id").agg(F.count_if("bad").alias("violations"))


@query("result_count_distribution", "SELECT n AS results, count(*) AS cases FROM (SELECT i.item_id, count(d.doc_id) AS n FROM benchmark i LEFT JOIN documents d ON contains(d.text, substr(i.text, 1, 60)) GROUP BY 1) GROUP BY 1")
def result_count_distribution(spark, d):
    """How many documents hold the first 60 characters of each benchmark item: the text is looked up at every place by its first word run."""
    items = read(spark, d, "benchmark", "item_id", "text").select("item_id", F.substring("text", 1, 60).alias("q"))
    return rp.containment_counts(read(spark, d, "documents", "doc_id", "text"), "text", "doc_id", items, "item_id", "q").groupBy(F.col("n").alias("results")).agg(F.count(F.lit(1)).alias("cases"))


@query("split_crosstab_share", "SELECT lang, count(*) AS n, round(count(*) FILTER (n_chars > 1000) / count(*), 9) AS long_share FROM documents GROUP BY 1")
def split_crosstab_share(spark, d):
    return read(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(share(F.count_if(F.col("n_chars") > 1000), F.count(F.lit(1))), 9).alias("long_share"))
