"""Facts, lineage, gates, ranking, events and features on the driver's tables.

Where a table lacks a column that an operator needs, it is derived; each docstring says how.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import micros
from tessera.operators import features as fe
from tessera.operators import records as rc
from tessera.operators import retrieval as rt
from tessera.plans.catalog import query
from tessera.plans.common import read


@query(
    "ledger_conflicts",
    "WITH v AS (SELECT o_custkey AS k, o_orderpriority AS v, count(DISTINCT o_orderkey) AS support, bool_or(o_orderstatus = 'F') AND bool_or(o_totalprice > 100000) AND NOT bool_or(o_orderkey % 13 = 0) AS reliable FROM orders GROUP BY 1, 2) "
    "SELECT k AS o_custkey, count(*) AS n_values, count(*) FILTER (reliable) AS n_reliable, max(support) AS best_support, CASE count(*) FILTER (reliable) WHEN 0 THEN 'insufficient' WHEN 1 THEN 'none' ELSE 'conflicted' END AS conflict_status FROM v GROUP BY 1",
)
def ledger_conflicts(spark, d):
    """Fact: a customer's priority; positive: status F; direct: above 100,000; unresolved: key divisible by 13."""
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", "o_totalprice")
    o = o.select("o_custkey", "o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "F").alias("pos"), (F.col("o_totalprice") > 100000).alias("dir"), (F.col("o_orderkey") % 13 == 0).alias("unres"))
    return rc.ledger(o, "o_custkey", "o_orderpriority", "o_orderkey", "pos", "dir", "unres")


@query("review_eligible", "SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 100000) AS eligible FROM orders GROUP BY 1")
def review_eligible(spark, d):
    o = read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.groupBy("o_custkey").agg(rc.row_eligible(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).alias("eligible"))


@query("dedup_keep_best", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_keep_best(spark, d):
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    return rc.keep_best(o, ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("latest_review", "WITH r AS (SELECT user_id AS g, event_id % 5 AS revision, event_type AS body FROM events), t AS (SELECT g, max(revision) AS revision FROM r GROUP BY 1) SELECT g, revision, min(body) AS body, count(DISTINCT body) > 1 AS conflict FROM r JOIN t USING (g, revision) GROUP BY 1, 2")
def latest_review(spark, d):
    """Revision: the event's id modulo 5; body: its type."""
    e = read(spark, d, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("g"), (F.col("event_id") % 5).alias("revision"), F.col("event_type").alias("body"))
    return rc.latest_review(e, "g", "revision", "body")


@query("status_counts_with_pending", "SELECT coalesce(CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END, 'pending') AS status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality END AS quality, l.doc_id AS lid FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN labels l USING (doc_id)) WHERE lid IS NOT NULL GROUP BY 1 UNION ALL SELECT 'pending', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def status_counts_with_pending(spark, d):
    decided = read(spark, d, "labels", "doc_id", "quality").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("status"))
    return rc.status_counts(read(spark, d, "documents", "doc_id"), decided, "doc_id", "status")


@query("latest_revision", "SELECT label, fact_key, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, fact_key ORDER BY vec_id DESC) AS k FROM (SELECT label, vec_id, CASE WHEN vec_id % 6 = 0 THEN NULL ELSE vec_id % 17 END AS fact_key FROM embeddings)) WHERE k = 1 OR fact_key IS NULL")
def latest_revision(spark, d):
    """Fact key: the id modulo 17, none for ids divisible by 6; later ids are later revisions."""
    e = read(spark, d, "embeddings", "label", "vec_id").withColumn("fact_key", F.when(F.col("vec_id") % 6 != 0, F.col("vec_id") % 17))
    return rt.latest_revision(e, "label", "fact_key", "vec_id").select("label", "fact_key", "vec_id")


@query("active_validity", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_orderdate <= TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-06-01' < o_orderdate + INTERVAL 365 DAY) AS active FROM orders GROUP BY 1")
def active_validity(spark, d):
    """Confirmed: status F; high sensitivity: urgent; valid for 365 days from the order's date."""
    o = read(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_orderdate")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    status, high = F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("other"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low")
    now = F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(rt.active(status, high, start, start + F.expr("INTERVAL 365 DAYS"), now)).alias("active"))


@query("conflict_sets", "SELECT user_id, count(DISTINCT event_type) AS n_values, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS vals FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def conflict_sets(spark, d):
    e = read(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("v"))
    return e.where(F.size("v") >= 2).select("user_id", F.size("v").cast("long").alias("n_values"), F.array_join("v", ",").alias("vals"))


@query("lineage_closure", "WITH l AS (SELECT o_orderkey AS obj, o_custkey % 50 AS path, list(l_suppkey) AS src FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), h AS (SELECT obj, path FROM l WHERE list_contains(src, 7)) SELECT DISTINCT obj FROM l WHERE path IN (SELECT path FROM h)")
def lineage_closure(spark, d):
    """Objects: orders; sources: their suppliers; paths: customers modulo 50. Supplier 7 is deleted."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("src"))
    o = read(spark, d, "orders", "o_orderkey", "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("obj"), (F.col("o_custkey") % 50).alias("path"), "src")
    return rc.deletion_closure(o, spark.range(7, 8).toDF("src"), "obj", "path", "src")


@query("anti_delete", "SELECT label, count(*) AS before, count(*) FILTER (vec_id % 9 <> 0) AS remaining, 0::BIGINT AS residual FROM embeddings GROUP BY 1")
def anti_delete(spark, d):
    """Deleted: ids divisible by 9."""
    e = read(spark, d, "embeddings", "label", "vec_id")
    gone = e.where("vec_id % 9 = 0").select("vec_id")
    kept = e.join(gone, "vec_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("remaining"), F.count_if(F.col("vec_id") % 9 == 0).alias("residual"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("before")).join(kept, "label")


@query("snapshot_diff", "SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END AS change FROM (SELECT p_partkey AS k, sha256(p_brand) AS h FROM part WHERE p_partkey % 10 <> 1) a FULL JOIN (SELECT p_partkey AS k, sha256(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END) AS h FROM part WHERE p_partkey % 10 <> 2) b ON a.k = b.k) WHERE change IS NOT NULL")
def snapshot_diff(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand")
    old = p.where("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("k"), F.sha2("p_brand", 256).alias("h"))
    new = p.where("p_partkey % 10 <> 2").select(F.col("p_partkey").alias("k"), F.sha2(F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_brand")), 256).alias("h"))
    return rc.snapshot_diff(old, new, "k", "h")


def _runs(spark, d):
    """Runs: suppliers; framework: nation modulo 2; dataset: a constant; score: the balance, missing below 0."""
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    return s.select(F.col("s_suppkey").alias("run_id"), (F.col("s_nationkey") % 2).alias("framework"), F.lit("v1").alias("dataset"), F.when(F.col("s_acctbal") >= 0, F.round("s_acctbal", 2)).alias("score"))


_RUNS = "runs AS (SELECT s_suppkey AS run_id, s_nationkey % 2 AS framework, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS score FROM supplier), ref AS (SELECT arg_min(framework, run_id) AS f FROM runs), r AS (SELECT run_id, score, concat_ws(',', CASE WHEN framework <> f THEN 'framework' END, CASE WHEN score IS NULL THEN 'missing_metric' END) AS reasons FROM runs, ref)"


@query("run_ranking", f"WITH {_RUNS} SELECT run_id, score, reasons, CASE WHEN reasons = '' THEN row_number() OVER (PARTITION BY reasons = '' ORDER BY score DESC, run_id) END::INT AS rank FROM r")
def run_ranking(spark, d):
    return rc.ranked_runs(_runs(spark, d), "score", ["framework", "dataset"])


@query("comparability_reasons", f"WITH {_RUNS} SELECT reasons, count(*) AS n FROM r GROUP BY 1")
def comparability_reasons(spark, d):
    return run_ranking(spark, d).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("quality_gates", "WITH m AS (SELECT s_suppkey AS run_id, 'balance' AS key, s_acctbal AS value FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier), g(name, key, op, threshold, required) AS (VALUES ('funded', 'balance', 'gte', 1000.0, true), ('low', 'balance', 'lt', 9000.0, false), ('named', 'nation', 'exists', 0.0, true), ('extra', 'other', 'gt', 0.0, false), ('must', 'nation', 'neq', 3.0, true)) SELECT r.run_id, name, CASE WHEN value IS NULL AND NOT required THEN 'skipped' WHEN value IS NULL THEN 'failed' WHEN CASE op WHEN 'exists' THEN true WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold WHEN 'gt' THEN value > threshold WHEN 'neq' THEN value <> threshold END THEN 'passed' ELSE 'failed' END AS status FROM (SELECT DISTINCT run_id FROM m) r CROSS JOIN g LEFT JOIN m ON m.run_id = r.run_id AND m.key = g.key")
def quality_gates(spark, d):
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    m = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("run_id"), F.lit("balance").alias("key"), F.col("s_acctbal").cast("double").alias("value"))
    m = m.unionByName(s.select(F.col("s_suppkey").alias("run_id"), F.lit("nation").alias("key"), F.col("s_nationkey").cast("double").alias("value")))
    gates = spark.createDataFrame([("funded", "balance", "gte", 1000.0, True), ("low", "balance", "lt", 9000.0, False), ("named", "nation", "exists", 0.0, True), ("extra", "other", "gt", 0.0, False), ("must", "nation", "neq", 3.0, True)], "name string, key string, op string, threshold double, required boolean")
    return rc.gate_results(gates, m)


@query("event_dedup", "SELECT user_id, event_type, min(event_id) AS first_seq, count(*) - 1 AS repeats, count(DISTINCT sha256(value::VARCHAR)) > 1 AS conflict FROM (SELECT user_id, event_type, event_id, floor(value) AS value FROM events) GROUP BY 1, 2")
def event_dedup(spark, d):
    """Message key: user and type; digest: the whole part of the value."""
    e = read(spark, d, "events", "user_id", "event_type", "event_id", "value").withColumn("h", F.floor("value"))
    return rc.inbox(e, ["user_id", "event_type"], "h", "event_id")


@query("revision_wins", "SELECT user_id, min(event_id) AS position, max(event_id % 7) AS revision, arg_max(event_type, (event_id % 7) * 100000000 - event_id) AS content FROM events GROUP BY 1")
def revision_wins(spark, d):
    """Revision: the id modulo 7."""
    e = read(spark, d, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", (F.col("event_id") % 7).alias("revision"), F.col("event_type").alias("content"))
    return rc.projection(e, "user_id", "revision", "event_id", "content")


@query("keyset_page", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 51")
def keyset_page(spark, d):
    return rc.keyset_page(read(spark, d, "events", "event_id", "user_id", "event_type"), "event_id", 100, 50)


@query("timeline_page", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 101")
def timeline_page(spark, d):
    return read(spark, d, "events", "event_id", "event_type").orderBy(F.desc("event_id")).limit(101)


@query("searched_page", "WITH f AS (SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%1%') SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 30 AS has_more FROM (SELECT * FROM f ORDER BY p_brand, p_partkey LIMIT 20 OFFSET 10)")
def searched_page(spark, d):
    return rc.searched_page(read(spark, d, "part", "p_partkey", "p_brand").where(F.col("p_brand").contains("1")), [F.col("p_brand"), F.col("p_partkey")], 10, 20)


@query("consent_exclusions", "SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN 'message_type' WHEN ts < TIMESTAMP '2024-01-02' THEN 'time_range' WHEN value > 90 THEN 'third_party' END AS reason, count(*) AS n FROM events GROUP BY 1")
def consent_exclusions(spark, d):
    """Allowed: clicks and views from 2 January 2024 on; third party: values above 90."""
    e = read(spark, d, "events", "event_type", "ts", "value")
    checks = [("message_type", ~F.col("event_type").isin("click", "view")), ("time_range", micros("ts") < F.lit(1704153600000000)), ("third_party", F.col("value") > 90)]
    return e.groupBy(rc.first_failing(checks).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("dag_ready", "WITH s AS (SELECT n_nationkey AS stage, CASE WHEN n_nationkey % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN n_nationkey % 4 = 1 THEN [] ELSE [n_nationkey - 1, n_nationkey - 4] END AS deps FROM nation) SELECT stage::BIGINT AS stage FROM s WHERE status = 'pending' AND stage NOT IN (SELECT stage FROM (SELECT stage, unnest(deps) AS dep FROM s) WHERE dep NOT IN (SELECT stage FROM s WHERE status = 'completed'))")
def dag_ready(spark, d):
    """Stages: nations; done: divisible by 3; each but some depends on those 1 and 4 before it."""
    k = F.col("n_nationkey").cast("long")
    s = read(spark, d, "nation", "n_nationkey").select(k.alias("stage"), F.when(k % 3 == 0, "completed").otherwise("pending").alias("status"), F.when(k % 4 == 1, F.array().cast("array<bigint>")).otherwise(F.array(k - 1, k - 4)).alias("deps"))
    return rc.ready_stages(s, "stage", "deps", "status")


@query("duplicate_ids", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_ids FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def duplicate_ids(spark, d):
    from tessera.operators.dedup import duplicate_id_count

    return duplicate_id_count(read(spark, d, "lineitem", "l_orderkey"), "l_orderkey")


@query("median_impute_by_group", "WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS v FROM part) SELECT p_partkey, round(coalesce(v, median(v) OVER (PARTITION BY p_brand), median(v) OVER ()), 6) AS v, (v IS NULL)::INT AS v_missing FROM p")
def median_impute_by_group(spark, d):
    """Missing: prices of keys divisible by 5."""
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_retailprice").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice").cast("double")).alias("v"))
    return fe.impute_by_group(p, "v", "p_brand").select("p_partkey", F.round("v", 6).alias("v"), "v_missing")


@query("ordinal_cross", "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE -1 END AS level, o_orderstatus || '_' || o_orderpriority AS crossed, round(sin(month(o_orderdate) * 2 * pi() / 12), 9) + 0.0::DOUBLE AS month_sin FROM orders")
def ordinal_cross(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return o.select("o_orderkey", fe.ordinal("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"]).alias("level"), fe.cross("o_orderstatus", "o_orderpriority").alias("crossed"), (F.round(fe.cyclic(F.month("o_orderdate"), 12)[0], 9) + F.lit(0.0)).alias("month_sin"))


@query("skew_columns", "SELECT c AS \"column\", round(s, 6) AS skew FROM (SELECT 'a' AS c, skewness(l_quantity * l_quantity) AS s FROM lineitem UNION ALL SELECT 'b', skewness(l_extendedprice * l_discount) FROM lineitem UNION ALL SELECT 'c', skewness(l_quantity) FROM lineitem) WHERE s > 0.75")
def skew_columns(spark, d):
    li = read(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount")
    return fe.skewed_columns(li.select((F.col("l_quantity") * F.col("l_quantity")).alias("a"), (F.col("l_extendedprice") * F.col("l_discount")).alias("b"), F.col("l_quantity").alias("c")), ["a", "b", "c"])


@query("ridge_gram", "SELECT count(*) AS n, round(sum(l_quantity), 4) AS s_q, round(sum(l_extendedprice), 2) AS s_y, round(sum(l_quantity * l_quantity), 4) AS p_qq, round(sum(l_quantity * l_extendedprice) / 1000, 2) AS p_qy FROM lineitem")
def ridge_gram(spark, d):
    g = fe.gram(read(spark, d, "lineitem", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return g.select("n", F.round("s_l_quantity", 4).alias("s_q"), F.round("s_l_extendedprice", 2).alias("s_y"), F.round("p_l_quantity__l_quantity", 4).alias("p_qq"), F.round(F.col("p_l_quantity__l_extendedprice") / 1000, 2).alias("p_qy"))


@query("ridge_closed_form")
def ridge_closed_form(spark, d):
    li = read(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice")
    return spark.createDataFrame(sorted(fe.ridge(li, ["l_quantity", "l_discount"], "l_extendedprice", 1.0).items()), "term string, coefficient double")


@query("blend_predict", "SELECT p_partkey, round(greatest(exp(0.25::DOUBLE * greatest(ln(1 + p_retailprice), 0) + 0.75::DOUBLE * greatest(ln(1 + p_size), 0)) - 1, 0), 6) AS prediction FROM part")
def blend_predict(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    return p.select("p_partkey", F.round(fe.blend([F.log1p("p_retailprice"), F.log1p("p_size")], [0.25, 0.75]), 6).alias("prediction"))
