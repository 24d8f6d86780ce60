"""Splits, samples, features and receipts on the driver's tables; docstrings say how missing columns are derived."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import features as fe
from tessera.operators import records as rc
from tessera.operators import splits as sp
from tessera.plans.catalog import query
from tessera.plans.common import read

_UNIT = "('0x' || substr(md5('{1}:' || {0}::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


@query(
    "content_grouped_split",
    f"""WITH r AS (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE lang IS NOT NULL), g AS (SELECT h, min(lang) AS label, count(*) AS n FROM r GROUP BY 1),
    o AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY n DESC, {_UNIT.format('h', 42)}, h) - n AS before, sum(n) OVER (PARTITION BY label) AS every FROM g)
    SELECT doc_id, CASE WHEN (before + n / 2) / every < 0.8 THEN 'training' WHEN (before + n / 2) / every < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM r JOIN o USING (h)""",
)
def content_grouped_split(spark, d):
    """Labels: languages."""
    docs = read(spark, d, "documents", "doc_id", "text", "lang").where("lang IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    return sp.content_grouped_split(docs, "h", "lang", [("training", 0.8), ("validation", 0.1), ("test", 0.1)]).select("doc_id", "split")


@query("class_split", f"SELECT p_brand, split, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM (SELECT p_brand, p_partkey, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor((n - floor(n * 0.8::DOUBLE)) / 2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {_UNIT.format('p_partkey', 7)}, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)) GROUP BY 1, 2")
def class_split(spark, d):
    """Per class in hash order: 80 %, and the rest halved."""
    p = read(spark, d, "part", "p_brand", "p_partkey")
    w = Window.partitionBy("p_brand")
    r, n = F.row_number().over(w.orderBy(sp.hash_unit("p_partkey", 7), "p_partkey")) - 1, F.count(F.lit(1)).over(w)
    first = F.floor(n * F.lit(0.8))
    split = F.when(r < first, "train").when(r < first + F.floor((n - first) / 2), "validation").otherwise("test")
    return p.withColumn("split", split).groupBy("p_brand", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("evenly_spaced", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE k IN (SELECT i * (SELECT max(n) FROM r) // 37 FROM range(37) t(i))")
def evenly_spaced(spark, d):
    return sp.evenly_spaced(read(spark, d, "orders", "o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 37).select("o_orderkey")


@query("day_sample", "SELECT day, n FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1) ORDER BY sha256('{\"day\":\"' || day || '\",\"seed\":7}') LIMIT 5")
def day_sample(spark, d):
    """Five days by the digest of day and seed: the limit is the operator's own."""
    days = read(spark, d, "events", "ts").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.sha2(F.concat(F.lit('{"day":"'), F.col("day"), F.lit('","seed":7}')).cast("binary"), 256)).limit(5)


@query("fixture_sample", "SELECT doc_id, n_chars FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 25")
def fixture_sample(spark, d):
    """The first 25 by sample id: the limit is the operator's own."""
    return read(spark, d, "documents", "doc_id", "n_chars").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)).limit(25)


@query("resolved_latest", "SELECT o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate::TIMESTAMP) // 1000000) * 1000000000 + o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1")
def resolved_latest(spark, d):
    """Of a customer's active urgent orders the latest."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").where("o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("run_groups", "SELECT s_nationkey AS tag, s_suppkey AS run_id, round(s_acctbal, 2) AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier WHERE s_acctbal > 0")
def run_groups(spark, d):
    """Tags: nations; within one the best balance first."""
    s = read(spark, d, "supplier", "s_nationkey", "s_suppkey", "s_acctbal").where("s_acctbal > 0")
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return s.select(F.col("s_nationkey").alias("tag"), F.col("s_suppkey").alias("run_id"), F.round("s_acctbal", 2).alias("score"), F.row_number().over(w).alias("rank"))


@query("first_successful_run", "SELECT o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate::TIMESTAMP) // 1000000) * 1000000000 + o_orderkey) AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderkey % 5 <> 0 GROUP BY 1")
def first_successful_run(spark, d):
    """Latest first; finished, above 50,000, key not divisible by 5."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderkey % 5 <> 0")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))


@query("metric_history_page", "SELECT event_id, round(value, 4) AS value FROM events WHERE event_type = 'click' AND event_id > 50 AND event_id % 6 <> 0 ORDER BY event_id LIMIT 41")
def metric_history_page(spark, d):
    """A page of 40 and one more; values of ids divisible by 6 aren't finite."""
    e = read(spark, d, "events", "event_id", "event_type", "value").where("event_type = 'click'").withColumn("value", F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rc.keyset_page(e.where(~F.isnan("value")).select("event_id", F.round("value", 4).alias("value")), "event_id", 50, 40)


@query("partition_resolver", f"SELECT strategy, split, count(*) AS n FROM (SELECT 'source' AS strategy, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'validation' END AS split FROM documents UNION ALL SELECT 'group', CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END FROM (SELECT {_UNIT.format('source', 42)} AS u FROM documents WHERE source IS NOT NULL)) GROUP BY 1, 2")
def partition_resolver(spark, d):
    """Either the split that rows bring along, or one by group (the source)."""
    docs = read(spark, d, "documents", "doc_id", "source")
    resolve = {
        "source": docs.select(F.when(F.col("doc_id") % 10 < 8, "train").otherwise("validation").alias("split")),
        "group": sp.group_split(docs.where("source IS NOT NULL"), "source", 0.8, 0.1).select("split"),
    }
    counted = [df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("strategy"), "split", "n") for k, df in resolve.items()]
    return counted[0].unionByName(counted[1])


@query("task_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def task_sequence(spark, d):
    e = read(spark, d, "events", "user_id", "event_id", "ts")
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


_PARTS = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS size, p_retailprice AS price FROM part)"


def _parts(spark, d):
    """Brands of keys divisible by 4 and sizes of keys divisible by 6 are missing."""
    k = F.col("p_partkey")
    return read(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").select(k, F.when(k % 4 != 0, F.col("p_brand")).alias("brand"), F.when(k % 6 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").cast("double").alias("price"))


@query("structural_fill", f"WITH {_PARTS} SELECT p_partkey, coalesce(brand, 'None') AS brand, coalesce(size, 0)::DOUBLE AS size, (size IS NULL)::INT AS size_missing FROM p")
def structural_fill(spark, d):
    return fe.filled(_parts(spark, d), ["brand"], ["size"]).select("p_partkey", "brand", "size", "size_missing")


@query("additive_features", f"WITH {_PARTS} SELECT p_partkey, round(coalesce(size, 0) + price, 4) AS total, greatest(CASE WHEN coalesce(size, 0) > 0 THEN 30 - size ELSE 0 END, 0)::INT AS age, (coalesce(size, 0) > 0)::INT AS has_size, round(coalesce(size, 0) * ln(1 + price), 6) AS interaction FROM p")
def additive_features(spark, d):
    size = F.coalesce("size", F.lit(0))
    return _parts(spark, d).select("p_partkey", F.round(fe.total("size", "price"), 4).alias("total"), fe.age(F.lit(30), F.col("size")).cast("int").alias("age"), (size > 0).cast("int").alias("has_size"), F.round(size * F.log1p("price"), 6).alias("interaction"))


@query(
    "preprocessed",
    f"""WITH {_PARTS}, q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.5) AS b, quantile_cont(size, 0.75) AS c FROM p)
    SELECT p_partkey, round((coalesce(size, b) - b) / CASE WHEN c = a THEN 1 ELSE c - a END, 9) AS size, (size IS NULL)::INT AS size_missing, coalesce(brand = 'Brand#1', false)::INT AS brand_1, coalesce(brand = 'Brand#2', false)::INT AS brand_2 FROM p, q""",
)
def preprocessed(spark, d):
    """Median, quartile distance and one-hot levels, unknown levels having none."""
    scaled = fe.robust_scaled(_parts(spark, d), ["size"])
    hot = fe.one_hot("brand", ["Brand#1", "Brand#2"])
    return scaled.select("p_partkey", F.round("size", 9).alias("size"), "size_missing", *[c.alias(n.replace("brand=Brand#", "brand_")) for n, c in hot.items()])


_FIT = """s AS (SELECT {0}, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM {1}),
c AS (SELECT *, xx / n - (sx / n) * (sx / n) AS v, xy / n - (sx / n) * (sy / n) AS k FROM s), b AS (SELECT *, (k / sqrt(v) * n / (n + 1)) / sqrt(v) AS slope, sy / n AS my, sx / n AS mx FROM c)"""


@query("ridge_closed_form_sql", "WITH " + _FIT.format("1 AS one", "lineitem GROUP BY 1") + " SELECT round(slope, 4) AS slope, round(my - slope * mx, 2) AS intercept FROM b")
def ridge_closed_form_sql(spark, d):
    """One feature, alpha 1: the slope of the standardised column is its covariance over n + 1 times n."""
    w = fe.ridge(read(spark, d, "lineitem", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice", 1.0)
    return spark.createDataFrame([(round(w["l_quantity"], 4), round(w["intercept"], 2))], "slope double, intercept double")


@query("out_of_fold", "WITH f AS (SELECT k.fold, l.* FROM (SELECT unnest(range(4)) AS fold) k JOIN lineitem l ON l.l_orderkey % 4 <> k.fold), " + _FIT.format("fold", "f GROUP BY 1") + " SELECT fold, count(*) AS n, round(sum(my + slope * (l_quantity - mx)) / count(*), 2) AS mean FROM lineitem JOIN b ON l_orderkey % 4 = fold GROUP BY 1")
def out_of_fold(spark, d):
    """Folds: order keys modulo 4; the fit of each row comes from the other folds."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice").withColumn("fold", F.col("l_orderkey") % 4)
    p = fe.out_of_fold(li, ["l_quantity"], "l_extendedprice", "fold", 4, 1.0)
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 2).alias("mean"))


@query("stacked_folds")
def stacked_folds(spark, d):
    """Two models (quantity; discount and tax) and the blend that each fold learns from the others."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("fold", F.col("l_orderkey") % 3)
    out = fe.stacked(li, {"by_quantity": ["l_quantity"], "by_rates": ["l_discount", "l_tax"]}, "l_extendedprice", "fold", 3, 1.0)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in ("by_quantity", "by_rates", "stack")])


@query("ridge_predictions", "SELECT l_orderkey, l_linenumber, round(10 + 2.5::DOUBLE * l_quantity - 3 * l_discount, 6) AS prediction FROM lineitem")
def ridge_predictions(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_linenumber", F.round(fe.ridge_predicted({"l_quantity": 2.5, "l_discount": -3.0, "intercept": 10.0}), 6).alias("prediction"))


@query("matrix_schema", "SELECT count(*) AS rows, count(*) FILTER (l_quantity IS NULL OR NOT isfinite(l_quantity) OR l_tax IS NULL OR NOT isfinite(l_tax)) AS bad, 'l_quantity,l_tax' AS columns FROM lineitem")
def matrix_schema(spark, d):
    """The exact columns, each finite."""
    li = read(spark, d, "lineitem", "l_quantity", "l_tax")
    bad = F.lit(False)
    for c in li.columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return li.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad")).withColumn("columns", F.lit(",".join(sorted(li.columns))))


@query("search_space", "SELECT r.r_name AS family, n.n_name AS optimizer, k AS depth FROM region r, nation n, (VALUES (1), (2), (3)) t(k) WHERE n.n_regionkey = 1 AND NOT (k = 3 AND r.r_regionkey = 0)")
def search_space(spark, d):
    """Regions, the nations of region 1, depths 1 to 3; region 0 has no depth 3. Bounded lists, so one explode after another."""
    r, n = read(spark, d, "region", "r_name", "r_regionkey"), read(spark, d, "nation", "n_name", "n_regionkey").where("n_regionkey = 1")
    choices = n.agg(F.collect_list("n_name").alias("choices"))
    space = r.crossJoin(F.broadcast(choices)).select(F.col("r_name").alias("family"), "r_regionkey", F.explode("choices").alias("optimizer"))
    depths = F.when(F.col("r_regionkey") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return space.select("family", "optimizer", F.explode(depths).alias("depth"))


@query("delete_receipts", "WITH r AS (SELECT label, vec_id, sha256(vec_id::VARCHAR) AS h FROM embeddings) SELECT label, count(*) AS before, count(*) FILTER (vec_id % 9 <> 0) AS after, count(*) FILTER (vec_id % 9 = 0) AS deleted, 0::BIGINT AS residual, sha256(coalesce(string_agg(h, '' ORDER BY h), '')) AS digest_before, sha256(coalesce(string_agg(h, '' ORDER BY h) FILTER (vec_id % 9 <> 0), '')) AS digest_after FROM r GROUP BY 1")
def delete_receipts(spark, d):
    """Owners: labels; deleted: ids divisible by 9."""
    e = read(spark, d, "embeddings", "label", "vec_id")
    return rc.delete_receipts(e, e.where("vec_id % 9 = 0").select("vec_id"), "label", "vec_id")


@query("lineage_rows", "SELECT 'session' AS kind, o_custkey::VARCHAR AS object_id, len(list(DISTINCT o_orderkey))::INT AS n_sources, min(o_orderkey) AS least FROM orders GROUP BY o_custkey UNION ALL SELECT 'candidate', l_orderkey::VARCHAR, len(list(DISTINCT l_suppkey))::INT, min(l_suppkey) FROM lineitem GROUP BY l_orderkey")
def lineage_rows(spark, d):
    """Sessions: customers of their orders; candidates: orders of their suppliers."""
    o, li = read(spark, d, "orders", "o_custkey", "o_orderkey"), read(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    rows = rc.lineage(session=(o, "o_custkey", "o_orderkey"), candidate=(li, "l_orderkey", "l_suppkey"))
    return rows.select("kind", "object_id", F.size("sources").alias("n_sources"), F.array_min("sources").alias("least"))


@query("unique_samples", "SELECT count(*) AS rows, count(*) - count(DISTINCT l_orderkey || ':' || l_linenumber) AS repeated, count(*) FILTER (l_quantity <= 0) AS invalid FROM lineitem")
def unique_samples(spark, d):
    """The gate of a table scan: ids once, values in range."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return li.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct("l_orderkey", "l_linenumber")).alias("repeated"), F.count_if(F.col("l_quantity") <= 0).alias("invalid"))


@query("study_history", "SELECT s_suppkey AS run_id, round(s_acctbal, 2) AS score FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 0 AND s_suppkey % 10 <> 3")
def study_history(spark, d):
    """Runs of the same framework (even nations) that ended well and have a score."""
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    params = F.create_map(F.lit("framework"), (F.col("s_nationkey") % 2).cast("string"), F.lit("status"), F.when(F.col("s_suppkey") % 10 == 3, "failed").otherwise("finished"))
    runs = s.select(F.col("s_suppkey").alias("run_id"), params.alias("params"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    return runs.where("params['framework'] = '0' AND params['status'] = 'finished' AND score IS NOT NULL").select("run_id", F.round("score", 2).alias("score"))
