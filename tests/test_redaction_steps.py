"""Redaction with cheap tests before its steps equals the plain steps; the steps stand once in the plan."""

from pyspark.sql import functions as F

from tessera.functions import privacy
from tessera.functions.text import normalized
from tessera.plans import load_catalog

SAID = "call 13812345678 a.b@c.org password: hunter22 id 11010119900307123X card 6222021234567890 at 31.23041, 121.47371 ip 10.0.0.1 地址：上海市某路1号。wxid_ab1 @bob https://u@ex.org:80/x?y ACCESS KEY abcd1234 密码 1234abcd one time password 99999 OTP 123456"


def test_steps_stand_once(spark, sf_dir):
    plan = load_catalog().QUERIES["redaction_categories"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "(size(" not in plan and plan.count("RLIKE") < 60


def test_hints_change_no_redaction(spark, sf_dir):
    texts = [SAID, SAID.upper(), SAID.replace(" ", "\t "), "Shopping pin 1", "token\tabcd  x", "", None, "a  b\t\tc \n\n\n\nd"]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    plain, hits = df.select("doc_id", normalized("text").alias("v")).localCheckpoint(), []
    for k, (name, category, put) in enumerate(privacy.STEPS):
        plain = plain.withColumn(f"h{k}", F.when(F.col("v").rlike(privacy.PATTERNS[name]), F.lit(category))).withColumn("v", F.regexp_replace("v", privacy.PATTERNS[name], put))
        hits.append(f"h{k}")
    plain = plain.withColumn("u", F.when(F.col("v").rlike(privacy.PATTERNS["url"]), F.lit("link_identifier")))
    plain = plain.withColumn("v", F.regexp_replace("v", r"(?iU)https?://(?:[^\s<>/?#@]*@)?([^\s<>/?#:@]+)[^\s<>]*", "<LINK:$1>")).withColumn("v", F.regexp_replace("v", privacy.PATTERNS["url"], "<LINK>"))
    want = {r.doc_id: (r.v, r.c) for r in plain.select("doc_id", "v", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits, "u")))).alias("c")).collect()}
    got = {r.doc_id: (r.redacted, r.categories) for r in privacy.with_redaction(df, "text").collect()}
    assert got == want and len(got[-1][1]) > 7
