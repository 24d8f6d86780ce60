"""Joins that have to come out even, on the driver's tables; docstrings say how missing columns are derived."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import joins as jn
from tessera.plans.catalog import query
from tessera.plans.common import read


def _reviews(spark, d):
    """Candidates: documents, their content hash and language; reviews: labels with the hash they were given for (wrong for ids divisible by 11)."""
    docs = read(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", F.sha2("text", 256).alias("content"), "lang")
    labels = read(spark, d, "labels", "doc_id", "quality", "toxic").join(docs, "doc_id", "left")
    content = F.when(F.col("doc_id") % 11 == 0, F.lit("old")).otherwise(F.col("content"))
    return docs, labels.select("doc_id", content.alias("content"), "lang", "quality", "toxic")


_REVIEWS = """docs AS (SELECT doc_id, sha256(text) AS content, lang FROM documents),
reviews AS (SELECT l.doc_id, CASE WHEN l.doc_id % 11 = 0 THEN 'old' ELSE d.content END AS content, d.lang, quality, toxic FROM labels l LEFT JOIN docs d USING (doc_id))"""


@query("review_bijection", f"WITH {_REVIEWS} SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN d.lang IS DISTINCT FROM r.lang THEN 'differs_lang' WHEN d.content IS DISTINCT FROM r.content THEN 'differs_content' ELSE 'ok' END AS state FROM docs d FULL JOIN reviews r USING (doc_id)")
def review_bijection(spark, d):
    docs, reviews = _reviews(spark, d)
    return jn.bijection(docs, reviews, "doc_id", ["lang", "content"])


@query("reviewed_rows", f"WITH {_REVIEWS} SELECT d.doc_id, d.lang, CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS review_status FROM docs d JOIN reviews r ON d.doc_id = r.doc_id AND d.content = r.content WHERE quality = 1")
def reviewed_rows(spark, d):
    """The compiled output: kept rows whose review was given for the text as it is."""
    docs, reviews = _reviews(spark, d)
    ok = jn.bijection(docs, reviews, "doc_id", ["lang", "content"]).where("state = 'ok'")
    status = F.when(F.col("quality") == 1, "keep").otherwise("reject")
    return docs.join(ok, "doc_id", "left_semi").join(reviews.select("doc_id", "quality"), "doc_id").where("quality = 1").select("doc_id", "lang", status.alias("review_status"))


@query("decision_coverage", "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN labels l USING (doc_id) GROUP BY 1")
def decision_coverage(spark, d):
    """Machine decisions (labels) against even documents: both sides have to cover each other."""
    docs = read(spark, d, "documents", "doc_id").where("doc_id % 2 = 0")
    return jn.bijection(docs, read(spark, d, "labels", "doc_id"), "doc_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_resolution",
    """WITH refs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), parts AS (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 7 = 0),
    t AS (SELECT p_partkey, count(*) AS n FROM parts GROUP BY 1)
    SELECT l_orderkey, count(*) AS n_refs, count(*) FILTER (n IS NULL) AS n_unresolved, count(*) FILTER (n > 1) AS n_ambiguous FROM refs LEFT JOIN t ON l_partkey = p_partkey GROUP BY 1""",
)
def evidence_resolution(spark, d):
    """Groups: orders; evidence references: their parts; parts divisible by 5 are gone, those divisible by 7 stand once more."""
    groups = read(spark, d, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("refs"))
    p = read(spark, d, "part", "p_partkey")
    return jn.resolve_once(groups, "refs", p.where("p_partkey % 5 <> 0").unionByName(p.where("p_partkey % 7 = 0")), "p_partkey", "l_orderkey")


@query(
    "fact_resolution",
    """WITH v AS (SELECT o_custkey AS k, o_orderpriority AS v, list_sort(list(DISTINCT o_orderkey)) AS refs FROM orders GROUP BY 1, 2),
    c AS (SELECT *, sha256(k || ':' || v || ':' || array_to_string(refs, ',')) AS candidate FROM v),
    s AS (SELECT k, arg_min(candidate, v) AS selected FROM c WHERE k % 3 <> 0 GROUP BY 1)
    SELECT c.k AS o_custkey, c.v AS value, len(c.refs)::INT AS n_evidence, (SELECT count(*) FROM lineitem WHERE list_contains(c.refs, l_orderkey)) AS n_extractions FROM c JOIN s ON c.candidate = s.selected""",
)
def fact_resolution(spark, d):
    """Groups: customers; candidates: their priorities, located by digest; evidence: orders; extractions: their lines. Decided: groups not divisible by 3, the first value."""
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey")
    c = o.groupBy(F.col("o_custkey"), F.col("o_orderpriority").alias("value")).agg(F.array_sort(F.collect_set("o_orderkey")).alias("refs"))
    c = c.withColumn("candidate", F.sha2(F.concat_ws(":", "o_custkey", "value", F.array_join("refs", ",")), 256))
    selected = c.where("o_custkey % 3 <> 0").groupBy("o_custkey").agg(F.min_by("candidate", "value").alias("candidate"))
    lines = read(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    chosen = c.join(selected, ["o_custkey", "candidate"])
    extracted = chosen.select("o_custkey", F.explode("refs").alias("l_orderkey")).join(lines, "l_orderkey").groupBy("o_custkey").agg(F.sum("n").alias("n_extractions"))
    return chosen.join(extracted, "o_custkey", "left").select("o_custkey", "value", F.size("refs").alias("n_evidence"), F.coalesce("n_extractions", F.lit(0)).alias("n_extractions"))


_LINEAGE = """r AS (SELECT o_orderkey AS k, list(DISTINCT l_suppkey) AS ids FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
l AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) FILTER (l_linenumber = 1) AS t, list(DISTINCT l_suppkey) FILTER (l_linenumber > 1 AND l_orderkey % 9 <> 0) AS c FROM lineitem GROUP BY 1)"""


@query("lineage_sets", f"WITH {_LINEAGE} SELECT k, list_sort(ids) = list_sort(list_distinct(coalesce(t, []) || coalesce(c, []))) AS equal, NOT list_has_any(coalesce(t, []), coalesce(c, [])) AS disjoint FROM r LEFT JOIN l USING (k)")
def lineage_sets(spark, d):
    """Rows: suppliers of an order; target: that of its first line; context: those of the others (lost for orders divisible by 9)."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber").withColumnRenamed("l_orderkey", "k")
    rows = li.join(read(spark, d, "orders", "o_orderkey"), F.col("k") == F.col("o_orderkey")).groupBy("k").agg(F.collect_set("l_suppkey").alias("ids"))
    context = F.collect_set(F.when((F.col("l_linenumber") > 1) & (F.col("k") % 9 != 0), F.col("l_suppkey")))
    lineage = li.groupBy("k").agg(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("t"), context.alias("c"))
    return jn.same_sets(rows, lineage, "k", "ids", "t", "c")


@query("session_split_lookup", "SELECT coalesce(s.split, 'unknown') AS split, count(*) AS n, count(DISTINCT user_id) AS users FROM events e LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 3 <> 0) s ON user_id = c_custkey GROUP BY 1")
def session_split_lookup(spark, d):
    """Sessions: users; those divisible by 3 have no split."""
    c = read(spark, d, "customer", "c_custkey").where("c_custkey % 3 <> 0")
    splits = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 < 8, "train").otherwise("test").alias("split"))
    return jn.with_split(read(spark, d, "events", "user_id"), splits, "user_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "message_exposure",
    """WITH u AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM supplier WHERE s_suppkey % 5 <> 0),
    m AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS times FROM lineitem GROUP BY 1)
    SELECT CASE WHEN u.id IS NULL THEN 'unknown' ELSE split END AS split, count(u.id) AS messages, count(m.id) AS exposed, coalesce(sum(times), 0)::BIGINT AS times FROM u FULL JOIN m ON u.id = m.id GROUP BY 1""",
)
def message_exposure(spark, d):
    """Messages: suppliers (those divisible by 5 aren't in the universe); rows: orders, which name their suppliers once each."""
    s = read(spark, d, "supplier", "s_suppkey").where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "validation").otherwise("train").alias("split"))
    rows = read(spark, d, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return jn.exposure(rows, "ids", s, "s_suppkey", "split")


@query("selected_rows", "SELECT doc_id, sha256(text) AS raw_sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_rows(spark, d):
    """The curated snapshot: raw bytes of the selected rows alone."""
    keep = read(spark, d, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    return read(spark, d, "documents", "doc_id", "text").join(keep, "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("raw_sha256"))


_REPLIES = """m AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
  CASE WHEN turn % 4 = 1 THEN conv_id || ':' || (turn - 1) WHEN turn % 4 = 2 THEN (conv_id + 1) || ':0' WHEN turn % 4 = 3 THEN conv_id || ':' || (turn + 1 - turn % 2 * 2 + conv_id % 3) END AS ref FROM conversations)"""


def _replies(spark, d):
    """Replies: turns 1 of 4 name the turn before, 2 of 4 the start of the next conversation, 3 of 4 a turn around."""
    c = read(spark, d, "conversations", "conv_id", "turn")
    name = lambda conv, turn: F.concat_ws(":", conv, turn)
    t, k = F.col("turn"), F.col("conv_id")
    ref = F.when(t % 4 == 1, name(k, t - 1)).when(t % 4 == 2, name(k + 1, F.lit(0))).when(t % 4 == 3, name(k, t + 1 - t % 2 * 2 + k % 3))
    return c.select(name(k, t).alias("id"), "conv_id", "turn", F.when(k % 5 == 0, "validation").otherwise("train").alias("split"), ref.alias("ref"))


@query(
    "reply_causality",
    f"""WITH {_REPLIES} SELECT a.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN b.split <> a.split THEN 'other_split' WHEN b.conv_id <> a.conv_id THEN 'other_session' WHEN b.turn >= a.turn THEN 'not_earlier' ELSE 'ok' END AS state
    FROM m a LEFT JOIN m b ON a.ref = b.id WHERE a.ref IS NOT NULL""",
)
def reply_causality(spark, d):
    return jn.reply_state(_replies(spark, d), "id", "ref", "split", "conv_id", "turn")


@query(
    "reply_links",
    f"""WITH {_REPLIES}, w AS (SELECT id, CASE WHEN ref IS NULL THEN [] ELSE [ref] END AS refs, coalesce(list(id) OVER p, []) AS prefix, coalesce(list(id) OVER c, []) AS context, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m
      WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, len(refs) > 0 AND len(list_filter(refs, lambda x: NOT list_contains(prefix, x) OR NOT list_contains(context, x))) = 0 AS explicit FROM w)
    SELECT id, array_to_string(CASE WHEN explicit THEN refs WHEN before IS NOT NULL THEN [before] ELSE [] END, ',') AS linked, CASE WHEN explicit THEN 'explicit' WHEN before IS NOT NULL THEN 'adjacent' ELSE 'none' END AS basis FROM e""",
)
def reply_links(spark, d):
    """Prefix: all turns before; context: the last two."""
    m, by = _replies(spark, d), Window.partitionBy("conv_id").orderBy("turn")
    refs = F.when(F.col("ref").isNull(), F.array().cast("array<string>")).otherwise(F.array("ref"))
    rows = m.withColumns({"refs": refs, "prefix": F.collect_list("id").over(by.rowsBetween(Window.unboundedPreceding, -1)), "context": F.collect_list("id").over(by.rowsBetween(-2, -1)), "before": F.lag("id").over(by)})
    return jn.reply_links(rows, "id", "refs", "prefix", "context", "before").select("id", F.array_join("linked", ",").alias("linked"), "basis")


@query(
    "neighbour_days",
    """WITH t AS (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS l FROM events),
    c AS (SELECT DISTINCT user_id, day FROM (SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'))
    SELECT c.user_id || '/' || c.day AS chunk, c.user_id, t.event_id, (t.day - c.day)::INT AS "offset" FROM c JOIN t ON c.user_id = t.user_id AND t.day BETWEEN c.day - 2 AND c.day + 2 AND t.day <> c.day WHERE CASE WHEN t.day < c.day THEN l ELSE f END <= 3""",
)
def neighbour_days(spark, d):
    """Chunks: days of a user; marked: with a purchase; two days around, three turns each."""
    e = read(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("day", F.to_date("ts"))
    chunks = e.groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "purchase").alias("marked")).withColumn("id", F.concat_ws("/", "user_id", "day"))
    return jn.neighbour_days(chunks, e, "day", "id", ["ts", "event_id"], 2, 3, F.col("marked"), ["user_id"]).select("chunk", "user_id", "event_id", "offset")


@query("evidence_lookup", "SELECT conv_id || ':' || turn AS ref, role, sha256(coalesce(text, '')) AS text_sha256, conv_id AS session FROM conversations")
def evidence_lookup(spark, d):
    """Sessions hold turns, which are unnested to one row a reference again."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    nested = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    flat = nested.select(F.col("conv_id").alias("session"), F.inline("turns"))
    return flat.select(F.concat_ws(":", "session", "turn").alias("ref"), "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "session")


@query(
    "quote_containment",
    """WITH q AS (SELECT doc_id, CASE k WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN upper(substr(text, 5, 30)) ELSE substr(text, 2, 300) END AS quote FROM documents, range(3) r(k)),
    h AS (SELECT q.doc_id, contains(d.text, quote) AND len(quote) BETWEEN 1 AND 240 AS held, d.doc_id % 2 = 0 AS prim FROM q JOIN documents d ON d.doc_id = q.doc_id)
    SELECT doc_id, count(*) AS n_quotes, count(*) FILTER (held) AS n_held, coalesce(bool_or(held AND prim), false) AS any_primary FROM h GROUP BY 1""",
)
def quote_containment(spark, d):
    """Three quotes a document: a true one, one in capitals, one that is too long; even documents are primary evidence."""
    docs = read(spark, d, "documents", "doc_id", "text")
    quotes = docs.select("doc_id", F.explode(F.array(F.substring("text", 11, 60), F.upper(F.substring("text", 5, 30)), F.substring("text", 2, 300))).alias("quote"), F.col("doc_id").alias("ref"))
    return jn.quotes_held(quotes, docs.select(F.col("doc_id").alias("ref"), "text", (F.col("doc_id") % 2 == 0).alias("is_primary")), "quote", "ref", "doc_id", "text", "is_primary")


@query("fold_map", "SELECT o_orderkey % 5 AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS groups FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def fold_map(spark, d):
    """Folds: order keys modulo 5, looked up by id."""
    folds = read(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).alias("fold"))
    return read(spark, d, "lineitem", "l_orderkey").join(folds, "l_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("groups"))


@query("frozen_targets", "WITH f AS (SELECT doc_id AS position, doc_id AS sample_id FROM labels), n AS (SELECT doc_id, count(*) AS c FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1) SELECT position, sample_id, coalesce(c, 0) = 1 AS found FROM f LEFT JOIN n ON sample_id = doc_id")
def frozen_targets(spark, d):
    """Frozen: the labelled documents by id; since then documents divisible by 6 are gone."""
    frozen = read(spark, d, "labels", "doc_id").select(F.col("doc_id").alias("position"), F.col("doc_id").alias("sample_id"))
    now = read(spark, d, "documents", "doc_id").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("sample_id"))
    return jn.frozen_match(frozen, now, "sample_id", "position")


@query("last_wins", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'second' WHEN p_partkey % 5 = 0 THEN 'third' ELSE p_brand END AS value FROM part WHERE NOT (p_partkey % 15 = 0) UNION ALL SELECT p_partkey, 'third' FROM part WHERE p_partkey % 15 = 0")
def last_wins(spark, d):
    """Three layers: brands, a second one for keys divisible by 3, a third for those divisible by 5."""
    p = read(spark, d, "part", "p_partkey", "p_brand")
    first = p.select("p_partkey", F.col("p_brand").alias("value"))
    layer = lambda k, name: p.where(F.col("p_partkey") % k == 0).select("p_partkey", F.lit(name).alias("value"))
    return jn.last_wins([first, layer(3, "second"), layer(5, "third")], "p_partkey")


@query("layer_union", "SELECT 'documents' AS layer, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def layer_union(spark, d):
    n = lambda t: read(spark, d, t).agg(F.count(F.lit(1)).alias("n"))
    return jn.layers(documents=n("documents"), pages=n("pages"), benchmark=n("benchmark"))


@query("decision_index", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS repeated, count(DISTINCT 'reviewer') AS reviewers, count(*) FILTER (quality NOT IN (0, 1)) AS unknown_status FROM labels")
def decision_index(spark, d):
    """Gate over decisions: ids are unique, there is one reviewer, no status is unknown."""
    labels = read(spark, d, "labels", "doc_id", "quality").withColumn("reviewer", F.lit("reviewer"))
    return labels.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated"), F.countDistinct("reviewer").alias("reviewers"), F.count_if(~F.col("quality").isin(0, 1)).alias("unknown_status"))


@query("split_map", "WITH m AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM conversations UNION ALL SELECT conv_id, 'test' FROM conversations WHERE conv_id % 17 = 3) SELECT conv_id AS session, min(split) AS split, count(DISTINCT split) AS n_splits FROM m GROUP BY 1")
def split_map(spark, d):
    """A map of splits to sessions, inverted; sessions 3 of 17 stand in the test split, too."""
    c = read(spark, d, "conversations", "conv_id").distinct()
    of = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("validation"))).otherwise(F.array(F.lit("train")))
    splits = F.when(F.col("conv_id") % 17 == 3, F.concat(of, F.array(F.lit("test")))).otherwise(of)
    return c.select("conv_id", F.explode(splits).alias("split")).groupBy(F.col("conv_id").alias("session")).agg(F.min("split").alias("split"), F.countDistinct("split").alias("n_splits"))


@query("split_manifest_violations", "WITH m AS (SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, 'test' FROM conversations WHERE conv_id % 17 = 3 UNION ALL VALUES (-1, 'train'), (-1, 'train')) SELECT id, CASE WHEN id NOT IN (SELECT conv_id FROM conversations) THEN 'unknown' WHEN count(DISTINCT split) > 1 THEN 'crossing' ELSE 'repeated' END AS violation FROM m GROUP BY 1 HAVING count(*) > 1")
def split_manifest_violations(spark, d):
    """The manifest names session -1, which isn't there, twice, and sessions 3 of 17 in two splits."""
    known = read(spark, d, "conversations", "conv_id").distinct().select(F.col("conv_id").alias("id"))
    m = known.select("id", F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"))
    m = m.unionByName(known.where("id % 17 = 3").withColumn("split", F.lit("test"))).unionByName(spark.createDataFrame([(-1, "train"), (-1, "train")], "id long, split string"))
    counted = m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    seen = counted.join(known.withColumn("known", F.lit(True)), "id", "left")
    violation = F.when(F.col("known").isNull(), "unknown").when(F.col("splits") > 1, "crossing").when(F.col("n") > 1, "repeated")
    return seen.select("id", violation.alias("violation")).where("violation IS NOT NULL")


@query("identity_boundaries", "SELECT count(*) - count(DISTINCT doc_id) AS repeated_ids, (SELECT count(*) FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 5 = 0) > 1)) AS crossing_contents, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 5 = 0) > 1)) AS crossing_sources FROM documents")
def identity_boundaries(spark, d):
    """Splits: whether the id is divisible by 5. Repeated ids, equal contents and sources that cross the border."""
    docs = read(spark, d, "documents", "doc_id", "text", "source").select("doc_id", F.sha2("text", 256).alias("content"), "source", (F.col("doc_id") % 5 == 0).alias("split"))
    crossing = lambda c: docs.groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias(f"crossing_{c}s"))
    ids = docs.agg((F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated_ids"))
    return ids.crossJoin(crossing("content")).crossJoin(crossing("source"))


@query("variant_sets", "SELECT event_type AS variant, count(DISTINCT user_id) AS cases, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) AS complete FROM events GROUP BY 1")
def variant_sets(spark, d):
    """Variants: event types; their case sets have to equal the set of all users."""
    e = read(spark, d, "events", "event_type", "user_id")
    every = e.agg(F.countDistinct("user_id").alias("every"))
    found = e.groupBy(F.col("event_type").alias("variant")).agg(F.countDistinct("user_id").alias("cases"))
    return found.crossJoin(every).select("variant", "cases", (F.col("cases") == F.col("every")).alias("complete"))


@query("content_overlap", "WITH t AS (SELECT DISTINCT sha256(text) AS h, 'part' || (doc_id % 3) AS part FROM documents) SELECT a.part AS a, b.part AS b, count(*) AS n FROM t a JOIN t b ON a.h = b.h AND a.part < b.part GROUP BY 1, 2")
def content_overlap(spark, d):
    """Parts: ids modulo 3; how many contents each two share."""
    from tessera.operators.splits import overlap

    return overlap(read(spark, d, "documents", "doc_id", "text").select(F.sha2("text", 256).alias("h"), F.concat(F.lit("part"), F.col("doc_id") % 3).alias("part")), "h", "part")


@query("unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return read(spark, d, "documents", "doc_id").join(read(spark, d, "labels", "doc_id"), "doc_id", "left_anti")
