"""Ordered folds and parsers: no SQL says them; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import packing as pk
from tessera.plans.catalog import query
from tessera.plans.common import read
from tessera.sources import chat

KEYWORDS = {"question": ("?",), "the": ("the ",), "die": ("die ",), "les": ("les ",), "que": ("que ",)}


@query(
    "evidence_chunks",
    """WITH RECURSIVE m AS (SELECT conv_id, turn, len(coalesce(text, '')) + len(coalesce(role, '')) + 2 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (SELECT conv_id, turn, k, c AS size, 1 AS n, 0 AS chunk_no FROM m WHERE k = 1
      UNION ALL SELECT m.conv_id, m.turn, m.k, CASE WHEN f.size + m.c > 700 OR f.n >= 12 THEN m.c ELSE f.size + m.c END, CASE WHEN f.size + m.c > 700 OR f.n >= 12 THEN 1 ELSE f.n + 1 END, f.chunk_no + CASE WHEN f.size + m.c > 700 OR f.n >= 12 THEN 1 ELSE 0 END
      FROM f JOIN m ON m.conv_id = f.conv_id AND m.k = f.k + 1)
    SELECT conv_id, turn, chunk_no FROM f""",
)
def evidence_chunks(spark, d):
    return pk.chunk_groups(read(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


def _turns(spark, d):
    """Turns of the conversations; turns 3 of 4 reply to the one two before."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return c.withColumns({"text": F.coalesce("text", F.lit("")), "ref": F.when(F.col("turn") % 4 == 3, F.col("turn") - 2).otherwise(F.lit(-1))})


@query("topic_assign")
def topic_assign(spark, d):
    def run(rows):
        found = pk.topics_of([(text, {turn}, {ref}) for turn, text, ref in rows], KEYWORDS)
        return [(turn, n, c) for (turn, _, _), (n, c) in zip(rows, found, strict=True)]

    return pk.folded(_turns(spark, d), "conv_id", "turn", ["turn", "text", "ref"], run, "turn bigint, topic_no int, category string")


@query("topic_turns")
def topic_turns(spark, d):
    """Messages of one role 90 seconds apart; system messages are of another kind."""
    t = _turns(spark, d).withColumns({"day": (F.col("turn") / 6).cast("int"), "at": F.col("turn") * 90.0, "kind": F.when(F.col("role") == "system", "system").otherwise("text"), "who": F.when(F.col("turn") % 5 < 3, "a").otherwise("b")})

    def run(rows):
        return [(r[0], n) for r, n in zip(rows, pk.merged_turns([r[1:] for r in rows], KEYWORDS), strict=True)]

    return pk.folded(t, "conv_id", "turn", ["turn", "who", "day", "at", "kind", "text"], run, "turn bigint, turn_no int")


@query("token_chunks")
def token_chunks(spark, d):
    """Costs: words of a turn and two; 20 for the empty request, 120 at most, two turns carried over."""

    def run(rows):
        return [(k, a, b, c) for k, (a, b, c) in enumerate(pk.token_chunks([len(t.split()) + 2 for (t,) in rows], 20, 120, 2))]

    return pk.folded(_turns(spark, d), "conv_id", "turn", ["text"], run, "chunk int, first int, stop int, carried int")


@query("fitted_context")
def fitted_context(spark, d):
    """Days away: turns minus 3; room for 80 words."""

    def run(rows):
        return [(rows[k][0],) for k in pk.fitted([(turn - 3, (turn,), len(t.split())) for turn, t in rows], 80)]

    return pk.folded(_turns(spark, d), "conv_id", "turn", ["turn", "text"], run, "turn bigint")


@query("exchange_selection")
def exchange_selection(spark, d):
    """The turns chosen before each conversation's end, 150 words and 10 turns at most; none where an answer lacks its question."""

    def run(rows):
        roles, refs = [r[1] for r in rows], [[r[3]] if r[3] >= 0 else [] for r in rows]
        topics = [n for n, _ in pk.topics_of([(text, {turn}, {ref}) for turn, _, text, ref in rows], KEYWORDS)]
        chosen = pk.selected_turns(roles, refs, topics, [len(r[2].split()) for r in rows], 150, 10)
        return [(rows[k][0],) for k in chosen or []]

    return pk.folded(_turns(spark, d), "conv_id", "turn", ["turn", "role", "text", "ref"], run, "turn bigint")


@query(
    "history_with_gaps",
    """WITH k AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS gap FROM conversations WHERE turn % 3 <> 1)
    SELECT conv_id, sha256(string_agg(CASE WHEN gap THEN '[…]' || chr(10) ELSE '' END || role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS history FROM k GROUP BY 1""",
)
def history_with_gaps(spark, d):
    """Kept: turns that aren't 1 of 3."""
    kept = read(spark, d, "conversations", "conv_id", "turn", "role", "text").where("turn % 3 <> 1")
    return pk.history(kept, "conv_id", "turn", "role", "text", "[…]").select("conv_id", F.sha2(F.col("history").cast("binary"), 256).alias("history"))


@query(
    "assistant_labels",
    """WITH t AS (SELECT conv_id, turn, coalesce(len(text), 0)::INT AS id, (role = 'assistant')::INT AS m FROM conversations), s AS (SELECT *, m = 1 AND coalesce(lag(m) OVER w, 0) = 0 AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, string_agg(CASE WHEN m = 1 THEN id ELSE -100 END::VARCHAR, ',' ORDER BY turn) AS labels, count(*) FILTER (opens)::INT AS n_spans FROM s GROUP BY 1""",
)
def assistant_labels(spark, d):
    """Tokens: one a turn, its length; mask: replies."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("id"), (F.col("role") == "assistant").cast("int").alias("m"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "m"))).alias("x"))
    ids, mask = F.transform("x", lambda x: x["id"]), F.transform("x", lambda x: x["m"])
    return g.select("conv_id", F.array_join(F.transform(pk.assistant_labels(ids, mask), lambda x: x.cast("string")), ",").alias("labels"), F.size(pk.mask_spans(mask)).alias("n_spans"))


@query("grounded_prompts", "WITH c AS (SELECT quality, string_agg('[m' || doc_id || '] label ' || toxic, chr(10) ORDER BY doc_id) AS m FROM labels WHERE doc_id % 50 < 3 GROUP BY 1) SELECT i.item_id, sha256('<memory>' || chr(10) || coalesce(m, '(none)') || chr(10) || '</memory>' || chr(10) || 'user: ' || i.text) AS prompt FROM benchmark i LEFT JOIN c ON i.item_id % 3 = c.quality")
def grounded_prompts(spark, d):
    """Memories of an item: labels of the quality that its id modulo 3 names, with ids below 3 of 50; items of remainder 2 have none."""
    m = read(spark, d, "labels", "doc_id", "quality", "toxic").where("doc_id % 50 < 3").select("quality", F.col("doc_id").alias("k"), F.concat(F.lit("m"), "doc_id").alias("memory_id"), F.concat(F.lit("label "), "toxic").alias("content"))
    items = read(spark, d, "benchmark", "item_id", "text").withColumn("quality", (F.col("item_id") % 3).cast("int"))
    grouped = m.groupBy("quality").agg(F.array_sort(F.collect_list(F.struct("k", "memory_id", "content"))).alias("held"))
    joined = items.join(grouped, "quality", "left")
    prompt = pk.grounded_prompt(F.col("held"), F.col("text"), "(none)")
    return joined.select("item_id", F.sha2(prompt.cast("binary"), 256).alias("prompt"))


@query(
    "memory_contexts",
    """WITH m AS (SELECT o_custkey AS g, string_agg('- ' || o_orderdate::DATE::VARCHAR || ' ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS lines FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    v AS (SELECT o_custkey AS g, o_orderpriority AS k, list_sort(list(DISTINCT o_orderdate::DATE::VARCHAR)) AS vals FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2), x AS (SELECT g, string_agg('- ' || k || ': ' || array_to_string(vals, ', '), chr(10) ORDER BY k) AS lines FROM v WHERE len(vals) >= 2 GROUP BY 1)
    SELECT a.g, sha256('<memory>' || chr(10) || coalesce(m.lines, '(none)') || chr(10) || '</memory>' || chr(10) || '<conflicts>' || chr(10) || coalesce(x.lines, '(none)') || chr(10) || '</conflicts>') AS context FROM (SELECT DISTINCT o_custkey AS g FROM orders) a LEFT JOIN m ON a.g = m.g LEFT JOIN x ON a.g = x.g""",
)
def memory_contexts(spark, d):
    """Confirmed memories: orders with status F; candidates: those with status O, whose facts are priorities and values dates."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus", "o_orderpriority")
    out = pk.memory_context(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "day", "o_orderpriority", "(none)")
    return out.select(F.col("o_custkey").alias("g"), F.sha2(F.col("context").cast("binary"), 256).alias("context"))


@query("html_messages")
def html_messages(spark, d):
    return chat.html_messages(read(spark, d, "pages", "page_id", "html"), "page_id", "html")


@query("html_visible_text")
def html_visible_text(spark, d):
    return chat.visible_text(read(spark, d, "pages", "page_id", "html"), "page_id", "html")


_YMD, _YM, _MD = "((?:19|20)[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", "((?:19|20)[0-9]{2})[-/.年]([0-9]{1,2})", "(?:^|[^0-9])([0-9]{1,2})月([0-9]{1,2})日?"
_DATES = f"""WITH t AS (SELECT doc_id, text, {", ".join(f"regexp_extract(text, '{p}', {k}) AS {n}{k}" for n, p, most in (("f", _YMD, 3), ("m", _YM, 2), ("d", _MD, 2)) for k in range(1, most + 1))}, regexp_extract(text, '(?:19|20)[0-9]{{2}}') AS y FROM documents),
r AS (SELECT doc_id, CASE WHEN contains(text, '前天') THEN ['2023-12-30', 'day'] WHEN contains(text, '昨天') THEN ['2023-12-31', 'day'] WHEN contains(text, '今天') THEN ['2024-01-01', 'day'] WHEN contains(text, '明天') THEN ['2024-01-02', 'day'] WHEN contains(text, '后天') THEN ['2024-01-03', 'day']
  WHEN try_cast(f1 || '-' || f2 || '-' || f3 AS DATE) IS NOT NULL THEN [try_cast(f1 || '-' || f2 || '-' || f3 AS DATE)::VARCHAR, 'day']
  WHEN try_cast(m2 AS INT) BETWEEN 1 AND 12 THEN [m1 || '-' || lpad(m2, 2, '0'), 'month']
  WHEN try_cast(d1 AS INT) BETWEEN 1 AND 12 AND try_cast(d2 AS INT) BETWEEN 1 AND 31 THEN ['--' || lpad(d1, 2, '0') || '-' || lpad(d2, 2, '0'), 'month_day']
  WHEN y <> '' THEN [y, 'year'] ELSE [NULL, 'unknown'] END AS r FROM t)
SELECT doc_id, r[1] AS value, r[2] AS precision FROM r"""


@query("document_dates", _DATES)
def document_dates(spark, d):
    """The date that each whole document names; today is 2024-01-01."""
    r = read(spark, d, "documents", "doc_id", "text").select("doc_id", pk.resolved_date(F.col("text"), F.lit("2024-01-01").cast("date")).alias("r"))
    return r.select("doc_id", "r.value", "r.precision")


@query("char_budget", "WITH RECURSIVE i AS (SELECT conv_id, turn, len(coalesce(text, ''))::INT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), f AS (SELECT conv_id, turn, k, c <= 600 AS kept, CASE WHEN c <= 600 THEN c ELSE 0 END AS used FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.turn, i.k, used + c <= 600, CASE WHEN used + c <= 600 THEN used + c ELSE used END FROM f JOIN i ON i.conv_id = f.conv_id AND i.k = f.k + 1) SELECT conv_id, turn FROM f WHERE kept")
def char_budget(spark, d):
    """Turns that fit into 600 characters, in order; those that don't are skipped."""
    c = read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("c")).alias("x"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("items"))
    return g.select("conv_id", F.explode(pk.within_budget(F.col("items"), "c", 600)).alias("x")).select("conv_id", "x.turn")
