"""Sessions of the event stream and turns of the conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import micros
from tessera.operators import sessions as ops
from tessera.plans.catalog import query
from tessera.plans.common import read

GAP = 360
_ISLANDS = f"""
m AS (SELECT *, epoch_us(ts) AS t FROM events),
f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {GAP} * 60000000::BIGINT THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM f)"""
_SUMMARY = """SELECT user_id, session_no, count(*) AS n_events, min(t) AS start_us, max(t) AS end_us, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS participants,
  round(sum(value), 4) AS total_value, 'session_' || substr(sha256(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id)), 1, 16) AS session_id FROM s GROUP BY 1, 2"""


def _islands(spark, d):
    return ops.gap_sessions(read(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value"), "user_id", "ts", "event_id", GAP)


@query("sessions_gap", f"WITH {_ISLANDS} SELECT event_id, user_id, session_no FROM s")
def sessions_gap(spark, d):
    return _islands(spark, d).select("event_id", "user_id", "session_no")


@query("session_participants", f"WITH {_ISLANDS} {_SUMMARY}")
def session_participants(spark, d):
    return ops.session_summary(_islands(spark, d), "user_id", "ts", "event_id", "event_type", "value")


@query("session_topk", f"WITH {_ISLANDS} SELECT * FROM ({_SUMMARY}) ORDER BY n_events DESC, user_id, session_no LIMIT 20")
def session_topk(spark, d):
    return session_participants(spark, d).orderBy(F.desc("n_events"), "user_id", "session_no").limit(20)


_CAPPED = f"""WITH RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, t AS session_start FROM m WHERE k = 1
  UNION ALL SELECT m.user_id, m.event_id, m.t, m.k, CASE WHEN m.t - f.t > {GAP} * 60000000::BIGINT OR m.t - f.session_start > 720 * 60000000::BIGINT THEN m.t ELSE f.session_start END FROM f JOIN m ON m.user_id = f.user_id AND m.k = f.k + 1)
SELECT user_id, session_start, event_id FROM f"""


@query("sessions_duration_capped", _CAPPED)
def sessions_duration_capped(spark, d):
    return ops.capped_sessions(read(spark, d, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", GAP, 720)


@query(
    "session_window_counts",
    "SELECT event_type, (epoch_us(ts) // 86400000000)::BIGINT AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
)
def session_window_counts(spark, d):
    e = read(spark, d, "events", "event_type", "ts", "user_id").withColumn("day", F.floor(micros("ts") / F.lit(86_400_000_000)).cast("long"))
    return e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


_TURNS = """WITH f AS (SELECT *, CASE WHEN lag(1) OVER w = 1 AND lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS fresh FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM f)
SELECT conv_id, turn_no, first(role) AS role, count(*) AS n_messages, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM g GROUP BY 1, 2"""


@query("turn_merge", _TURNS)
def turn_merge(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role <> 'system'")
    return ops.merge_turns(c, ["conv_id"], ["turn"], "role", "text")


@query(
    "turn_merge_rules",
    """WITH f AS (SELECT *, CASE WHEN lag(1) OVER w = 1 AND (lag(event_id) OVER w) % 2 = event_id % 2 AND event_type NOT IN ('error', 'signup') AND epoch_us(ts) - epoch_us(lag(ts) OVER w) BETWEEN 0 AND 43200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS turn_no FROM f)
    SELECT user_id, turn_no, min(event_id % 2) AS role, count(*) AS n_messages, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS text FROM g GROUP BY 1, 2""",
)
def turn_merge_rules(spark, d):
    """Roles: odd and even ids; errors and signups start a turn, and so does what comes more than 12 hours later."""
    e = read(spark, d, "events", "user_id", "ts", "event_id", "event_type").withColumn("role", F.col("event_id") % 2)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    joins = ~F.col("event_type").isin("error", "signup") & (micros("ts") - F.lag(micros("ts")).over(w)).between(0, 43_200_000_000)
    return ops.merge_turns(e, ["user_id"], ["ts", "event_id"], "role", "event_type", joins)


@query(
    "context_window8",
    """WITH k AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, ''), ' ') <> ''),
    w AS (SELECT conv_id, turn, role, text AS reply, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS c FROM k)
    SELECT conv_id, turn, coalesce(len(c), 0)::INT AS n_context, coalesce(array_to_string(c, chr(10)), '') AS context, reply FROM w WHERE role = 'assistant'""",
)
def context_window8(spark, d):
    return ops.context_windows(read(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


@query("last_user_turn", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_turn(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query(
    "event_coverage_gaps",
    """WITH e AS (SELECT user_id, (epoch_us(ts) // (86400000000 * 30))::BIGINT AS epoch, event_id AS seq FROM events),
    g AS (SELECT *, coalesce(lag(epoch) OVER w <> epoch OR seq > lag(seq) OVER w + 1, false) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch, seq))
    SELECT *, NOT max(gap) OVER (PARTITION BY user_id ORDER BY epoch, seq) AS complete FROM g""",
)
def event_coverage_gaps(spark, d):
    """Epoch: 30-day periods of the clock; sequence: the event's id."""
    e = read(spark, d, "events", "user_id", "ts", "event_id").select("user_id", F.floor(micros("ts") / F.lit(86_400_000_000 * 30)).cast("long").alias("epoch"), F.col("event_id").alias("seq"))
    return ops.coverage_gaps(e, "user_id", "epoch", "seq")
