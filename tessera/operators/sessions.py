"""Sessions, turns and context windows over ordered messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import digest, micros


def gap_sessions(df: DataFrame, owner: str, ts: str, tie: str, gap_minutes: int) -> DataFrame:
    """``df`` plus session_no (from 1 per owner): a new one where more than the gap lies behind the message before."""
    order = Window.partitionBy(owner).orderBy(ts, tie)
    before = F.lag(micros(ts)).over(order)
    new = F.when(before.isNull() | (micros(ts) - before > F.lit(gap_minutes * 60_000_000)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(order)).drop("__new")


def capped_sessions(df: DataFrame, owner: str, ts: str, tie: str, gap_minutes: int = 120, cap_minutes: int = 720) -> DataFrame:
    """Gap sessions that also end where a message lies more than the cap after the session's start.

    The cap depends on where the session began, so messages of one gap session are folded in
    order; gap sessions bound what a fold holds.  Returns owner, tie, session_start (microseconds).
    """
    gap = gap_sessions(df.select(owner, ts, tie), owner, ts, tie, gap_minutes).withColumn("__t", micros(ts))
    ordered = gap.groupBy(owner, "session_no").agg(F.array_sort(F.collect_list(F.struct("__t", F.col(tie).alias("id")))).alias("m"))
    cap = F.lit(cap_minutes * 60_000_000)
    empty = F.struct(F.lit(0).cast("long").alias("start"), F.array().cast("array<struct<start:bigint,id:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.when((F.size(acc["out"]) == 0) | (x["__t"] - acc["start"] > cap), x["__t"]).otherwise(acc["start"])
        return F.struct(start.alias("start"), F.array_append(acc["out"], F.struct(start.alias("start"), x["id"].cast("long").alias("id"))).alias("out"))

    folded = ordered.select(owner, F.aggregate("m", empty, step)["out"].alias("out"))
    return folded.select(owner, F.inline("out").alias("session_start", tie))


def session_summary(df: DataFrame, owner: str, ts: str, tie: str, member: str, value: str) -> DataFrame:
    """One row per session of ``gap_sessions``: size, bounds, sorted members, the id of its ordered message ids."""
    grouped = df.groupBy(owner, "session_no").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(micros(ts)).alias("start_us"),
        F.max(micros(ts)).alias("end_us"),
        F.array_join(F.array_sort(F.collect_set(member)), ",").alias("participants"),
        F.round(F.sum(value), 4).alias("total_value"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ts, tie))), lambda x: x[tie].cast("string")), ",").alias("__ids"),
    )
    return grouped.withColumn("session_id", F.concat(F.lit("session_"), F.substring(digest("__ids"), 1, 16))).drop("__ids")


def merge_turns(df: DataFrame, owner: Sequence[str], order: Sequence[str], role: str, text: str, joins: Column | None = None) -> DataFrame:
    """Runs of one role become a turn: owner, turn_no, role, n_messages and texts joined by newlines.

    ``joins`` may forbid a merge by what the incoming message is (kind, time since the one before).
    """
    w = Window.partitionBy(*owner).orderBy(*order)
    same = F.lag(role).over(w).eqNullSafe(F.col(role)) & (F.lag(F.lit(1)).over(w) == 1)
    same = same & joins if joins is not None else same
    numbered = df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("turn_no", F.sum("__new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__text"))))
    return numbered.groupBy(*owner, "turn_no").agg(F.first(role).alias(role), F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(ordered, lambda x: x["__text"]), "\n").alias("text"))


def context_windows(df: DataFrame, owner: str, order: str, role: str, text: str, last: int = 8, reply: str = "assistant", roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """Each reply with the ``last`` eligible messages before it: owner, order, n_context, context."""
    kept = df.where(F.col(role).isin(*roles) & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    w = Window.partitionBy(owner).orderBy(order).rowsBetween(-last, -1)
    line = F.concat_ws(": ", role, text)
    out = kept.withColumn("__context", F.collect_list(line).over(w)).where(F.col(role) == reply)
    return out.select(owner, order, F.size("__context").alias("n_context"), F.array_join("__context", "\n").alias("context"), F.col(text).alias("reply"))


def coverage_gaps(df: DataFrame, owner: str, epoch: str, seq: str) -> DataFrame:
    """``df`` plus gap: the epoch changed or the sequence jumped; and complete, whether no gap came up to here."""
    w = Window.partitionBy(owner).orderBy(epoch, seq)
    gap = (F.lag(epoch).over(w) != F.col(epoch)) | (F.col(seq) > F.lag(seq).over(w) + 1)
    flagged = df.withColumn("gap", F.coalesce(gap, F.lit(False)))
    return flagged.withColumn("complete", ~F.max("gap").over(w))
