"""Facts, reviews, lineage, gates, ranking and event projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.splits import positioned

from tessera.operators.dedup import keep_first


def ledger(df: DataFrame, key: str, value: str, ref: str, positive: str, direct: str, unresolved: str) -> DataFrame:
    """Per key: values with their support, and status none, conflicted or insufficient.

    A value is reliable if its set of rows has a positive one, a direct one, and none unresolved.
    One reliable value: none; several: conflicted; no reliable one: insufficient.
    """
    values = df.groupBy(key, value).agg(
        F.countDistinct(ref).alias("support"),
        (F.bool_or(positive) & F.bool_or(direct) & ~F.bool_or(unresolved)).alias("reliable"),
    )
    out = values.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.count_if("reliable").alias("n_reliable"), F.max("support").alias("best_support"))
    status = F.when(F.col("n_reliable") == 0, "insufficient").when(F.col("n_reliable") == 1, "none").otherwise("conflicted")
    return out.withColumn("conflict_status", status)


def row_eligible(positive: Column, direct: Column) -> Column:
    """Review's own rule: one and the same row is positive and direct."""
    return F.bool_or(positive & direct)


def keep_best(df: DataFrame, keys: Sequence[str], confidence: str, ordinal: str) -> DataFrame:
    """The row of highest confidence of each key; of equals the first."""
    return keep_first(df, keys, [F.col(confidence).desc(), F.col(ordinal).asc()])


def latest_review(df: DataFrame, group: str, revision: str, body: str) -> DataFrame:
    """Per group the highest revision, one of its bodies, and whether bodies of that revision differ."""
    top = df.groupBy(group).agg(F.max(revision).alias(revision))
    return df.join(top, [group, revision]).groupBy(group, revision).agg(F.min(body).alias(body), (F.countDistinct(body) > 1).alias("conflict"))


def status_counts(groups: DataFrame, decisions: DataFrame, key: str, status: str) -> DataFrame:
    """Groups by status; those without a decision are pending."""
    return groups.select(key).distinct().join(decisions.select(key, status), key, "left").groupBy(F.coalesce(status, F.lit("pending")).alias(status)).agg(F.count(F.lit(1)).alias("n"))


def deletion_closure(lineage: DataFrame, sources: DataFrame, obj: str, path: str, source: str) -> DataFrame:
    """Objects that name a deleted source (``lineage`` holds an array of them), and all objects on such a path."""
    hit = lineage.select(obj, path, F.explode(source).alias(source)).join(sources, source, "left_semi").select(obj, path).distinct()
    by_path = lineage.join(hit.select(path).distinct(), path, "left_semi").select(obj)
    return by_path.unionByName(hit.select(obj)).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (added, deleted, modified) of what differs."""
    a, b = old.select(key, F.col(digest).alias("__a")), new.select(key, F.col(digest).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def gate_results(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """gate rows (name, key, op, threshold, required) against metrics (run_id, key, value): run_id, name, status."""
    runs = metrics.select("run_id").distinct()
    every = runs.crossJoin(F.broadcast(gates.hint("broadcast")))  # gates are a configuration: a few rows
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    ok = F.when(op == "exists", v.isNotNull()).when(op == "eq", v == t).when(op == "neq", v != t).when(op == "gt", v > t).when(op == "gte", v >= t).when(op == "lt", v < t).when(op == "lte", v <= t)
    status = F.when(v.isNull() & ~F.col("required"), "skipped").when(v.isNull() | ~F.coalesce(ok, F.lit(False)), "failed").otherwise("passed")
    return every.join(metrics, ["run_id", "key"], "left").select("run_id", "name", status.alias("status"))


def ranked_runs(runs: DataFrame, metric: str, identity: Sequence[str], run: str = "run_id", descending: bool = True) -> DataFrame:
    """run, reasons (identity fields that differ from the first run's, missing metric), and rank of the others."""
    first = runs.groupBy().agg(F.min_by(F.struct(*identity), run).alias("__ref"))
    d = runs.crossJoin(F.broadcast(first))  # one row
    reasons = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__ref.{c}")), F.lit(c)) for c in identity], F.when(F.col(metric).isNull(), F.lit("missing_metric"))))
    d = d.withColumn("reasons", F.array_join(reasons, ",")).withColumn("ok", F.col("reasons") == "")
    order = F.col(metric).desc() if descending else F.col(metric).asc()
    kept = positioned(d.where("ok").select(run, metric, "reasons"), [order, F.col(run)])
    return kept.select(run, metric, "reasons", (F.col("__position") + 1).cast("int").alias("rank")).unionByName(d.where("NOT ok").select(run, metric, "reasons", F.lit(None).cast("int").alias("rank")))


def inbox(df: DataFrame, keys: Sequence[str], digest: str, order: str) -> DataFrame:
    """First message of each key, how often it came again, and whether it came with another digest."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_seq"), (F.count(F.lit(1)) - 1).alias("repeats"), (F.countDistinct(digest) > 1).alias("conflict"))


def projection(df: DataFrame, key: str, revision: str, seq: str, content: str) -> DataFrame:
    """The content of the highest revision (of equals the first), at the place of the first event."""
    return df.groupBy(key).agg(F.min(seq).alias("position"), F.max(revision).alias(revision), F.max_by(content, F.struct(F.col(revision), -F.col(seq))).alias(content))


def ready_stages(stages: DataFrame, stage: str, depends: str, status: str) -> DataFrame:
    """Pending stages whose dependencies are all completed or skipped."""
    waiting = stages.where(F.col(status) == "pending").select(stage, F.explode_outer(depends).alias("__on"))
    state = stages.select(F.col(stage).alias("__on"), F.col(status).alias("__s"))
    joined = waiting.join(state, "__on", "left")
    done = F.col("__on").isNull() | F.coalesce(F.col("__s").isin("completed", "skipped"), F.lit(False))
    return joined.groupBy(stage).agg(F.bool_and(done).alias("ready")).where("ready").select(stage)


def keyset_page(df: DataFrame, seq: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows plus one that tells whether there are more."""
    return df.where(F.col(seq) > after).orderBy(seq).limit(size + 1)


def searched_page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page of a filtered result with total and has_more."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(offset).limit(size)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


def first_failing(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first check that holds; null if none: a reason to exclude, in order."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def delete_receipts(rows: DataFrame, gone: DataFrame, owner: str, key: str) -> DataFrame:
    """owner, before, after, deleted, residual, digest_before and digest_after: what a deletion of the ids ``gone`` does to each owner's rows.

    Digests are over the sorted digests of ids, so that a receipt can be checked against the rows that are left.
    """
    marked = rows.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left").withColumn("__h", F.sha2(F.col(key).cast("string").cast("binary"), 256))
    kept = F.col("__gone").isNull()
    over = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    out = marked.groupBy(owner).agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.count("__gone").alias("deleted"), over("__h").alias("digest_before"), over(F.when(kept, F.col("__h"))).alias("digest_after"))
    return out.withColumn("residual", F.col("before") - F.col("after") - F.col("deleted"))


def lineage(**objects: tuple[DataFrame, str, str]) -> DataFrame:
    """kind, object_id and sources (distinct, in order) of each object of tables (rows, object, source)."""
    out = None
    for kind, (df, object_, source) in objects.items():
        rows = df.groupBy(F.col(object_).cast("string").alias("object_id")).agg(F.array_sort(F.collect_set(F.col(source).cast("long"))).alias("sources")).select(F.lit(kind).alias("kind"), "object_id", "sources")
        out = rows if out is None else out.unionByName(rows)
    return out


#: States of an external operation that it doesn't leave any more.
TERMINAL = ("succeeded", "failed", "cancelled")


def observed(messages: Sequence[tuple[object, str]], most: int = 100) -> dict:
    """The state of an external operation after its messages (id, status), in order.

    A message id that comes again with the same status is a repeat, with another one a conflict; a status that is told again by a new message changes nothing;
    a terminal state stays unless another terminal one comes.  ``kept`` are the last ``most`` observations that counted.
    """
    seen: dict[object, str] = {}
    last, status, kept, repeats, conflicts = None, "accepted", [], 0, 0
    for message, told in messages:
        if message in seen:
            repeats, conflicts = repeats + (seen[message] == told), conflicts + (seen[message] != told)
            continue
        if told == last:
            continue
        seen[message] = last = told
        if status in TERMINAL and told not in TERMINAL:
            continue
        status = told
        kept = [*kept, told][-most:]
    return {"status": status, "kept": kept, "repeats": repeats, "conflicts": conflicts}
