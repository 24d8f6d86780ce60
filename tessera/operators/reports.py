"""Reports: one grouped aggregate each, with rates that are 0 where there is nothing to divide by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import share


def max_merged(views: Sequence[dict[str, Column]], total: str = "hard_leak_count") -> dict[str, Column]:
    """Counters of equivalent views: the greatest of each, and their sum."""
    names = list(dict.fromkeys(n for v in views for n in v))
    merged = {n: F.greatest(*[F.coalesce(v[n], F.lit(0)) for v in views if n in v], F.lit(0)) for n in names}
    return merged | {total: sum(merged.values(), F.lit(0))}


def day_bundles(df: DataFrame, ts: str, owner: str, id_: str) -> DataFrame:
    """day and sessions: array of (owner, turns in order); a session that passes midnight is in both days."""
    sessions = df.groupBy(F.to_date(ts).alias("day"), F.col(owner).alias("owner")).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id")))).alias("turns"))
    return sessions.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("owner", "turns"))).alias("sessions"))


def variant_matrix(df: DataFrame, variant: str, non_empty: Column, latency: str) -> DataFrame:
    return df.groupBy(variant).agg(F.count(F.lit(1)).alias("record_count"), share(F.count_if(non_empty), F.count(F.lit(1))).alias("non_empty_rate"), F.round(F.avg(latency), 6).alias("latency_mean"))


def automatic_metrics(df: DataFrame, by: str, output: str, loss: str) -> DataFrame:
    text = F.coalesce(output, F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.round(F.avg(words), 9).alias("generated_length_mean"),
        F.round(F.coalesce(F.avg(loss), F.lit(0.0)), 9).alias("validation_loss"),
        share(F.count_if(text != ""), F.count(F.lit(1))).alias("format_follow_rate"),
    )


def memory_metrics(df: DataFrame) -> DataFrame:
    """From supported, claim, should_refuse, refused, conflict, latest and leak; ``passed`` asks for no leak and no unsupported claim."""
    c = {n: F.col(n) for n in df.columns}
    rate = lambda part, whole: F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1))
    open_ = ~c["supported"]
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        rate(c["supported"], F.lit(True)).alias("evidence_support_rate"),
        rate(open_ & c["claim"], open_).alias("unsupported_claim_rate"),
        rate(open_ & c["should_refuse"] & c["refused"], open_ & c["should_refuse"]).alias("unsupported_refusal_rate"),
        rate(c["conflict"] & c["latest"], c["conflict"]).alias("latest_conflict_accuracy"),
        rate(c["leak"], F.lit(True)).alias("leak_rate"),
        ((F.count_if(c["leak"]) == 0) & (F.count_if(open_ & c["claim"]) == 0)).alias("passed"),
    )


def counters(df: DataFrame, by: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """case_count and how many rows each rule holds for."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("case_count"), *[F.count_if(c).alias(n) for n, c in rules.items()])


def latency_summary(df: DataFrame, by: str, ok: Column, value: str) -> DataFrame:
    """Over the rows that are ok: mean, median and most; samples counts all."""
    kept = F.when(ok, F.col(value))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("ok"), F.round(F.avg(kept), 6).alias("mean"), F.round(F.median(kept), 6).alias("p50"), F.round(F.max(kept), 6).alias("most"))


def budget_reserve(df: DataFrame, by: str, slot: str, used: str, cost: str, protected: Sequence[str], budget: float) -> DataFrame:
    """``by``, reserved (cost of what is used), held (the dearest choice of each protected slot that isn't used yet) and whether both fit."""
    slots = df.where(F.col(slot).isin(*protected)).groupBy(by, slot).agg(F.max(cost).alias("__c"), F.bool_or(used).alias("__u")).where(~F.col("__u")).groupBy(by).agg(F.sum("__c").alias("held"))
    every = df.groupBy(by).agg(F.sum(F.when(F.col(used), F.col(cost))).alias("reserved")).join(slots, by, "left")
    reserved, held = F.coalesce("reserved", F.lit(0.0)), F.coalesce("held", F.lit(0.0))
    return every.select(by, F.round(reserved, 2).alias("reserved"), F.round(held, 2).alias("held"), (reserved + held <= budget).alias("fits"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Reports of one row each, side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def quality_score(f1: Column, rouge: Column, exact: Column, follows: Column, repeats: Column, cut: Column) -> Column:
    """Weighted overlap, less for repetition and for outputs that were cut off; 0 to 100."""
    overlap = 0.45 * f1 + 0.35 * rouge + 0.10 * exact + 0.10 * follows
    return 100.0 * overlap * (1.0 - 0.25 * repeats) * (1.0 - 0.10 * cut)


def generation_report(df: DataFrame, output: Column, reference: Column, tokens: Column, most_tokens: int, f1: Column | None = None, rouge: Column | None = None) -> DataFrame:
    """Lengths, exact matches, repetition and the auxiliary score over all outputs."""
    rows = df.select(output.alias("__a"), reference.alias("__b"), tokens.alias("__t"), (f1 if f1 is not None else F.lit(0.0)).alias("__f"), (rouge if rouge is not None else F.lit(0.0)).alias("__l"))
    tri = F.transform(F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("__t", i + 1), F.get("__t", i + 2)))
    rows = rows.withColumns({"__n": F.size("__t"), "__rep": F.size(F.array_distinct(tri)) < F.size(tri)})
    rate = lambda c: share(F.count_if(c), F.count(F.lit(1)))
    same, follows, rep, cut = rate(F.col("__a") == F.col("__b")), rate(F.col("__a") != ""), rate(F.col("__rep")), rate(F.col("__n") >= most_tokens)
    return rows.agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("__n"), 9).alias("tokens_mean"), F.round(F.percentile("__n", F.lit(0.5)), 6).alias("tokens_p50"), F.round(F.percentile("__n", F.lit(0.95)), 6).alias("tokens_p95"),
        F.round(same, 9).alias("exact_match_rate"), F.round(follows, 9).alias("format_follow_rate"), F.round(rep, 9).alias("repetition_rate"), F.round(cut, 9).alias("max_length_stop_rate"),
        F.round(quality_score(F.avg("__f"), F.avg("__l"), same, follows, rep, cut), 6).alias("score"),
    )


def example_loss(df: DataFrame, by: str, loss: str, counted: Column) -> DataFrame:
    """Mean loss of the tokens that count; null without one."""
    return df.groupBy(by).agg((F.sum(F.when(counted, F.col(loss))) / F.nullif(F.count_if(counted), F.lit(0))).alias("loss"))


def containment_counts(docs: DataFrame, text: str, key: str, items: DataFrame, item: str, quote: str, words: int = 3) -> DataFrame:
    """``item`` and n, the documents that hold its quote as an exact part.

    Documents and quotes meet on runs of ``words`` whole words, the second to the next ones of the quote, which stand in every text that holds it; the
    containment is tested only there.  Quotes of fewer than words + 2 words are compared with every text, in one broadcast join, and have to be few.
    """
    split = lambda c: F.split(c, r"\s+")
    w = split(F.col(quote))
    full = items.withColumn("__w", w).withColumn("__run", F.when(F.size("__w") >= words + 2, F.concat_ws(" ", F.slice("__w", 2, words))))
    runs = F.array_distinct(F.transform(F.slice("__d", F.lit(1), F.greatest(F.size("__d") - (words - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get("__d", i + k) for k in range(1, words)])))
    placed = docs.select(key, text, split(F.col(text)).alias("__d")).select(key, text, F.explode(runs).alias("__run"))
    # the items' runs are small; texts are joined back by key only where a run is met
    met = placed.select(key, "__run").join(full.where("__run IS NOT NULL").select(item, quote, "__run"), "__run").select(key, item, quote)
    long_hits = docs.select(key, text).join(met, key).where(F.contains(F.col(text), F.col(quote))).select(item, key)
    short = full.where("__run IS NULL").select(item, quote)
    short_hits = docs.select(key, text).join(F.broadcast(short), F.contains(F.col(text), F.col(quote))).select(item, key)
    hits = long_hits.unionByName(short_hits).groupBy(item).agg(F.countDistinct(key).alias("n"))
    return items.select(item).join(hits, item, "left").select(item, F.coalesce("n", F.lit(0)).alias("n"))
