"""Ordered decision rules as expressions: eligibility, review, labels, transitions, deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Risks under which a label can't be kept.
HARD_RISKS = ("privacy", "third_party", "identity", "control", "abuse")
#: Relationship between risks of a fact's candidates and the decision without a reviewer; the first that holds counts.
DETERMINISTIC = (
    (("unresolved_reference",), "deferred", "temporal_unresolved"),
    (("quoted_or_hypothetical",), "rejected", "quoted_or_hypothetical"),
    (("no_positive_evidence", "mixed_or_non_positive_polarity"), "rejected", "negative_or_uncertain"),
)
REVIEW_STATES = ("keep", "redact_keep", "reject", "uncertain")


def candidate_risks(rows: DataFrame, by: Sequence[str], polarity: str, claim: str, unresolved: Column, basis: str) -> DataFrame:
    """Per candidate: eligible and its sorted risks (an array), from its extraction rows."""
    positive, direct = F.col(polarity) == "positive", F.col(claim).isin("explicit", "relative")
    some = rows.groupBy(*by).agg(
        F.bool_or(positive & direct).alias("__good"), F.bool_or(unresolved).alias("__open"), F.bool_or(positive).alias("__pos"), F.bool_or(direct).alias("__direct"),
        F.bool_or(F.col(polarity).isin("negative", "uncertain")).alias("__mixed"), F.bool_or(F.col(claim).isin("quoted", "hypothetical")).alias("__said"), F.bool_or(F.col(basis) == "unknown").alias("__undated"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    risks = [("mixed_or_non_positive_polarity", yes("__mixed")), ("no_positive_evidence", ~yes("__pos")), ("non_direct_claim", ~yes("__direct")), ("quoted_or_hypothetical", yes("__said")), ("unknown_date_basis", yes("__undated")), ("unresolved_reference", yes("__open"))]
    return some.select(*by, (yes("__good") & ~yes("__open")).alias("eligible"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in risks])).alias("risks"))


def deterministic_decision(candidates: DataFrame, by: str, eligible: str, risks: str) -> DataFrame:
    """``by``, status and reason of each group without an eligible candidate; groups with one are left to the reviewer and don't come back."""
    groups = candidates.groupBy(by).agg(F.bool_or(eligible).alias("__some"), F.array_distinct(F.flatten(F.collect_list(risks))).alias("__risks"))
    has = lambda names: F.arrays_overlap("__risks", F.array(*map(F.lit, names)))
    status = reason = F
    for names, s, r in DETERMINISTIC:
        status, reason = status.when(has(names), F.lit(s)), reason.when(has(names), F.lit(r))
    return groups.where(~F.col("__some")).select(by, status.otherwise("deferred").alias("status"), reason.otherwise("needs_more_context").alias("reason"))


def thresholded_decision(status: Column, reason: Column, confidence: Column, eligible: Column, conflicted: Column, confirm: float, reject: float) -> Column:
    """A struct of status and reason: what is claimed with too little confidence, or for no eligible candidate, is deferred."""
    weak_yes = (status == "confirmed") & ((confidence < confirm) | ~F.coalesce(eligible, F.lit(False)))
    weak_no = (status == "rejected") & (confidence < reject)
    why = F.when(weak_yes & conflicted, F.lit("conflict_unresolved")).when(weak_yes | weak_no, F.lit("needs_more_context")).otherwise(reason)
    return F.struct(F.when(weak_yes | weak_no, F.lit("deferred")).otherwise(status).alias("status"), why.alias("reason"))


def repaired_decision(events: DataFrame, by: str, status: str, selected: str, reason: str, conflicted: str) -> DataFrame:
    """``by``, status, selected and reason where several events of a group have the same revision: what they agree on, else deferred."""
    held = events.groupBy(by).agg(F.collect_set(status).alias("__s"), F.collect_set(F.when(F.col(status) == "confirmed", F.col(selected))).alias("__c"), F.min(reason).alias("__r"), F.bool_or(conflicted).alias("__x"))
    only = lambda s: (F.size("__s") == 1) & F.array_contains("__s", s)
    one = only("confirmed") & (F.size("__c") == 1)
    state = F.when(one, "confirmed").when(only("rejected"), "rejected").otherwise("deferred")
    why = F.when(one, F.lit("evidence_confirmed")).when(only("rejected") | only("deferred"), F.col("__r")).when(F.col("__x"), "conflict_unresolved").otherwise("needs_more_context")
    return held.select(by, state.alias("status"), F.when(one, F.col("__c")[0]).alias("selected"), why.alias("reason"))


def label_decision(status: Column, labels: Column, confidence: Column, risks: Column, least: float, fallback: str = "uncertain") -> Column:
    weak = (confidence < least) | ((status == "keep") & ((F.size(labels) == 0) | F.arrays_overlap(risks, F.array(*map(F.lit, HARD_RISKS)))))
    return F.when(status.isin("keep", "reject") & weak, F.lit(fallback)).otherwise(status)


def review_error(status: Column, reviewer: Column, reason: Column, edited: Column) -> Column:
    """What forbids a review, or null; the first rule that fails."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    return (
        F.when(~F.coalesce(status.isin(*REVIEW_STATES), F.lit(False)), "invalid review status")
        .when(blank(reviewer), "reviewer is required")
        .when((status == "redact_keep") & ~F.coalesce(edited, F.lit(False)), "redact_keep requires edited messages")
        .when((status == "redact_keep") & blank(reason), "redact_keep requires a reason")
        .when((status == "reject") & blank(reason), "reject requires a reason")
    )


def delivery(runs: DataFrame, by: str, role: str, intact: Column, gate_passed: Column, order: str) -> DataFrame:
    """``by``, run and outcome: the last intact champion, else an intact trial at best effort; accepted only with a passed gate on a champion."""
    ranked = runs.withColumn("__rank", F.struct((F.col(role) == "champion").cast("int"), F.col(order)))
    best = ranked.groupBy(by).agg(F.max_by(F.when(intact, F.struct(F.col(order).alias("run"), F.col(role).alias("role"), gate_passed.alias("gate"))), F.when(intact, F.col("__rank"))).alias("b"))
    champion = F.col("b.role") == "champion"
    outcome = F.when(F.col("b").isNull(), "blocked").when(champion & F.coalesce("b.gate", F.lit(False)), "accepted").otherwise("best-effort")
    return best.select(by, F.col("b.run").alias("run"), outcome.alias("outcome"))


def capacity(current: Column, candidate: Column, within_budget: Column, safe: Column, round_trip: Column, least: float = 0.05) -> Column:
    return F.when((candidate - current >= least) & within_budget & safe & round_trip, "adopt").otherwise("stop")


def guarded_reply(output: Column, unsafe: Sequence[str], leaks: Column) -> Column:
    """A struct of text and blocked: outputs with an unsafe marker or a leak, and blank ones, are refused."""
    low = F.lower(output)
    bad = leaks
    for marker in unsafe:
        bad = bad | F.contains(low, F.lit(marker))
    blocked = F.coalesce(bad, F.lit(False)) | F.coalesce(F.trim(output) == "", F.lit(True))
    return F.struct(F.when(blocked, F.lit("refused")).otherwise(F.trim(output)).alias("text"), blocked.alias("blocked"))


def acceptance(rules: DataFrame, metrics: DataFrame, by: str, name: str, value: str, order: str, artifacts: DataFrame, role: str) -> DataFrame:
    """``by``, rule and passed for each rule (rule, kind, subject, op, threshold) and stage of ``artifacts`` or ``metrics``.

    ``metric_threshold`` looks at the metric's last value; ``artifact_exists`` at roles, ``*`` being any.
    """
    stages = metrics.select(by).unionByName(artifacts.select(by)).distinct()
    last = metrics.groupBy(by, F.col(name).alias("subject")).agg(F.max_by(value, order).alias("__last"))
    have = artifacts.groupBy(by, F.col(role).alias("subject")).agg(F.lit(True).alias("__has"))
    have = have.unionByName(artifacts.select(by).distinct().withColumns({"subject": F.lit("*"), "__has": F.lit(True)}))
    asked = stages.join(F.broadcast(rules)).join(last, [by, "subject"], "left").join(have, [by, "subject"], "left")
    reached = F.when(F.col("op") == ">=", F.col("__last") >= F.col("threshold")).otherwise(F.col("__last") <= F.col("threshold"))
    passed = F.when(F.col("kind") == "metric_threshold", F.coalesce(reached, F.lit(False))).otherwise(F.coalesce("__has", F.lit(False)))
    return asked.select(by, "rule", passed.alias("passed"))


def sample_error(id_: Column, messages: Column, metadata: Column, required: Sequence[str], least: int = 2) -> Column:
    """What is wrong with a training sample (messages: array of role, content), or null."""
    return (
        F.when(~F.coalesce(id_.rlike(r"^[A-Za-z0-9._-]+\z"), F.lit(False)), "sample_id")
        .when(F.coalesce(F.size(messages), F.lit(0)) < least, "messages")
        .when(~F.forall(messages, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False))), "role")
        .when(~F.forall(messages, lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False))), "content")
        .when(F.element_at(messages, -1)["role"] != "assistant", "last_message")
        .when(~F.forall(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.map_contains_key(metadata, k), F.lit(False))), "metadata")
    )


def export_violations(rows: DataFrame, id_: str, evidence: Column, split: str, role_ok: Column, hash_ok: Column, leaks: Column, session: str, duplicate: str) -> DataFrame:
    """``id_`` and ``gate`` for each row and gate of an export that it fails.

    Gates in order: id once, evidence named, split known, last role, content hash, no leak, session and duplicate group in one split.
    """
    times = rows.groupBy(F.col(id_).alias("__i")).agg(F.count(F.lit(1)).alias("__times"))
    spread = lambda c, n: rows.groupBy(F.col(c).alias(f"__{n}")).agg(F.countDistinct(split).alias(f"__{n}_splits"))
    every = rows.join(times, F.col(id_) == F.col("__i"), "left").join(spread(session, "s"), F.col(session) == F.col("__s"), "left").join(spread(duplicate, "d"), F.col(duplicate) == F.col("__d"), "left")
    gates = [("duplicate_id", F.col("__times") > 1), ("evidence", ~evidence), ("split", ~F.col(split).isin("train", "validation", "test")), ("role", ~role_ok), ("hash", ~hash_ok), ("leak", leaks), ("session_crossing", F.col("__s_splits") > 1), ("duplicate_crossing", F.col("__d_splits") > 1)]
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in gates]))
    return every.select(id_, F.explode(failed).alias("gate"))
