"""Joins that have to come out even: coverage both ways, set equality, causality, neighbours in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def bijection(left: DataFrame, right: DataFrame, key: str, equal: Sequence[str] = ()) -> DataFrame:
    """``key`` and ``state`` for every id of either side.

    ``missing``: not on the right, ``extra``: not on the left, ``repeated``: more than once on a side, ``differs_<column>``: the first
    of the columns ``equal`` that differs, else ``ok``.  One full outer join of pre-aggregated sides.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"__{tag}")).agg(F.count(F.lit(1)).alias(f"__n_{tag}"), *[F.min(c).alias(f"__{tag}_{c}") for c in equal])

    both = side(left, "l").join(side(right, "r"), _same("__l", "__r"), "full_outer")
    state = F.when(F.col("__n_r").isNull(), "missing").when(F.col("__n_l").isNull(), "extra").when((F.col("__n_l") > 1) | (F.col("__n_r") > 1), "repeated")
    for c in equal:
        state = state.when(~_same(f"__l_{c}", f"__r_{c}"), f"differs_{c}")
    return both.select(F.coalesce("__l", "__r").alias(key), state.otherwise("ok").alias("state"))


def resolve_once(rows: DataFrame, refs: str, targets: DataFrame, target_key: str, id_: str) -> DataFrame:
    """``id_``, n_refs, n_unresolved and n_ambiguous: references that name no target, or several."""
    known = targets.groupBy(F.col(target_key).alias("__ref")).agg(F.count(F.lit(1)).alias("__times"))
    each = rows.select(id_, F.explode(F.array_distinct(refs)).alias("__ref")).join(known, "__ref", "left")
    counted = each.groupBy(id_).agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("__times").isNull()).alias("n_unresolved"), F.count_if(F.col("__times") > 1).alias("n_ambiguous"))
    return counted


def same_sets(rows: DataFrame, lineage: DataFrame, key: str, ids: str, target: str, context: str) -> DataFrame:
    """``key``, ``equal`` (the row names just the ids of its lineage, as a set) and ``disjoint`` (target and context share none)."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    joined = rows.select(key, F.col(ids).alias("__ids")).join(lineage.select(key, F.col(target).alias("__t"), F.col(context).alias("__c")), key, "left")
    nothing = F.array().cast(rows.schema[ids].dataType)
    both = F.concat(F.coalesce("__t", nothing), F.coalesce("__c", nothing))
    return joined.select(key, (as_set(F.coalesce("__ids", nothing)) == as_set(both)).alias("equal"), (~F.arrays_overlap(F.coalesce("__t", nothing), F.coalesce("__c", nothing))).alias("disjoint"))


def with_split(rows: DataFrame, splits: DataFrame, key: str, split: str = "split", default: str = "unknown") -> DataFrame:
    """``rows`` plus the split of their key; ``splits`` has one row a key."""
    return rows.join(splits.select(F.col(key).alias("__k"), F.col(split).alias("__s")), _same(key, "__k"), "left").withColumn(split, F.coalesce("__s", F.lit(default))).drop("__k", "__s")


def exposure(rows: DataFrame, ids: str, universe: DataFrame, id_: str, split: str) -> DataFrame:
    """Per split of ``universe``: distinct messages, how many of them rows name, and how often; names without a message count as ``unknown``."""
    named = rows.select(F.explode(ids).alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("__times"))
    known = universe.groupBy(F.col(id_).alias("__u")).agg(F.min(split).alias("__split"))
    both = known.join(named, _same("__u", "__id"), "full_outer")
    split_ = F.when(F.col("__u").isNull(), "unknown").otherwise(F.col("__split")).alias(split)
    return both.groupBy(split_).agg(F.count("__u").alias("messages"), F.count("__id").alias("exposed"), F.coalesce(F.sum("__times"), F.lit(0)).alias("times"))


def reply_state(rows: DataFrame, id_: str, reply_to: str, split: str, session: str, order: str) -> DataFrame:
    """``id_`` and ``state`` of each reply: its message has to exist, in the same split and session, and to come earlier."""
    past = rows.select(F.col(id_).alias("__p"), F.col(split).alias("__ps"), F.col(session).alias("__pn"), F.col(order).alias("__po"))
    replies = rows.where(F.col(reply_to).isNotNull()).join(past, F.col(reply_to) == F.col("__p"), "left")
    state = F.when(F.col("__p").isNull(), "missing").when(~_same("__ps", split), "other_split").when(~_same("__pn", session), "other_session").when(F.col("__po") >= F.col(order), "not_earlier")
    return replies.select(id_, state.otherwise("ok").alias("state"))


def reply_links(rows: DataFrame, id_: str, refs: str, prefix: str, context: str, before: str) -> DataFrame:
    """``id_``, ``linked`` and ``basis``: explicit references if prefix and context hold them all, else the message before."""
    explicit = (F.size(refs) > 0) & (F.size(F.array_except(refs, prefix)) == 0) & (F.size(F.array_except(refs, context)) == 0)
    adjacent = F.when(F.col(before).isNotNull(), F.array(before)).otherwise(F.array().cast(rows.schema[refs].dataType))
    basis = F.when(explicit, "explicit").when(F.col(before).isNotNull(), "adjacent").otherwise("none")
    return rows.select(id_, F.when(explicit, F.array_sort(F.array_distinct(refs))).otherwise(adjacent).alias("linked"), basis.alias("basis"))


def neighbour_days(chunks: DataFrame, turns: DataFrame, day: str, id_: str, order: Sequence[str], days: int, per_day: int, marked: Column, group: Sequence[str] = ()) -> DataFrame:
    """Turns of the ``days`` days around each marked chunk, its own day left out: the last ``per_day`` of days before, the first of days after.

    The range is spelled out as the days it holds, so that the join is by equality.
    """
    by = [*group, day]
    first = Window.partitionBy(*by).orderBy(*[F.col(c).asc() for c in order])
    last = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    ranked = turns.withColumns({"__first": F.row_number().over(first), "__last": F.row_number().over(last)}).where((F.col("__first") <= per_day) | (F.col("__last") <= per_day))
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-days, days + 1) if k]))
    wanted = chunks.where(marked).select(*group, F.col(id_).alias("chunk"), F.col(day).alias("__anchor"), offsets.alias("offset"))
    wanted = wanted.withColumn(day, F.date_add("__anchor", F.col("offset"))).drop("__anchor")
    near = wanted.join(ranked, by)
    return near.where(F.when(F.col("offset") < 0, F.col("__last")).otherwise(F.col("__first")) <= per_day).drop("__first", "__last")


def quotes_held(quotes: DataFrame, evidence: DataFrame, quote: str, ref: str, id_: str, text: str, primary: str, longest: int = 240) -> DataFrame:
    """``id_`` of each quote row's claim, with ``n_quotes``, ``n_held`` (an exact part of the text it refers to, of allowed length) and ``any_primary``."""
    joined = quotes.join(evidence.select(F.col(ref).alias("__ref"), F.col(text).alias("__text"), F.col(primary).alias("__primary")), F.col(ref) == F.col("__ref"), "left")
    held = F.coalesce(F.contains("__text", quote) & (F.length(quote) <= longest) & (F.length(quote) > 0), F.lit(False))
    return joined.groupBy(id_).agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(held).alias("n_held"), F.coalesce(F.bool_or(held & F.col("__primary")), F.lit(False)).alias("any_primary"))


def frozen_match(frozen: DataFrame, population: DataFrame, key: str, order: str) -> DataFrame:
    """The frozen targets in their order, with ``found``: whether the population still has just one of each."""
    now = population.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__times"))
    return frozen.join(now, _same(key, "__k"), "left").select(order, key, (F.coalesce("__times", F.lit(0)) == 1).alias("found"))


def last_wins(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """One row a key: that of the last layer which has it.  Layers have the same columns; within a layer keys are unique."""
    tagged = [df.select(F.lit(i).alias("__layer"), F.struct("*").alias("__row")) for i, df in enumerate(layers)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    return every.groupBy(F.col(f"__row.{key}").alias("__key")).agg(F.max_by("__row", "__layer").alias("__row")).select("__row.*")


def layers(**named: DataFrame) -> DataFrame:
    """The union of reports, each row with the name of its layer."""
    out = None
    for name, df in named.items():
        df = df.withColumn("layer", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
