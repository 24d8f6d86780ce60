"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and every document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the rate's fraction, where rate = target / words of its source.

A document's draw is a hash of the seed and its id (of its text, where the id is null), and hangs on no
other document.  What a source takes then has standard deviation sqrt(p * (1 - p) * sum of its squared sizes), which is
next to nothing for many documents but not for a few long ones.  So the draw is made with ``SEEDS`` seeds, and each source
uses the one whose total comes nearest to its target: totals per source and seed are all that is
aggregated for it.  The distance left is typically a tenth of the standard deviation, and never above the least of ``SEEDS`` draws.

Texts are read to count words and once more to be emitted; they are never shuffled.  Sources are joined by
broadcast if their number has been counted and is ``FEW`` at most, otherwise by a join that Spark plans by size.  Draws depend
on seed, id and totals alone: reruns agree, on any number of executors.

Defined results: null and empty texts have size 0; a null source is a source of
its own, last in the order; sources without words have target 0 and are taken 0
times; repeated rows of one id are drawn alike (rows without id: if their texts are equal); extra columns of any
name are carried along; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, discard, stored, table

SEED = 17
#: Draws of which each source uses one.
SEEDS = 16
#: Sources that are broadcast, at most: about 100 bytes each.
FEW = 50_000


def multiplier(k: int) -> int:
    """The odd factor that makes the k-th draw of a document's hash."""
    return (2654435761 * (2 * k + 1)) % (1 << 31) | 1


def hashed(key: Column, text: Column, seed: int) -> Column:
    """32 bits of an md5 of the seed and the row's id; of its text, where the id is null."""
    known = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), known).cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(hash_: Column, factor: Column) -> Column:
    """A number in [0, 1)."""
    return ((hash_ * factor) % F.lit(1 << 32)).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: its words, weight and target.

    Weights repeat over the sources in code point order, null last.  A target stops at
    ``most`` times its source's words and the excess is shared out again by weight until
    none is above: the level L with sum(min(most * words, L * weight)) = share * all words,
    found by one pass over the sources in the order of words / weight, in which they stop.
    """
    per_source = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("source_size"))
    n = len(weights)
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    weighted = per_source.withColumn("__weight", F.array(*map(F.lit, weights))[((F.row_number().over(order) - 1) % n).cast("int")].cast("long"))
    everywhere = Window.partitionBy()
    stops = Window.orderBy((F.col("source_size") / F.col("__weight")).asc(), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = weighted.select(
        "*",
        F.sum("source_size").over(everywhere).alias("__all"),
        F.sum("__weight").over(everywhere).alias("__weights"),
        F.coalesce(F.sum("source_size").over(stops), F.lit(0)).alias("__before"),
        F.coalesce(F.sum("__weight").over(stops), F.lit(0)).alias("__weights_before"),
    )
    # The level if just the sources before this one stop; the true one is the first at which this one stays below its stop.
    level = (F.lit(float(share)) * F.col("__all") - F.lit(float(most)) * F.col("__before")) / (F.col("__weights") - F.col("__weights_before"))
    leveled = sums.withColumn("__level", level).withColumn("__stays", F.col("__level") * F.col("__weight") <= F.lit(float(most)) * F.col("source_size"))
    settled = leveled.withColumn("__final", F.min(F.when(F.col("__stays"), F.struct("__before", "__weights_before", "__level"))).over(everywhere)["__level"])
    capped = F.lit(float(most)) * F.col("source_size")
    target = F.when(F.col("__final").isNull(), capped).otherwise(F.least(capped, F.col("__final") * F.col("__weight")))
    return settled.select("__source", F.col("source_size"), F.col("__weight").alias("weight"), target.alias("target"))


def joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (column __of) with the columns of their source; ``sources`` is broadcast only if it is known to be small."""
    few = sources.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(sources) if few else sources, F.col("__of").eqNullSafe(F.col("__source")))


def plan(counted: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source from rows (__of, __size, __hash): __source, source_size, target, __floor and __p of its rate, and __factor, its draw."""
    found = source_targets(counted, "__of", "__size", weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stored(found.withColumn("__rate", rate).select("__source", "source_size", "target", F.floor("__rate").alias("__floor"), (F.col("__rate") - F.floor("__rate")).alias("__p")))
    factors = F.array(*[F.lit(multiplier(k)).cast("long") for k in range(SEEDS)])
    tried = joined(counted, targets).select("__source", "__size", "__hash", "__p", F.posexplode(factors).alias("k", "__factor"))
    taken = tried.groupBy("__source", "k", "__factor").agg(F.sum(F.when(drawn(F.col("__hash"), F.col("__factor")) < F.col("__p"), F.col("__size")).otherwise(F.lit(0))).alias("extra"))
    off = F.abs((F.col("__floor") * F.col("source_size") + F.col("extra")).cast("double") - F.col("target"))
    best = taken.withColumnRenamed("__source", "__s").join(targets, F.col("__s").eqNullSafe(F.col("__source"))).groupBy("__source").agg(F.min(F.struct(off.alias("off"), "k", "__factor")).alias("b"))
    chosen = best.select(F.col("__source").alias("__s"), F.col("b.__factor").alias("__factor"))
    out = stored(targets.join(chosen, F.col("__s").eqNullSafe(F.col("__source"))).drop("__s"))
    discard(targets)
    return out


def copies() -> Column:
    return F.col("__floor") + F.when(drawn(F.col("__hash"), F.col("__factor")) < F.col("__p"), F.lit(1)).otherwise(F.lit(0))


def word_count(text: str) -> Column:
    """Words of a text; 0 for null."""
    cut = F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(cut == "", F.lit(0)).otherwise(F.size(F.split(cut, r"[ \t-\r]+"))).cast("long")


def counted_rows(df: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    """__id, __of (its source), __size and __hash of each row, written once so that texts aren't read again."""
    columns = {c: F.col(f"`{c}`") for c in (text, source, key)}
    return stored(df.select(columns[key].alias("__id"), columns[source].alias("__of"), word_count(text).alias("__size"), hashed(columns[key], columns[text], seed).alias("__hash")))


def amounts(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """``key``, size, source_size, target (its source's) and taken (words the mix takes, repeats counted) of each row."""
    counted = counted_rows(df, text, source, key, seed)
    out = joined(counted, plan(counted.drop("__id"), weights, share, most))
    return out.select(F.col("__id").alias(key), F.col("__size").alias("size"), "source_size", "target", (copies() * F.col("__size")).alias("taken"))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mixed rows themselves: each row of ``df`` as often as it is taken, with its own columns."""
    sources = plan(counted_rows(df, text, source, key, seed).drop("__id"), weights, share, most)
    of, id_, said = (F.col(f"`{c}`") for c in (source, key, text))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), of.alias("__of"), hashed(id_, said, seed).alias("__hash"))
    taken = joined(rows, sources).where(copies() > 0)
    return taken.select("__row", F.explode(F.sequence(F.lit(1), copies().cast("int")))).select(*[F.col("__row")[c].alias(c) for c in df.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all ``documents``: sources weigh 5, 2, 1, repeating, and share 150 % of all sizes."""
    return amounts(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 8))::BIGINT AS hash
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per_source),
sums AS (
  SELECT *, sum(source_size) OVER () AS every, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER stops, 0) AS before, coalesce(sum(weight) OVER stops, 0) AS weights_before
  FROM weighted
  WINDOW stops AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, (1.5::DOUBLE * every::DOUBLE - 2.0::DOUBLE * before::DOUBLE) / (weights - weights_before)::DOUBLE AS level FROM sums),
final AS (SELECT arg_min(level, weights_before) AS level FROM leveled WHERE level * weight <= 2.0::DOUBLE * source_size::DOUBLE),
targets AS (
  SELECT source, source_size,
    CASE WHEN f.level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size::DOUBLE, f.level * weight::DOUBLE) END AS target
  FROM leveled, final f),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM targets),
draws AS (SELECT unnest(range(0, {SEEDS})) AS k, unnest([{", ".join(str(multiplier(k)) for k in range(SEEDS))}])::BIGINT AS factor),
tried AS (
  SELECT r.source, k, factor, sum(CASE WHEN ((hash * factor) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN size ELSE 0 END)::BIGINT AS extra
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, draws
  GROUP BY ALL),
best AS (
  SELECT r.source, arg_min(factor, {{'off': abs((floor(rate)::BIGINT * source_size + extra)::DOUBLE - target), 'k': k}}) AS factor
  FROM tried t JOIN rates r ON t.source IS NOT DISTINCT FROM r.source
  GROUP BY r.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN ((hash * factor) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""
