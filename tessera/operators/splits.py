"""Splits and the gates that hold them apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.operators.materialize import cut


def hash_unit(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the key and a seed."""
    text = F.concat(F.lit(f"{seed}:"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_by_rank(rank: Column, n: Column, train: float, validation: float) -> Column:
    """train, validation or test by 0-based rank: floor of the share for the first two."""
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(validation))
    return F.when(rank < a, "train").when(rank < a + b, "validation").otherwise("test")


def positioned(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` plus __position (from 0) in the order and __all, the number of rows.

    A range-partitioned sort is written once, each row with its number inside its range; rows before each range are counted
    from that table.  So no task orders all rows.  The order has to tell rows apart.
    """
    numbered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    # by its definition, the upper bits name the partition and the lower 33 the row in it
    rows = numbered.withColumns({"__p": F.shiftright("__m", 33), "__r": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m")
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    placed = rows.join(F.broadcast(before), "__p")  # a row for each partition of the sort
    return placed.withColumn("__position", F.col("__before") + F.col("__r")).drop("__p", "__r", "__before")


def chronological_split(df: DataFrame, order: Sequence[str], train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """The order columns plus split by position in the order; order columns have to tell rows apart."""
    return positioned(df.select(*order), order).withColumn("split", split_by_rank(F.col("__position"), F.col("__all"), train, validation)).select(*order, "split")


def group_split(df: DataFrame, group: str, train: float, validation: float, seed: int = 42) -> DataFrame:
    """``df`` plus split, the same for all rows of a group, by hash: no shuffle, and stable when rows are added."""
    u = hash_unit(group, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def quantile_strata(df: DataFrame, value: str, tie: str, bins: int) -> DataFrame:
    """``df`` plus stratum: equal-frequency bins of the rank, at most max(2, n // 20) of them."""
    n, r = F.col("__all"), F.col("__position")
    q = F.least(F.lit(bins), F.greatest(F.lit(2), F.floor(n / 20))).cast("int")
    stratum = F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.ceil(r * q / (n - 1)), F.lit(1)) - 1)
    return positioned(df, [value, tie]).withColumn("stratum", stratum.cast("int")).drop("__position", "__all")


def stratified_folds(df: DataFrame, stratum: Sequence[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` plus fold in 0..k-1, even within strata, in hash order of the key."""
    placed = positioned(df.withColumn("__u", hash_unit(key, seed)), [*stratum, "__u", key])
    first = placed.groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(stratum)]).agg(F.min("__position").alias("__first"))
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(stratum)]
    folded = placed.join(first, same).withColumn("fold", ((F.col("__position") - F.col("__first")) % k).cast("int"))
    return folded.select(*df.columns, "fold")


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over all rows before, in an order that tells rows apart; ranges are summed first, as in ``positioned``."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(*order)) - F.col(value)
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__base") + F.col("__inside")).drop("__p", "__inside", "__base")


def overlap(df: DataFrame, value: str, part: str) -> DataFrame:
    """For each pair of parts, how many values stand in both; one grouping, pairs of the few parts of a value."""
    parts = df.groupBy(value).agg(F.array_sort(F.collect_set(part)).alias("p")).where(F.size("p") > 1)
    pairs = parts.select(F.posexplode("p").alias("i", "a"), "p").select("a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def crossing(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in more than one part."""
    return df.groupBy(group).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


def crosstab(df: DataFrame, part: str, label: str, labels: Sequence) -> DataFrame:
    """Rows per part and label, empty cells as 0; labels are given, so that no scan looks for them."""
    return df.groupBy(part).agg(*[F.count_if(F.col(label) == v).alias(f"c_{v}") for v in labels])


def manifest_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One digest of all rows whatever their order: the digest of the sorted digests of lines, in 4,096 buckets by digest, so that no task holds all lines."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = df.select(F.sha2(line.cast("binary"), 256).alias("h"))
    buckets = lines.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return buckets.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], x["d"])), "\n").cast("binary"), 256).alias("digest"))


def content_grouped_split(df: DataFrame, content: str, label: str, shares: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """``df`` plus split: rows of equal content stay together, and each label's rows near the splits' shares.

    Contents are ordered by size, the big ones first, then by hash; each goes where its place in its label's running row count falls.  That
    place comes from range-partitioned running sums, so no driver or task holds all contents.  A content with several labels
    goes by its least one.
    """
    groups = df.groupBy(content).agg(F.min(label).alias("__label"), F.count(F.lit(1)).alias("__n"))
    ordered = running_sum(groups.withColumn("__u", hash_unit(content, seed)), ["__label", F.desc("__n"), "__u", content], "__n", "__before")
    per = groups.groupBy("__label").agg(F.sum("__n").alias("__all"))
    first = ordered.groupBy("__label").agg(F.min("__before").alias("__first"))
    sums = per.join(first, "__label")  # a row a label
    at = (F.col("__before") - F.col("__first") + F.col("__n") / 2) / F.col("__all")
    placed, upto = F.lit(shares[-1][0]), 1.0
    for name, share_ in reversed(shares[:-1]):
        upto = sum(s for n, s in shares[: [x for x, _ in shares].index(name) + 1])
        placed = F.when(at < upto, F.lit(name)).otherwise(placed)
    split = ordered.join(sums, "__label").select(F.col(content).alias("__c"), placed.alias("split"))
    return df.join(split, F.col(content).eqNullSafe(F.col("__c"))).drop("__c")


def evenly_spaced(df: DataFrame, order: Sequence[Column | str], count: int) -> DataFrame:
    """``count`` rows at the places index * n // count of the order; all rows if there are no more."""
    placed = positioned(df, order)
    n, k = F.col("__all"), F.col("__position")
    # the first index whose place is k, if any
    index = F.ceil(k * count / n)
    return placed.where((n <= count) | ((index < count) & (F.floor(index * n / count) == k))).drop("__position", "__all")
