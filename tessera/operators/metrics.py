"""Classification, regression, ranking and generation metrics as one- or two-step aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import share
from tessera.functions.text import windows
from tessera.operators.splits import running_sum


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 for every label that is actual or predicted; 0 where a denominator is 0."""
    cells = confusion(df, actual, predicted)
    a = cells.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("named"))
    both = a.join(p, "label", "full").na.fill(0, ["support", "tp", "named"])
    pr, rc = share(F.col("tp"), F.col("named")), share(F.col("tp"), F.col("support"))
    f1 = F.when(pr + rc == 0, F.lit(0.0)).otherwise(2 * pr * rc / (pr + rc))
    return both.select("label", "support", F.round(pr, 9).alias("precision"), F.round(rc, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def macro(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hits = df.agg(F.round(share(F.count_if(F.col(actual) == F.col(predicted)), F.count(F.lit(1))), 9).alias("accuracy"))
    means = per_class(df, actual, predicted).agg(*[F.round(F.avg(c), 8).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return hits.crossJoin(means)  # one row each


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by average ranks; rows are summed per score first, so ties and order cost no sort of all rows."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = running_sum(per, ["s"], "q", "less")
    u = F.sum(F.col("p") * (F.col("less") + F.col("q") / 2))
    return below.agg(F.round(u / (F.sum("p") * F.sum("q")), 9).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def binary_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    pr, rc = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    f1 = F.when(pr + rc == 0, F.lit(0.0)).otherwise(2 * pr * rc / (pr + rc))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(n) for n, c in (("accuracy", acc), ("precision", pr), ("recall", rc), ("f1", f1))])


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - actual, 2)))


def rmsle(actual: Column, predicted: Column) -> Column:
    return rmse(F.log1p(actual), F.log1p(F.greatest(predicted, F.lit(0.0))))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def token_f1(generated: Column, reference: Column) -> Column:
    """F1 of two token arrays as multisets, by the tokens' counts."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(generated), F.lit(0), lambda s, t: s + F.least(times(generated, t), times(reference, t)))
    total = F.size(generated) + F.size(reference)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)


def repeated_trigram(tokens: Column) -> Column:
    tri = windows(tokens, 3)
    return F.size(F.array_distinct(tri)) < F.size(tri)


@F.pandas_udf(T.DoubleType())
def rouge_l(generated: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays; one row of the table at a time."""

    def one(a: Sequence, b: Sequence) -> float:
        if not len(a) or not len(b):
            return 0.0
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return 2.0 * row[-1] / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(generated, reference, strict=True)])
