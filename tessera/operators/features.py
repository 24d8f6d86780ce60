"""Tabular features, imputation, ridge and blending; sums in Spark, small systems on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def impute_by_group(df: DataFrame, value: str, group: str, fit: DataFrame | None = None) -> DataFrame:
    """``df`` with nulls of ``value`` filled by its group's median, else the overall one, learned on ``fit``."""
    fit = df if fit is None else fit
    per = fit.groupBy(group).agg(F.median(value).alias("__m"))
    every = fit.agg(F.median(value).alias("__all"))
    filled = df.join(per, group, "left").crossJoin(F.broadcast(every))
    return filled.withColumn(f"{value}_missing", F.col(value).isNull().cast("int")).withColumn(value, F.coalesce(value, "__m", "__all")).drop("__m", "__all")


def ordinal(c: Column | str, levels: Sequence[str]) -> Column:
    """Place of the value among the levels; -1 for others."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_position(F.array(*map(F.lit, levels)), value).cast("int"), F.lit(0)) - 1


def cross(*cs: str) -> Column:
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cs])


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = c * F.lit(2 * np.pi / period)
    return F.sin(angle), F.cos(angle)


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def skewed_columns(df: DataFrame, columns: Sequence[str], least: float = 0.75) -> DataFrame:
    """column, skew of non-negative columns with more than two values and a skew above ``least``; one pass."""
    aggs = [a for c in columns for a in (sample_skewness(c).alias(f"{c}__s"), F.min(c).alias(f"{c}__m"), F.countDistinct(c).alias(f"{c}__d"))]
    row = F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"{c}__s", 6).alias("skew"), (F.col(f"{c}__m") >= 0).alias("low"), F.col(f"{c}__d").alias("d")) for c in columns])
    return df.agg(*aggs).select(F.inline(row)).where((F.col("d") > 2) & F.col("low") & (F.col("skew") > least)).select("column", "skew")


def gram(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One row: n, means and all products that a linear fit needs."""
    cs = [*columns, target]
    sums = [F.sum(c).alias(f"s_{c}") for c in cs] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for i, a in enumerate(cs) for b in cs[i:]]
    return df.agg(F.count(F.lit(1)).alias("n"), *sums)


def ridge(df: DataFrame, columns: Sequence[str], target: str, alpha: float) -> dict[str, float]:
    """Coefficients on population z-scores, alpha not on the intercept; from the one row of ``gram``."""
    return ridge_from(gram(df, columns, target).first().asDict(), columns, target, alpha)


def ridge_from(g: dict[str, float], columns: Sequence[str], target: str, alpha: float) -> dict[str, float]:
    """``ridge`` from the sums of ``gram``."""
    n, k = g["n"], len(columns)
    mean = np.array([g[f"s_{c}"] / n for c in columns], float)
    prod = np.array([[g[f"p_{a}__{b}"] if f"p_{a}__{b}" in g else g[f"p_{b}__{a}"] for b in columns] for a in columns], float) / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(prod))
    ybar = g[f"s_{target}"] / n
    xy = np.array([g[f"p_{c}__{target}"] / n - m * ybar for c, m in zip(columns, mean, strict=True)], float) / sd
    beta = np.linalg.solve(prod / np.outer(sd, sd) * n + alpha * np.eye(k), xy * n)
    raw = beta / sd
    return dict(zip(columns, raw.tolist(), strict=True)) | {"intercept": float(ybar - raw @ mean)}


def simplex_weights(df: DataFrame, predictions: Sequence[str], target: str, penalty: float = 0.0, steps: int = 5000) -> np.ndarray:
    """Weights at or above 0 with sum 1 of least squared error, drawn to equal ones by ``penalty``; projected gradients on ``gram``."""
    g = gram(df, predictions, target).first()
    k, n = len(predictions), g["n"]
    a = np.array([[g[f"p_{x}__{y}"] if f"p_{x}__{y}" in g else g[f"p_{y}__{x}"] for y in predictions] for x in predictions]) / n + penalty * np.eye(k)
    b = np.array([g[f"p_{x}__{target}"] for x in predictions]) / n + penalty / k
    w, rate = np.full(k, 1 / k), 1 / np.linalg.eigvalsh(a)[-1]
    for _ in range(steps):
        v = w - rate * (a @ w - b)
        u = np.sort(v)[::-1]
        css = np.cumsum(u) - 1
        rho = np.flatnonzero(u > css / np.arange(1, k + 1))[-1]
        w = np.maximum(v - css[rho] / (rho + 1), 0)
    return w


def blend(predictions: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of log predictions cut at 0, back from the log scale, cut at 0."""
    total = F.lit(0.0)
    for p, w in zip(predictions, weights, strict=True):
        total = total + F.greatest(p, F.lit(0.0)) * F.lit(float(w))
    return F.greatest(F.expm1(total), F.lit(0.0))


def filled(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Missing categories as ``None``, missing numbers as 0 with an indicator: what is missing isn't there."""
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in numbers})
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in categories} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})


def total(*cs: Column | str) -> Column:
    """Sum in which a missing part counts 0."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)) for c in cs]
    return sum(parts[1:], parts[0])


def age(later: Column, earlier: Column) -> Column:
    """Years between, 0 at least, 0 where the earlier one isn't known."""
    return F.when(F.coalesce(earlier, F.lit(0)) > 0, F.greatest(later - earlier, F.lit(0))).otherwise(F.lit(0))


def robust_scaled(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """``df`` with missing numbers as the median and an indicator, less the median, by the distance of the quartiles (1 if that is 0); learned on ``fit`` in one pass."""
    fit = df if fit is None else fit
    q = fit.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(q))  # one row
    scaled = {}
    for c in columns:
        low, mid, high = (F.col(f"__q_{c}")[k] for k in range(3))
        scaled |= {f"{c}_missing": F.col(c).isNull().cast("int"), c: (F.coalesce(F.col(c).cast("double"), mid) - mid) / F.when(high == low, F.lit(1.0)).otherwise(high - low)}
    return out.withColumns({k: v for k, v in scaled.items() if k.endswith("_missing")}).withColumns({k: v for k, v in scaled.items() if not k.endswith("_missing")}).drop(*[f"__q_{c}" for c in columns])


def one_hot(c: str, levels: Sequence[str]) -> dict[str, Column]:
    """An indicator per known level; unknown ones have none."""
    return {f"{c}={v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for v in levels}


def ridge_predicted(coefficients: dict[str, float]) -> Column:
    terms = [F.lit(float(v)) * F.col(k).cast("double") for k, v in sorted(coefficients.items()) if k != "intercept"]
    return sum(terms, F.lit(float(coefficients.get("intercept", 0.0))))


def out_of_fold(df: DataFrame, columns: Sequence[str], target: str, fold: str, folds: int, alpha: float, name: str = "prediction") -> DataFrame:
    """``df`` plus the prediction of a ridge fit to the other folds; one aggregate of sums per fold, the rest on the driver."""
    sums = {r["__f"]: r for r in gram_by(df, columns, target, fold).collect()}  # a row a fold
    out = F.lit(None).cast("double")
    for k in range(folds):
        others = [r for f, r in sums.items() if f != k]
        if others:
            out = F.when(F.col(fold) == k, ridge_predicted(ridge_from(_added(others), columns, target, alpha))).otherwise(out)
    return df.withColumn(name, out)


def gram_by(df: DataFrame, columns: Sequence[str], target: str, by: str) -> DataFrame:
    cs = [*columns, target]
    sums = [F.sum(c).alias(f"s_{c}") for c in cs] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for i, a in enumerate(cs) for b in cs[i:]]
    return df.groupBy(F.col(by).alias("__f")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _added(rows: Sequence) -> dict[str, float]:
    return {k: sum(r[k] for r in rows) for k in rows[0].asDict() if k != "__f"}


def stacked(df: DataFrame, models: dict[str, Sequence[str]], target: str, fold: str, folds: int, alpha: float) -> DataFrame:
    """``df`` plus a column of out-of-fold predictions per model, and ``stack``: their blend with weights that each fold learns from the others."""
    out = df
    for name, columns in models.items():
        out = out_of_fold(out, columns, target, fold, folds, alpha, name)
    blended = F.lit(None).cast("double")
    for k in range(folds):
        w = simplex_weights(out.where(F.col(fold) != k), list(models), target)
        blended = F.when(F.col(fold) == k, sum((F.lit(float(x)) * F.col(m) for x, m in zip(w, models, strict=True)), F.lit(0.0))).otherwise(blended)
    return out.withColumn("stack", blended)
