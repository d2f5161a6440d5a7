"""Robust statistics of samples in groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNIFICANCE, LEAST_CHANGE, TRIM, LEAST_NOISE = 0.01, 0.02, 0.10, 0.01
MAD_TO_SD = 1.4826


def medians(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("median"))


def mads(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Median of the absolute deviations from the group's median, unscaled."""
    centre = medians(df, value, by)
    return df.join(centre, list(by)).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, mean, sample variance, coefficient of variation."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("_sd"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("_sd") / F.col("mean"))).drop("_sd")


def trimmed_means(df: DataFrame, value: str, by: Sequence[str], fraction: float = TRIM) -> DataFrame:
    """Mean without the floor(n * fraction) least and largest values of each group.

    Equal values are counted first, and places follow from running sums over the counts, so that a group's window
    holds a row for each distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy(value))
    n = F.sum("c").over(W.partitionBy(*by))
    cut = F.floor(n * fraction)
    kept = F.greatest(F.lit(0), F.least(upto, n - cut) - F.greatest(upto - F.col("c"), cut))
    return counts.withColumn("_k", kept).groupBy(*by).agg((F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("trimmed_mean"))


def welch(a: Column, var_a: Column, n_a: Column, b: Column, var_b: Column, n_b: Column, noise: Column | None = None) -> tuple[Column, Column]:
    """t and degrees of freedom of Welch's test of two means. noise: the environment's standard error, added in quadrature; the degrees are then 2 at least."""
    x, y = var_a / n_a, var_b / n_b
    spread = x + y
    t = (a - b) / F.sqrt(spread + (noise * noise if noise is not None else F.lit(0.0)))
    df = spread * spread / (x * x / (n_a - 1) + y * y / (n_b - 1))
    return t, F.greatest(df, F.lit(2.0)) if noise is not None else df


def _log_gamma(x: float) -> float:
    return math.lgamma(x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # convergents p / q of 1 + d1 / (1 + d2 / (1 + ...))
    p0, q0, p1, q1, value = 1.0, 0.0, 1.0, 1.0, 1.0
    for i in range(1, 600):
        m = i // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        p0, q0, p1, q1 = p1, q1, p1 + d * p0, q1 + d * q0
        if q1:
            new = p1 / q1
            p0, q0, p1, q1 = p0 / q1, q0 / q1, new, 1.0
            if abs(new - value) < 1e-15 * abs(new):
                value = new
                break
            value = new
    return front / value


def two_tailed_p(t: float, df: float) -> float:
    """Of Student's distribution; 1 where there is no spread to test with."""
    if not (math.isfinite(t) and math.isfinite(df)) or df <= 0:
        return 1.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([two_tailed_p(np.nan if pd.isna(x) else x, np.nan if pd.isna(y) else y) for x, y in zip(ts, dfs, strict=True)])

    return p(t, df)


def noise_floor(changes: DataFrame, value: str, least: float = LEAST_NOISE) -> DataFrame:
    """One row: the scaled MAD of the changes, `least` at least; `least` for fewer than three."""
    centre = changes.agg(F.median(value).alias("_m"))
    spread = changes.join(F.broadcast(centre)).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"), F.count(value).alias("_n"))  # centre is one row
    return spread.select(F.when(F.col("_n") < 3, F.lit(least)).otherwise(F.greatest(F.lit(least), F.col("_mad") * MAD_TO_SD)).alias("noise_floor"))


def bias_adjusted(changes: DataFrame, value: str) -> DataFrame:
    """The changes less their median; unchanged if they are fewer than three."""
    centre = changes.agg(F.median(value).alias("_m"), F.count(value).alias("_n"))
    return changes.join(F.broadcast(centre)).withColumn(value, F.when(F.col("_n") < 3, F.col(value)).otherwise(F.col(value) - F.col("_m"))).drop("_m", "_n")  # centre is one row


def verdict(p: Column, change: Column) -> Column:
    """regression, improvement or unchanged."""
    return F.when((p < SIGNIFICANCE) & (change > LEAST_CHANGE), "regression").when((p < SIGNIFICANCE) & (change < -LEAST_CHANGE), "improvement").otherwise("unchanged")
