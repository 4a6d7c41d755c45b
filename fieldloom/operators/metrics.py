"""Smoothing and running totals of metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_mean(df: DataFrame, key: str, order: str, value: str, window: int = 20, out: str = "rolling") -> DataFrame:
    """Mean of the last ``window`` values; null while there are fewer."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - window, 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def ewm_smooth(df: DataFrame, key: str, order: str, value: str, span: int = 50, out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean with weights (1 - 2 / (span + 1)) ** age, normalized.

    The window reaches back as far as a weight counts in double precision.
    """
    keep = 1 - 2 / (span + 1)
    horizon = 1
    while keep**horizon > 1e-16:
        horizon += 1
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-horizon, 0)
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    fold = F.aggregate(
        F.collect_list(F.col(value).cast("double")).over(w), start,
        lambda a, x: F.struct((a["v"] * keep + x).alias("v"), (a["w"] * keep + 1).alias("w")), lambda a: a["v"] / a["w"],
    )
    return df.withColumn(out, fold)
