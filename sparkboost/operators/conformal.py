"""Conformal intervals from held-out scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import kth


def score_quantile(df: DataFrame, score: Column, alpha: float) -> float:
    """The k-th smallest score, k = ceil((n + 1)(1 - alpha)); infinite if there are fewer."""
    n = df.where(score.isNotNull()).count()
    k = math.ceil((n + 1) * (1 - alpha) - 1e-12)
    return math.inf if k > n else float(kth(df, score.cast("double"), [max(k, 1)])[0])


def split_interval(calibration: DataFrame, label: str, prediction: str, alpha: float, rows: DataFrame) -> DataFrame:
    """rows with lower and upper around their prediction, by absolute residuals."""
    q = score_quantile(calibration, F.abs(F.col(label) - F.col(prediction)), alpha)
    return rows.withColumn("lower", F.col(prediction) - q).withColumn("upper", F.col(prediction) + q)


def quantile_interval(calibration: DataFrame, label: str, low: str, high: str, alpha: float, rows: DataFrame) -> DataFrame:
    """rows with their predicted band widened (or narrowed) by the score max(low - y, y - high)."""
    y = F.col(label)
    q = score_quantile(calibration, F.greatest(F.col(low) - y, y - F.col(high)), alpha)
    return rows.withColumn("lower", F.col(low) - q).withColumn("upper", F.col(high) + q)
