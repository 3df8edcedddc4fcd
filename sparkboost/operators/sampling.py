"""Row sampling as pure functions of row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .order import releasing, running


def bernoulli(df: DataFrame, row_id: str, share: float, seed: int, iteration: int = 0, slot: int = 0) -> DataFrame:
    return df.where(uniform(F.col(row_id), seed, iteration, slot) < share)


def balanced(df: DataFrame, row_id: str, label: str, positive: float, negative: float, seed: int, iteration: int = 0) -> DataFrame:
    """Separate shares of rows with label 1 and of the others."""
    return df.where(uniform(F.col(row_id), seed, iteration) < F.when(F.col(label) == 1, positive).otherwise(negative))


def whole_queries(df: DataFrame, qid: str, share: float, seed: int, iteration: int = 0) -> DataFrame:
    """Queries are kept or dropped as a whole."""
    return df.where(uniform(F.col(qid), seed, iteration) < share)


def gradient_threshold(df: DataFrame, norm: Column, share: float) -> float:
    """u for which the sum of min(1, norm / u) over all rows is share times their number.

    The norms' distinct values are put in order with running sums; no task sees all rows.
    """
    with releasing():
        return _threshold(df, norm, share)


def _threshold(df: DataFrame, norm: Column, share: float) -> float:
    by = df.groupBy(norm.cast("double").alias("r")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("s"), F.max("r").alias("top")).first()
    if not total["n"] or not total["s"]:
        return 0.0
    want = share * total["n"]
    # with u between two values: the rows above count 1 each, the others r / u
    runs = running(by, ["r"], {"below": F.col("n") * F.col("r"), "under": F.col("n")})
    left = want - (total["n"] - F.col("under") - F.col("n"))
    u = F.when(left > 0, (F.col("below") + F.col("n") * F.col("r")) / F.when(left > 0, left))
    ok = runs.withColumn("u", u).where((F.col("u") >= F.col("r")) & (F.col("u") > 0))
    found = ok.agg(F.min_by("u", F.col("r")).alias("u")).first()["u"]
    return float(found if found is not None else total["top"])
