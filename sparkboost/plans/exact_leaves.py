"""Leaves as order statistics of the residuals that fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import running


def leaf_quantiles(rows: DataFrame, leaf: str, residual: str, alpha: float, weight: str | None = None) -> DataFrame:
    """(leaf, value): the residuals' quantile on the (n + 1) * alpha grid, clamped to the extremes.

    With weights: the least residual at which the running weight reaches alpha of the leaf's.
    Distinct (leaf, residual) pairs are put in order over all partitions, so a leaf that
    holds most of the rows doesn't pass through one task.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    by = rows.where(F.col(residual).isNotNull()).groupBy(F.col(leaf).alias("leaf"), F.col(residual).alias("r")).agg(n.alias("n"))
    placed = running(by, ["leaf", "r"], {"before": F.col("n")})
    totals = placed.groupBy("leaf").agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    at = placed.join(F.broadcast(totals), "leaf").withColumn("low", F.col("before") - F.col("first")).withColumn("high", F.col("low") + F.col("n"))
    if weight is not None:
        enough = F.col("high") >= F.lit(alpha) * F.col("total") * (1 - 1e-12)
        return at.groupBy("leaf").agg(F.min(F.when(enough, F.col("r"))).alias("value"))
    x = F.greatest(F.least(F.lit(alpha) * (F.col("total") + 1), F.col("total").cast("double")), F.lit(1.0))
    at = at.withColumn("x", x)
    k = F.floor("x")
    holds = lambda rank: (F.col("low") < rank) & (F.col("high") >= rank)
    picked = at.groupBy("leaf").agg(F.max("x").alias("x"), F.max(F.when(holds(k), F.col("r"))).alias("a"), F.max(F.when(holds(F.least(k + 1, F.col("total"))), F.col("r"))).alias("b"))
    return picked.select("leaf", (F.col("a") + (F.col("x") - F.floor("x")) * (F.col("b") - F.col("a"))).alias("value"))
