"""Ordered target statistics of categorical features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidData
from ..functions.rng import uniform
from .order import running


@dataclass
class Fitted:
    """All-rows statistics: one small table of (feature, category, sum, count), and the prior."""

    columns: list[str]
    table: DataFrame
    prior: float
    smoothing: float

    def transform(self, df: DataFrame) -> DataFrame:
        """df with every column replaced by its statistic: unseen is the prior, missing stays missing."""
        for c in self.columns:
            own = self.table.where(F.col("feature") == c).select(F.col("category").alias("__c"), ((F.col("s") + self.smoothing * self.prior) / (F.col("n") + self.smoothing)).alias("__v"))
            df = df.join(own, F.col(c).cast("string") == F.col("__c"), "left")
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("__v", F.lit(self.prior)))).drop("__c", "__v")
        return df


def fit(df: DataFrame, columns: Sequence[str], label: str, *, smoothing: float = 1.0, binary: bool = False) -> Fitted:
    """Sums and counts of the label by category, for all columns in one shuffle."""
    if binary and not df.where(~F.col(label).isin(0, 1)).isEmpty():
        raise InvalidData("a binary target has labels 0 and 1")
    prior = float(df.agg(F.avg(label).alias("p")).first()["p"] or 0.0)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns)))
    table = df.select(F.col(label).cast("double").alias("y"), each.alias("e")).where("e.category is not null").groupBy("e.feature", "e.category").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    return Fitted(list(columns), table, prior, smoothing)


def fit_transform(df: DataFrame, columns: Sequence[str], label: str, row_id: str, *, seed: int = 0, permutations: int = 1, smoothing: float = 1.0) -> tuple[DataFrame, Fitted]:
    """df with each category replaced by the statistic of the rows before it in a seeded order.

    The order is that of a keyed draw of row_id; several orders are averaged.  A row's own label
    never counts for it.  All rows are put in order by category and draw over ranges, so that a
    category (or the missing ones) that holds most of the rows is dealt over many tasks; where the
    running sums of a category begin is taken off.
    """
    fitted = fit(df, columns, label, smoothing=smoothing)
    y = F.col(label).cast("double")
    for c in columns:
        total = F.lit(0.0)
        for k in range(permutations):
            u = uniform(F.col(row_id), seed, k)
            df = running(df.withColumns({"__c": F.col(c).cast("string"), "__u": u}), ["__c", "__u", row_id], {f"__s{k}": y, f"__n{k}": F.when(y.isNotNull(), 1).otherwise(0)}).drop("__u")
            first = df.groupBy("__c").agg(F.min_by(F.struct(f"__s{k}", f"__n{k}"), F.struct(f"__n{k}", uniform(F.col(row_id), seed, k), row_id)).alias("__first"))
            df = df.join(first.withColumnRenamed("__c", "__d"), F.col("__c").eqNullSafe(F.col("__d")))
            s, n = F.col(f"__s{k}") - F.col(f"__first.__s{k}"), F.col(f"__n{k}") - F.col(f"__first.__n{k}")
            df = df.withColumn(f"__e{k}", (s + smoothing * fitted.prior) / (n + smoothing)).drop("__c", "__d", "__first", f"__s{k}", f"__n{k}")
            total = total + F.col(f"__e{k}")
        df = df.withColumn(f"__{c}", F.when(F.col(c).isNotNull(), total / permutations)).drop(*(f"__e{k}" for k in range(permutations)))
    for c in columns:
        df = df.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return df, fitted
