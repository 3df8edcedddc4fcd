"""Explainable additive models: one feature at a time, and the search for pairs that interact."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Model
from ..params import Params, parse
from .train import train


def train_additive(params: Params | dict, df: DataFrame, features: Sequence[str], label: str, cycles: int, **options) -> Model:
    """A model whose iteration i splits feature i modulo their number only, for so many cycles over them."""
    if isinstance(params, dict):
        params = parse({**params, "booster": "ebm"})
    return train(params, df, features, label, cycles * len(features), **options)


def shapes(spark: SparkSession, model: Model) -> DataFrame:
    """(feature, output, start, value): the step function of each feature; start is null for missing values.

    A feature's values sum up its trees; the first step of a feature starts at minus infinity.
    """
    rows = []
    for f, name in enumerate(model.features):
        own = [t for t in model.trees if t.feature[0] == f]
        cuts = sorted({t.threshold[n] for t in own for n, x in enumerate(t.feature) if x >= 0})
        starts = [-np.inf, *cuts]
        x = np.full((len(starts) + 1, len(model.features)), np.nan, dtype=np.float32)
        x[: len(starts), f] = starts
        for k in range(model.outputs):
            value = np.zeros(len(x))
            for t in own:
                if t.output == k:
                    value += t.weight * np.array(t.value)[t.walk(x)]
            rows += [(name, k, float(s) if s is not None else None, float(v)) for s, v in zip([*starts, None], value, strict=True)]
    return spark.createDataFrame(rows, "feature string, output int, start double, value double")


def fast_pairs(rows: DataFrame, pairs: Sequence[tuple[int, int]], residual: str, top: int) -> DataFrame:
    """(a, b, gain) of the pairs of binned features whose best cut into four quadrants reduces the residual most.

    One shuffle forms the sums of all pairs' cells (bins times bins rows); prefix sums over them
    are windows.  Missing bins stay out.  Ties go to the lower features.
    """
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("bins")[a].cast("int").alias("i"), F.col("bins")[b].cast("int").alias("j")) for a, b in pairs)))
    cells = rows.select(F.col(residual).alias("r"), each.alias("e")).where("e.i is not null and e.j is not null").groupBy("e.a", "e.b", "e.i", "e.j").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    grid = cells.select("a", "b", "i").distinct().join(cells.select("a", "b", "j").distinct(), ["a", "b"]).join(cells, ["a", "b", "i", "j"], "left").fillna({"s": 0.0, "n": 0})
    row = Window.partitionBy("a", "b", "i").orderBy("j")
    column = Window.partitionBy("a", "b", "j").orderBy("i")
    whole = Window.partitionBy("a", "b")
    for c in "sn":
        grid = grid.withColumn(f"{c}r", F.sum(c).over(row)).withColumn(f"{c}q", F.sum(f"{c}r").over(column)).withColumn(f"{c}t", F.sum(c).over(whole))
    last = lambda c, part: F.max_by(f"{c}q", part).over
    for c in "sn":
        grid = grid.withColumn(f"{c}i", last(c, "j")(Window.partitionBy("a", "b", "i"))).withColumn(f"{c}j", last(c, "i")(Window.partitionBy("a", "b", "j")))
    part = lambda s, n: F.when(n > 0, s * s / n).otherwise(0.0)
    q = {c: (F.col(f"{c}q"), F.col(f"{c}i") - F.col(f"{c}q"), F.col(f"{c}j") - F.col(f"{c}q"), F.col(f"{c}t") - F.col(f"{c}i") - F.col(f"{c}j") + F.col(f"{c}q")) for c in "sn"}
    gain = sum((part(s, n) for s, n in zip(q["s"][1:], q["n"][1:], strict=True)), part(q["s"][0], q["n"][0])) - part(F.col("st"), F.col("nt"))
    return grid.withColumn("gain", gain).groupBy("a", "b").agg(F.max("gain").alias("gain")).orderBy(F.desc("gain"), "a", "b").limit(top)
