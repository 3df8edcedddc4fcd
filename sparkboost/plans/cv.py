"""Cross-validation over fold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import lookup
from ..model import Model
from ..params import Params
from .train import train


def summary(history: DataFrame) -> DataFrame:
    """(iteration, dataset, metric, mean, std) of (fold, iteration, dataset, metric, value); std is of the population."""
    return history.groupBy("iteration", "dataset", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def best_round(rounds: DataFrame, metric: str, patience: int | None) -> tuple[int, int]:
    """(best, last) iteration by the mean over folds of the test table: strict improvements, ``patience`` rounds without one end it."""
    larger = lookup(metric)[1]
    best, value, last = 0, None, 0
    for r in rounds.where((F.col("dataset") == "test") & (F.col("metric") == metric)).orderBy("iteration").collect():
        last = r["iteration"]
        if r["mean"] == r["mean"] and (value is None or (r["mean"] > value if larger else r["mean"] < value)):
            best, value = last, r["mean"]
        elif patience and last - best >= patience:
            break
    return best, last


def cv(params: Params | dict, df: DataFrame, features: Sequence[str], label: str, rounds: int, folds: DataFrame, *, row_id: str, target_stats: Sequence[str] = (), early_stopping_rounds: int | None = None, per_fold: bool = False, history_only: bool = False, **options) -> tuple[DataFrame, dict[int, Model], DataFrame | None]:
    """(summary, models, out-of-fold margins) of a training for each fold.

    target_stats: categorical columns that are encoded with statistics of the fold's training
    rows alone.  early_stopping_rounds: rounds without a better mean over the folds, after which the
    rest is cut off and the models end at the best round; with per_fold each fold stops by its own
    test rows instead.  history_only: no models and no margins are kept.
    """
    from ..operators import target_stats as ts

    spark = df.sparkSession
    history, models, outsides = [], {}, {}
    given = options.get("base_margin") or []
    wanted = {row_id, label, "label_lower", "label_upper", *features, *target_stats, *given, *(options.get(c) for c in ("weight", "qid", "split_group"))}
    wanted = {c.lower() for c in wanted if c}
    df = df.select(*(c for c in df.columns if c.lower() in wanted))
    for fold in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        own = folds.where(F.col("fold") == fold).select(F.col("row_id").alias("__row"), "role")
        # held while the fold trains: what df is made by and the join run once for all its passes
        rows = df.join(own, F.col(row_id) == F.col("__row")).drop("__row").persist(StorageLevel.MEMORY_AND_DISK)
        inside, outside = rows.where("role = 'train'").drop("role"), rows.where("role = 'test'").drop("role")
        if target_stats:
            inside, fitted = ts.fit_transform(inside, target_stats, label, row_id)
            outside = fitted.transform(outside)
        model = train(params, inside, features, label, rounds, row_id=row_id, evals={"train": inside, "test": outside}, early_stopping_rounds=early_stopping_rounds if per_fold else None, **options)
        rows.unpersist()
        history += [(fold, i, d, m, v) for i, d, m, v in model.history]
        if not history_only:
            models[fold], outsides[fold] = model, outside
    table = summary(spark.createDataFrame(history, "fold int, iteration int, dataset string, metric string, value double"))
    if early_stopping_rounds and not per_fold:
        best, last = best_round(table, history[-1][3], early_stopping_rounds)
        table = table.where(F.col("iteration") <= last)
        for model in models.values():
            model.best_iteration = best
    held = None
    for fold, model in models.items():
        part = model.margins(outsides[fold], [row_id, label]).withColumn("fold", F.lit(fold))
        held = part if held is None else held.unionByName(part)
    return table, models, held


def refit(params: Params | dict, df: DataFrame, features: Sequence[str], label: str, models: dict[int, Model], **options) -> Model:
    """A model of all rows with as many rounds as the folds' models use on average."""
    used = [m.iterations if m.best_iteration is None else m.best_iteration + 1 for m in models.values()]
    return train(params, df, features, label, max(1, round(sum(used) / len(used))), **options)
