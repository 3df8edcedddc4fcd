"""Evaluation metrics as aggregates; rank metrics as windows over small tables.

A metric takes a DataFrame with columns of predictions (transformed, except where noted), a
label, and optionally a weight and a query id, and gives a one-row DataFrame with ``value``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.order import running

TINY = 1e-16


def _mean(df: DataFrame, term: Column, weight: Column, after: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    return df.agg(after(F.sum(weight * term) / F.sum(weight)).alias("value"))


def _log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY))
    return -(y * F.log(q) + (1 - y) * F.log1p(-q))


def _elementwise(term: Callable[[Column, Column, dict], Column], after: Callable[[Column], Column] = lambda x: x):
    def metric(df, preds, label, weight, qid, options):
        return _mean(df, term(F.col(preds[0]), F.col(label), options), weight, after)

    return metric


def _over_outputs(term: Callable[[Column, Column, float], Column], option: str):
    def metric(df, preds, label, weight, qid, options):
        terms = [term(F.col(p), F.col(label), a) for p, a in zip(preds, options[option], strict=True)]
        return _mean(df, sum(terms[1:], terms[0]) / len(terms), weight)

    return metric


def _classes(term: Callable[[Sequence[str], Column], Column]):
    def metric(df, preds, label, weight, qid, options):
        return _mean(df, term(preds, F.col(label)), weight)

    return metric


def _of_label(preds: Sequence[str], y: Column) -> Column:
    return F.element_at(F.array(*preds), (y + 1).cast("int"))


def _wrong(preds: Sequence[str], y: Column) -> Column:
    a = F.array(*preds)
    return F.when(F.array_position(a, F.array_max(a)) - 1 == y, 0.0).otherwise(1.0)


def _by_score(df: DataFrame, pred: str, label: str, weight: Column) -> DataFrame:
    """Positives and negatives of each distinct score, and those of higher scores before it."""
    pos = F.col(label) > 0.5
    by = df.groupBy((-F.col(pred)).alias("s")).agg(F.sum(F.when(pos, weight).otherwise(0.0)).alias("p"), F.sum(F.when(pos, 0.0).otherwise(weight)).alias("n"))
    return running(by, ["s"], {"p0": F.col("p"), "n0": F.col("n")})


def auc(df, preds, label, weight, qid, options):
    """Share of pairs in order, ties a half; weights are ignored, and 0.5 is given for one class."""
    by = _by_score(df, preds[0], label, F.lit(1.0))
    both = F.sum("p") * F.sum("n")
    return by.agg(F.when(both > 0, F.sum(F.col("n") * (F.col("p0") + F.col("p") / 2)) / both).otherwise(0.5).alias("value"))


def aucpr(df, preds, label, weight, qid, options):
    """Trapezoids of precision over recall at distinct scores; 0 for one class."""
    by = _by_score(df, preds[0], label, weight)
    at = lambda p, n: F.when(p + n > 0, p / (p + n))
    p1, n1 = F.col("p0") + F.col("p"), F.col("n0") + F.col("n")
    now = at(p1, n1)
    area = F.col("p") * (now + F.coalesce(at(F.col("p0"), F.col("n0")), now)) / 2
    return by.agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum(area) / F.sum("p")).otherwise(0.0).alias("value"))


def _ranked(df: DataFrame, pred: str, label: str, weight: Column, qid: str | None) -> DataFrame:
    """Rows with their place by prediction and by label within the query, ties in row order."""
    row = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    rows = df.select((F.col(qid) if qid else F.lit(0)).alias("q"), row.alias("row"), F.col(pred).alias("p"), F.col(label).alias("y"), weight.alias("w"))
    if not qid:  # all rows are one query: their places are counted over ranges
        rows = running(rows, [-F.col("p"), "row"], {"r": F.lit(1)})
        return running(rows, [-F.col("y"), "row"], {"i": F.lit(1)})
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "row")) - 1).withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("y"), "row")) - 1)


def _queries(by: DataFrame) -> DataFrame:
    return by.agg((F.sum(F.when(F.col("w") != 0, F.col("w") * F.col("score"))) / F.sum("w")).alias("value"))


def _cut(options: dict, default: int | None = None) -> int:
    k = options.get("k", default)
    return (1 << 60) if k is None else int(k)


def ndcg(df, preds, label, weight, qid, options):
    rows, k = _ranked(df, preds[0], label, weight, qid), _cut(options)
    part = lambda c: F.sum(F.when(F.col(c) < k, (F.pow(F.lit(2.0), F.col("y")) - 1) / F.log2(F.col(c) + 2.0)).otherwise(0.0))
    by = rows.groupBy("q").agg(F.min_by("w", "row").alias("w"), part("r").alias("d"), part("i").alias("best"))
    return _queries(by.withColumn("score", F.when(F.col("best") > 0, F.col("d") / F.col("best")).otherwise(0.0)))


def map_(df, preds, label, weight, qid, options):
    rows, k = _ranked(df, preds[0], label, weight, qid), _cut(options)
    hit = F.when(F.col("y") > 0, 1).otherwise(0)
    if qid:
        rows = rows.withColumn("hits", F.sum(hit).over(Window.partitionBy("q").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = running(rows, ["r"], {"hits": hit}).withColumn("hits", F.col("hits") + hit)
    by = rows.groupBy("q").agg(F.min_by("w", "row").alias("w"), F.sum(F.when((F.col("r") < k) & (F.col("y") > 0), F.col("hits") / (F.col("r") + 1)).otherwise(0.0)).alias("ap"), F.sum(hit).alias("rel"))
    return _queries(by.withColumn("score", F.when(F.col("rel") > 0, F.col("ap") / F.col("rel")).otherwise(0.0)))


def precision(df, preds, label, weight, qid, options):
    rows, k = _ranked(df, preds[0], label, weight, qid), _cut(options, 32)
    by = rows.groupBy("q").agg(F.min_by("w", "row").alias("w"), (F.sum(F.when(F.col("r") < k, F.col("y")).otherwise(0.0)) / F.least(F.count("*"), F.lit(k))).alias("score"), F.max(F.when(F.col("y").isin(0, 1), 0).otherwise(1)).alias("odd"))
    value = F.least(F.sum(F.when(F.col("w") != 0, F.col("w") * F.col("score"))) / F.sum("w"), F.lit(1.0))
    return by.agg(F.when(F.max("odd") == 0, value).otherwise(F.lit(float("nan"))).alias("value"))


def cox(df, preds, label, weight, qid, options):
    """Negative partial log-likelihood of hazard ratios, by event; ties share a risk set."""
    p, y = F.col(preds[0]), F.col(label)
    event = y > 0
    by = df.groupBy(F.abs(y).alias("t")).agg(F.sum(p).alias("p"), F.sum(F.when(event, 1).otherwise(0)).alias("d"), F.sum(F.when(event, F.log(p)).otherwise(0.0)).alias("l"))
    by = running(by, ["t"], {"risk": F.col("p")}, after=True)
    return by.agg((F.sum(F.col("d") * F.log("risk") - F.col("l")) / F.sum("d")).alias("value"))


def brier(df, preds, label, weight, qid, options):
    """Squared errors of the exceedance probabilities, weighted by the width of the thresholds' grid."""
    k = list(options["thresholds"])
    width = [(k[min(j + 1, len(k) - 1)] - k[max(j - 1, 0)]) / 2 for j in range(len(k))]
    terms = [q * F.pow(F.col(p) - F.when(F.col(label) >= t, 1.0).otherwise(0.0), F.lit(2.0)) for p, t, q in zip(preds, k, width, strict=True)]
    return _mean(df, sum(terms[1:], terms[0]), weight)


def interval_accuracy(df, preds, label, weight, qid, options):
    """Share of predicted times within the bounds label_lower and label_upper."""
    ok = (F.col(preds[0]) >= F.col("label_lower")) & (F.col(preds[0]) <= F.col("label_upper"))
    return _mean(df, F.when(ok, 1.0).otherwise(0.0), weight)


def _family(preds, options: dict) -> str:
    from .distributions import family_of

    name = options.get("objective", "")
    return family_of(name) if name.startswith("dist:") else "normal"


def nll(df, preds, label, weight, qid, options):
    """Mean negative log-likelihood of the distributions whose parameters are the predictions (without an objective, normal ones)."""
    family = _family(preds, options)
    m, y = F.col(preds[0]), F.col(label)
    if family in ("normal", "lognormal"):
        s, z = F.col(preds[1]), F.log(y) if family == "lognormal" else y
        return _mean(df, 0.5 * math.log(2 * math.pi) + F.log(s) + (z - m) * (z - m) / (2 * s * s) + (z if family == "lognormal" else 0.0), weight)
    return _mean(df, _of_dist(family, "log_prob", preds, label, -1.0), weight)


def crps(df, preds, label, weight, qid, options):
    """Mean continuous ranked probability score of the predicted distributions."""
    return _mean(df, _of_dist(_family(preds, options), "crps", preds, label), weight)


def _of_dist(family: str, what: str, preds, label: str, sign: float = 1.0) -> Column:
    """A score of each row by an Arrow function: the special functions that Spark lacks."""

    @F.pandas_udf("double")
    def score(y, *p):
        import numpy as np
        import pandas as pd

        from sparkboost.functions.distributions import Dist

        return pd.Series(sign * np.asarray(getattr(Dist(family, [x.to_numpy(dtype=float) for x in p]), what)(y.to_numpy(dtype=float))))

    return score(F.col(label).cast("double"), *preds)


def aft(df, preds, label, weight, qid, options):
    """Mean negative log-likelihood of accelerated failure times; predictions are times, bounds label_lower and label_upper."""
    from .losses import AcceleratedFailure

    loss = AcceleratedFailure("survival:aft", "", options)
    density, _, _, below = loss._functions()
    s, lo, hi = loss.sigma, F.col("label_lower"), F.col("label_upper")
    finite = hi < float("inf")
    z = lambda t: (F.log(t) - F.log(F.col(preds[0]))) / s
    exact = F.greatest(density(z(F.when(lo > 0, lo).otherwise(1.0))) / (s * lo), F.lit(1e-12))
    upper = F.when(finite, below(z(F.when(finite, hi).otherwise(1.0)))).otherwise(1.0)
    lower = F.when(lo > 0, below(z(F.when(lo > 0, lo).otherwise(1.0)))).otherwise(0.0)
    return _mean(df, -F.log(F.when(lo == hi, exact).otherwise(F.greatest(upper - lower, F.lit(1e-12)))), weight)


def _tweedie(p: Column, y: Column, options: dict) -> Column:
    r = float(options.get("rho", options.get("tweedie_variance_power", 1.5)))
    return -y * F.pow(p, F.lit(1 - r)) / (1 - r) + F.pow(p, F.lit(2 - r)) / (2 - r)


def _mphe(p: Column, y: Column, options: dict) -> Column:
    d2 = float(options.get("huber_slope", 1.0)) ** 2
    return d2 * (F.sqrt(1 + (y - p) * (y - p) / d2) - 1)


CATALOG: dict[str, tuple[Callable, bool]] = {  # metric, whether larger is better
    "rmse": (_elementwise(lambda p, y, o: (y - p) * (y - p), F.sqrt), False),
    "rmsle": (_elementwise(lambda p, y, o: F.pow(F.log1p(y) - F.log1p(p), F.lit(2.0)), F.sqrt), False),
    "mae": (_elementwise(lambda p, y, o: F.abs(y - p)), False),
    "mape": (_elementwise(lambda p, y, o: F.abs((y - p) / y)), False),
    "mphe": (_elementwise(_mphe), False),
    "logloss": (_elementwise(lambda p, y, o: _log_loss(y, p)), False),
    "error": (_elementwise(lambda p, y, o: F.when((p > 0.5) == (y > 0.5), 0.0).otherwise(1.0)), False),
    "poisson-nloglik": (_elementwise(lambda p, y, o: p - y * F.log(F.greatest(p, F.lit(TINY)))), False),
    "gamma-nloglik": (_elementwise(lambda p, y, o: y / p + F.log(p)), False),
    "tweedie-nloglik": (_elementwise(_tweedie), False),
    "mlogloss": (_classes(lambda preds, y: -F.log(F.greatest(_of_label(preds, y), F.lit(TINY)))), False),
    "merror": (_classes(_wrong), False),
    "quantile": (_over_outputs(lambda p, y, a: F.when(y >= p, a * (y - p)).otherwise((1 - a) * (p - y)), "quantile_alpha"), False),
    "expectile": (_over_outputs(lambda p, y, a: F.when(p >= y, 1 - a).otherwise(a) * (p - y) * (p - y), "expectile_alpha"), False),
    "exceedance-logloss": (_over_outputs(lambda p, y, k: _log_loss(F.when(y >= k, 1.0).otherwise(0.0), p), "thresholds"), False),
    "exceedance-brier": (brier, False),
    "auc": (auc, True),
    "aucpr": (aucpr, True),
    "ndcg": (ndcg, True),
    "map": (map_, True),
    "pre": (precision, True),
    "cox-nloglik": (cox, False),
    "interval-regression-accuracy": (interval_accuracy, True),
    "aft-nloglik": (aft, False),
    "nll": (nll, False),
    "crps": (crps, False),
}


def lookup(name: str) -> tuple[Callable, bool, dict]:
    """The metric of a name like ``ndcg@5`` or ``tweedie-nloglik@1.3``: function, larger is better, options."""
    stem, at, arg = name.partition("@")
    if stem not in CATALOG or at and stem not in ("ndcg", "map", "pre", "tweedie-nloglik"):
        raise InvalidParameter(f"unknown metric {name!r}")
    f, larger = CATALOG[stem]
    return f, larger, ({"rho": float(arg)} if stem == "tweedie-nloglik" else {"k": int(arg)}) if at else {}


def evaluate(name: str, df: DataFrame, preds: Sequence[str], label: str = "label", *, weight: Column | None = None, qid: str | None = None, **options) -> DataFrame:
    """A one-row DataFrame with the metric's ``value``."""
    f, _, own = lookup(name)
    return f(df, list(preds), label, F.lit(1.0) if weight is None else weight, qid, {**options, **own})
