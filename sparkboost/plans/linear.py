"""Linear booster: coordinate descent on the quadratic surrogate of each round.

A round's gradients are fixed, so its coordinate updates depend on the rows only through
X'HX and X'g: one aggregate job for each round, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleModel
from ..functions.losses import Objective
from ..model import Model
from ..operators.binning import clean
from ..params import Params


def _shrunk(g: float, h: float, w: float, alpha: float, lambda_: float) -> float:
    """The coordinate's step under L1 and L2 penalties."""
    if h < 1e-5:
        return 0.0
    g, h = g + lambda_ * w, h + lambda_
    free = w - g / h
    return max(-(g + alpha) / h, -w) if free >= 0 else min(-(g - alpha) / h, -w)


def _moments(rows: DataFrame, n: int, k: int) -> dict[tuple[int, int], np.ndarray]:
    """By output and feature (n is the bias): the row of X'HX with the bias, then X'g.

    Tasks add up whole matrices of their batches; each matrix row is added up by one task, so that
    the driver gets n + 1 rows of n + 2 numbers for each output, whatever the number of partitions.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, n + 1, n + 2))
        for batch in batches:
            flat = batch.column(0).values.to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
            x = np.concatenate([flat.reshape(batch.num_rows, n), np.ones((batch.num_rows, 1))], axis=1)
            for o in range(k):
                g, h = (batch.column(1 + 2 * o + j).to_numpy(zero_copy_only=False) for j in range(2))
                held[o, :, : n + 1] += x.T @ (x * h[:, None])
                held[o, :, n + 1] += x.T @ g
        for o in range(k):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, o, np.int32)), pa.array(np.arange(n + 1, dtype=np.int32)), pa.array([r.tobytes() for r in held[o]], pa.binary())], names=["o", "f", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for o, f, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                old = held.get((o, f))
                held[o, f] = np.frombuffer(v) if old is None else old + np.frombuffer(v)
        for (o, f), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([f], pa.int32()), pa.array([v.tobytes()])], names=["o", "f", "v"])

    columns = ["x", *(f"{c}{o}" for o in range(k) for c in "gh")]
    parts = rows.select(*columns).mapInArrow(local, "o int, f int, v binary")
    return {(r["o"], r["f"]): np.frombuffer(r["v"]) for r in parts.repartition(min(n + 1, 64), "o", "f").mapInArrow(added, "o int, f int, v binary").collect()}


def _product(x: str, coef: np.ndarray, bias: float) -> Column:
    """bias + x . coef as one expression over the array."""
    terms = F.zip_with(F.col(x), F.array(*(F.lit(float(c)) for c in coef)), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(float(bias)), lambda a, b: a + b)


def train_linear(params: Params, loss: Objective, df: DataFrame, features: Sequence[str], label: str, rounds: int, *, weight: str | None = None, init_model: Model | None = None) -> Model:
    """Coefficients by coordinate descent; missing features count as 0.  Goes on from init_model if there is one."""
    if init_model is not None and (init_model.linear is None or init_model.features != list(features)):
        raise IncompatibleModel("the model isn't a linear one of these features")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(label).cast("double").alias("label"), w.alias("weight"), F.array(*(F.coalesce(clean(f).cast("double"), F.lit(0.0)) for f in features)).alias("x")).persist()
    n, k = len(features), loss.outputs
    if init_model is not None:
        coef, bias = np.array(init_model.linear, dtype=float), np.array(init_model.base, dtype=float)
    else:
        base = [loss.link(params.base_score)] * k if params.base_score is not None else loss.intercepts(rows, "label", F.col("weight"))
        coef, bias = np.zeros((n, k)), np.array(base, dtype=float)
    for _ in range(rounds):
        at, margins = rows, [f"m{o}" for o in range(k)]
        for o in range(k):
            at = at.withColumn(f"m{o}", _product("x", coef[:, o], bias[o]))
        at = loss.prepare(at, margins, "label", F.col("weight"))
        pairs = loss.pairs([F.col(m) for m in margins], F.col("label"), F.col("weight"))
        for o, (g, h) in enumerate(pairs):
            at = at.withColumn(f"g{o}", g.cast("double")).withColumn(f"h{o}", h.cast("double"))
        got = _moments(at, n, k)
        for o in range(k):
            whole = np.stack([got[o, f] for f in range(n + 1)])
            gram, g, cross = whole[:n, :n], whole[:n, n + 1].copy(), whole[:n, n]
            step = params.eta * -whole[n, n + 1] / max(whole[n, n], 1e-12)
            bias[o] += step
            g = g + cross * step
            for f in range(n):
                d = params.eta * _shrunk(g[f], gram[f, f], coef[f, o], params.alpha, params.lambda_)
                coef[f, o] += d
                g = g + gram[f] * d
    rows.unpersist()
    return Model(params.objective, params.loss, list(features), bias.tolist(), [], linear=coef.tolist())
