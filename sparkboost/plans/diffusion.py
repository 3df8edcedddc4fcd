"""Generative models on boosted trees: diffusion of labels given features, and whole tables by forests.

A noising path takes data z at time 0 to noise at time 1: z_t = a(t) z + s(t) e.  Trees learn the noise e
(or the velocity dz/dt) from z_t, t and the features; sampling goes from time 1 back to 0.  Noise is a keyed
draw of the row, the copy and the step: samples don't depend on partitions or retries.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter
from ..functions.rng import normal, uniform, uniforms
from ..model import Model
from ..operators.binning import clean
from ..operators.folds import k_fold
from .train import train

#: Fixed values of the published paths: beta of variance preserving ones, sigma of exploding ones.
BETA, SIGMA = (0.1, 20.0), (0.01, 5.0)
#: Times nearer to 0 aren't trained on nor stepped to.
FIRST = 1e-3


@dataclass(frozen=True)
class Path:
    """kind: vp, subvp, ve (stochastic processes), linear or trig (flows)."""

    kind: str = "vp"

    def __post_init__(self) -> None:
        if self.kind not in ("vp", "subvp", "ve", "linear", "trig"):
            raise InvalidParameter(f"unknown path {self.kind!r}")

    def columns(self, t: Column) -> tuple[Column, Column]:
        """a(t) and s(t) as columns."""
        if self.kind == "linear":
            return 1 - t, t
        if self.kind == "trig":
            return F.cos(t * (math.pi / 2)), F.sin(t * (math.pi / 2))
        if self.kind == "ve":
            return F.lit(1.0), SIGMA[0] * F.pow(F.lit(SIGMA[1] / SIGMA[0]), t)
        a = F.exp(-0.25 * t * t * (BETA[1] - BETA[0]) - 0.5 * t * BETA[0])
        return a, (1 - a * a if self.kind == "subvp" else F.sqrt(1 - a * a))

    def at(self, t: float) -> tuple[float, float, float, float]:
        """a, s and their derivatives."""
        if self.kind == "linear":
            return 1 - t, t, -1.0, 1.0
        if self.kind == "trig":
            w = math.pi / 2
            return math.cos(w * t), math.sin(w * t), -w * math.sin(w * t), w * math.cos(w * t)
        if self.kind == "ve":
            s = SIGMA[0] * (SIGMA[1] / SIGMA[0]) ** t
            return 1.0, s, 0.0, s * math.log(SIGMA[1] / SIGMA[0])
        a = math.exp(-0.25 * t * t * (BETA[1] - BETA[0]) - 0.5 * t * BETA[0])
        da = -a * (0.5 * t * (BETA[1] - BETA[0]) + 0.5 * BETA[0])
        if self.kind == "subvp":
            return a, 1 - a * a, da, -2 * a * da
        s = math.sqrt(max(1 - a * a, 1e-12))
        return a, s, da, -a * da / s

    def velocity(self, z: np.ndarray, e: np.ndarray, t: float) -> np.ndarray:
        """dz/dt of the path through z whose noise is e."""
        a, s, da, ds = self.at(t)
        return da * (z - s * e) / max(a, 1e-4) + ds * e


def _noise(key: np.ndarray, seed: int, step: int, copy: int, width: int) -> np.ndarray:
    u = [uniforms(key, seed, step, (copy * width + k) * 2 + j + 1) for k in range(width) for j in range(2)]
    return np.stack([np.sqrt(-2 * np.log(u[2 * k])) * np.cos(2 * math.pi * u[2 * k + 1]) for k in range(width)], axis=1)


def _noised(df: DataFrame, columns: Sequence[str], path: Path, t: Column, key: Column, seed: int, flow: bool) -> DataFrame:
    """df with __t, the noised columns __z0, ... and their targets __y0, ..."""
    a, s = path.columns(F.col("__t"))
    df = df.withColumn("__t", t)
    for k, c in enumerate(columns):
        e = normal(key, seed, 0, 1000 + k)
        target = e if not flow else (F.col("__e") - F.col(c) if path.kind == "linear" else (math.pi / 2) * (a * F.col("__e") - s * F.col(c)))
        df = df.withColumn("__e", e)
        df = df.withColumns({f"__z{k}": a * F.col(c) + s * F.col("__e"), f"__y{k}": target if flow else F.col("__e")}).drop("__e")
    return df


def residualized(params: dict, df: DataFrame, features: Sequence[str], label: str, row_id: str, *, rounds: int = 20, splits: int = 2, seed: int = 0, **options) -> tuple[DataFrame, Model]:
    """df with the label less its out-of-fold mean prediction, and the model of all rows that gives the mean back."""
    parts = k_fold(df, row_id, splits, seed).where("role = 'test'").select(F.col("row_id").alias("__r"), "fold")
    dealt = df.join(parts, F.col(row_id) == F.col("__r")).drop("__r")
    out = None
    for fold in range(splits):
        model = train(params, dealt.where(F.col("fold") != fold), features, label, rounds, row_id=row_id, **options)
        part = model.margins(dealt.where(F.col("fold") == fold), df.columns)
        part = part.withColumn(label, F.col(label) - F.col("m0")).select(*df.columns)
        out = part if out is None else out.unionByName(part)
    return out, train(params, df, features, label, rounds, row_id=row_id, **options)


@dataclass
class DiffusionModel:
    """Samples of labels given features.

    parameterization: ``noise`` of a process, or ``velocity`` of a flow (linear, trig).
    """

    features: list[str]
    labels: list[str]
    path: Path
    velocity: bool
    center: list[float]
    scale: list[float]
    model: Model
    mean: list[Model] = field(default_factory=list)

    @classmethod
    def fit(cls, params: dict, df: DataFrame, features: Sequence[str], labels: Sequence[str], rounds: int, *, row_id: str, path: str = "vp", repeats: int = 10, seed: int = 0, residual: bool = False) -> DiffusionModel:
        """Each row is repeated with its own times and noise; one training learns all labels' noise."""
        route, flow = Path(path), path in ("linear", "trig")
        mean = []
        if residual:
            for label in labels:
                df, model = residualized({k: v for k, v in params.items() if k != "multi_strategy"}, df, features, label, row_id, seed=seed)
                mean.append(model)
        sums = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(labels) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        center, scale = [sums[f"m{k}"] or 0.0 for k in range(len(labels))], [sums[f"s{k}"] or 1.0 for k in range(len(labels))]
        rows = df.select(F.col(row_id).cast("long").alias("__id"), *features, *(((F.col(c) - m) / s).alias(f"__l{k}") for k, (c, m, s) in enumerate(zip(labels, center, scale, strict=True))))
        rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        rows = rows.withColumn("__key", F.xxhash64("__id", "__copy", F.lit(seed)))
        t = FIRST + (1 - FIRST) * uniform(F.col("__key"), seed, 0, 999)
        rows = _noised(rows, [f"__l{k}" for k in range(len(labels))], route, t, F.col("__key"), seed, flow)
        inputs = [*features, "__t", *(f"__z{k}" for k in range(len(labels)))]
        targets = [f"__y{k}" for k in range(len(labels))]
        model = train(params, rows, inputs, targets if len(targets) > 1 else targets[0], rounds, row_id="__key")
        return cls(list(features), list(labels), route, flow, center, scale, model, mean)

    def _step(self, x: np.ndarray, z: np.ndarray, t: float) -> np.ndarray:
        """What the trees say at time t: noise or velocity."""
        full = np.concatenate([x, np.full((len(x), 1), t), z], axis=1).astype(np.float32)
        return self.model.margins_of(full)

    def _drift(self, x: np.ndarray, z: np.ndarray, t: float) -> np.ndarray:
        got = self._step(x, z, t)
        return got if self.velocity else self.path.velocity(z, got, t)

    def draws(self, x: np.ndarray, key: np.ndarray, samples: int, steps: int, solver: str, seed: int) -> np.ndarray:
        """(rows, samples, labels): from noise at time 1 back to data, all steps here."""
        times = np.linspace(1.0, FIRST, steps + 1)
        out = np.zeros((len(x), samples, len(self.labels)))
        for c in range(samples):
            z = _noise(key, seed, 0, c, len(self.labels)) * (SIGMA[1] if self.path.kind == "ve" else 1.0)
            for k in range(steps):
                t, dt = float(times[k]), float(times[k] - times[k + 1])
                if solver == "sde":
                    a, s, da, ds = self.path.at(t)
                    f = da / max(a, 1e-4)
                    g2 = max(2 * s * ds - 2 * f * s * s, 0.0)
                    e = self._step(x, z, t)
                    z = z - (f * z + g2 * e / s) * dt + math.sqrt(g2 * dt) * _noise(key, seed, k + 1, c, len(self.labels))
                    continue
                v = self._drift(x, z, t)
                ahead = z - v * dt
                if solver == "heun" and k + 1 < steps:
                    ahead = z - (v + self._drift(x, ahead, float(times[k + 1]))) / 2 * dt
                z = ahead
            out[:, c] = z * np.array(self.scale) + np.array(self.center)
        for j, m in enumerate(self.mean):
            out[:, :, j] += m.margins_of(x)[:, :1]
        return out

    def sample(self, df: DataFrame, row_id: str, samples: int, *, steps: int = 30, solver: str = "euler", seed: int = 0) -> DataFrame:
        """(row_id, sample, output, value) of df's rows; solver: euler or heun of the flow, or sde of a process."""
        if solver not in ("euler", "heun", "sde") or solver == "sde" and self.velocity:
            raise InvalidParameter(f"solver {solver!r} doesn't go with the path")
        n, d = len(self.features), len(self.labels)
        source = df.select(F.col(row_id).cast("long").alias("row_id"), *(clean(f).alias(f"__f{k}") for k, f in enumerate(self.features)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy()
                x = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float32) for k in range(n)], axis=1)
                got = self.draws(x, key, samples, steps, solver, seed)
                m = len(key) * samples * d
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, samples * d)), pa.array(np.tile(np.repeat(np.arange(samples), d), len(key))), pa.array(np.tile(np.arange(d), len(key) * samples)), pa.array(got.reshape(m))], names=["row_id", "sample", "output", "value"])

        return source.mapInArrow(run, "row_id long, sample long, output long, value double")

    def save(self, spark, path: str) -> None:
        """One row of JSON as a Parquet folder."""
        doc = {"features": self.features, "labels": self.labels, "path": self.path.kind, "velocity": self.velocity, "center": self.center, "scale": self.scale, "model": self.model.to_json(), "mean": [m.to_json() for m in self.mean]}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> DiffusionModel:
        x = json.loads(spark.read.parquet(path).first()["doc"])
        return cls(x["features"], x["labels"], Path(x["path"]), x["velocity"], x["center"], x["scale"], Model.from_json(x["model"]), [Model.from_json(m) for m in x["mean"]])


def sample_means(samples: DataFrame) -> DataFrame:
    """(row_id, output, mean, std) over samples."""
    return samples.groupBy("row_id", "output").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def sample_quantiles(samples: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(row_id, output, q0, q1, ...): linear interpolation between a row's ordered samples."""
    n, values = F.size("v"), F.col("v")
    rows = samples.groupBy("row_id", "output").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a row has as many samples as were asked for
    out = []
    for k, a in enumerate(alphas):
        at = F.lit(float(a)) * (n - 1)
        low = F.floor(at).cast("int")
        first, second = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        out.append((first + (at - low) * (second - first)).alias(f"q{k}"))
    return rows.select("row_id", "output", *out)


def sample_crps(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """(output, crps): mean over rows of E|X - y| - E|X - X'| / 2; truth: (row_id, output, y)."""
    rows = samples.groupBy("row_id", "output").agg(F.sort_array(F.collect_list("value")).alias("v")).join(truth, ["row_id", "output"])
    n = F.size("v")
    near = F.aggregate(F.transform("v", lambda x: F.abs(x - F.col("y"))), F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(F.transform("v", lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x) / (n * n)
    return rows.select("output", (near - spread).alias("c")).groupBy("output").agg(F.avg("c").alias("crps"))


@dataclass
class ForestModel:
    """Whole rows by a flow from noise to data: a model for each class and time.

    Columns are scaled to -1..1; a column of categories becomes a column for each of them, of which the
    largest sampled one is taken.  Missing values stay out of the training of their own targets.
    """

    columns: list[str]
    categories: dict[str, list[float]]
    low: list[float]
    high: list[float]
    classes: dict[str, float]
    levels: int
    models: dict[str, list[Model]]

    @property
    def wide(self) -> list[tuple[str, float | None]]:
        return [(c, v) for c in self.columns for v in (self.categories[c] if c in self.categories else [None])]

    @classmethod
    def fit(cls, params: dict, df: DataFrame, columns: Sequence[str], rounds: int, *, row_id: str, label: str | None = None, categorical: Sequence[str] = (), levels: int = 10, repeats: int = 5, seed: int = 0) -> ForestModel:
        cats = {c: sorted(float(r[0]) for r in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).distinct().limit(1000).collect()) for c in categorical}
        row = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max)))).first()
        low, high = [row[f"a{k}"] or 0.0 for k in range(len(columns))], [row[f"z{k}"] or 0.0 for k in range(len(columns))]
        group = F.lit("") if label is None else F.col(label).cast("string")
        counts = {r["g"]: float(r["count"]) for r in df.select(group.alias("g")).where("g is not null").groupBy("g").count().collect()}
        out = cls(list(columns), cats, low, high, counts, levels, {})
        values = []
        for c, v in out.wide:
            k = out.columns.index(c)
            x = F.col(c).cast("double")
            values.append(F.when(x.isNotNull(), F.when(x == v, 1.0).otherwise(-1.0)) if v is not None else 2 * (x - low[k]) / ((high[k] - low[k]) or 1.0) - 1)
        rows = df.select(F.col(row_id).cast("long").alias("__id"), group.alias("__g"), *(x.alias(f"__l{k}") for k, x in enumerate(values)))
        rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("__key", F.xxhash64("__id", "__copy", F.lit(seed)))
        names = [f"__l{k}" for k in range(len(values))]
        inputs = [f"__z{k}" for k in range(len(values))]
        for g in counts:
            out.models[g] = []
            for j in range(levels):
                part = _noised(rows.where(F.col("__g") == g), names, Path("linear"), F.lit((j + 1) / levels), F.col("__key"), seed, True)
                part = part.na.drop(subset=[f"__y{k}" for k in range(len(values))])
                targets = [f"__y{k}" for k in range(len(values))]
                out.models[g].append(train(params, part, inputs, targets if len(targets) > 1 else targets[0], rounds, row_id="__key"))
        return out

    def _generated(self, group: str, key: np.ndarray, seed: int, known: np.ndarray | None = None) -> np.ndarray:
        width = len(self.wide)
        noise = _noise(key, seed, 0, 0, width)
        z = noise.copy()
        for j in range(self.levels - 1, -1, -1):
            t = (j + 1) / self.levels
            if known is not None:  # known cells follow their own way from the noise
                z = np.where(np.isnan(known), z, (1 - t) * known + t * noise)
            z = z - self.models[group][j].margins_of(z.astype(np.float32)) / self.levels
        if known is not None:
            z = np.where(np.isnan(known), z, known)
        out, k = [], 0
        for i, c in enumerate(self.columns):
            if c in self.categories:
                n = len(self.categories[c])
                out.append(np.array(self.categories[c])[z[:, k : k + n].argmax(axis=1)])
                k += n
            else:
                out.append(np.clip((z[:, k] + 1) / 2, 0, 1) * (self.high[i] - self.low[i]) + self.low[i])
                k += 1
        return np.stack(out, axis=1)

    def _mapped(self, source: DataFrame, seed: int, columns: bool) -> DataFrame:
        """source: row_id, group and, if columns, the given values."""
        width = len(self.columns)
        schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("label", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in self.columns)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, group = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
                got = np.zeros((len(key), width))
                known = None
                if columns:
                    given = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(width)], axis=1)
                    known = []
                    for c, v in self.wide:
                        k = self.columns.index(c)
                        x = given[:, k]
                        known.append(np.where(np.isnan(x), np.nan, np.where(x == v, 1.0, -1.0) if v is not None else 2 * (x - self.low[k]) / ((self.high[k] - self.low[k]) or 1.0) - 1))
                    known = np.stack(known, axis=1)
                for g in set(group.tolist()):
                    own = np.flatnonzero(group == g)
                    got[own] = self._generated(g, key[own], seed, None if known is None else known[own])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.copy()) for c in got.T)], names=schema.names)

        return source.mapInArrow(run, schema)

    def sample(self, spark, n: int, seed: int = 0) -> DataFrame:
        """(row_id, label, columns) of n new rows, of classes in their proportions."""
        names, u = list(self.classes), uniform(F.col("id"), seed, 0, 5)
        ends = np.cumsum([self.classes[g] for g in names]) / sum(self.classes.values())
        pick = F.lit(names[-1])
        for g, end in reversed(list(zip(names[:-1], ends[:-1], strict=True))):
            pick = F.when(u < float(end), g).otherwise(pick)
        return self._mapped(spark.range(n).select(F.col("id"), pick.alias("g")), seed, False)

    def sample_for_labels(self, labels: DataFrame, row_id: str, label: str, seed: int = 0) -> DataFrame:
        """A new row for each row of labels, of its class."""
        return self._mapped(labels.select(F.col(row_id).cast("long"), F.col(label).cast("string")), seed, False)

    def impute(self, df: DataFrame, row_id: str, label: str | None = None, seed: int = 0) -> DataFrame:
        """df's rows with their missing cells generated beside the known ones."""
        group = F.lit("") if label is None else F.col(label).cast("string")
        return self._mapped(df.select(F.col(row_id).cast("long"), group, *(F.col(c).cast("double") for c in self.columns)), seed, True)

    def to_json(self) -> str:
        return json.dumps({**{k: v for k, v in asdict(self).items() if k != "models"}, "models": {g: [m.to_json() for m in ms] for g, ms in self.models.items()}})

    @classmethod
    def from_json(cls, text: str) -> ForestModel:
        x = json.loads(text)
        x["models"] = {g: [Model.from_json(m) for m in ms] for g, ms in x["models"].items()}
        return cls(**x)
