"""Trained models: trees as driver-side tables, and everything that reads them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IncompatibleModel, InvalidParameter
from .functions.losses import Objective, objective
from .operators.binning import clean


@dataclass
class Tree:
    """Nodes by number, 0 the root; left is -1 in leaves.  Values include the learning rate."""

    iteration: int = 0
    output: int = 0
    parallel: int = 0
    weight: float = 1.0
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    default_left: list[bool] = field(default_factory=lambda: [False])
    categories: list[list[float] | None] = field(default_factory=lambda: [None])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, threshold: float, default_left: bool, categories, gain: float) -> tuple[int, int]:
        """Turns a leaf into an inner node; its new children's numbers."""
        self.feature[node], self.bin[node], self.threshold[node], self.default_left[node], self.categories[node], self.gain[node] = feature, bin_, threshold, default_left, categories, gain
        children = len(self.left), len(self.left) + 1
        self.left[node], self.right[node] = children
        for _ in children:
            for name, empty in (("left", -1), ("right", -1), ("feature", -1), ("bin", -1), ("threshold", 0.0), ("default_left", False), ("categories", None), ("value", 0.0), ("gain", 0.0), ("cover", 0.0)):
                getattr(self, name).append(empty)
            self.depth.append(self.depth[node] + 1)
        return children

    def leaves(self) -> list[int]:
        return [n for n, x in enumerate(self.left) if x < 0]

    def parents(self) -> dict[int, int]:
        return {c: n for n in range(len(self.left)) for c in (self.left[n], self.right[n]) if c >= 0}

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of raw features (NaN missing), level by level."""
        node = np.zeros(len(x), dtype=np.int64)
        left, right, feature = (np.array(v) for v in (self.left, self.right, self.feature))
        threshold, default = np.array(self.threshold, dtype=np.float32), np.array(self.default_left)
        going = np.arange(len(x)) if left[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            at = node[going]
            v = x[going, feature[at]]
            go = v < threshold[at]
            for k in np.unique(at):
                if self.categories[k] is not None:
                    own = at == k
                    go[own] = np.isin(v[own], np.array(self.categories[k], dtype=np.float32))
            go = np.where(np.isnan(v), default[at], go)
            node[going] = np.where(go, left[at], right[at])
            going = going[left[node[going]] >= 0]
        return node


class Router:
    """Routes rows of packed codes (a bin plus 1, 0 for a missing value) through a tree of the training that made them."""

    def __init__(self, tree: Tree, cuts) -> None:
        self.left, self.right, self.feature = (np.array(v) for v in (tree.left, tree.right, tree.feature))
        self.bin, self.default = np.array(tree.bin), np.array(tree.default_left)
        self.sets = {n: np.searchsorted(cuts.values[tree.feature[n]], np.array(c, dtype=np.float32)) + 1 for n, c in enumerate(tree.categories) if c is not None}

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(codes), dtype=np.int64)
        going = np.arange(len(codes)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            at = node[going]
            code = codes[going, self.feature[at]].astype(np.int64)
            go = code <= self.bin[at] + 1
            for n, own in self.sets.items():
                here = at == n
                if here.any():
                    go[here] = np.isin(code[here], own)
            go = np.where(code == 0, self.default[at], go)
            node[going] = np.where(go, self.left[at], self.right[at])
            going = going[self.left[node[going]] >= 0]
        return node


@dataclass
class Model:
    """Trees, intercepts and the record of their objective."""

    objective: str
    options: dict
    features: list[str]
    base: list[float]
    trees: list[Tree]
    best_iteration: int | None = None
    history: list[tuple[int, str, str, float]] = field(default_factory=list)
    linear: list[list[float]] | None = None  # [feature][output], of a linear booster

    @property
    def loss(self) -> Objective:
        return objective(self.objective, **self.options)

    @property
    def outputs(self) -> int:
        return len(self.base)

    @property
    def iterations(self) -> int:
        return 1 + max((t.iteration for t in self.trees), default=-1)

    def chosen(self, iterations: tuple[int, int] | str | None = None) -> list[Tree]:
        """Trees of a range of iterations; by default up to the best one if it is known."""
        if iterations is None:
            iterations = "best" if self.best_iteration is not None else (0, self.iterations)
        if iterations == "best":
            if self.best_iteration is None:
                raise IncompatibleModel("no best iteration is recorded")
            iterations = (0, self.best_iteration + 1)
        begin, end = iterations
        if not 0 <= begin <= end <= self.iterations:
            raise InvalidParameter(f"iterations lie in 0..{self.iterations}")
        return [t for t in self.trees if begin <= t.iteration < end]

    # numpy on the driver or within a task

    def margins_of(self, x: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        """(rows, outputs) margins of raw features."""
        out = np.tile(np.array(self.base, dtype=float), (len(x), 1))
        if self.linear is not None:
            return out + np.nan_to_num(x) @ np.array(self.linear)
        for t in self.chosen() if trees is None else trees:
            out[:, t.output] += t.weight * np.array(t.value)[t.walk(x)]
        return out

    # Spark

    def _map(self, df: DataFrame, keep: Sequence[str], new: Sequence[T.StructField], f) -> DataFrame:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise IncompatibleModel(f"columns are missing: {missing}")
        keep = list(keep)
        source = df.select(*keep, *(clean(c).alias(f"__f{k}") for k, c in enumerate(self.features)))
        schema = T.StructType([*(source.schema[c] for c in keep), *new])
        n = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(np.float32) for k in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0), np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *f(x)], names=schema.names)

        return source.mapInArrow(run, schema)

    def margins(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """The columns ``keep`` and the margins m0, m1, ... of each row."""
        trees = self.chosen(iterations) if self.linear is None else None
        new = [T.StructField(f"m{k}", T.DoubleType()) for k in range(self.outputs)]
        return self._map(df, keep, new, lambda x: [pa.array(c.copy()) for c in self.margins_of(x, trees).T])

    def predict(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """keep and ``prediction`` (or prediction0, prediction1, ... for several values)."""
        rows = self.margins(df, keep, iterations)
        values = self.loss.transform([F.col(f"m{k}") for k in range(self.outputs)])
        names = ["prediction"] if len(values) == 1 else [f"prediction{k}" for k in range(len(values))]
        return rows.select(*keep, *(v.alias(n) for v, n in zip(values, names, strict=True)))

    def predict_class(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """keep and ``class``: the first largest output, or whether the one prediction exceeds 0.5."""
        rows = self.margins(df, keep, iterations)
        m = [F.col(f"m{k}") for k in range(self.outputs)]
        if self.outputs > 1:
            all_ = F.array(*m)
            return rows.select(*keep, (F.array_position(all_, F.array_max(all_)) - 1).cast("int").alias("class"))
        return rows.select(*keep, (self.loss.transform(m)[0] > 0.5).cast("int").alias("class"))

    def predict_leaf(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """keep and ``leaves``: each tree's leaf."""
        trees = self.chosen(iterations)

        def f(x: np.ndarray):
            all_ = np.stack([t.walk(x) for t in trees], axis=1) if trees else np.zeros((len(x), 0), np.int64)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(trees)), pa.array(all_.ravel().astype(np.int32)))]

        return self._map(df, keep, [T.StructField("leaves", T.ArrayType(T.IntegerType()))], f)

    def contributions(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """keep, ``output`` and ``contributions``: a value for each feature and the bias, that add up to the margin."""
        from .plans.shap import contributions

        trees = self.chosen(iterations)
        n = len(self.features)

        def f(x: np.ndarray):
            phi = contributions(self, x, trees)
            return [pa.array(phi[:, k].reshape(len(x), n + 1).tolist(), pa.list_(pa.float64())) for k in range(self.outputs)]

        new = [T.StructField(f"contributions{k}", T.ArrayType(T.DoubleType())) for k in range(self.outputs)]
        return self._map(df, keep, new, f)

    def interactions(self, df: DataFrame, keep: Sequence[str] = (), iterations=None) -> DataFrame:
        """keep and ``interactions{k}``: the flat (features + 1) squared matrix of each output."""
        from .plans.shap import interactions

        trees = self.chosen(iterations)

        def f(x: np.ndarray):
            phi = interactions(self, x, trees)
            return [pa.array(phi[:, k].reshape(len(x), -1).tolist(), pa.list_(pa.float64())) for k in range(self.outputs)]

        return self._map(df, keep, [T.StructField(f"interactions{k}", T.ArrayType(T.DoubleType())) for k in range(self.outputs)], f)

    def predict_rows(self, x: np.ndarray, iterations=None) -> np.ndarray:
        """(rows, outputs) margins of raw features on this machine, without Spark."""
        return self.margins_of(np.atleast_2d(np.asarray(x, dtype=np.float32)), None if self.linear is not None else self.chosen(iterations))

    def predict_row(self, row: dict[str, float | None], iterations=None) -> list[float]:
        """Margins of one row, given by feature name; absent features and None are missing."""
        x = [[np.nan if row.get(f) is None else row[f] for f in self.features]]
        return self.predict_rows(np.array(x, dtype=np.float32), iterations)[0].tolist()

    def predict_distribution(self, df: DataFrame, keep: Sequence[str] = (), iterations=None, quantiles: Sequence[float] = ()) -> DataFrame:
        """keep, the distribution's parameters, its ``mean`` and ``variance``, and q0, q1, ... at ``quantiles``, of a dist:* model."""
        from .functions.distributions import PARAMETERS, Dist, family_of

        family = family_of(self.objective)
        if not self.objective.startswith("dist:"):
            raise IncompatibleModel("the model predicts no distribution")
        names = [*PARAMETERS[family], "mean_value", "variance", *(f"q{k}" for k in range(len(quantiles)))]
        trees = self.chosen(iterations)

        def f(x: np.ndarray):
            d = Dist.of_margins(family, list(self.margins_of(x, trees).T))
            return [pa.array(np.asarray(v, dtype=float)) for v in (*d.p, d.mean(), d.variance(), *(d.quantile(q) for q in quantiles))]

        return self._map(df, keep, [T.StructField(c, T.DoubleType()) for c in names], f)

    def variants(self, row: dict[str, float | None], changes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Predictions of many variants of one row: a null in a feature column of ``changes`` leaves the row's own value."""
        own = {f: F.lit(None if row.get(f) is None else float(row[f])).cast("float") for f in self.features}
        full = changes.select(*keep, *(F.coalesce(F.col(f).cast("float"), v).alias(f) if f in changes.columns else v.alias(f) for f, v in own.items()))
        return self.predict(full, keep)

    def virtual_ensemble(self, df: DataFrame, keep: Sequence[str] = (), members: int = 10) -> DataFrame:
        """keep, ``mean``, ``knowledge``, ``data`` and ``total``: uncertainty over truncations of the model.

        The members end at ``members`` evenly spaced iterations of the second half.  knowledge: the
        variance of the members' predictions.  data: of a dist:* model the mean of their variances, of
        a classifier's entropy the mean of the members'; else null.  total is that of the mean
        prediction (knowledge and data together).  A classifier's are entropies.
        """
        n = self.iterations
        ends = sorted({n - (n // 2) * k // members for k in range(members)})
        groups = [[t for t in self.trees if begin <= t.iteration < end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]
        kind = "dist" if self.objective.startswith("dist:") else "classes" if self.objective in ("binary:logistic", "multi:softprob", "multi:softmax") else ""

        def entropy(p: np.ndarray) -> np.ndarray:
            return -(p * np.log(np.maximum(p, 1e-300))).sum(axis=-1)

        def f(x: np.ndarray):
            at, seen = np.tile(np.array(self.base, dtype=float), (len(x), 1)), []
            for group in groups:
                for t in group:
                    at[:, t.output] += t.weight * np.array(t.value)[t.walk(x)]
                seen.append(at.copy())
            all_ = np.stack(seen)
            none = pa.nulls(len(x), pa.float64())
            if kind == "classes":
                if self.outputs == 1:
                    p = 1 / (1 + np.exp(-all_))
                    p = np.concatenate([1 - p, p], axis=2)
                else:
                    p = np.exp(all_ - all_.max(axis=2, keepdims=True))
                    p /= p.sum(axis=2, keepdims=True)
                total, data = entropy(p.mean(axis=0)), entropy(p).mean(axis=0)
                return [pa.array(p.mean(axis=0)[:, -1].copy()), pa.array(np.maximum(total - data, 0)), pa.array(data), pa.array(total)]
            if kind == "dist":
                from .functions.distributions import Dist, family_of

                d = [Dist.of_margins(family_of(self.objective), list(m.T)) for m in all_]
                mean, data = np.stack([v.mean() for v in d]), np.mean([v.variance() for v in d], axis=0)
                return [pa.array(mean.mean(axis=0)), pa.array(mean.var(axis=0)), pa.array(data), pa.array(data + mean.var(axis=0))]
            return [pa.array(all_[..., 0].mean(axis=0)), pa.array(all_[..., 0].var(axis=0)), none, none]

        return self._map(df, keep, [T.StructField(c, T.DoubleType()) for c in ("mean", "knowledge", "data", "total")], f)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """All nodes of all trees as a table."""
        rows = [
            (k, t.iteration, t.output, t.parallel, n, t.left[n], t.right[n], t.feature[n], float(t.threshold[n]), bool(t.default_left[n]), t.categories[n], float(t.value[n]), float(t.cover[n]), float(t.gain[n]), float(t.weight))
            for k, t in enumerate(self.trees)
            for n in range(len(t.left))
        ]
        kinds = "tree int, iteration int, output int, parallel int, node_id int, left int, right int, split_feature int, split_cond double, default_left boolean, categories_left array<double>, leaf_value double, sum_hess double, split_gain double, tree_weight double"
        return spark.createDataFrame(rows, kinds)

    def importance(self, kind: str = "weight") -> dict[str, float]:
        """weight, gain, total_gain, cover or total_cover of each feature that splits."""
        total: dict[int, list[float]] = {}
        for t in self.trees:
            for n, f in enumerate(t.feature):
                if f >= 0:
                    x = total.setdefault(f, [0, 0.0, 0.0])
                    x[0] += 1
                    x[1] += t.gain[n]
                    x[2] += t.cover[n]
        pick = {"weight": lambda x: float(x[0]), "total_gain": lambda x: x[1], "total_cover": lambda x: x[2], "gain": lambda x: x[1] / x[0], "cover": lambda x: x[2] / x[0]}
        if kind not in pick:
            raise InvalidParameter(f"unknown importance {kind!r}")
        return {self.features[f]: pick[kind](x) for f, x in sorted(total.items())}

    def slice(self, begin: int, end: int, step: int = 1) -> Model:
        """The model of every step-th iteration of a range; the best iteration is dropped."""
        keep = {i: k for k, i in enumerate(range(begin, end, step))}
        if not keep or max(keep) >= self.iterations:
            raise InvalidParameter(f"iterations lie in 0..{self.iterations}")
        trees = [Tree(**{**asdict(t), "iteration": keep[t.iteration]}) for t in self.trees if t.iteration in keep]
        return Model(self.objective, self.options, self.features, self.base, trees)

    @staticmethod
    def average(models: Sequence[Model]) -> Model:
        """The model whose margin is the mean of the models' margins."""
        first = models[0]
        if any(m.objective != first.objective or m.features != first.features or m.outputs != first.outputs or m.linear is not None for m in models):
            raise IncompatibleModel("models of one objective and one set of features can be averaged")
        n, trees, begin = len(models), [], 0
        for m in models:
            trees += [Tree(**{**asdict(t), "iteration": begin + t.iteration, "value": [v / n for v in t.value]}) for t in m.chosen()]
            begin += m.iterations
        return Model(first.objective, first.options, first.features, list(np.mean([m.base for m in models], axis=0)), trees)

    def bounds(self, low: Sequence[float], high: Sequence[float]) -> list[tuple[float, float]]:
        """Sound bounds of each output's margin over a box of features."""
        out = [[b, b] for b in self.base]
        for t in self.chosen():
            reach, ends = [0], []
            while reach:
                n = reach.pop()
                if t.left[n] < 0:
                    ends.append(t.weight * t.value[n])
                    continue
                f = t.feature[n]
                if t.categories[n] is not None or low[f] < t.threshold[n]:
                    reach.append(t.left[n])
                if t.categories[n] is not None or high[f] >= t.threshold[n]:
                    reach.append(t.right[n])
            out[t.output][0] += min(ends)
            out[t.output][1] += max(ends)
        return [tuple(x) for x in out]

    def to_json(self) -> str:
        return json.dumps({"format": "sparkboost-1", "objective": self.objective, "options": {k: v for k, v in self.options.items() if not callable(v)}, "features": self.features, "base": self.base, "best_iteration": self.best_iteration, "linear": self.linear, "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        x = json.loads(text)
        if x.pop("format", None) != "sparkboost-1":
            raise IncompatibleModel("not a model of this library")
        x["trees"] = [Tree(**t) for t in x["trees"]]
        return Model(**x)
