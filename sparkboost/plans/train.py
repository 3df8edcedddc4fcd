"""Training: a driver loop of rounds over one cached table of packed rows.

A round needs one job that forms its gradients, with their bounds, and one for each level of its
trees.  The trees of all outputs and of a forest grow at once: they share those jobs.  Rows are kept
as packed codes and margins; gradients are column expressions, which are held with the codes in blocks
of many rows for the levels; histograms and margins are made in Arrow batches, and only best splits
come to the driver.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleModel, InvalidData, InvalidParameter
from ..functions.losses import Objective, objective
from ..functions.metrics import evaluate, lookup
from ..functions.rng import draw, normal, uniform
from ..model import Model, Router, Tree
from ..operators import histogram
from ..operators.binning import Cuts, clean, from_bytes, make_cuts, packed
from ..operators.order import batches_of, hold, releasing
from ..operators.split import Node, Regularisation, chunks
from ..params import Params, parse
from .matrix import BinnedMatrix

#: Rounds after which the rows' lineage is cut, where the session has a checkpoint folder.
CHECKPOINT = 10
#: Levels of a best-first tree over which parents' sums are handed on before both children are counted again.
CHAIN = 8
#: Objectives of one output that also take several label columns, an output for each.
ELEMENTWISE = ("reg:squarederror", "reg:squaredlogerror", "reg:pseudohubererror", "reg:absoluteerror", "reg:logistic", "binary:logistic", "count:poisson", "reg:gamma", "reg:tweedie")


@dataclass
class Grown:
    """A tree that grows (or the trees of one structure, by output), with the nodes that may still be split."""

    trees: list[Tree]
    slot: int
    outputs: list[int]
    features: list[int]
    nodes: dict[int, Node] = field(default_factory=dict)

    @property
    def tree(self) -> Tree:
        return self.trees[0]


def _unmeasured(f):
    """Rows of few features go to Python in batches that are limited by their number alone."""

    @functools.wraps(f)
    def run(params, df, features, *args, **options):
        spark = (df.rows if isinstance(df, BinnedMatrix) else df).sparkSession
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows * 8 * (len(features) + 16) <= 1 << 26:
            return f(params, df, features, *args, **options)
        with batches_of(spark, (1 << 31) - 1):
            return f(params, df, features, *args, **options)

    return run


@_unmeasured
def train(
    params: Params | dict,
    df: DataFrame | BinnedMatrix,
    features: Sequence[str],
    label: str | Sequence[str],
    rounds: int,
    *,
    weight: str | None = None,
    qid: str | None = None,
    row_id: str | None = None,
    categorical: Sequence[str] = (),
    base_margin: Sequence[str] | None = None,
    split_group: str | None = None,
    feature_weights: dict[str, float] | None = None,
    evals: dict[str, DataFrame] | None = None,
    early_stopping_rounds: int | None = None,
    custom_metric: tuple[str, Callable[[DataFrame, list[str]], float]] | None = None,
    init_model: Model | None = None,
    on_round: Callable[[int, Model], bool | None] | None = None,
) -> Model:
    """Fits a model on df, or on rows that ``BinnedMatrix`` has binned (tree_method hist).

    label: a column, or several for an elementwise objective, which then has an output for each.
    row_id: a column of distinct whole numbers; row sampling is a pure function of it (without one,
    of a hash of the row, so that equal rows share their draws).  feature_weights: of column
    sampling, 1 if not given.  split_group: a column of which both children of a split must hold
    min_child_groups values (numeric features only).  evals: tables to evaluate after every round.  early_stopping_rounds:
    rounds without a strict improvement of the last metric of the last table, after which training
    ends.  on_round: called after each round; True ends training.
    """
    if isinstance(params, dict):
        params = parse(params)
    labels = [label] if isinstance(label, str) else list(label)
    loss = objective(params.objective, **({**params.loss, "targets": len(labels)} if len(labels) > 1 else params.loss))
    if params.booster == "gblinear":
        from .linear import train_linear

        refused = {"evals": evals, "early_stopping_rounds": early_stopping_rounds, "categorical": categorical, "base_margin": base_margin, "custom_metric": custom_metric, "feature_weights": feature_weights, "labels": labels[1:]}
        if wrong := [k for k, v in refused.items() if v]:
            raise InvalidParameter(f"gblinear doesn't take {', '.join(wrong)}")
        return train_linear(params, loss, df, features, labels[0], rounds, weight=weight, init_model=init_model)
    if params.process_type == "update":
        from .refresh import refreshed

        if init_model is None or len(labels) > 1:
            raise InvalidParameter("process_type update needs a model, and one label")
        return refreshed(params, init_model, df, labels[0], weight=weight)
    if init_model and list(features) != init_model.features:
        raise IncompatibleModel("the model has other features")
    if params.bagging_by_query and not qid:
        raise InvalidParameter("bagging_by_query needs qid")
    if params.multi_strategy == "multi_output_tree" and (params.booster != "gbtree" or params.tree_method == "exact"):
        raise InvalidParameter("vector leaves need booster gbtree and tree_method hist or approx")
    if params.min_child_groups > 1 and (not split_group or categorical):
        raise InvalidParameter("min_child_groups needs split_group, and numeric features")
    exact, approx = params.tree_method == "exact", params.tree_method == "approx"
    matrix = df if isinstance(df, BinnedMatrix) else None
    if matrix is not None:
        if exact or approx or init_model or list(features) != matrix.cuts.features:
            raise InvalidParameter("a binned matrix needs tree_method hist, its own features and no init_model")
        df, categorical = matrix.rows, [f for f, c in zip(features, matrix.cuts.categorical, strict=True) if c]
    sampled = params.subsample < 1 or params.balanced_bagging is not None
    drawn = sampled or params.langevin or params.quantized_bins > 0
    source = _source(df, labels, weight, qid, row_id, base_margin, ["codes"] if matrix is not None else features, split_group=split_group if params.min_child_groups > 1 else None, need_ids=drawn or params.objective.startswith(("rank:", "survival:cox")))
    names = [c for c in source.columns if c not in features]
    _check_labels(source, loss, len(labels))
    cut = lambda rows, w: make_cuts(rows, features, max_bin=params.max_bin, categorical=categorical, weight=w, exact=exact)
    cuts = matrix.cuts if matrix is not None else cut(source, F.col("weight"))
    base = list(init_model.base) if init_model else ([loss.link(params.base_score)] * loss.outputs if params.base_score is not None else loss.intercepts(source, "label", F.col("weight")))
    raw = approx or (params.booster == "dart" and init_model is not None)

    def prepared(rows: DataFrame) -> DataFrame:
        """Rows with margins, and with codes or raw features."""
        own = [c for c in rows.columns if c not in features]
        if init_model:
            margins = [f"m{k}" for k in range(len(base))]
            rows = init_model.margins(rows, [*own, *features], iterations=(0, init_model.iterations)).drop(*(f"__base{k}" for k in range(len(base_margin or []))))
            own = [*(c for c in own if not c.startswith("__base")), *margins]
            base_, given = None, None
        else:
            base_, given = base, base_margin
        out = packed(rows, cuts, [*own, *(features if raw else [])])
        return _spread(_start(out, base_, given)).persist(StorageLevel.MEMORY_AND_DISK)

    state = prepared(source) if matrix is None else _spread(_start(source, base, base_margin)).persist(StorageLevel.MEMORY_AND_DISK)
    tables = {}
    same = {name for name, e in (evals or {}).items() if e is df}  # the training rows' own margins
    for name, e in (evals or {}).items():
        tables[name] = state if name in same else prepared(_source(e, labels, weight, qid, row_id, base_margin, features, need_ids=params.objective.startswith(("rank:", "survival:cox"))))
    model = Model(params.objective, {**params.loss, "targets": len(labels)} if len(labels) > 1 else params.loss, list(features), base, list(init_model.trees) if init_model else [])
    done = model.iterations
    metrics = params.eval_metric or [loss.metric]
    best_value, stale, old = None, 0, []
    cut_again = approx and not constant_hessian(params)
    for i in range(done, done + rounds):
        if params.objective == "rank:xendcg":
            loss.options.update(seed=params.seed, iteration=i)
        if params.model_shrink_rate and i:
            s = 1 - params.model_shrink_rate * params.eta if params.model_shrink_mode == "constant" else 1 - params.model_shrink_rate / i
            model.base = [b * s for b in model.base]
            for t in model.trees:
                t.weight *= s
            state, tables = _scaled(state, s), {k: _scaled(t, s) for k, t in tables.items() if k not in same}
            tables |= dict.fromkeys(same, state)
        dropped = _dropped(params, model, i)
        seen = _updated(state, dropped, [-t.weight for t in dropped], cuts, features if raw else None) if dropped else state
        if cut_again and i > done:
            cuts = cut(*_hessians(loss, seen))
            seen = packed(seen.drop("codes"), cuts, [c for c in seen.columns if c != "codes"])
        trees = _round(params, loss, cuts, seen, i, model.trees, feature_weights or {}, lambda: [x.unpersist() for x in old])
        old = []
        factors = [1.0] * len(trees)
        if params.booster == "dart":
            factors = _rescaled(params, trees, dropped)
        model.trees += trees
        changed = [*trees, *dropped]
        factors = [*(t.weight for t in trees), *factors[len(trees) :]]
        old = [state, *(t for k, t in tables.items() if k not in same)]
        advance = lambda t, own=changed, f=factors, cuts=cuts: _kept(_updated(t, own, f, cuts, features if raw else None), i)
        state = advance(state)
        tables = {k: state if k in same else advance(t) for k, t in tables.items()}
        stop = False
        for name, t in tables.items():
            shown = _shown(loss, t)
            for m in metrics:
                if len(labels) > 1:
                    value = float(_over_labels(m, shown, labels, params.loss).first()["value"])
                else:
                    with releasing():
                        value = float(evaluate(m, shown, _preds(loss, m), weight=F.col("weight"), qid="qid" if qid else None, **_metric_options(params)).first()["value"])
                model.history.append((i, name, m, value))
            if custom_metric:
                m, value = custom_metric[0], float(custom_metric[1](shown, _preds(loss, "")))
                model.history.append((i, name, m, value))
        if early_stopping_rounds and tables:
            larger = lookup(m)[1] if not custom_metric else False
            better = not math.isnan(value) and (best_value is None or (value > best_value if larger else value < best_value))
            if better:
                best_value, model.best_iteration, stale = value, i, 0
            else:
                stale += 1
                stop = stale >= early_stopping_rounds
        if on_round and on_round(i, model):
            stop = True
        if stop:
            break
    for t in (*old, state, *tables.values()):
        t.unpersist()
    return model


def constant_hessian(params: Params) -> bool:
    """Whether the Hessian is the row's weight, whatever the margins."""
    return params.objective == "reg:squarederror"


def _metric_options(params: Params) -> dict:
    return {**params.loss, "objective": params.objective}


def _over_labels(metric: str, shown: DataFrame, labels: Sequence[str], options: dict) -> DataFrame:
    """An elementwise metric over all cells of several labels."""
    each = F.explode(F.array(*(F.struct(F.col(f"p{k}").alias("p0"), F.col("label" if not k else f"label{k}").alias("label")) for k in range(len(labels)))))
    return evaluate(metric, shown.select("weight", each.alias("e")).select("weight", "e.*"), ["p0"], weight=F.col("weight"), **options)


def _hessians(loss: Objective, rows: DataFrame) -> tuple[DataFrame, object]:
    """Rows with their gradients prepared, and the weight of a row in the next cuts: the sum of its Hessians."""
    margins = _margins(rows)
    rows = loss.prepare(rows, margins, "label", F.col("weight"))
    pairs = loss.pairs([F.col(m) for m in margins], F.col("label"), F.col("weight"))
    return rows, sum((h for _, h in pairs[1:]), pairs[0][1])


def _spread(rows: DataFrame) -> DataFrame:
    """rows on as many partitions as there are cores at least: every round reads them many times."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _source(df, labels, weight, qid, row_id, base_margin, features, need_ids, split_group=None) -> DataFrame:
    if set(labels) & set(features):
        raise InvalidParameter("the label must not be a feature")
    cols = [F.col(c).cast("double").alias("label" if not k else f"label{k}") for k, c in enumerate(labels)]
    cols.append((F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    cols += [F.col(c).cast("double").alias(c) for c in ("label_lower", "label_upper") if c in df.columns and c not in features]
    if qid:
        cols.append(F.col(qid).alias("qid"))
    if split_group:
        cols.append(F.xxhash64(split_group).alias("grp"))
    if row_id:
        cols.append(F.col(row_id).cast("long").alias("row_id"))
    elif need_ids:
        cols.append(F.xxhash64(*labels, *([qid] if qid else []), *features).alias("row_id"))
    cols += [F.col(c).cast("double").alias(f"__base{k}") for k, c in enumerate(base_margin or [])]
    return df.select(*cols, *(F.col(f) if f == "codes" else clean(f).alias(f) for f in features))


def _check_labels(source: DataFrame, loss: Objective, n: int) -> None:
    bad = F.lit(False)
    for c in ["label", *(f"label{k}" for k in range(1, n))]:
        bad = bad | F.col(c).isNull() | F.isnan(c)
        rule = loss.allowed(F.col(c))
        if rule is not None:
            bad = bad | ~rule
    row = source.agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.sum(F.when((F.col("weight") < 0) | F.col("weight").isNull(), 1).otherwise(0)).alias("negative"), F.max("weight").alias("most")).first()
    if not row["n"]:
        raise InvalidData("there are no rows")
    if row["bad"]:
        raise InvalidData(f"{row['bad']} labels aren't allowed by {loss.name}")
    if row["negative"] or not row["most"] > 0:
        raise InvalidData("weights must not be negative, and one must be positive")


def _start(rows: DataFrame, base, base_margin) -> DataFrame:
    if base is None:
        return rows
    for k, b in enumerate(base):
        rows = rows.withColumn(f"m{k}", F.col(f"__base{k}") if base_margin and k < len(base_margin) else F.lit(float(b)))
    return rows.drop(*(f"__base{k}" for k in range(len(base_margin or []))))


def _margins(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:1] == "m" and c[1:].isdigit()]


def _preds(loss: Objective, metric: str) -> list[str]:
    n = 1 if loss.name == "multi:softmax" and metric not in ("mlogloss", "merror", "") else len(loss.transform([F.lit(0.0)] * loss.outputs))
    return [f"p{k}" for k in range(loss.outputs if loss.name == "multi:softmax" and metric in ("mlogloss", "merror") else n)]


def _shown(loss: Objective, rows: DataFrame) -> DataFrame:
    """Rows with transformed predictions p0, p1, ..."""
    m = [F.col(c) for c in _margins(rows)]
    values = loss.probabilities(m) if hasattr(loss, "probabilities") else loss.transform(m)
    for k, v in enumerate(values):
        rows = rows.withColumn(f"p{k}", v)
    return rows


def _scaled(rows: DataFrame, factor: float) -> DataFrame:
    return rows.withColumns({m: F.col(m) * factor for m in _margins(rows)})


def _updated(rows: DataFrame, trees: Sequence[Tree], factors: Sequence[float], cuts: Cuts, raw: Sequence[str] | None) -> DataFrame:
    """Rows with each tree's values times its factor added to their margins; one pass, no shuffle.

    Rows are routed by their codes, or by their raw features if the trees may have other cuts.
    """
    names, n, code = rows.columns, len(cuts.features), cuts.code
    place = {c: k for k, c in enumerate(names)}
    parts = [(t if raw else Router(t, cuts), np.array(t.value) * f, place[f"m{t.output}"]) for t, f in zip(trees, factors, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            if raw:
                x = np.stack([batch.column(place[f]).to_numpy(zero_copy_only=False).astype(np.float32) for f in raw], axis=1)
            else:
                x = from_bytes(batch.column(place["codes"]), n, code)
            at: dict[int, np.ndarray] = {}
            for route, value, m in parts:
                old = at.get(m)
                if old is None:
                    old = columns[m].to_numpy(zero_copy_only=False)
                at[m] = old + value[route.walk(x) if raw else route(x)]
            for m, value in at.items():
                columns[m] = pa.array(value)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


def _kept(rows: DataFrame, i: int) -> DataFrame:
    if (i + 1) % CHECKPOINT == 0 and not rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        rows = rows.checkpoint(eager=False)
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _dropped(params: Params, model: Model, i: int) -> list[Tree]:
    if params.booster != "dart" or not model.trees or draw(params.seed, i, -1) < params.skip_drop:
        return []
    out = [t for k, t in enumerate(model.trees) if draw(params.seed, i, k) < params.rate_drop]
    return out or ([model.trees[int(draw(params.seed, i, -2) * len(model.trees))]] if params.one_drop else [])


def _rescaled(params: Params, trees: Sequence[Tree], dropped: Sequence[Tree]) -> list[float]:
    """The new trees and the k dropped ones share the step: 1 / (k + eta) and k / (k + eta).

    Returned: how much of each tree's values the margins of all rows then lack.
    """
    k = len(dropped)
    for t in trees:
        t.weight = 1 / (k + params.eta) if k else 1.0
    lacking = [t.weight for t in trees]
    for t in dropped:
        old = t.weight
        t.weight *= k / (k + params.eta)
        lacking.append(t.weight - old)
    return lacking


def _gradients(params: Params, loss: Objective, state: DataFrame, i: int) -> tuple[DataFrame, int]:
    """codes, g and h of each output, and what sampling needs (key, chance), of the rows with a weight; number of outputs."""
    margins = _margins(state)
    rows = loss.prepare(state, margins, "label", F.col("weight"))
    pairs = loss.pairs([F.col(m) for m in margins], F.col("label"), F.col("weight"))
    for k, (g, h) in enumerate(pairs):
        rows = rows.withColumn(f"g{k}", g.cast("float")).withColumn(f"h{k}", h.cast("float"))
    outputs = [f"{c}{k}" for k in range(len(pairs)) for c in "gh"]
    columns = ["codes", *outputs]
    if "row_id" in rows.columns:
        key = F.xxhash64("qid") if params.bagging_by_query else F.col("row_id")
        columns.append(key.alias("key"))
    if "grp" in rows.columns:
        columns.append("grp")
    if params.balanced_bagging:
        columns.append(F.when(F.col("label") == 1, params.balanced_bagging[0]).otherwise(params.balanced_bagging[1]).alias("chance"))
    rows = rows.where(F.col("weight") > 0)
    if params.sampling_method == "gradient_based" and params.subsample < 1:
        from ..operators.sampling import gradient_threshold

        rows = hold(rows.select(*columns, "weight"))
        norm = F.sqrt(sum((F.col(f"g{k}") * F.col(f"g{k}") + 0.1 * F.col(f"h{k}") * F.col(f"h{k}") for k in range(len(pairs))), F.lit(0.0)))
        u = gradient_threshold(rows, norm, params.subsample)
        rows = rows.withColumn("chance", F.least(F.lit(1.0), norm / F.lit(u)) if u > 0 else F.lit(1.0))
        for c in outputs:
            rows = rows.withColumn(c, (F.col(c) / F.col("chance")).cast("float"))
        columns = [*columns, "chance"]
    return rows.select(*columns), len(pairs)


def _quantized(params: Params, rows: DataFrame, n: int, most: Sequence[float], least_h: float, i: int) -> DataFrame:
    """Gradients and Hessians rounded (at random by default) to whole multiples of a scale."""
    half = params.quantized_bins // 2
    scale = {"g": most[0] / half, "h": most[1] / params.quantized_bins}
    for k in range(n):
        for c in "gh":
            if not scale[c] or (c == "h" and least_h == most[1]):
                continue
            x = F.col(f"{c}{k}").cast("double") / scale[c]
            u = uniform(F.col("key"), params.seed, i, (2 * k + (c == "h") + 1) << 24) if params.quantized_stochastic else F.lit(0.5)
            rows = rows.withColumn(f"{c}{k}", (F.when(x >= 0, F.floor(x + u)).otherwise(F.ceil(x - u)) * scale[c]).cast("float"))
    return rows


def _round(params: Params, loss: Objective, cuts: Cuts, state: DataFrame, i: int, before: Sequence[Tree], feature_weights: dict[str, float], ready: Callable[[], object]) -> list[Tree]:
    with releasing():
        return _grown(params, loss, cuts, state, i, before, feature_weights, ready)


def _grown(params: Params, loss: Objective, cuts: Cuts, state: DataFrame, i: int, before: Sequence[Tree], feature_weights: dict[str, float], ready: Callable[[], object]) -> list[Tree]:
    rows, n_outputs = _gradients(params, loss, state, i)
    n, code = len(cuts.features), cuts.code
    sigma = math.sqrt(2 / (params.eta * params.diffusion_temperature)) if params.langevin else 0.0
    renewed = sigma or params.quantized_bins  # rows are read besides the levels
    kept = renewed and (loss.costly or params.subsample < 1 and params.sampling_method == "gradient_based")
    counted = rows
    if renewed:
        if kept:
            rows = counted = rows.persist(StorageLevel.MEMORY_AND_DISK)
        sums = [F.count("*").alias("n")]
        for k in range(n_outputs):
            sums += [F.max(F.abs(F.col(f"{c}{k}"))).alias(f"m{c}{k}") for c in "gh"] + [F.min(f"h{k}").alias(f"l{k}")]
        total = rows.agg(*sums).first()
        n_rows, most = total["n"], [max((total[f"m{c}{k}"] or 0.0) for k in range(n_outputs)) for c in "gh"]
        _finite(most)
        if params.quantized_bins:
            counted = _quantized(params, rows, n_outputs, most, min(total[f"l{k}"] for k in range(n_outputs)), i)
        for k in range(n_outputs if sigma else 0):
            counted = counted.withColumn(f"g{k}", (F.col(f"g{k}") + sigma * normal(F.col("key"), params.seed, i, 100 + k)).cast("float"))
    own = set(counted.columns) - (set() if params.balanced_bagging or params.subsample < 1 else {"key"})
    counted = histogram.in_blocks(counted.select(*(c for c in counted.columns if c in own)), n, code).persist(StorageLevel.MEMORY_AND_DISK)
    held = histogram.totals(counted, n_outputs)
    if not renewed:
        n_rows, most = held
        _finite(most)
    ready()
    if sigma:
        most[0] += 9 * sigma
    shift = histogram.shifts(n_rows, most)
    constraints = {cuts.features.index(f): d for f, d in params.monotone_constraints.items() if d}
    reg = Regularisation(params.lambda_, params.alpha, params.gamma, params.min_child_weight, params.step_bound, constraints, params.path_smooth, params.extra_trees, params.extra_seed, params.toad_penalty_feature, params.toad_penalty_threshold, params.min_child_groups)
    vector = params.multi_strategy == "multi_output_tree"
    slots = [(list(range(n_outputs)), p) for p in range(params.num_parallel_tree)] if vector else [([k], p) for k in range(n_outputs) for p in range(params.num_parallel_tree)]
    sampler = _Columns(params, cuts, i, feature_weights)
    grown = []
    for s, (outputs, p) in enumerate(slots):
        pool = [i % len(cuts.features)] if params.booster == "ebm" else range(len(cuts.features))
        x = Grown([Tree(iteration=i, output=k, parallel=p) for k in outputs], s, outputs, sampler.tree(pool, s))
        x.nodes[0] = Node(np.full(len(outputs), -math.inf), np.full(len(outputs), math.inf), key=(params.seed, i, s, 0))
        grown.append(x)
    sample = None
    if params.balanced_bagging or "chance" in rows.columns:
        sample = histogram.Sample(params.seed, i)
    elif params.subsample < 1:
        sample = histogram.Sample(params.seed, i, params.subsample)
    grower = _Grower(params, cuts, counted, reg, shift, sample, sampler, before)
    if params.grow_policy == "lossguide":
        grower.by_loss(grown)
    else:
        grower.by_depth(grown)
    grower.close()
    counted.unpersist()
    trees = [t for x in grown for t in x.trees]
    if params.leaf_estimation == "exact":
        _exact_leaves(params, loss, state, trees, cuts)
    elif sigma or (params.quantized_bins and params.quantized_renew):
        _renewed_leaves(params, reg, rows, trees, cuts, shift, sigma, i)
    if kept:
        rows.unpersist()
    for t in trees:
        t.value = [v * params.eta / params.num_parallel_tree for v in t.value]
    return trees


def _finite(most: Sequence[float]) -> None:
    if any(math.isnan(x) or math.isinf(x) for x in most):
        raise InvalidData("a gradient is not finite")


def _renewed_leaves(params: Params, reg: Regularisation, rows: DataFrame, trees: Sequence[Tree], cuts: Cuts, shift, sigma: float, i: int) -> None:
    """Leaves from the whole gradients of all their rows, with noise of their own on the sums if sigma isn't 0."""
    got = histogram.leaf_sums(rows, [Router(t, cuts) for t in trees], [t.output for t in trees], len(cuts.features), cuts.code, shift)
    for s, t in enumerate(trees):
        for node in t.leaves():
            g, h, _ = got.get((s, node), (0.0, 0.0, 0))
            if h <= 0 or h < params.min_child_weight:
                t.value[node] = 0.0
                continue
            if sigma:
                u, v = (max(draw(params.seed, i, s, node, k, 31), 1e-18) for k in (0, 1))
                g += sigma * math.sqrt(abs(h) + params.lambda_) * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
            t.value[node] = reg.number(g, h)


def _exact_leaves(params: Params, loss: Objective, state: DataFrame, trees: Sequence[Tree], cuts: Cuts) -> None:
    """Every leaf's quantile of the residuals of all rows that it holds, sampled or not."""
    from .exact_leaves import leaf_quantiles

    alphas = list(params.loss.get("quantile_alpha", [0.5])) if params.objective == "reg:quantileerror" else [0.5] * loss.outputs
    n, code = len(cuts.features), cuts.code
    for t in trees:
        router, label = Router(t, cuts), "label" if params.objective == "reg:quantileerror" or not t.output else f"label{t.output}"
        source = state.where("weight > 0").select("codes", (F.col(label) - F.col(f"m{t.output}")).alias("residual"), "weight")

        def run(batches: Iterator[pa.RecordBatch], router=router) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(router(from_bytes(batch.column(0), n, code))), batch.column(1), batch.column(2)], names=["leaf", "residual", "weight"])

        leaves = source.mapInArrow(run, "leaf long, residual double, weight double")
        weighted = not leaves.where("weight <> 1").isEmpty()
        for r in leaf_quantiles(leaves, "leaf", "residual", alphas[t.output], weight="weight" if weighted else None).collect():
            v = r["value"]
            t.value[r["leaf"]] = max(min(v, params.step_bound), -params.step_bound) if params.step_bound > 0 else v


class _Columns:
    """Draws of features for trees, levels and nodes; each keeps at least one."""

    def __init__(self, params: Params, cuts: Cuts, iteration: int, weights: dict[str, float]) -> None:
        self.params, self.iteration = params, iteration
        self.weights = {cuts.features.index(f): w for f, w in weights.items()}

    def _drawn(self, features: Sequence[int], share: float, *keys: int) -> list[int]:
        features = list(features)
        n = max(1, int(np.float32(share) * len(features))) if features else 0
        if n == len(features):
            return features
        rank = lambda f: -math.log(max(draw(self.params.seed, self.iteration, *keys, f), 1e-300)) / max(self.weights.get(f, 1.0), 1e-6)
        return sorted(sorted(sorted(features), key=rank)[:n])

    def tree(self, pool: Sequence[int], slot: int) -> list[int]:
        return self._drawn(pool, self.params.colsample_bytree, slot)

    def level(self, pool: Sequence[int], slot: int, depth: int) -> list[int]:
        return self._drawn(pool, self.params.colsample_bylevel, slot, depth, 3)

    def node(self, pool: Sequence[int], slot: int, node: int) -> list[int]:
        return self._drawn(pool, self.params.colsample_bynode, slot, node, 7)


class _Grower:
    """Finds splits of many nodes of many trees in one job."""

    def __init__(self, params: Params, cuts: Cuts, rows: DataFrame, reg: Regularisation, shift, sample, sampler: _Columns, before: Sequence[Tree]) -> None:
        self.params, self.cuts, self.rows, self.reg, self.shift, self.sample, self.sampler = params, cuts, rows, reg, shift, sample, sampler
        self.groups = [{cuts.features.index(f) for f in g} for g in params.interaction_constraints]
        #: Parents hold the sums of all features that their children may use.
        self.handed_on = params.colsample_bylevel == 1 and params.colsample_bynode == 1
        self.whole: dict[tuple[int, int], tuple[DataFrame, int]] = {}  # by open node: where its sums are, and how long its chain is
        self.tables: list[DataFrame] = []
        self.used = None
        if params.toad_penalty_feature or params.toad_penalty_threshold:
            self.used = (set(), set())
            for t in before:
                for n in range(len(t.left)):
                    if t.left[n] >= 0:
                        self._use(t.feature[n], t.threshold[n], t.categories[n])

    def _use(self, feature: int, threshold: float, categories) -> None:
        self.used[0].add(feature)
        self.used[1].add((feature, float(threshold) if categories is None else tuple(sorted(categories))))

    def allowed(self, x: Grown, node: int, depth: int) -> frozenset[int]:
        out = self.sampler.level(x.features, x.slot, depth)
        if self.groups:
            parents, path = x.tree.parents(), set()
            n = node
            while n in parents:
                n = parents[n]
                path.add(x.tree.feature[n])
            open_ = set().union(*(g for g in self.groups if path <= g)) | path if path else set(range(len(self.cuts.features)))
            out = [f for f in out if f in open_]
        return frozenset(self.sampler.node(out, x.slot, node))

    def find(self, frontier: list[tuple[Grown, list[int], dict[int, tuple[int, int]]]], depth: int, last: bool) -> dict:
        """Totals and best splits of the frontier's nodes, by (slot, node).

        frontier: trees with the nodes to search, and by parent its two children, the one with
        fewer rows first.  last: no node below will be searched.
        """
        symmetric = self.params.grow_policy == "symmetric"
        if not hasattr(self, "parts"):  # the same for all levels, so that parents' sums fit
            features = sorted({f for x, *_ in frontier for f in x.features})
            self.parts = chunks(features, self.cuts.sizes, self.cuts.categorical, histogram.CHUNK_CELLS)
        tasks, nodes, parents = [], {}, {}
        wide = 0
        for x, own, pairs in frontier:
            up = {c: p for p, both in pairs.items() for c in both}
            count, others = [], {}
            for n in own:
                x.nodes[n].allowed = self.allowed(x, n, depth)
                nodes[x.slot, n] = x.nodes[n]
                p = up.get(n)
                here = self.whole.get((x.slot, p)) if p is not None and self.handed_on else None
                if here is not None and here[1] < CHAIN:
                    others[p] = pairs[p]
                    parents.setdefault(id(here[0]), (here[0], {}))[1].setdefault(x.slot, set()).add(p)
                    if n == pairs[p][0]:
                        count.append(n)
                else:
                    count.append(n)
            groups = {n: 0 if symmetric else up.get(n, -1) for n in own}
            tasks.append(histogram.Task(x.slot, Router(x.tree, self.cuts), count, x.outputs, groups, others, own))
            wide += len(count) * (2 * len(x.outputs) + 1)
        # in one pass, or in several over features where a level is too large for a task's memory
        per = max(1, histogram.TASK_CELLS // max(wide, 1))
        sums, first = None, 0
        while first < len(self.parts):
            stop, held = first + 1, self.parts[first].cells
            while stop < len(self.parts) and held + self.parts[stop].cells <= per:
                held += self.parts[stop].cells
                stop += 1
            part = histogram.partial_sums(self.rows, tasks, self.parts[first:stop], len(self.cuts.features), self.cuts.code, self.shift, self.sample, first)
            sums, first = part if sums is None else sums.unionByName(part), stop
        if sums is None:
            return {}
        if self.params.min_child_groups > 1:
            sums = sums.unionByName(histogram.group_counts(self.rows, tasks, self.parts, len(self.cuts.features), self.cuts.code, self.sample))
        for table, wanted in parents.values():
            sums = sums.unionByName(histogram.parent_sums(table, {s: sorted(p) for s, p in wanted.items()}, symmetric=symmetric))
        whole = histogram.searched(sums, tasks, self.parts, self.reg, self.shift, nodes, symmetric=symmetric, used=self.used, cuts=self.cuts.values)
        keep = self.handed_on and not last
        if keep:
            whole = whole.persist(StorageLevel.MEMORY_AND_DISK)
        with batches_of(whole.sparkSession, histogram.SENT_BYTES):
            found = whole.drop("sums").collect()
        if keep:
            chain = 1 + max((c for _, c in self.whole.values()), default=0) if parents else 0
            self.tables.append(whole)
            self.whole.update({k: (whole, chain) for k in nodes})
        return histogram.merged_level(found) if symmetric else histogram.merged(found)

    def release(self, open_: set[tuple[int, int]]) -> None:
        """Drops the sums of nodes that no search will ask for again."""
        self.whole = {k: v for k, v in self.whole.items() if k in open_}
        need = {id(t) for t, _ in self.whole.values()}
        for t in [t for t in self.tables if id(t) not in need]:
            t.unpersist()
            self.tables.remove(t)

    def close(self) -> None:
        self.release(set())

    def root(self, x: Grown, found: dict) -> None:
        at = found.get((x.slot, 0))
        for j, t in enumerate(x.trees):
            if at:
                t.value[0] = self.reg.number(at["g"][j], at["h"][j])
                t.cover[0] = float(sum(at["h"]))

    def apply(self, x: Grown, r) -> tuple[int, int]:
        f, node = r["feature"], r["node"]
        cuts = self.cuts.values[f]
        cats = [float(cuts[b]) for b in r["categories"]] if r["categories"] is not None else None
        for t in x.trees:
            a, b = t.split(node, f, r["bin"], float(cuts[r["bin"]]), bool(r["default_left"]), cats, float(r["loss"]))
        low, high = x.nodes[node].low, x.nodes[node].high
        for child, c in ((a, "l"), (b, "r")):
            w = np.array(r[f"w{c}"])
            for j, t in enumerate(x.trees):
                t.value[child], t.cover[child] = float(w[j]), float(sum(r[f"h{c}"]))
            x.nodes[child] = Node(low.copy(), high.copy(), w, key=(*x.nodes[0].key[:3], child))
        way = self.reg.monotone.get(f, 0)
        if way:
            middle = (x.nodes[a].value + x.nodes[b].value) / 2
            up, down = (a, b) if way > 0 else (b, a)
            x.nodes[up].high, x.nodes[down].low = middle, middle
        if self.used is not None:
            self._use(f, float(cuts[r["bin"]]), cats)
        return (a, b) if r["nl"] <= r["nr"] else (b, a)

    def by_depth(self, grown: list[Grown]) -> None:
        at = {x.slot: x for x in grown}
        frontier = [(x, [0], {}) for x in grown]
        depth = 0
        while frontier and (self.params.max_depth == 0 or depth < self.params.max_depth):
            found = self.find(frontier, depth, depth + 1 == self.params.max_depth)
            if not depth:
                for x in grown:
                    self.root(x, found)
            pairs: dict[int, dict[int, tuple[int, int]]] = {}
            for (slot, node), r in sorted(found.items()):
                if r["split"] is not None:
                    pairs.setdefault(slot, {})[node] = self.apply(at[slot], r["split"])
            frontier = [(at[s], sorted(c for both in own.values() for c in both), own) for s, own in pairs.items()]
            self.release({(s, p) for s, own in pairs.items() for p in own})
            depth += 1

    def by_loss(self, grown: list[Grown]) -> None:
        """Best first: in each job the next nodes of all trees are looked at."""
        p, at = self.params, {x.slot: x for x in grown}
        heaps: dict[int, list] = {x.slot: [] for x in grown}
        leaves = {x.slot: 1 for x in grown}
        frontier, step = [(x, [0], {}) for x in grown], 0
        while frontier:
            found = self.find(frontier, step, False)
            if not step:
                for x in grown:
                    self.root(x, found)
            for (slot, node), r in found.items():
                if r["split"] is not None:
                    heapq.heappush(heaps[slot], (-r["split"]["loss"], node, r["split"]))
            step += 1
            frontier = []
            for s, heap in heaps.items():
                while heap and (not p.max_leaves or leaves[s] < p.max_leaves):
                    _, node, r = heapq.heappop(heap)
                    both = self.apply(at[s], r)
                    leaves[s] += 1
                    if p.max_depth and at[s].tree.depth[both[0]] >= p.max_depth:
                        continue
                    if not p.max_leaves or leaves[s] < p.max_leaves:
                        frontier.append((at[s], sorted(both), {node: both}))
                        break
            self.release({(s, n) for s, heap in heaps.items() for _, n, _ in heap} | {(x.slot, q) for x, _, pairs in frontier for q in pairs})


def cover_check(model: Model) -> float:
    """Largest difference between an inner node's cover and its children's sum."""
    return max((abs(t.cover[n] - t.cover[t.left[n]] - t.cover[t.right[n]]) for t in model.trees for n in range(len(t.left)) if t.left[n] >= 0), default=0.0)
