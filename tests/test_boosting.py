"""The trainer against a plain numpy trainer, contributions, constraints, parameters, model operations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboost.errors import IncompatibleModel, InvalidData, InvalidParameter
from sparkboost.functions.losses import objective
from sparkboost.functions.metrics import evaluate
from sparkboost.model import Model
from sparkboost.operators.binning import make_cuts
from sparkboost.params import parse
from sparkboost.plans.shap import contributions, interactions
from sparkboost.plans.train import cover_check, train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 300
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 7, n) / 4.0, rng.integers(0, 5, n)
    y = 2.0 * (a > 5) + b + 0.5 * np.isin(c, [1, 3]) + rng.normal(0, 0.1, n)
    data = [(i, float(a[i]) if i % 9 else None, float(b[i]), int(c[i]), float(y[i]), int(y[i] > 2), i % 3) for i in range(n)]
    df = spark.createDataFrame(data, "row_id long, a double, b double, c int, y double, z int, k int").repartition(3).persist()
    df.count()
    return df


def plain_tree(x, g, h, depth, lam=1.0):
    """Split search over all distinct values, missing to either side: nested (feature, threshold, default, left, right) or a leaf."""
    G, H = g.sum(), h.sum()
    leaf = -G / (H + lam)
    best = (1e-6, None)
    for f in range(x.shape[1]) if depth else ():
        gone = np.isnan(x[:, f])
        ends = [np.inf] if gone.any() else []  # all present values to the left, missing ones to the right
        for v in [*np.unique(x[~gone, f])[1:], *ends]:
            for default in (False, True) if gone.any() and v < np.inf else (False,):
                left = np.where(gone, default, x[:, f] < v)
                hl, hr = h[left].sum(), h[~left].sum()
                if hl < 1 or hr < 1:
                    continue
                loss = np.float32(g[left].sum() ** 2 / (hl + lam) + g[~left].sum() ** 2 / (hr + lam) - G**2 / (H + lam))
                if loss > best[0]:
                    best = (loss, (f, v, default, left))
    if best[1] is None:
        return leaf
    f, v, default, left = best[1]
    return f, v, default, plain_tree(x[left], g[left], h[left], depth - 1), plain_tree(x[~left], g[~left], h[~left], depth - 1)


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        f, v, default, left, right = tree
        tree = left if (default if math.isnan(row[f]) else row[f] < v) else right
    return tree


def test_trees_are_those_of_a_plain_trainer(rows):
    model = train({"max_depth": 3, "eta": 0.5}, rows, ["a", "b"], "y", 2)
    p = rows.toPandas()
    x, y = p[["a", "b"]].to_numpy(float), p["y"].to_numpy()
    margin = np.full(len(y), y.mean())
    for _ in range(2):
        tree = plain_tree(x, margin - y, np.ones(len(y)), 3)
        margin = margin + 0.5 * np.array([plain_predict(tree, r) for r in x])
    got = {r["row_id"]: r["prediction"] for r in model.predict(rows, ["row_id"]).collect()}
    assert np.allclose([got[i] for i in p["row_id"]], margin, atol=1e-5)
    assert cover_check(model) < 1e-6


def test_partitions_do_not_matter(rows):
    one = train({"max_depth": 2}, rows.coalesce(1), ["a", "b"], "y", 1)
    many = train({"max_depth": 2}, rows.repartition(7), ["a", "b"], "y", 1)
    assert [(t.feature, t.threshold) for t in one.trees] == [(t.feature, t.threshold) for t in many.trees]
    assert np.allclose(one.trees[0].value, many.trees[0].value, atol=1e-9)


def test_contributions_add_up_and_json_round_trip(rows):
    model = train({"max_depth": 3, "objective": "multi:softprob", "num_class": 3}, rows, ["a", "b", "c"], "k", 1, categorical=["c"])
    x = rows.select("a", "b", "c").toPandas().to_numpy(np.float32)
    again = Model.from_json(model.to_json())
    assert np.allclose(again.margins_of(x), model.margins_of(x))
    assert np.allclose(contributions(model, x, model.trees).sum(axis=2), model.margins_of(x))
    inter = interactions(model, x, model.trees)
    assert np.allclose(inter.sum(axis=3), contributions(model, x, model.trees))
    low, high = np.zeros(3), np.full(3, 20.0)
    x = np.nan_to_num(x)  # the bounds are of present values
    for k, (lo, hi) in enumerate(model.bounds(low, high)):
        assert lo - 1e-9 <= model.margins_of(x)[:, k].min() and model.margins_of(x)[:, k].max() <= hi + 1e-9
    assert sum(model.importance("weight").values()) == sum(f >= 0 for t in model.trees for f in t.feature)


def test_monotone_and_interaction_constraints(rows):
    model = train({"max_depth": 3, "monotone_constraints": {"b": -1}, "interaction_constraints": [["a"], ["b"]]}, rows, ["a", "b"], "y", 1)
    grid = np.array([[6.0, b] for b in np.arange(0, 1.6, 0.25)], dtype=np.float32)
    assert (np.diff(model.margins_of(grid)[:, 0]) <= 1e-9).all()
    for t in model.trees:
        parents = t.parents()
        for n, f in enumerate(t.feature):
            if f >= 0 and n in parents:
                assert t.feature[parents[n]] == f


def test_slice_average_and_continuation(rows):
    model = train({"max_depth": 2}, rows, ["a", "b"], "y", 2)
    x = rows.select("a", "b").toPandas().to_numpy(np.float32)
    assert np.allclose(model.slice(0, 1).margins_of(x), model.margins_of(x, model.chosen((0, 1))))
    assert np.allclose(Model.average([model, model.slice(0, 1)]).margins_of(x), (model.margins_of(x) + model.slice(0, 1).margins_of(x)) / 2)
    more = train({"max_depth": 2}, rows, ["a", "b"], "y", 1, init_model=model.slice(0, 1))
    assert np.allclose(more.margins_of(x), model.margins_of(x), atol=1e-6)


def test_early_stopping_keeps_the_best_round(rows):
    seen = []
    model = train({"max_depth": 1, "eta": 0.3}, rows, ["a"], "z", 6, evals={"t": rows.withColumn("z", 1 - F.col("z"))}, early_stopping_rounds=1, on_round=lambda i, m: seen.append(i))
    assert model.best_iteration == 0 and seen == [0, 1] and model.chosen() == model.trees[:1]


@pytest.mark.parametrize("options", [{"etaa": 1}, {"eta": 0}, {"booster": "x"}, {"subsample": 0}, {"device": "cuda"}, {"verbosity": 3}, {"objective": "reg:squarederr"}])
def test_bad_parameters_are_refused(options, rows):
    with pytest.raises(InvalidParameter):
        train(parse(options), rows, ["a"], "y", 1)


def test_bad_data_is_refused(rows):
    with pytest.raises(InvalidData):
        train({"objective": "binary:logistic"}, rows, ["a"], "y", 1)
    with pytest.raises(InvalidData):
        train({}, rows.limit(0), ["a"], "y", 1)
    with pytest.raises(IncompatibleModel):
        Model("reg:squarederror", {}, ["nope"], [0.0], []).predict(rows)


def test_cuts_leave_out_the_minimum_and_end_above_the_maximum(rows):
    cuts = make_cuts(rows, ["a", "b"])
    assert cuts.values[0][0] == 1 and cuts.values[0][-1] > 11 and len(cuts.values[0]) == 12


@pytest.mark.parametrize("name", ["reg:squarederror", "reg:pseudohubererror", "binary:logistic", "count:poisson", "reg:gamma", "reg:tweedie", "dist:normal", "reg:expectileerror"])
def test_gradients_are_derivatives(spark, name):
    """Against differences of the loss that belongs to each objective."""
    losses = {
        "reg:squarederror": lambda m, y: (m[0] - y) ** 2 / 2,
        "reg:pseudohubererror": lambda m, y: math.sqrt(1 + (m[0] - y) ** 2) - 1,
        "binary:logistic": lambda m, y: math.log1p(math.exp(m[0])) - y * m[0],
        "count:poisson": lambda m, y: math.exp(m[0]) - y * m[0],
        "reg:gamma": lambda m, y: y * math.exp(-m[0]) + m[0],
        "reg:tweedie": lambda m, y: y * math.exp(-0.5 * m[0]) / 0.5 + math.exp(0.5 * m[0]) / 0.5,
        "dist:normal": lambda m, y: (m[0] - y) ** 2 * math.exp(-2 * m[1]) / 2 + m[1],
        "reg:expectileerror": lambda m, y: 0.5 * (0.75 if m[0] >= y else 0.25) * (m[0] - y) ** 2 + 0.5 * (0.25 if m[0] + 1e-6 + math.log1p(math.exp(m[1])) >= y else 0.75) * (m[0] + 1e-6 + math.log1p(math.exp(m[1])) - y) ** 2,
    }
    loss = objective(name, expectile_alpha=[0.25, 0.75])
    m, y, e = [0.3, -0.2], 0.9, 1e-5
    df = spark.createDataFrame([(*m, y)], "m0 double, m1 double, y double")
    pairs = loss.pairs([F.col(f"m{k}") for k in range(loss.outputs)], F.col("y"), F.lit(1.0))
    got = df.select(*(g.alias(f"g{k}") for k, (g, _) in enumerate(pairs))).first()
    for k in range(loss.outputs):
        up, down = list(m), list(m)
        up[k] += e
        down[k] -= e
        assert got[f"g{k}"] == pytest.approx((losses[name](up, y) - losses[name](down, y)) / (2 * e), abs=1e-6)


def test_ranking_gradients_match_pairs(spark):
    """All pairs of two queries by hand."""
    data = [(0, 1, 0.5, 2.0), (1, 1, 0.9, 0.0), (2, 1, 0.1, 1.0), (3, 2, 0.0, 1.0), (4, 2, 0.0, 0.0)]
    df = spark.createDataFrame(data, "row_id long, qid long, m0 double, y double")
    loss = objective("rank:pairwise")
    out = loss.prepare(df, ["m0"], "y", F.lit(1.0))
    g, h = loss.pairs([F.col("m0")], F.col("y"), F.lit(1.0))[0]
    got = {r["row_id"]: (r["g"], r["h"]) for r in out.select("row_id", g.alias("g"), h.alias("h")).collect()}
    want = {i: [0.0, 0.0] for i in range(5)}
    for q in (1, 2):
        own = [d for d in data if d[1] == q]
        span = max(d[2] for d in own) - min(d[2] for d in own)
        total, part = 0.0, {d[0]: [0.0, 0.0] for d in own}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                hi, lo = (a, b) if a[3] > b[3] else (b, a)
                s = 1 / (1 + math.exp(-(hi[2] - lo[2])))
                d = 1 / (abs(hi[2] - lo[2]) + 0.01) if span else 1.0
                lam, hes = (s - 1) * d, s * (1 - s) * d * 2
                for r, sign in ((hi, 1), (lo, -1)):
                    part[r[0]][0] += sign * lam
                    part[r[0]][1] += hes
                total += -2 * lam
        for r, v in part.items():
            want[r] = [x * math.log2(total + 1) / total for x in v]
    for i in range(5):
        assert got[i] == pytest.approx(want[i])


def test_auc_of_known_order(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)], "p double, label int")
    assert evaluate("auc", df, ["p"]).first()["value"] == pytest.approx((1 + 0 + 0 + 1 + 1 + 0.5) / 6)
    assert evaluate("auc", df.where("label = 1"), ["p"]).first()["value"] == 0.5


def plain_best(cells, sizes, reg, cats=()):
    """The best split of a node by loops: cells[feature][bin] = (g, h, n), bin -1 for missing values."""
    soft = lambda g: math.copysign(max(abs(g) - reg.alpha, 0), g)
    gain = lambda g, h: soft(g) ** 2 / (h + reg.lambda_) if h > 0 else 0.0
    best = None
    for f, own in enumerate(cells):
        total = [sum(x[k] for x in own.values()) for k in range(3)]
        gone = own.get(-1, (0, 0, 0))
        bins = sorted(b for b in own if b >= 0)
        if f in cats and len(bins) >= 4:
            bins.sort(key=lambda b: (-soft(own[b][0]) / (own[b][1] + reg.lambda_), b))
        sets = [[b] for b in bins] if f in cats and len(bins) < 4 else [bins[: k + 1] for k in range(len(bins))]
        if f in cats and len(bins) >= 4:
            sets = [s for k, s in enumerate(sets) if k < 64 or k >= len(bins) - 64]
        for missing in (False, True) if gone[2] else (False,):
            for s in reversed(sets) if missing else sets:
                left = [sum(own[b][k] for b in s) + (gone[k] if missing else 0) for k in range(3)]
                right = [t - x for t, x in zip(total, left, strict=True)]
                if min(left[2], right[2]) > 0 and min(left[1], right[1]) >= max(reg.min_child_weight, 1e-300):
                    loss = np.float32(gain(*left[:2]) + gain(*right[:2]) - gain(*total[:2]))
                    if loss > 1e-6 and loss >= reg.gamma and (best is None or loss > best[0]):
                        best = (loss, f, sorted(s) if f in cats else s[-1], missing, left[2])
    return best


def search_of(cells, sizes, reg, cats=()):
    from sparkboost.operators.split import Chunk, Node, Search

    chunk = Chunk(list(range(len(sizes))), list(sizes), [f in cats for f in range(len(sizes))])
    hist = np.zeros((3, chunk.cells), dtype=np.int64)
    for f, own in enumerate(cells):
        for b, (g, h, n) in own.items():
            hist[:, chunk.starts[f] + 1 + b] = g * 1024, h * 1024, n
    return Search(chunk, reg, (1 / 1024, 1 / 1024)), hist, Node(np.array([-np.inf]), np.array([np.inf]))


def test_search_is_that_of_plain_loops():
    from sparkboost.operators.split import Regularisation

    rng = np.random.default_rng(9)
    for trial in range(60):
        sizes, cats = (7, 12, 3, 6), (2, 3) if trial % 2 else ()
        rows = [[int(rng.integers(-1, s)) for s in sizes] for _ in range(40)]
        gh = [(int(rng.integers(-40, 40)) / 8, int(rng.integers(1, 16)) / 8) for _ in rows]
        cells = [{} for _ in sizes]
        for r, (g, h) in zip(rows, gh, strict=True):
            for f, b in enumerate(r):
                x = cells[f].get(b, (0, 0, 0))
                cells[f][b] = (x[0] + g, x[1] + h, x[2] + 1)
        reg = Regularisation(alpha=0.25, gamma=0.01, min_child_weight=2.0)
        want = plain_best(cells, sizes, reg, cats)
        search, hist, node = search_of(cells, sizes, reg, cats)
        got = search.best(hist, node)
        assert got is not None and (got["feature"], got["categories"] if got["feature"] in cats else got["bin"], got["default_left"], got["nl"]) == want[1:] and got["loss"] == pytest.approx(float(want[0]), rel=1e-5)


@pytest.mark.parametrize("gone", [0.0, 2.0, -9.0])
def test_category_sets_at_the_high_end(gone):
    """300 categories of which the last 10 by leaf weight differ, with missing values like either side."""
    from sparkboost.operators.split import Regularisation

    g = [1.0 if (b * 7) % 300 < 290 else -20.0 for b in range(300)]
    cells = [{b: (x, 2.0, 2) for b, x in enumerate(g)} | ({-1: (40 * gone, 40.0, 40)} if gone else {})]
    search, hist, node = search_of(cells, (300,), Regularisation(), (0,))
    r = search.best(hist, node)
    few = {b for b, x in enumerate(g) if x < 0}
    assert len(few) == 10 and r is not None and set(r["categories"]) == set(range(300)) - few
    assert r["default_left"] == (gone > 0) and r["nr"] == 20 + (40 if gone < 0 else 0) and r["gr"] == [-200 + (40 * gone if gone < 0 else 0)]
