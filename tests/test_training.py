"""Options of training: draws, cuts, search options, distributions, continuation."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboost.errors import InvalidParameter
from sparkboost.model import Model
from sparkboost.operators.binning import make_cuts
from sparkboost.plans.train import train


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=(n, 4)).astype(np.float32)
    x[rng.random((n, 4)) < 0.05] = np.nan
    c = rng.integers(0, 9, n)
    y = np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) > 0.3) + np.isin(c, [1, 4, 7]) + rng.normal(size=n) / 4
    rows = [(int(i) * 3_000_000_000, *(None if np.isnan(v) else float(v) for v in x[i]), int(c[i]), float(y[i]), int(i % 7), float(rng.integers(1, 4)), float(y[i] > 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a float, b float, c float, d float, cat int, y double, q int, w double, pos double").repartition(4).cache()


X = ["a", "b", "c", "d", "cat"]


def trees_of(model):
    return [(t.left, t.right, t.feature, t.threshold, t.default_left, t.categories, t.value) for t in model.trees]


@pytest.mark.parametrize("params", [{}, {"subsample": 0.6, "colsample_bynode": 0.6}, {"grow_policy": "lossguide", "max_leaves": 6, "max_depth": 0}, {"grow_policy": "symmetric"}, {"extra_trees": True, "path_smooth": 3.0}, {"quantized_bins": 8}, {"langevin": True, "model_shrink_rate": 0.1}, {"monotone_constraints": {"a": 1}, "max_delta_step": 0.8}, {"objective": "reg:pseudohubererror", "tree_method": "approx"}])
def test_trees_do_not_depend_on_partitions(table, params):
    fit = lambda df: train({"max_depth": 3, "max_bin": 64, **params}, df, X, "y", 2, weight="w", row_id="id", categorical=["cat"])
    one = fit(table.coalesce(1).repartition(5, "id"))
    other = fit(table.repartition(8, "q"))
    assert trees_of(one) == trees_of(other) and sum(len(t.left) for t in one.trees) > 12


def test_draws_are_random_and_independent(spark):
    from sparkboost.functions.rng import normal, uniform, uniforms

    ids = np.concatenate([np.arange(20_000), np.arange(20_000) * 1_000_003, (1 << 62) + np.arange(20_000) * 7, -np.arange(1, 20_001)])
    u = [uniforms(ids, 5, r, s) for r, s in ((0, 0), (1, 0), (0, 1), (2, 0))]
    for k, x in enumerate(u):
        for part in np.split(x, 4):
            assert abs(part.mean() - 0.5) < 0.012 and abs((part < 0.1).mean() - 0.1) < 0.01
            assert abs(np.corrcoef(part[:-1], part[1:])[0, 1]) < 0.03
        for y in u[k + 1 :]:
            assert abs(((x < 0.5) & (y < 0.5)).mean() - 0.25) < 0.01
    df = spark.createDataFrame([(int(i),) for i in ids[::97]], "id long").select("id", uniform(F.col("id"), 5, 1).alias("u"), normal(F.col("id"), 5, 1).alias("z")).toPandas()
    assert df.u.to_numpy() == pytest.approx(uniforms(df.id.to_numpy(), 5, 1), abs=1e-15)
    assert abs(df.z.mean()) < 0.12 and abs(df.z.std() - 1) < 0.1 and abs((df.z**3).mean()) < 0.35 and df.z.max() > 2


def test_balanced_and_query_bagging_reach_the_trees(table):
    one = train({"objective": "binary:logistic", "max_depth": 1, "balanced_bagging": (0.2, 0.9)}, table, X, "pos", 1, row_id="id", categorical=["cat"])
    pos = table.where("pos = 1").count()
    n = table.count()
    p = pos / n
    assert one.trees[0].cover[0] == pytest.approx((0.2 * pos + 0.9 * (n - pos)) * p * (1 - p), rel=0.05)
    two = train({"max_depth": 1, "subsample": 0.5, "bagging_by_query": True}, table, X, "y", 4, qid="q", row_id="id", categorical=["cat"])
    sizes = {r["q"]: r["count"] for r in table.groupBy("q").count().collect()}
    sums = {sum(s) for k in range(8) for s in itertools.combinations(sizes.values(), k)}
    assert all(t.cover[0] in sums for t in two.trees) and len({t.cover[0] for t in two.trees}) > 1


def test_weights_move_the_cuts(spark):
    df = spark.range(3000).select(F.col("id").cast("float").alias("x"), F.when(F.col("id") < 10, 1000.0).otherwise(1e-3).alias("w"), (F.col("id") % 3).cast("double").alias("y"))
    cuts = make_cuts(df, ["x"], max_bin=8, weight=F.col("w")).values[0]
    assert (cuts[:-1] < 10).all() and len(cuts) > 5


def test_exact_splits_between_neighbours_and_hist_at_its_cuts(spark):
    df = spark.range(3000).select(F.col("id").cast("float").alias("x"), F.when(F.col("id") < 1234, 0.0).otherwise(1.0).alias("y"))
    split = lambda method: train({"max_depth": 1, "max_bin": 8, "tree_method": method}, df, ["x"], "y", 1).trees[0].threshold[0]
    assert split("exact") == 1233.5 and split("hist") != 1233.5
    late = lambda method, rounds: train({"max_depth": 1, "max_bin": 8, "eta": 1.0, "tree_method": method, "objective": "binary:logistic"}, df, ["x"], "y", rounds)
    assert len({t.threshold[0] for t in late("approx", 4).trees} - {t.threshold[0] for t in late("hist", 4).trees}) > 0


def test_vector_leaves_share_their_structure(table):
    df = table.withColumn("z", -F.col("y") + F.col("a").isNull().cast("int"))
    model = train({"max_depth": 3, "multi_strategy": "multi_output_tree"}, df, X, ["y", "z"], 2, categorical=["cat"], evals={"t": df})
    assert len(model.trees) == 4 and all(model.trees[k].threshold == model.trees[k + 1].threshold and model.trees[k].value != model.trees[k + 1].value for k in (0, 2))
    out = model.predict(df, ["y", "z"]).toPandas()
    assert model.history[-1][3] == pytest.approx(float(np.sqrt((((out.y - out.prediction0) ** 2).sum() + ((out.z - out.prediction1) ** 2).sum()) / (2 * len(out)))), rel=1e-6)
    each = train({"max_depth": 3}, df, X, ["y", "z"], 2, categorical=["cat"])
    alone = train({"max_depth": 3}, df, X, "z", 2, categorical=["cat"])
    assert [t.threshold for t in each.trees if t.output == 1] == [t.threshold for t in alone.trees]


def test_exact_leaves_are_quantiles_of_their_rows(table):
    model = train({"objective": "reg:quantileerror", "quantile_alpha": [0.2, 0.8], "leaf_estimation": "exact", "max_depth": 2, "eta": 1.0}, table, X, "y", 1, categorical=["cat"])
    rows = model.predict_leaf(table, ["y"]).toPandas()
    for k, t in enumerate(model.trees):
        for leaf in t.leaves():
            r = np.sort(rows.y[rows.leaves.map(lambda v, k=k: v[k]) == leaf] - model.base[k])
            x = min(max((0.2, 0.8)[k] * (len(r) + 1), 1), len(r))
            low = int(np.floor(x))
            want = r[low - 1] + (x - low) * (r[min(low, len(r) - 1)] - r[low - 1])
            assert t.value[leaf] == pytest.approx(want, abs=1e-6)


def test_feature_weights_lean_the_draws(table):
    model = train({"max_depth": 1, "colsample_bytree": 0.2, "num_parallel_tree": 40}, table, X, "y", 1, categorical=["cat"], feature_weights={"a": 0.0, "b": 50.0})
    used = [t.feature[0] for t in model.trees if t.feature[0] >= 0]
    assert used.count(1) > 25 and used.count(0) == 0


def test_dart_goes_on_from_a_loaded_model_with_categories(table):
    params = {"booster": "dart", "rate_drop": 0.9, "one_drop": True, "max_depth": 2, "max_bin": 16}
    first = Model.from_json(train(params, table, X, "y", 2, categorical=["cat"]).to_json())
    more = train({**params, "seed": 3}, table, X, "y", 2, categorical=["cat"], init_model=first)
    out = more.margins(table, ["id"]).toPandas()
    assert more.iterations == 4 and np.isfinite(out.m0).all()


def test_linear_refuses_what_it_does_not_use_and_goes_on(table):
    with pytest.raises(InvalidParameter):
        train({"booster": "gblinear"}, table, ["a", "b"], "y", 1, evals={"t": table})
    two = train({"booster": "gblinear"}, table, ["a", "b"], "y", 4)
    one = train({"booster": "gblinear"}, table, ["a", "b"], "y", 2, init_model=train({"booster": "gblinear"}, table, ["a", "b"], "y", 2))
    assert np.allclose(one.linear, two.linear) and np.allclose(one.base, two.base)


@pytest.mark.parametrize("name", ["dist:gamma", "dist:negbinomial", "dist:student_t", "dist:poisson", "dist:lognormal"])
def test_distributions_train_and_improve(table, name):
    e = F.exp(F.col("y") / 4)
    label = {"dist:gamma": e, "dist:lognormal": e, "dist:negbinomial": F.floor(4 * e), "dist:poisson": F.floor(4 * e)}.get(name, F.col("y"))
    df = table.withColumn("y", label.cast("double"))
    model = train({"objective": name, "max_depth": 2, "eval_metric": ["nll", "crps"]}, df, X, "y", 3, categorical=["cat"], evals={"t": df})
    for metric in ("nll", "crps"):
        values = [v for *_, m, v in model.history if m == metric]
        assert values[-1] < values[0] - 0.01


def test_distribution_functions_agree_with_each_other():
    from sparkboost.functions.distributions import Dist

    cases = {"normal": [0.3, -0.2], "lognormal": [0.3, -0.5], "gamma": [0.4, 0.9], "poisson": [1.1], "negbinomial": [1.2, 0.3], "student_t": [0.1, -0.1, 1.4]}
    for family, m in cases.items():
        at = lambda y, n=1: Dist.of_margins(family, [np.full(n, x) for x in m])  # noqa: E731, B023
        if family in ("poisson", "negbinomial"):
            k = np.arange(400.0)
            p = np.exp(at(0, 400).log_prob(k))
            assert p.sum() == pytest.approx(1, abs=1e-9) and (p * k).sum() == pytest.approx(at(0).mean()[0], rel=1e-8) and (p * k * k).sum() - (p * k).sum() ** 2 == pytest.approx(at(0).variance()[0], rel=1e-7)
            run = np.cumsum(p)
            assert at(0, 400).cdf(k)[:50] == pytest.approx(run[:50], abs=1e-9)
            assert at(0).quantile(0.6)[0] == np.flatnonzero(run >= 0.6)[0]
            y = 3.0
            assert at(0).crps(np.array([y]))[0] == pytest.approx(((run - (k >= y)) ** 2).sum(), abs=1e-8)
        else:
            x = np.linspace(1e-9 if family in ("gamma", "lognormal") else -400, 400, 2_000_001)
            d = at(0, len(x))
            p = np.exp(d.log_prob(x))
            run = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(x))])
            some = slice(0, None, 50_000)
            cdf = Dist(family, [v[some] for v in d.p]).cdf(x[some])
            assert cdf == pytest.approx(run[some], abs=2e-4)
            assert at(0).quantile(0.7)[0] == pytest.approx(np.interp(0.7, run, x), abs=1e-3)
            y = 0.9
            assert at(0).crps(np.array([y]))[0] == pytest.approx((((run - (x >= y)) ** 2)[:-1] * np.diff(x)).sum(), abs=2e-3)
        y = np.array([2.0])
        for j, (g, _) in enumerate(at(0).gradients(y)):
            up, down = list(m), list(m)
            up[j] += 1e-5
            down[j] -= 1e-5
            slope = (Dist.of_margins(family, [np.array([x]) for x in down]).log_prob(y) - Dist.of_margins(family, [np.array([x]) for x in up]).log_prob(y)) / 2e-5
            assert g[0] == pytest.approx(slope[0], abs=1e-5)


@pytest.mark.parametrize("error", ["normal", "logistic", "extreme"])
def test_failure_times_are_judged_by_their_likelihood(spark, table, error):
    df = table.withColumns({"label_lower": F.exp("y"), "label_upper": F.when(F.col("q") == 0, float("inf")).when(F.col("q") == 1, F.exp(F.col("y") + 0.5)).otherwise(F.exp("y"))})
    model = train({"objective": "survival:aft", "aft_loss_distribution": error, "max_depth": 2, "max_delta_step": 0.7}, df, X, "y", 2, categorical=["cat"], evals={"t": df})
    values = [h[3] for h in model.history]
    assert model.history[0][2] == "aft-nloglik" and values[-1] < values[0]
