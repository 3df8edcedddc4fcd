"""Additive models, exact leaves, readers, interchange, estimators, calibration and updates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboost.ml import BoostClassifier
from sparkboost.operators import folds
from sparkboost.operators.order import grid_quantiles, kth
from sparkboost.plans.ebm import fast_pairs, shapes, train_additive
from sparkboost.plans.exact_leaves import leaf_quantiles
from sparkboost.plans.refresh import refreshed
from sparkboost.plans.train import train
from sparkboost.sources import xgboost_json
from sparkboost.sources.files import read_csv, read_libsvm
from sparkboost.streaming.online_calibrator import calibrated, step
from sparkboost.streaming.online_model import OnlineModel


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 200), rng.integers(0, 6, 200)
    y = (a > 2) * 1.0 + (b > 3) * 0.5 + 2.0 * ((a > 2) & (b > 3)) + rng.normal(0, 0.05, 200)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i]), int(y[i] > 0.75), float(np.exp(y[i])), float(np.exp(y[i])) if i % 4 else float("inf")) for i in range(200)], "row_id long, a double, b double, y double, z int, label_lower double, label_upper double").persist()
    df.count()
    return df


def test_shapes_of_an_additive_model_add_up_to_its_margin(spark, rows):
    model = train_additive({"max_depth": 2}, rows, ["a", "b"], "y", 1)
    steps = shapes(spark, model).collect()
    x = np.array([[4.0, 1.0]], dtype=np.float32)
    total = model.base[0]
    for k, f in enumerate(model.features):
        total += max((r for r in steps if r["feature"] == f and r["start"] is not None and r["start"] <= x[0, k]), key=lambda r: r["start"])["value"]
    assert total == pytest.approx(model.margins_of(x)[0, 0])


def test_fast_pairs_by_hand(spark):
    data = [([i, j, k], float((i > 0) == (j > 1)) + 0.1 * k) for i in range(3) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(data, "bins array<int>, r double")
    got = {(r["a"], r["b"]): r["gain"] for r in fast_pairs(df, [(0, 1), (0, 2), (1, 2)], "r", 3).collect()}
    part = lambda v: sum(v) ** 2 / len(v) if v else 0.0
    for (a, b), gain in got.items():
        best = 0.0
        for i in range(3):
            for j in range(3):
                quarters = {}
                for bins, r in data:
                    quarters.setdefault((bins[a] <= i, bins[b] <= j), []).append(r)
                best = max(best, sum(part(v) for v in quarters.values()) - part([r for _, r in data]))
        assert gain == pytest.approx(best)
    assert max(got, key=got.get) == (0, 1)


def test_leaf_quantiles(spark, rows):
    got = {r["leaf"]: r["value"] for r in leaf_quantiles(rows, "a", "y", 0.3).collect()}
    for leaf, want in got.items():
        assert want == pytest.approx(grid_quantiles(rows.where(F.col("a") == leaf), "y", [0.3])[0])


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 5]], "v double")
    assert kth(df, F.col("v"), [1, 2, 3, 5, 6]) == [1, 2, 2, 5, None]
    assert grid_quantiles(df, "v", [0.0, 0.5, 1.0]) == [1, 2, 5]


def test_survival_and_interchange(rows):
    model = train({"objective": "survival:aft", "aft_loss_distribution": "logistic", "max_depth": 2}, rows, ["a", "b"], "y", 1)
    x = rows.select("a", "b").toPandas().to_numpy(np.float32)
    assert np.allclose(xgboost_json.read(xgboost_json.write(model)).margins_of(x), model.margins_of(x))


def test_refresh_on_the_same_rows_changes_nothing(rows):
    model = train({"max_depth": 2}, rows, ["a", "b"], "y", 1)
    again = refreshed({"max_depth": 2}, model, rows, "y")
    assert np.allclose(again.trees[0].value, model.trees[0].value, atol=1e-6) and np.allclose(again.trees[0].cover, model.trees[0].cover)


def test_estimator_and_virtual_ensemble(rows):
    fitted = BoostClassifier(features=["a", "b"], label="z", rounds=2, max_depth=2).fit(rows)
    out = fitted.transform(rows)
    assert out.where("prediction = z").count() >= 190
    assert fitted.model.virtual_ensemble(rows, ["row_id"], 2).where("knowledge >= 0").count() == 200


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2.5\n;NA\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), ["x", "y"], sep=";", na_value="NA").collect()] == [(1.0, 2.5), (None, None)]
    (tmp_path / "a.svm").write_text("# head\n1 qid:3 0:0.5 2:0 # tail\n\n0 1:2\n")
    rows = read_libsvm(spark, str(tmp_path / "a.svm")).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [(0.0, None, None, 2.0, None), (1.0, 3, 0.5, None, 0.0)]


def test_query_folds_keep_queries_whole(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).alias("q"))
    parts = folds.query_folds(df, "q", "id", 3).where("role = 'test'")
    assert parts.join(df, parts["row_id"] == df["id"]).groupBy("q").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert parts.count() == 60


def test_calibration_follows_misses(spark):
    scores = [1.0, 3.0, 0.2, 5.0]
    got = calibrated(spark.createDataFrame([("k", i, s) for i, s in enumerate(scores)], "key string, seq long, score double"), 0.1, 1.0, 2.0).orderBy("seq").collect()
    at = 2.0
    for r, s in zip(got, scores, strict=True):
        assert r["threshold"] == pytest.approx(at) and r["missed"] == (s > at)
        at, _ = step(at, s, 0.1, 1.0)


def test_online_update_is_a_retraining(rows, tmp_path):
    online = OnlineModel({"max_depth": 2}, str(tmp_path / "rows"), ["a", "b"], "y", 1, "row_id")
    online.update(rows.where("row_id < 150"))
    online.update(rows.where("row_id >= 150"), rows.where("row_id < 20"))
    whole = train({"max_depth": 2}, rows.where("row_id >= 20"), ["a", "b"], "y", 1, row_id="row_id")
    assert np.allclose(online.model.trees[0].value, whole.trees[0].value)
