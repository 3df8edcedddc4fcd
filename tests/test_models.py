"""Model files, prepared rows, further predictions, cross-validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboost.errors import IncompatibleModel, InvalidData
from sparkboost.operators import folds
from sparkboost.plans.cv import cv, refit
from sparkboost.plans.matrix import BinnedMatrix, select_rows
from sparkboost.plans.train import train
from sparkboost.sources import lightgbm_text, models, ubjson
from sparkboost.sources.sparse import dense


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(i, float(rng.normal()), None if i % 9 == 0 else float(rng.normal()), int(rng.integers(0, 7))) for i in range(600)]
    df = spark.createDataFrame([(*d, (d[1] > 0.2) * 2.0 + (d[2] or 0) * 0.5 + (d[3] in (2, 5)) + 0.01 * d[0] % 0.1) for d in data], "id long, a float, b float, c int, y double")
    return df.repartition(4).cache()


X = ["a", "b", "c"]


def same(model, other, rows):
    a, b = (m.margins(rows, ["id"]).orderBy("id").toPandas() for m in (model, other))
    assert np.allclose(a.m0, b.m0, atol=1e-5) and a.m0.std() > 0.1


@pytest.mark.parametrize("suffix", ["json", "xgb.json", "ubj"])
@pytest.mark.parametrize("booster", ["gbtree", "dart"])
def test_model_files_round_trip(rows, suffix, booster):
    model = train({"max_depth": 3, "booster": booster, "rate_drop": 0.8, "one_drop": True}, rows, X, "y", 3, categorical=["c"])
    assert any(c is not None for t in model.trees for c in t.categories)
    same(model, models.loads(models.dumps(model, suffix)), rows)
    with pytest.raises(IncompatibleModel):
        models.loads(b"\x00what")


def test_ubjson_holds_all_kinds():
    x = {"a": [1, -200, 70_000, 1 << 40, 2.5, True, None, "é"], "b": {}, "c": [0.5, 1.5], "d": [], "e": [[1], {"f": "g"}]}
    assert ubjson.loads(ubjson.dumps(x)) == x
    assert ubjson.loads(b"[$U#U\x03\x01\x02\xff") == [1, 2, 255] and ubjson.loads(b"[i\x01NT]") == [1, True]
    with pytest.raises(IncompatibleModel):
        ubjson.loads(b"{i\x01a")


TEXT = """tree
version=v4
num_class=1
num_tree_per_iteration=1
max_feature_idx=2
objective=binary sigmoid:1
feature_names=a b c
feature_infos=none none none

Tree=0
num_leaves=3
num_cat=1
split_feature=0 2
split_gain=5 3
threshold=0.5 0
decision_type=10 1
left_child=1 -1
right_child=-2 -3
leaf_value=0.25 -1 2
leaf_weight=3 4 5
leaf_count=3 4 5
internal_value=0 0
internal_weight=12 8
internal_count=12 8
cat_boundaries=0 1
cat_threshold=20
is_linear=0
shrinkage=1


end of trees
"""


def test_text_models_are_read():
    model = lightgbm_text.read(TEXT)
    x = np.array([[0.5, 0, 2], [0.5, 0, 4], [0.4, 0, 3], [0.6, 0, 2], [np.nan, 0, 4], [np.nextafter(np.float32(0.5), np.float32(1)), 0, 2]], dtype=np.float32)
    assert model.predict_rows(x)[:, 0].tolist() == [0.25, 0.25, 2, -1, 0.25, -1]
    assert model.objective == "binary:logistic" and model.trees[0].cover[0] == 12
    with pytest.raises(IncompatibleModel):
        lightgbm_text.read(TEXT.replace("decision_type=10", "decision_type=6"))


def test_sparse_rows(spark):
    df = spark.createDataFrame([(1, [0, 2], [1.5, 0.0]), (2, [], []), (3, None, None), (4, [1], [7.0])], "id long, i array<int>, v array<double>")
    got = {r["id"]: (r["f0"], r["f1"], r["f2"]) for r in dense(df, "i", "v", 3, ["id"]).collect()}
    assert got == {1: (1.5, None, 0.0), 2: (None,) * 3, 3: (None,) * 3, 4: (None, 7.0, None)}
    for bad in ([0, 0], [0, 3]):
        with pytest.raises(Exception, match="InvalidData|index"):
            dense(spark.createDataFrame([(1, bad, [1.0, 2.0])], "id long, i array<int>, v array<double>"), "i", "v", 3).collect()
    assert InvalidData


def test_a_binned_matrix_trains_the_same_trees_again_and_again(rows):
    matrix = BinnedMatrix.of(rows, X, max_bin=32, categorical=["c"])
    want = train({"max_depth": 3, "max_bin": 32}, rows, X, "y", 2, categorical=["c"])
    for _ in range(2):
        got = train({"max_depth": 3, "max_bin": 32}, matrix, X, "y", 2)
        assert [(t.threshold, t.value) for t in got.trees] == [(t.threshold, t.value) for t in want.trees]
    matrix.release()


def test_views_repeat_and_order_rows(spark, rows):
    selection = spark.createDataFrame([(0, 5), (1, 3), (2, 5)], "position long, row_id long")
    assert [r["id"] for r in select_rows(rows, "id", selection).orderBy("position").collect()] == [5, 3, 5]


def test_rows_variants_and_distributions_of_a_model(spark, rows):
    model = train({"max_depth": 2, "objective": "dist:normal"}, rows, X, "y", 4, categorical=["c"])
    r = rows.where("id = 9").first()
    margins = model.margins(rows.where("id = 9")).first()
    assert model.predict_row(r.asDict()) == pytest.approx(list(margins))
    d = model.predict_distribution(rows.where("id = 9"), ["id"], quantiles=[0.5, 0.975]).first()
    assert d["q0"] == pytest.approx(d["mean_value"], abs=1e-6) and d["q1"] - d["q0"] == pytest.approx(1.959964 * d["variance"] ** 0.5, rel=1e-4)
    changes = spark.createDataFrame([(0, None), (1, 2.0), (2, -2.0)], "k long, a float")
    got = {v["k"]: v["prediction0"] for v in model.variants(r.asDict(), changes, ["k"]).collect()}
    assert got[0] == pytest.approx(margins["m0"]) and got[1] > got[2]
    u = model.virtual_ensemble(rows, ["id"], 3).toPandas()
    assert np.allclose(u.total, u.knowledge + u.data) and (u.data > 0).all() and u.knowledge.max() > 0


def test_classifiers_share_their_uncertainty_out(rows):
    df = rows.withColumn("z", (F.col("y") > 1).cast("int"))
    model = train({"max_depth": 2, "objective": "binary:logistic"}, df, X, "z", 6, categorical=["c"])
    u = model.virtual_ensemble(df, ["id"], 4).toPandas()
    assert np.allclose(u.total, u.knowledge + u.data, atol=1e-9) and u.total.max() <= np.log(2) + 1e-9


def test_cross_validation_stops_by_the_mean_and_refits(rows):
    parts = folds.k_fold(rows, "id", 3, 1)
    table, fitted, held = cv({"max_depth": 3, "eta": 1.0}, rows, ["a", "b"], "y", 6, parts, row_id="id", early_stopping_rounds=1)
    test = table.where("dataset = 'test'").orderBy("iteration").collect()
    means = [r["mean"] for r in test]
    best = fitted[0].best_iteration
    assert best == int(np.argmin(means)) and len(means) <= best + 2 and held.count() == 600
    model = refit({"max_depth": 3, "eta": 1.0}, rows, ["a", "b"], "y", fitted, row_id="id")
    assert model.iterations == best + 1
    table, none, held = cv({"max_depth": 1}, rows, ["a"], "y", 1, parts, row_id="id", history_only=True)
    assert not none and held is None and table.count() == 2
