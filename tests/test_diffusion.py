"""Sampling of labels and of whole rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboost.plans.diffusion import DiffusionModel, ForestModel, Path, sample_crps, sample_means, sample_quantiles


@pytest.mark.parametrize("kind", ["vp", "subvp", "ve", "linear", "trig"])
def test_paths_and_their_derivatives(spark, kind):
    path = Path(kind)
    for t in (0.1, 0.5, 0.9):
        a, s, da, ds = path.at(t)
        up, down = path.at(t + 1e-6), path.at(t - 1e-6)
        assert da == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-4) and ds == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-4)
        both = spark.range(1).select(*(c.alias(n) for c, n in zip(path.columns(F.lit(t)), "as", strict=True))).first()
        assert both["a"] == pytest.approx(a) and both["s"] == pytest.approx(s)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 1.0], 240)
    y = 3 * x + rng.normal(size=240) * 0.5
    return spark.createDataFrame([(i, float(x[i]), float(y[i]), "up" if x[i] > 0 else "down", int(x[i] > 0), None if i % 10 == 0 else float(y[i])) for i in range(240)], "id long, x float, y double, g string, c int, z double").repartition(2).cache()


@pytest.mark.parametrize(("path", "solver", "rounds"), [("vp", "sde", 6), ("linear", "heun", 8)])
def test_samples_follow_the_conditional_distribution(spark, rows, path, solver, rounds, tmp_path):
    model = DiffusionModel.fit({"max_depth": 4, "eta": 0.3, "max_bin": 64}, rows, ["x"], ["y"], rounds, row_id="id", path=path, repeats=12)
    few = spark.createDataFrame([(1, 1.0), (2, -1.0)], "id long, x float")
    samples = model.sample(few, "id", 60, steps=15, solver=solver)
    means = {r["row_id"]: r for r in sample_means(samples).collect()}
    assert means[1]["mean"] == pytest.approx(3, abs=1.2) and means[2]["mean"] == pytest.approx(-3, abs=1.2)
    assert 0.2 < means[1]["std"] < (1.2 if path == "linear" else 3.2)
    q = sample_quantiles(samples, [0.1, 0.5, 0.9]).collect()
    assert all(r["q0"] < r["q1"] < r["q2"] for r in q)
    truth = spark.createDataFrame([(1, 0, 3.0), (2, 0, -3.0)], "row_id long, output long, y double")
    v = {r: np.array([s["value"] for s in samples.collect() if s["row_id"] == r]) for r in (1, 2)}
    want = np.mean([np.abs(v[r] - y).mean() - np.abs(v[r][:, None] - v[r]).mean() / 2 for r, y in ((1, 3.0), (2, -3.0))])
    assert sample_crps(samples, truth).first()["crps"] == pytest.approx(want)
    model.save(spark, str(tmp_path / "m"))
    again = DiffusionModel.load(spark, str(tmp_path / "m")).sample(few.repartition(2), "id", 60, steps=15, solver=solver)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, samples.collect()))


def test_forests_generate_and_impute_rows(spark, rows):
    model = ForestModel.fit({"max_depth": 3, "max_bin": 32}, rows, ["z", "c"], 2, row_id="id", label="g", categorical=["c"], levels=3, repeats=4)
    model = ForestModel.from_json(model.to_json())
    got = model.sample(spark, 200).toPandas()
    assert set(got.label) == {"up", "down"} and set(got.c) <= {0.0, 1.0}
    assert got.z[got.label == "up"].mean() > 0.5 and got.z[got.label == "down"].mean() < -0.5
    assert (got.c[got.label == "up"] == 1).mean() > 0.9
    full = model.impute(rows, "id", "g").toPandas().set_index("row_id")
    before = rows.toPandas().set_index("id")
    known = before.z.notna()
    assert np.allclose(full.z[known[known].index], before.z[known], atol=1e-6) and full.z.notna().all()
    lost = before.index[~known]
    assert (np.sign(full.z[lost]) == np.sign(before.y[lost])).mean() > 0.8
    assert model.sample_for_labels(rows.limit(5), "id", "g").count() == 5
