"""Least squares by products alone against dense solvers."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cairn.config import MissingPolicy, ModelPolicy, PipelineConfig, ScalingPolicy, TargetSpec
from cairn.operators import models, wide_linear
from cairn.plans import run_regression


def one_hot_frame(spark, n=3000, first=60, second=25, seed=0, dense_rows=False):
    """Two categorical columns of very unequal frequencies, a far-off and a small numeric column, one that is always zero."""
    rng = np.random.default_rng(seed)
    a, b = rng.zipf(1.4, n) % first, rng.integers(0, second, n)
    x = np.column_stack((rng.normal(size=n) * 1e3 + 1e6, rng.normal(size=n) * 1e-2))
    y = 3 * rng.normal(size=first)[a] + rng.normal(size=second)[b] + x @ (2e-3, 50.0) + rng.normal(size=n)
    d = 3 + first + second
    full = np.zeros((n, d))
    full[:, :2] = x
    full[np.arange(n), 3 + a] = 1.0
    full[np.arange(n), 3 + first + b] = 1.0
    vector = lambda r: Vectors.dense(r) if dense_rows else Vectors.sparse(d, {int(j): float(r[j]) for j in np.flatnonzero(r)})
    return spark.createDataFrame([(vector(r), float(t)) for r, t in zip(full, y)], ["features", "label"]).repartition(4).cache(), full, y


def fitted(df, intercept=True, positive=False, wide=True, monkeypatch=None):
    monkeypatch.setattr(models, "GRAM_MAX_FEATURES", 8 if wide else 4096)
    model = models.NonNegativeLeastSquares(featuresCol="features", labelCol="label", fitIntercept=intercept, positive=positive).fit(df)
    return np.array(model.getOrDefault("coefficients")), model.getOrDefault("intercept"), model


@pytest.mark.parametrize("intercept,dense_rows", [(True, False), (False, False), (True, True)])
def test_minimum_norm_fit(spark, monkeypatch, intercept, dense_rows):
    df, x, y = one_hot_frame(spark, dense_rows=dense_rows)
    beta, icpt, model = fitted(df, intercept, monkeypatch=monkeypatch)
    if intercept:
        want = np.linalg.pinv(x - x.mean(0), rcond=1e-12) @ (y - y.mean())
        assert np.isclose(icpt, y.mean() - x.mean(0) @ want, atol=1e-5)
    else:
        scale = 1 / np.where(np.linalg.norm(x, axis=0) > 0, np.linalg.norm(x, axis=0), 1)
        z = np.linalg.lstsq(x * scale, y, rcond=1e-12)[0] * scale
        null = np.linalg.svd(x * scale)[2][np.linalg.matrix_rank(x * scale):].T * scale[:, None]
        basis = np.linalg.qr(null)[0]
        want = z - basis @ (basis.T @ z)
    assert np.abs(beta - want).max() < 1e-4 * max(1, np.abs(want).max())
    got = np.array([r.prediction for r in model.transform(df).select("prediction").collect()])
    fit = np.array([r.features.toArray() @ want + icpt for r in df.select("features").collect()])
    assert np.abs(got - fit).max() < 1e-6


@pytest.mark.parametrize("intercept", [True, False])
def test_equals_the_gram_solver(spark, monkeypatch, intercept):
    df, _, _ = one_hot_frame(spark, seed=3)
    for positive in (False, True):
        wide = fitted(df, intercept, positive, True, monkeypatch)[2]
        gram = fitted(df, intercept, positive, False, monkeypatch)[2]
        a, b = (np.array([r.prediction for r in m.transform(df).select("prediction").collect()]) for m in (wide, gram))
        assert np.abs(a - b).max() < 1e-4 if positive else np.abs(a - b).max() < 1e-6


def test_non_negative_certificate(spark, monkeypatch):
    df, x, y = one_hot_frame(spark, seed=5)
    beta, icpt, _ = fitted(df, True, True, monkeypatch=monkeypatch)
    assert (beta >= 0).all() and (beta == 0).any()
    gradient = (x - x.mean(0)).T @ ((x - x.mean(0)) @ beta - (y - y.mean()))
    length = np.linalg.norm(x - x.mean(0), axis=0)
    length[length == 0] = 1.0
    size = np.abs((x - x.mean(0)).T @ (y - y.mean()) / length).max()
    assert (np.abs(gradient[beta > 0] / length[beta > 0]) < 1e-8 * size).all() and (gradient[beta == 0] / length[beta == 0] > -1e-8 * size).all()


def test_unsettled_fits_raise(spark, monkeypatch):
    df, _, _ = one_hot_frame(spark, seed=5)
    monkeypatch.setattr(wide_linear, "CERTIFICATE", -1.0)
    with pytest.raises(RuntimeError, match="did not settle"):
        design = wide_linear.Design(df, models._entries("features"), "label", 88, models.shift_row(df, "features", "label"), True)
        wide_linear.non_negative(design, max_passes=40)
    with pytest.raises(RuntimeError, match="did not settle"):
        wide_linear.conjugate_gradients(lambda v: np.diag(np.logspace(0, 9, 60)) @ v, np.ones(60), max_steps=5)
    with pytest.raises(ValueError, match="iterative solver"):
        wide_linear.Design(df, models._entries("features"), "label", wide_linear.MAX_FEATURES + 1, (np.zeros(2), 0.0), True)


def test_semidefinite_systems_have_the_least_norm():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 30))
    s, c = a.T @ a, a.T @ rng.normal(size=12)
    assert np.allclose(wide_linear.conjugate_gradients(lambda v: s @ v, c), np.linalg.pinv(s) @ c, atol=1e-8)
    assert not wide_linear.conjugate_gradients(lambda v: s @ v, np.zeros(30)).any()


def test_default_run_on_more_than_ten_thousand_one_hot_columns(spark):
    n = 24_000
    df = spark.range(n).selectExpr("CAST(id % 10500 AS STRING) AS c", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 10500 + 3 * (id % 7) AS DOUBLE) AS y", "id")
    cfg = PipelineConfig(target=TargetSpec("explicit", "y"), model=ModelPolicy("linear_regression"), missing=MissingPolicy(), scaling=ScalingPolicy("standard"))
    res = run_regression(spark, cfg, df, key="id", unique_key=True)
    assert res.prep.feature_count > 8_000
    seen = res.predictions.join(res.split.where("NOT is_test").select("c").distinct(), "c")
    assert seen.selectExpr("max(abs(prediction - y)) AS e").first().e < 1e-5
    res.release()
