import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cairn.config import EvalPolicy, ModelPolicy
from cairn.operators.metrics import metrics_dict, regression_metrics
from cairn.operators.models import build_estimator, max_features_count, nnls_gram


def _fit(df, cols, label, policy):
    est = build_estimator(policy, len(cols), "features", label, "prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), est]).fit(df)


def test_linear_model_learns_identity(spark):
    train = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    test = spark.createDataFrame([(4.0, 4.0), (5.0, 5.0)], "x double, y double")
    model = _fit(train, ["x"], "y", ModelPolicy())
    preds = [r.prediction for r in model.transform(test).orderBy("x").collect()]
    assert preds == pytest.approx([4.0, 5.0])


def test_persist_round_trip(spark, tmp_path):
    from cairn.sources.artifacts import load_artifacts, save_artifacts
    from cairn.operators.prep import fit_prep

    train = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    prep = fit_prep(train, ["x"], [])
    pm = prep.pipeline_model("features", train)
    model = build_estimator(ModelPolicy(), 1, "features", "y").fit(pm.transform(train))
    before = [r.prediction for r in model.transform(pm.transform(train)).collect()]
    save_artifacts(pm, model, str(tmp_path / "a"))
    pm2, model2 = load_artifacts(str(tmp_path / "a"))
    after = [r.prediction for r in model2.transform(pm2.transform(train)).collect()]
    assert before == after
    with pytest.raises(RuntimeError, match="incomplete"):
        load_artifacts(str(tmp_path / "missing"))


def test_nnls_matches_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = x @ np.array([1.5, -2.0, 0.5, -0.1]) + rng.normal(scale=0.1, size=200)
    beta = nnls_gram(x.T @ x, x.T @ y)
    best, best_sse = None, np.inf
    for mask in range(16):
        idx = [i for i in range(4) if mask >> i & 1]
        b = np.zeros(4)
        if idx:
            b[idx] = np.linalg.lstsq(x[:, idx], y, rcond=None)[0]
        if (b >= 0).all():
            sse = float(((x @ b - y) ** 2).sum())
            if sse < best_sse:
                best, best_sse = b, sse
    assert np.allclose(beta, best, atol=1e-8)


def test_positive_linear_model(spark):
    rows = [(float(i), float(i % 7), 2.0 * i - 3.0 * (i % 7) + 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = _fit(df, ["a", "b"], "y", ModelPolicy("linear_regression", {"positive": True}))
    coefs = model.stages[-1].getOrDefault("coefficients")
    assert coefs[1] == 0.0 and coefs[0] > 0


def test_forest_meets_r2_threshold_on_part(spark):
    from cairn import catalog

    res = catalog._part_run(spark, "/root/testdata/sf0.01", "random_forest",
                            {"n_estimators": 30, "max_depth": 12, "random_state": 42})
    assert res.metrics["r2"] >= 0.9


def test_parameter_allow_list_messages():
    with pytest.raises(ValueError, match="Unsupported parameter\\(s\\) for linear_regression: alpha, beta"):
        ModelPolicy("linear_regression", {"beta": 1, "alpha": 2})
    with pytest.raises(ValueError, match="n_estimators"):
        ModelPolicy("random_forest", {"n_estimators": 0})
    assert ModelPolicy("random_forest", {"max_depth": None}).params == {}
    with pytest.raises(NotImplementedError):
        build_estimator(ModelPolicy("random_forest", {"criterion": "poisson"}), 3)


def test_max_features_resolution():
    assert max_features_count("sqrt", 5) == "2"
    assert max_features_count("log2", 5) == "2"
    assert max_features_count(0.5, 5) == "2"
    assert max_features_count(None, 5) == "all"
    assert max_features_count(1.0, 5) == "all"
    assert max_features_count(1, 5) == "1"


def test_metrics_values_and_threshold(spark):
    y, p = [1.0, 2.0, 3.0, 4.0], [1.05, 1.95, 3.1, 4.05]
    df = spark.createDataFrame(list(zip(y, p)), "label double, prediction double")
    m = metrics_dict(df)
    ya, pa = np.array(y), np.array(p)
    assert m["r2"] >= 0.8
    assert m["r2"] == pytest.approx(1 - ((ya - pa) ** 2).sum() / ((ya - ya.mean()) ** 2).sum())
    assert m["rmse"] == pytest.approx(np.sqrt(((ya - pa) ** 2).mean()))
    assert m["mae"] == pytest.approx(np.abs(ya - pa).mean())


def test_constant_target_rule_and_groups(spark):
    df = spark.createDataFrame([("a", 5.0, 5.0), ("a", 5.0, 5.0 + 1e-9), ("b", 5.0, 6.0), ("b", 5.0, 5.0)],
                               "g string, label double, prediction double")
    got = {r.g: r.r2 for r in regression_metrics(df, group_by=["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError, match="Unsupported metric"):
        EvalPolicy(("r2", "mape"))


def test_gram_solver_gives_min_norm_solution(spark):
    from cairn.operators.prep import fit_prep
    from cairn.config import ScalingPolicy

    rows = [(float(i % 5), "abc"[i % 3], 2.0 * (i % 5) + {"a": 1.0, "b": 3.0, "c": -2.0}["abc"[i % 3]]) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, cat string, y double")
    prep = fit_prep(df, ["x"], ["cat"], scaling=ScalingPolicy("none"))
    pm = prep.pipeline_model("features", df)
    data = pm.transform(df)
    gram = build_estimator(ModelPolicy("linear_regression", solver="gram"), 4, "features", "y").fit(data)
    spark_lr = build_estimator(ModelPolicy("linear_regression", solver="spark"), 4, "features", "y").fit(data)
    a = [r.prediction for r in gram.transform(data).collect()]
    b = [r.prediction for r in spark_lr.transform(data).collect()]
    assert np.allclose(a, b, atol=1e-6)
    # min-norm coefficients of the centred problem (numpy reference)
    x = np.array([[r[0], r[1] == "a", r[1] == "b", r[1] == "c"] for r in rows], dtype=float)
    y = np.array([r[2] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert np.allclose(gram.getOrDefault("coefficients"), expected, atol=1e-8)
    with pytest.raises(ValueError, match="linear solver"):
        ModelPolicy("linear_regression", solver="qr")


def test_gram_statistics_equal_numpy_over_many_partitions(spark):
    from pyspark.ml.functions import array_to_vector

    from cairn.operators.models import gram_statistics

    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 12))
    y = x @ rng.normal(size=12) + rng.normal(size=500)
    rows = [([float(v) for v in xi], float(yi)) for xi, yi in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(37)
    df = df.select(array_to_vector("x").alias("features"), "y")
    xtx, xty, sx, sy, yy, n = gram_statistics(df, "features", "y", (np.zeros(12), 0.0))
    assert n == 500
    assert np.allclose(xtx, x.T @ x) and np.allclose(xty, x.T @ y) and np.allclose(sx, x.sum(0))
    assert np.isclose(sy, y.sum()) and np.isclose(yy, y @ y)


def test_one_solver_at_every_width():
    from pyspark.ml.regression import LinearRegression

    from cairn.operators.models import GRAM_MAX_FEATURES, NonNegativeLeastSquares

    for width in (3, GRAM_MAX_FEATURES, GRAM_MAX_FEATURES + 1):
        for policy in (ModelPolicy(), ModelPolicy(params={"positive": True})):
            assert isinstance(build_estimator(policy, width), NonNegativeLeastSquares)
    assert isinstance(build_estimator(ModelPolicy(solver="spark"), GRAM_MAX_FEATURES + 1), LinearRegression)
    assert not build_estimator(ModelPolicy(), 3).getOrDefault("positive")
    assert build_estimator(ModelPolicy("random_forest"), 10).getMaxBins() == build_estimator(ModelPolicy("random_forest"), 900).getMaxBins()


def _linear(spark, x, y, sparse=False, **params):
    from pyspark.ml.linalg import Vectors

    make = (lambda r: Vectors.sparse(len(r), {int(i): float(r[i]) for i in np.flatnonzero(r)})) if sparse else (lambda r: Vectors.dense(r.tolist()))
    df = spark.createDataFrame([(make(r), float(v)) for r, v in zip(x, y)], ["features", "label"])
    model = build_estimator(ModelPolicy("linear_regression", params), x.shape[1]).fit(df)
    return model, np.array([r.prediction for r in model.transform(df).select("prediction").collect()])


def test_linear_fit_far_from_zero_and_on_unlike_scales(spark):
    rng = np.random.default_rng(0)
    t = 1.7e9 + rng.uniform(0, 1e5, 400)
    model, p = _linear(spark, t[:, None], 3 * t + 7)
    assert abs(model.getOrDefault("coefficients")[0] - 3) < 1e-9 and np.abs(p - (3 * t + 7)).max() < 1e-4
    x = np.column_stack([rng.normal(size=400) * 1e6, rng.normal(size=400) * 1e-3, np.eye(3)[rng.integers(0, 3, 400)]])
    y = x @ [2e-6, 5e3, 1, 2, 3] + 4
    coefs = []
    for sparse in (False, True):
        model, p = _linear(spark, x, y, sparse)
        assert np.abs(p - y).max() < 1e-8
        coefs.append(model.getOrDefault("coefficients"))
    assert np.allclose(coefs[0], coefs[1]) and np.allclose(coefs[0][2:], [-1, 0, 1], atol=1e-8)  # minimum norm
    model, p = _linear(spark, x[:, 2:] + 5, (x[:, 2:] + 5) @ [1, 2, 3], fit_intercept=False)
    assert model.getOrDefault("intercept") == 0 and np.allclose(model.getOrDefault("coefficients"), [1, 2, 3])


def test_nnls_that_does_not_settle_is_an_error():
    from cairn.operators.models import nnls_gram

    with pytest.raises(RuntimeError, match="settle"):
        nnls_gram(np.eye(5), np.ones(5), max_iter=2)


def test_metrics_use_complete_pairs_only(spark):
    from cairn.operators.metrics import regression_metrics

    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (None, 9.0), (3.0, float("nan"))], "label double, prediction double")
    r = regression_metrics(df, with_count=True, with_pairs=True).first()
    assert (r.n, r.n_pairs) == (4, 2) and abs(r.rmse - 0.5) < 1e-12 and abs(r.mae - 0.5) < 1e-12 and abs(r.r2 - 0.0) < 1e-12


def test_drop_rows_counts_in_report(spark):
    from cairn.config import MissingPolicy, PipelineConfig, TargetSpec
    from cairn.plans import run_regression

    rows = [(None if i % 4 == 0 else float(i), float(2 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, target double")
    cfg = PipelineConfig(target=TargetSpec("explicit", "target"), missing=MissingPolicy(numeric="drop_rows"))
    res = run_regression(spark, cfg, df)
    entry = [line for line in res.logs if line.startswith("drop_rows:")][0]
    kept_train = int(entry.split("train_kept=")[1].split(",")[0])
    kept_test = int(entry.split("test_kept=")[1])
    assert kept_train + kept_test == 30


def test_min_norm_gram_equals_least_squares_on_x():
    from cairn.operators.models import min_norm_gram

    for seed in range(20):
        rng = np.random.default_rng(seed)
        n = 400
        # rank-deficient: full one-hot next to an intercept (centred columns sum to zero)
        oh = np.eye(3)[rng.integers(0, 3, n)]
        x = np.column_stack([rng.normal(0, 1, n), oh, rng.normal(5, 2, n)])
        y = x @ np.array([1.0, 2.0, 3.0, 4.0, -1.0]) + rng.normal(0, 0.1, n)
        xc, yc = x - x.mean(0), y - y.mean()
        assert np.allclose(min_norm_gram(xc.T @ xc, xc.T @ yc), np.linalg.lstsq(xc, yc, rcond=None)[0],
                           rtol=1e-6, atol=1e-8)
        # full rank, unscaled features nine orders of magnitude apart
        x = np.column_stack([rng.normal(0, 1e6, n), rng.normal(0, 1e-3, n), rng.normal(0, 1, n)])
        y = x @ np.array([2e-6, 5e3, 1.5]) + rng.normal(0, 1e-3, n)
        xc, yc = x - x.mean(0), y - y.mean()
        assert np.allclose(min_norm_gram(xc.T @ xc, xc.T @ yc), np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-6)


def test_nnls_on_unscaled_features_equals_brute_force():
    import itertools

    from cairn.operators.models import nnls_equilibrated

    rng = np.random.default_rng(1)
    n = 1000
    x = np.column_stack([rng.normal(0, 1e6, n), rng.normal(0, 1e-3, n), rng.normal(0, 1, n)])
    y = x @ np.array([2e-6, 5e3, -1.5]) + rng.normal(0, 1e-3, n)
    xc, yc = x - x.mean(0), y - y.mean()
    best = None
    for k in range(4):  # every active set, unconstrained least squares on it, keep the feasible best
        for cols in itertools.combinations(range(3), k):
            beta = np.zeros(3)
            if cols:
                sol = np.linalg.lstsq(xc[:, cols], yc, rcond=None)[0]
                if (sol < 0).any():
                    continue
                beta[list(cols)] = sol
            rss = float(np.sum((yc - xc @ beta) ** 2))
            if best is None or rss < best[0]:
                best = (rss, beta)
    assert np.allclose(nnls_equilibrated(xc.T @ xc, xc.T @ yc), best[1], rtol=1e-6, atol=1e-12)


def test_gram_fit_on_no_rows_is_an_error(spark):
    from pyspark.ml.functions import array_to_vector

    empty = spark.createDataFrame([], "x array<double>, y double").select(array_to_vector("x").alias("features"), "y")
    with pytest.raises(ValueError, match="No training rows"):
        build_estimator(ModelPolicy("linear_regression", solver="gram"), 2, "features", "y").fit(empty)


def test_narrow_fit_takes_one_job_and_equals_the_gram_pass(spark):
    from cairn.operators.models import gram_statistics, narrow_statistics, vector_size

    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)) * [1, 1e3, 1e-3, 1, 1, 1] + [0, 1e9, 5, 0, 0, -7]
    x[:, 3] = rng.integers(0, 2, 700)
    y = x @ [1, 2e-3, 300, 4, 0, 1] + rng.normal(size=700)
    from pyspark.ml.linalg import Vectors

    rows = [((Vectors.dense if i % 2 else lambda r: Vectors.sparse(6, {j: float(v) for j, v in enumerate(r) if v}))(r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["features", "y"]).repartition(5)
    assert vector_size(df, "features") == 6
    g, c, mx, my, n = narrow_statistics(df, "features", "y", 6)
    xc, yc = x - x.mean(0), y - y.mean()
    size = np.sqrt(np.outer((xc ** 2).sum(0), (xc ** 2).sum(0)))
    assert n == 700 and np.allclose(mx, x.mean(0)) and np.isclose(my, y.mean())
    assert np.abs(g - xc.T @ xc).max() < 1e-8 * size.max() and np.allclose(g / size, xc.T @ xc / size, atol=1e-9) and np.allclose(c, xc.T @ yc, rtol=1e-6)
    g0, c0, _, _, _ = narrow_statistics(df, "features", "y", 6, centred=False)
    xtx, xty, *_ = gram_statistics(df, "features", "y", (np.zeros(6), 0.0))
    assert np.allclose(g0, xtx) and np.allclose(c0, xty)
    tracker = spark.sparkContext
    tracker.setJobGroup("narrow", "one job")
    narrow_statistics(df, "features", "y", 6)
    jobs = tracker.statusTracker().getJobIdsForGroup("narrow")
    tracker.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # with adaptive execution the test frame's own repartition is a job of its stage


def test_a_narrow_design_reaches_python_in_plain_columns(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from cairn.operators import models

    def nested(column):
        raise AssertionError("vectors are taken apart in nested form")

    monkeypatch.setattr(models, "_entries", nested)
    rows = [(Vectors.dense(1e8 + i, 0.0, i % 3), float(i)) if i % 2 else (Vectors.sparse(3, {0: 1e8 + i, 2: i % 5 + 1.0}), float(i * i)) for i in range(50)]
    df = spark.createDataFrame(rows, ["features", "y"]).repartition(3)
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
    g, c, mx, my, n = models.narrow_statistics(df, "features", "y", 3)
    assert n == 50 and my == pytest.approx(y.mean()) and mx == pytest.approx(x.mean(axis=0))
    assert g == pytest.approx((x - x.mean(axis=0)).T @ (x - x.mean(axis=0))) and c == pytest.approx((x - x.mean(axis=0)).T @ (y - y.mean()))


@pytest.mark.parametrize("decimal", [".", ","])
def test_numbers_parse_alike_with_and_without_white_space(spark, decimal):
    from cairn.functions.numeric import parse_decimal

    texts = ["1.5", " 1.5\t", "1,5", " 1,5", "-2e3", "5\n", " 5\n", "1_0", "inf", " -Infinity ", "nan", "", "x", "1 5", "+.5", "7.", None]
    value = {t: None for t in texts} | {"-2e3": -2000.0, "5\n": 5.0, " 5\n": 5.0, "inf": float("inf"), " -Infinity ": float("-inf")}
    value |= {"1.5": 1.5, " 1.5\t": 1.5, "+.5": 0.5, "7.": 7.0} if decimal == "." else {"1,5": 1.5, " 1,5": 1.5}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", parse_decimal("t", decimal).alias("v")).collect()} == value
