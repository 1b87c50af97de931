import numpy as np
import pandas as pd
import pytest

from cairn.operators import stats as S


@pytest.mark.parametrize("direct_limit,fetch_total", [(0, 10**9), (10**9, 10**9), (0, 60)])
def test_exact_quantiles_on_skewed_and_heavy_tailed_data(spark, monkeypatch, direct_limit, fetch_total):
    rng = np.random.default_rng(1)
    n = 20_000
    a = np.concatenate([rng.lognormal(0, 6, n // 2), -rng.exponential(3, n // 4), np.full(n // 4, 7.25)])
    pdf = pd.DataFrame({"a": a, "b": rng.integers(0, 30, n).astype(float)})
    pdf.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(8)
    monkeypatch.setattr(S, "FETCH_LIMIT", 50)
    monkeypatch.setattr(S, "VALUE_TABLE_LIMIT", 10)
    monkeypatch.setattr(S, "DIRECT_HISTOGRAM_LIMIT", direct_limit)
    monkeypatch.setattr(S, "FETCH_TOTAL", fetch_total)  # 60: brackets wait for later passes
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = S.exact_quantiles(df, {"a": probs, "b": probs})
    st = S.column_stats(df, ["a", "b"])
    ranks = {c: {r for p in probs for r in S._positions(st[c].count, p)[:2]} for c in "ab"}
    refined = S.exact_quantiles(df, {"a": probs, "b": probs}, st, first=S.first_pass(df, ["a", "b"], st, [], ranks)[0])
    for c in "ab":
        assert np.allclose(got[c], pdf[c].quantile(probs).tolist(), rtol=1e-12, atol=0)
        assert refined[c] == got[c]


def test_value_table_path_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (3.0, "b"), (1.0, "a"), (None, None)], "x double, s string")
    assert S.exact_quantiles(df, {"x": [0.5]})["x"] == [2.0]
    assert S.modes(df, ["x"], True) == {"x": 1.0}
    assert S.modes(df, ["s"], False) == {"s": "a"}


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert S.exact_quantiles(df, {"x": [0.5]})["x"] == [None]


def test_approximate_switch(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    assert S.exact_quantiles(df, {"x": [0.5]}, accuracy=10_000)["x"] == [500.0]


@pytest.mark.parametrize("direct_limit", [0, 10**9])
def test_fused_pass_counts_categories(spark, monkeypatch, direct_limit):
    monkeypatch.setattr(S, "DIRECT_HISTOGRAM_LIMIT", direct_limit)
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None), (4.0, "a")], "x double, c string")
    st = S.column_stats(df, ["x"])
    found, counts = S.first_pass(df, ["x"], st, ["c"], {"x": {1, 2}})
    assert counts == {"c": {"a": 2, "b": 1, None: 1}}
    assert found["x"][1][:2] == (2.0, 2.0) and found["x"][2][:2] == (3.0, 3.0)


SHAPES = {
    "one bucket": lambda rng, n: 1e9 + rng.random(n),
    "heavy tail": lambda rng, n: rng.standard_cauchy(n) ** 3,
    "ties": lambda rng, n: np.where(rng.random(n) < 0.6, 3.5, rng.normal(size=n)),
    "two clusters": lambda rng, n: np.where(rng.random(n) < 0.5, rng.random(n) * 1e-12, 1e12 + rng.random(n)),
}


@pytest.mark.parametrize("fetch_total", [10**9, 10])
@pytest.mark.parametrize("shape", SHAPES)
def test_two_jobs_on_any_distribution(spark, monkeypatch, shape, fetch_total):
    rng = np.random.default_rng(4)
    values = SHAPES[shape](rng, 60_000)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(6).cache()
    df.count()
    st = S.column_stats(df, ["x"])
    monkeypatch.setattr(S, "FETCH_TOTAL", fetch_total)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    group = f"quantiles {shape} {fetch_total}"
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else every stage counts as a job
        spark.sparkContext.setJobGroup(group, group)
        got = S.exact_quantiles(df, {"x": probs}, st)["x"]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=0)
    assert jobs - (fetch_total == 10) <= 2  # beside the broadcast of the wanted ranks


def test_sketch_that_misses_a_rank_is_replaced(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("CAST(id * 7 % 30011 AS DOUBLE) AS x")
    want = S.exact_quantiles(df, {"x": [0.3, 0.5]})["x"]
    monkeypatch.setattr(S, "_brackets", lambda ranks, n: [(r, r) for r in sorted(ranks)][:1])
    assert S.exact_quantiles(df, {"x": [0.3, 0.5]})["x"] == want
