"""Own model kinds, versioned artefacts and copies in a forest's input."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from cairn import model_kinds
from cairn.config import ModelPolicy, PipelineConfig, TargetSpec
from cairn.operators.models import build_estimator
from cairn.operators.prep import fit_prep
from cairn.operators.split import with_order_keys
from cairn.plans import run_regression
from cairn.plans.regression import forest_input
from cairn.sources import artifacts


def boosted(columns, params):
    return GBTRegressor(**columns, maxIter=int(params.get("rounds", 5)), maxDepth=4, seed=1)


@pytest.fixture
def kind(monkeypatch):
    monkeypatch.setattr(model_kinds, "_KINDS", {})
    return model_kinds.register_model_kind("boosted", boosted, ["rounds"], fixed_partitions=True)


def test_registered_kind_runs_logs_and_reloads(spark, tmp_path, kind):
    df = spark.range(600).selectExpr("CAST(id AS DOUBLE) AS id", "CAST(id % 20 AS DOUBLE) AS x", "CAST((id % 20) * (id % 20) AS DOUBLE) AS y")
    cfg = PipelineConfig(target=TargetSpec("explicit", "y"), model=ModelPolicy("boosted", {"rounds": 8}), persist=True, artifacts_root=str(tmp_path))
    res = run_regression(spark, cfg, df, key="id", unique_key=True)
    assert res.metrics["r2"] > 0.9 and "train_model:boosted" in res.logs
    base = res.artifacts[0].rsplit("/", 2)[0]
    prep, model = artifacts.load_artifacts(base)
    want = {r.id: r.prediction for r in res.predictions.collect()}
    got = {r.id: r.prediction for r in model.transform(prep.transform(res.split.where("is_test"))).collect()}
    assert got == want
    res.release()


def test_rules_of_the_registry(kind):
    assert build_estimator(ModelPolicy("boosted", {"rounds": 3}), 4, "f", "y", "p").getMaxIter() == 3
    assert model_kinds.register_model_kind("boosted", boosted, ["rounds"], True) == kind
    with pytest.raises(ValueError, match="already registered"):
        model_kinds.register_model_kind("boosted", lambda c, p: None)
    with pytest.raises(ValueError, match="already registered"):
        model_kinds.register_model_kind("random_forest", boosted)
    with pytest.raises(ValueError, match="Unsupported parameter"):
        ModelPolicy("boosted", {"trees": 3})
    with pytest.raises(ValueError):
        ModelPolicy("unknown")
    model_kinds.register_model_kind("careless", lambda c, p: GBTRegressor(featuresCol="other"))
    with pytest.raises(ValueError, match="without featuresCol"):
        build_estimator(ModelPolicy("careless"), 4, "f", "y", "p")
    assert model_kinds.kinds() == ("linear_regression", "random_forest", "boosted", "careless")


def test_failure_between_the_parts_leaves_the_former_pair(spark, tmp_path):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id * 2 AS DOUBLE) AS y")
    prep = fit_prep(df, ["x"], []).pipeline_model("features", df)
    model = build_estimator(ModelPolicy(), 1, "features", "y").fit(prep.transform(df))
    other = build_estimator(ModelPolicy(), 1, "features", "z").fit(prep.transform(df).withColumn("z", F.col("y") * 3))
    where = str(tmp_path / "a")
    predict = lambda: [round(r.prediction, 6) for r in (lambda p, m: m.transform(p.transform(df)))(*artifacts.load_artifacts(where)).orderBy("x").collect()]
    artifacts.save_artifacts(prep, model, where)
    first = predict()

    class Broken:
        def write(self):
            raise RuntimeError("disk full")

    from pyspark.ml import PipelineModel

    broken = PipelineModel(stages=[other])
    broken.write = Broken().write
    with pytest.raises(RuntimeError, match="disk full"):
        artifacts.save_artifacts(prep, broken, where)
    assert predict() == first
    artifacts.save_artifacts(prep, other, where)
    assert predict() == [3 * v for v in first]
    # a pair written without a manifest still loads
    old = tmp_path / "old"
    prep.write().save(str(old / "preprocessor"))
    PipelineModel(stages=[model]).write().save(str(old / "model"))
    assert artifacts.load_artifacts(str(old))[1].stages[0].getOrDefault("coefficients") == model.getOrDefault("coefficients")
    with pytest.raises(RuntimeError, match="incomplete"):
        artifacts.load_artifacts(str(tmp_path / "none"))


def test_copies_are_dealt_and_the_fit_follows_the_rows_alone(spark):
    n = 30_000
    crowd = "id % 3 = 0"
    df = spark.range(n).selectExpr(*[f"CASE WHEN {crowd} THEN 1.0D ELSE CAST(id % {m} AS DOUBLE) END AS {c}" for c, m in (("a", 97), ("b", 1009), ("y", 4001))])
    results = []
    for parts in (1, 2, 7):
        frame = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(with_order_keys(df.repartition(parts), 42))
        dealt = forest_input(frame, n)
        sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sum(sizes) == n and sizes[-1] <= 1.5 * sizes[4]
        assert dealt.groupBy("a", "b", "y").count().exceptAll(frame.groupBy("a", "b", "y").count()).isEmpty()
        model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=3, maxDepth=5, seed=3).fit(dealt)
        results.append(model.toDebugString.split("\n", 1)[1])
    assert results[0] == results[1] == results[2]


def test_copies_are_grouped_without_a_sort_of_the_rows(spark, capsys):
    n = 20_000
    df = spark.range(n).selectExpr("IF(id % 3 = 0, 1.0D, CAST(id % 4001 AS DOUBLE)) AS a", "IF(id % 3 = 0, null, 'x') AS name")
    frame = VectorAssembler(inputCols=["a"], outputCol="features").transform(with_order_keys(df, 42))
    dealt = forest_input(frame, n)
    dealt.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    assert dealt.groupBy("a", "name", "features").count().exceptAll(frame.groupBy("a", "name", "features").count()).isEmpty()
    assert dealt.count() == n and dealt.columns == [*[c for c in frame.columns if c.startswith("_cairn")], *[c for c in frame.columns if not c.startswith("_cairn")]]


@pytest.mark.parametrize("name", ["forest_fits", "forest_settings"])
def test_a_query_s_forest_reads_partitions_that_follow_the_rows(spark, tmp_path, monkeypatch, name):
    import cairn.catalog as catalog
    import cairn.catalog_cases  # noqa: F401

    part = spark.range(600).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'t' AS p_type", "'b' AS p_brand", "900.0D + id AS p_retailprice")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    plain = RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or plain(self, data))
    assert catalog.Q[name](spark, str(tmp_path)).count() > 0
    assert seen and set(seen) == {8}
