import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cairn.config import CategoryPolicy, MissingPolicy, ScalingPolicy
from cairn.operators.prep import fit_prep


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [(1.0, "a", 10.0), (2.0, "b", 20.0), (None, "c", 30.0), (4.0, None, 40.0), (5.0, "a", 50.0)],
        "num double, cat string, target double")


def test_standard_scaling_gives_zero_train_mean(spark, frame):
    prep = fit_prep(frame, ["num"], ["cat"])
    out = prep.columns(frame).toPandas()
    assert abs(out["num"].mean()) < 1e-9
    assert out["num"].std(ddof=0) == pytest.approx(1.0)
    assert list(out.columns) == ["num", "cat_a", "cat_b", "cat_c"]
    assert prep.log() == "build_preprocessor:num=1,cat=1"


def test_median_fill_and_mode_fill(spark, frame):
    prep = fit_prep(frame, ["num"], ["cat"], scaling=ScalingPolicy("none"), category=CategoryPolicy("ordinal"))
    out = prep.columns(frame).collect()
    assert [r.num for r in out] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r.cat for r in out] == [0.0, 1.0, 2.0, 0.0, 0.0]  # missing → mode 'a'


def test_unknown_category(spark, frame):
    train = frame.where(F.col("cat") != "c")
    ignore = fit_prep(train, [], ["cat"], category=CategoryPolicy("onehot", "ignore"))
    row_c = ignore.columns(frame.where(F.col("cat") == "c")).first()
    assert [row_c[c] for c in ignore.output_columns] == [0.0, 0.0]
    ordinal = fit_prep(train, [], ["cat"], category=CategoryPolicy("ordinal", "ignore"))
    assert ordinal.columns(frame.where(F.col("cat") == "c")).first()["cat"] == -1.0
    strict = fit_prep(train, [], ["cat"], category=CategoryPolicy("onehot", "error"))
    with pytest.raises(Exception, match="unknown categories"):
        strict.columns(frame).collect()


def test_all_missing_column_dropped_unless_constant(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "gone double, kept double")
    assert fit_prep(df, ["gone", "kept"], []).output_columns == ["kept"]
    const = fit_prep(df, ["gone", "kept"], [], MissingPolicy(numeric="constant", fill_value_numeric=7.0), ScalingPolicy("none"))
    assert [r.gone for r in const.columns(df).collect()] == [7.0, 7.0]


def test_constant_categorical_fill(spark, frame):
    prep = fit_prep(frame, [], ["cat"], MissingPolicy(categorical="constant", fill_value_categorical=""))
    assert prep.categorical[0].fill == "missing"
    assert "cat_missing" in prep.output_columns


@pytest.mark.parametrize("strategy", ["minmax", "robust"])
def test_other_scalers_match_numpy(spark, strategy):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = np.array([r.x for r in fit_prep(df, ["x"], [], scaling=ScalingPolicy(strategy)).columns(df).collect()])
    a = np.array(vals)
    if strategy == "minmax":
        exp = (a - a.min()) / (a.max() - a.min())
    else:
        q25, q50, q75 = np.percentile(a, [25, 50, 75])
        exp = (a - q50) / (q75 - q25)
    assert np.allclose(out, exp)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    for s in ["standard", "minmax", "robust"]:
        assert [r.x for r in fit_prep(df, ["x"], [], scaling=ScalingPolicy(s)).columns(df).collect()] == [0.0] * 3


def test_vector_form_equals_column_form(spark, frame):
    for enc in ["onehot", "ordinal"]:
        prep = fit_prep(frame, ["num"], ["cat"], category=CategoryPolicy(enc))
        cols = prep.columns(frame, keep=["target"]).orderBy("target").toPandas()
        vec = prep.pipeline_model("features", frame).transform(frame).orderBy("target")
        arr = np.array([r.v for r in vec.select(vector_to_array("features").alias("v")).collect()])
        assert np.allclose(arr, cols[prep.output_columns].to_numpy())


def test_drop_rows_filters_both_sides(spark, frame):
    prep = fit_prep(frame, ["num"], ["cat"], MissingPolicy(numeric="drop_rows", categorical="drop_rows"))
    assert prep.columns(frame).count() == 3


@pytest.mark.parametrize("encode", ["ordinal", "onehot"])
def test_table_vocabulary_matches_literal_vocabulary(spark, monkeypatch, encode, tmp_path):
    import cairn.operators.prep as P
    from pyspark.ml import PipelineModel

    rows = [(float(i), f"v{i % 37:02d}" if i % 11 else None, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "num double, cat string, target double")
    train = df.where(F.col("cat") != "v05")  # v05 unseen in the fit
    lit = fit_prep(train, ["num"], ["cat"], category=CategoryPolicy(encode))
    monkeypatch.setattr(P, "LITERAL_VOCAB_LIMIT", 3)
    tab = fit_prep(train, ["num"], ["cat"], category=CategoryPolicy(encode))
    assert tab.categorical[0].vocab_path and tab.categorical[0].vocab_size == len(lit.categorical[0].vocabulary)
    assert tab.categorical[0].fill == lit.categorical[0].fill
    assert tab.feature_count == lit.feature_count
    pm_lit, pm_tab = lit.pipeline_model("features", train), tab.pipeline_model("features", train)
    pm_tab.write().overwrite().save(str(tmp_path / "tab"))
    pm_tab = PipelineModel.load(str(tmp_path / "tab"))

    def vecs(pm):
        out = pm.transform(df).select("target", vector_to_array("features").alias("v")).orderBy("target").collect()
        return np.array([r.v for r in out])

    assert np.allclose(vecs(pm_lit), vecs(pm_tab))
    a = lit.columns(df, keep=["target"]).orderBy("target").toPandas()
    b = tab.columns(df, keep=["target"]).orderBy("target").toPandas()
    assert list(a.columns) == list(b.columns) and np.allclose(a.to_numpy(), b.to_numpy(), equal_nan=True)


def test_vocabulary_total_budget_moves_the_largest_columns_to_tables(spark, monkeypatch):
    import cairn.operators.prep as P

    rows = [(float(i), f"w{i % 40:02d}", f"s{i % 4}", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "num double, wide string, small string, target double")
    lit = fit_prep(df, ["num"], ["wide", "small"], category=CategoryPolicy("ordinal"))
    monkeypatch.setattr(P, "LITERAL_VOCAB_TOTAL", 10)  # 40 + 4 values: only "small" stays literal
    mixed = fit_prep(df, ["num"], ["wide", "small"], category=CategoryPolicy("ordinal"))
    plans = {p.name: p for p in mixed.categorical}
    assert plans["wide"].vocab_path and not plans["small"].vocab_path
    a = lit.columns(df, keep=["target"]).orderBy("target").toPandas()
    b = mixed.columns(df, keep=["target"]).orderBy("target").toPandas()
    assert np.allclose(a.to_numpy(), b.to_numpy())


def test_saved_preprocessor_carries_its_vocabulary_tables(spark, tmp_path, monkeypatch):
    import shutil

    import cairn.operators.prep as P
    from cairn.operators.models import build_estimator
    from cairn.config import ModelPolicy
    from cairn.sources.artifacts import load_artifacts, save_artifacts

    rows = [(float(i), f"v{i % 9}", float(i % 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "num double, cat string, target double")
    monkeypatch.setattr(P, "LITERAL_VOCAB_LIMIT", 3)
    prep = fit_prep(df, ["num"], ["cat"])
    pm = prep.pipeline_model("features", df)
    model = build_estimator(ModelPolicy(), prep.feature_count, "features", "target").fit(pm.transform(df))
    save_artifacts(pm, model, str(tmp_path / "a"))
    want = [r.prediction for r in model.transform(pm.transform(df)).orderBy("num").collect()]
    shutil.copytree(tmp_path / "a", tmp_path / "elsewhere")
    scratch = prep.categorical[0].vocab_path.replace("file:", "")
    pm2, model2 = load_artifacts(str(tmp_path / "elsewhere"))
    assert all(scratch not in s.getStatement() and str(tmp_path / "a") not in s.getStatement() for s in pm2.stages if hasattr(s, "getStatement"))
    got = [r.prediction for r in model2.transform(pm2.transform(df)).orderBy("num").collect()]
    assert np.allclose(got, want)


@pytest.mark.parametrize("encode", ["onehot", "ordinal"])
def test_frequent_categories_of_a_table_vocabulary_are_spread(spark, monkeypatch, encode):
    import cairn.operators.prep as P

    monkeypatch.setattr(P, "LITERAL_VOCAB_LIMIT", 100)
    n = 40_000
    cat = "CASE WHEN id % 10 < 6 THEN 'hot' WHEN id % 10 = 6 THEN NULL WHEN id % 10 = 7 THEN concat('w', id % 30) ELSE concat('c', id % 3000) END"
    df = spark.range(n, numPartitions=16).selectExpr("id", "CAST(id % 11 AS DOUBLE) AS num", f"{cat} AS cat").repartition(16)
    prep = fit_prep(df.where("cat IS NULL OR cat != 'w7'"), ["num"], ["cat"], category=CategoryPolicy(encode))
    plan = prep.categorical[0]
    frequent = [r.value for r in spark.read.parquet(plan.hot_path).collect()]
    assert "hot" in frequent and len(frequent) < 1_000 and plan.fill in frequent
    monkeypatch.setattr(P, "LITERAL_VOCAB_LIMIT", 10_000)
    literal = fit_prep(df.where("cat IS NULL OR cat != 'w7'"), ["num"], ["cat"], category=CategoryPolicy(encode))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(keep, ("16", "false", "-1")):
            spark.conf.set(c, v)
        vectors = [p.pipeline_model("features", df).transform(df) for p in (prep, literal)]
        a, b = ({r.id: r.features for r in v.select("id", "features").collect()} for v in vectors)
        assert a == b
        wide = [vectors[0]] + ([prep.columns(df, keep=["id"])] if encode == "ordinal" else [])
        for out in wide:
            sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
            assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_table_vocabulary_scores_a_stream(spark, monkeypatch, tmp_path):
    import cairn.operators.prep as P

    monkeypatch.setattr(P, "LITERAL_VOCAB_LIMIT", 3)
    df = spark.range(200).selectExpr("CAST(id AS DOUBLE) AS num", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 20) END AS cat")
    pm = fit_prep(df, ["num"], ["cat"]).pipeline_model("features", df)
    df.write.parquet(str(tmp_path / "in"))
    stream = pm.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.select("num", "features").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.num: r.features for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.num: r.features for r in pm.transform(df).collect()} and len(got) == 200
