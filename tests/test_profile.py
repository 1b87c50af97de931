from cairn.operators.profile import column_kinds, missing_over, missing_ratios, missing_summary

N = None


def test_top5_string_and_threshold(spark):
    rows = [(N, 1.0, N, N, 1.0, 1.0), (1.0, N, N, N, 2.0, 2.0), (N, 2.0, N, N, N, 3.0), (2.0, N, 3.0, N, 3.0, 4.0)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(6)))
    r = missing_ratios(df)
    assert missing_summary(r).first()["summary"] == "missing_top5:c3:1.000,c2:0.750,c0:0.500,c1:0.500,c4:0.250"
    assert [x.column_name for x in missing_over(r, 0.6).collect()] == ["c3", "c2"]


def test_low_missing_gives_no_warning(spark):
    df = spark.createDataFrame([(N, N, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)], "c0 double, c1 double, c2 double")
    assert missing_over(missing_ratios(df), 0.8).count() == 0


def test_nan_counts_as_missing_and_empty_frame(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    assert missing_ratios(df).first()["ratio"] == 0.5
    empty = spark.createDataFrame([], "a double")
    assert missing_ratios(empty).first()["ratio"] == 0.0
    assert missing_summary(missing_ratios(df, [])).first()["summary"] == "missing_top5:none"


def test_kinds_of_text_columns(spark):
    df = spark.createDataFrame(
        [("1", "a", "True", None, "1,5"), ("2.5", "b", "False", None, "2"), (None, "c", "True", None, "3")],
        "num string, cat string, flag string, empty string, comma string")
    kinds = column_kinds(df)
    assert kinds == {"num": "numeric", "cat": "categorical", "flag": "numeric", "empty": "numeric", "comma": "categorical"}
    assert column_kinds(df, decimal=",")["comma"] == "numeric"
