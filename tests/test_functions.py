import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import bin_by_edges, has_cjk, parse_decimal, sql_double, strict_double
from cairn.functions import test_count as rows_on_test_side


def test_strict_double_matches_python_float(spark):
    cases = ["1", " 2 ", "bad", "1d", "2f", "1_000", "inf", "-Infinity", "NaN", "1e3", "+4", ".5", "5.", "", None,
             "1__0", "_1", "\t3\n"]
    got = [r.v for r in spark.createDataFrame([(c,) for c in cases], "s string").select(strict_double("s").alias("v")).collect()]
    for text, value in zip(cases, got):
        try:
            expected = float(text.strip()) if text is not None and text.strip() else math.nan
        except ValueError:
            expected = math.nan
        if math.isnan(expected):
            assert value is None, text
        else:
            assert value == expected, text


def test_parse_decimal_comma(spark):
    df = spark.createDataFrame([("1,5",), ("2",), ("1.5",), ("x",)], "s string")
    got = [r.v for r in df.select(parse_decimal("s", ",").alias("v")).collect()]
    assert got == [1.5, 2.0, None, None]


def test_bin_by_edges_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1.5, 2, 3, 9]], "y double")
    got = [r.b for r in df.select(bin_by_edges("y", [1.0, 2.0, 3.0]).alias("b")).collect()]
    assert got == [0, 0, 1, 1, 2, 3]


def test_test_count_formula():
    assert rows_on_test_side(10, 0.2) == 2
    assert rows_on_test_side(3, 0.2) == 1
    assert rows_on_test_side(2, 0.49) == 1
    assert rows_on_test_side(101, 0.2) == 21
    with pytest.raises(RuntimeError):
        rows_on_test_side(1, 0.2)


def test_cjk_flag(spark):
    df = spark.createDataFrame([("日本語",), ("abc",), ("ｶﾀｶﾅ",), (None,)], "t string")
    assert [r.c for r in df.select(has_cjk("t").alias("c")).collect()] == [True, False, True, False]


def test_sql_double_literal_is_exact(spark):
    vals = [0.1, 1e-300, -2.5e17, 1 / 3, float("inf")]
    row = spark.sql("SELECT " + ", ".join(f"{sql_double(v)} AS c{i}" for i, v in enumerate(vals))).first()
    assert [row[f"c{i}"] for i in range(len(vals))] == vals


def test_ratio_format_rounds_like_python(spark):
    from cairn.functions.text import format_ratio

    vals = [0.2115, 0.0625, 0.0005, 0.1235, 0.0375, 1 / 3, 0.0, 1.0, 0.9995]
    df = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(vals)], "name string, ratio double")
    got = {r["name"]: r["s"] for r in df.select("name", format_ratio("name", "ratio").alias("s")).collect()}
    assert got == {f"c{i}": f"c{i}:" + "%.3f" % v for i, v in enumerate(vals)}
