"""Missing-value profile (ratio per column, top five, above-threshold report) and column kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    FloatType,
    MapType,
    NumericType,
    StringType,
    StructType,
    UserDefinedType,
)

from cairn.functions.text import qcol
from cairn.functions.numeric import parse_decimal
from cairn.functions.text import format_ratio

TOP_N = 5


def _missing(df: DataFrame, c: str):
    col = qcol(c)
    dt = df.schema[c].dataType
    if isinstance(dt, (FloatType, DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


#: Columns of one wide aggregate; a wider frame takes several in one job.
WIDE = 64


def missing_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, ratio) for every column: wide means of missing flags, then unpivoted.

    ``ratio`` is 0.0 for an empty frame. One row per partition and ``WIDE``
    columns reaches the shuffle; the rows themselves are not multiplied.
    """
    columns = list(df.columns if columns is None else columns)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, ratio double")
    means = [F.coalesce(F.avg(F.when(_missing(df, c), 1.0).otherwise(0.0)), F.lit(0.0)) for c in columns]
    chunks = [list(range(at, min(at + WIDE, len(columns)))) for at in range(0, len(columns), WIDE)]
    parts = []
    for chunk in chunks:
        pairs = F.array(*[F.struct(F.lit(columns[i]).alias("column_name"), F.col(f"m{i}").alias("ratio")) for i in chunk])
        parts.append(df.agg(*[means[i].alias(f"m{i}") for i in chunk]).select(F.inline(pairs)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_top(ratios: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` highest ratios; ties by column name."""
    return ratios.orderBy(F.desc("ratio"), F.asc("column_name")).limit(n)


def missing_summary(ratios: DataFrame, n: int = TOP_N) -> DataFrame:
    """One row: ``missing_top5:<c>:<r>,...`` (``none`` when there are no columns)."""
    top = missing_top(ratios, n)
    entries = top.select(
        F.struct((-F.col("ratio")).alias("k"), F.col("column_name").alias("c"), format_ratio("column_name", "ratio").alias("s")).alias("e")
    )
    joined = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), ",").alias("j"))
    return joined.select(
        F.concat(F.lit("missing_top5:"), F.when(F.col("j") == "", F.lit("none")).otherwise(F.col("j"))).alias("summary")
    )


def missing_over(ratios: DataFrame, threshold: float) -> DataFrame:
    """Columns whose ratio is strictly above the threshold, in top-five order."""
    return ratios.where(F.col("ratio") > F.lit(float(threshold))).orderBy(F.desc("ratio"), F.asc("column_name"))


BOOL_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")


def column_kinds(df: DataFrame, columns: list[str] | None = None, decimal: str = ".",
                 inspect_text: bool = True) -> dict[str, str]:
    """numeric / categorical per column, decided on all rows.

    Typed columns: numeric and boolean types are numeric, everything else
    categorical. Text columns of a raw CSV frame (``inspect_text``): one aggregation counts, per column, the
    non-missing values and those that read as numbers (or booleans); a column
    is numeric when every non-missing value does. A boolean column counts as
    numeric only without missing values; an all-missing column is numeric.
    """
    columns = list(df.columns if columns is None else columns)
    kinds: dict[str, str] = {}
    text_cols = []
    for c in columns:
        dt = df.schema[c].dataType
        if isinstance(dt, (ArrayType, MapType, StructType, BinaryType, UserDefinedType)):
            raise TypeError(f"feature column {c!r} has unsupported type {dt.simpleString()}; "
                            "expand it into scalar columns first")
        if isinstance(dt, (NumericType, BooleanType)):
            kinds[c] = "numeric"
        elif isinstance(dt, StringType) and inspect_text:
            text_cols.append(c)
        else:
            kinds[c] = "categorical"
    if text_cols:
        counts = text_counts(df, text_cols, decimal)
        kinds |= {c: text_kind(counts[c]) for c in text_cols}
    return {c: kinds[c] for c in columns}


def text_counts(df: DataFrame, columns: list[str], decimal: str = ".") -> dict[str, dict[str, int]]:
    """Per text column: rows, values (``n``), values that read as numbers (``num``) and as booleans (``b``)."""
    # long form: (column id, text) rows, a few counts per column id
    items = F.array(*[F.struct(F.lit(i).alias("cid"), qcol(c).alias("v")) for i, c in enumerate(columns)])
    v = F.col("v")
    rows = (
        df.select(F.inline(items))
        .groupBy("cid")
        .agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"),
             F.count(parse_decimal(v, decimal)).alias("num"), F.count_if(v.isin(*BOOL_TOKENS)).alias("b"))
        .toArrow().to_pylist()
    )
    got = {r["cid"]: r for r in rows}
    return {c: got.get(i, {"rows": 0, "n": 0, "num": 0, "b": 0}) for i, c in enumerate(columns)}


def text_kind(counts: dict[str, int]) -> str:
    n, booleans = counts["n"], counts["b"]
    numbers = n == 0 or counts["num"] == n or (booleans == n and n == counts["rows"])
    return "numeric" if numbers else "categorical"
