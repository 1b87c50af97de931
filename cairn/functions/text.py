"""Text expressions: NA tokens, CJK detection, ratio formatting, SQL literal helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default missing-value tokens of the pandas CSV reader.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# hiragana/katakana, CJK unified ideographs, half-width katakana.
CJK_PATTERN = "[぀-ヿ一-鿿ｦ-ﾝ]"


def na_to_null(c: Column | str) -> Column:
    """Raw CSV text → NULL when it is one of the NA tokens."""
    col = qcol(c) if isinstance(c, str) else c
    return F.when(~col.isin(*NA_TOKENS), col)


def has_cjk(c: Column | str) -> Column:
    col = qcol(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(CJK_PATTERN), F.lit(False))


def _python_3f(ratio):
    return ratio.map(lambda v: None if v != v else "%.3f" % v)


def format_ratio(name: Column | str, ratio: Column | str) -> Column:
    """``name:0.123`` (three decimals, rounded like Python's ``%.3f``).

    Python rounds the exact binary value half-to-even (0.2115 is stored as
    0.21149999… → ``0.211``); Java's ``%.3f`` (``format_string``) rounds the
    shortest decimal form half-up (→ ``0.212``) and ``format_number`` treats
    0.0005 as a tie. The digits therefore come from a small Arrow-batched
    Python function; it is applied to the few rows of a top-n report.
    """
    from pyspark.sql.functions import pandas_udf

    n = qcol(name) if isinstance(name, str) else name
    r = qcol(ratio) if isinstance(ratio, str) else ratio
    return F.concat(n, F.lit(":"), pandas_udf(_python_3f, "string")(r.cast("double")))


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    """An exact double literal (constant-folded by the optimizer)."""
    v = float(value)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"CAST('{v!r}' AS DOUBLE)"


def qcol(name: str) -> Column:
    """Column by exact name (dots, spaces and back-quotes in the name are literal)."""
    return F.col(sql_ident(name))
