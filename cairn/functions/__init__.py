"""Scalar column expressions (JVM-side, whole-stage codegen friendly)."""

from cairn.functions.numeric import (
    bin_by_edges,
    nan_to_null,
    parse_decimal,
    strict_double,
    strict_double_sql,
    test_count,
)
from cairn.functions.text import NA_TOKENS, format_ratio, has_cjk, na_to_null, qcol, sql_ident, sql_double, sql_string

__all__ = [
    "NA_TOKENS",
    "bin_by_edges",
    "format_ratio",
    "has_cjk",
    "na_to_null",
    "nan_to_null",
    "parse_decimal",
    "qcol",
    "sql_double",
    "sql_ident",
    "sql_string",
    "strict_double",
    "strict_double_sql",
    "test_count",
]
