"""Numeric coercion, missing-value fill, binning and split-count expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import qcol

# The text forms a number may take.
# Python float(): optional sign, digits with single underscores between them,
# optional fraction, optional exponent; or inf / infinity / nan in any case.
PY_FLOAT_PATTERN = (
    r"^[+-]?(?:(?:[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?$"
)
PY_SPECIAL_PATTERN = r"^(?i)[+-]?(?:inf|infinity|nan)$"
# CSV numeric inference: no underscores; inf / infinity accepted.
CSV_FLOAT_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
CSV_SPECIAL_PATTERN = r"^(?i)[+-]?(?:inf|infinity)$"
# Whitespace stripped around a number (str.strip semantics for the usual cases).
_STRIP = r"^[\s  -​　]+|[\s  -​　]+$"


def nan_to_null(c: Column) -> Column:
    """NaN and NULL are one notion of 'missing': fold NaN into NULL."""
    return F.nanvl(c, F.lit(None).cast("double"))


def strict_double(c: Column | str) -> Column:
    """Coerce a value to double the way Python's ``float(text.strip())`` does.

    Numbers pass through (NaN becomes NULL); text is stripped and must match
    the Python float grammar, so ``'1d'``/``'2f'`` (accepted by a plain cast)
    give NULL while ``'1_000'`` gives 1000.0. Anything else gives NULL.
    """
    col = qcol(c) if isinstance(c, str) else c
    text = F.regexp_replace(col.cast("string"), _STRIP, "")
    ok = text.rlike(PY_FLOAT_PATTERN) | text.rlike(PY_SPECIAL_PATTERN)
    value = F.when(ok, F.regexp_replace(text, "_", "").try_cast("double"))
    return nan_to_null(value)


def strict_double_sql(ident: str) -> str:
    """SQL text of :func:`strict_double` for use inside SQL-stage statements."""
    t = f"regexp_replace(CAST({ident} AS STRING), '{_sql_re(_STRIP)}', '')"
    return (
        f"nanvl(CASE WHEN {t} RLIKE '{_sql_re(PY_FLOAT_PATTERN)}' OR {t} RLIKE '{_sql_re(PY_SPECIAL_PATTERN)}' "
        f"THEN try_cast(regexp_replace({t}, '_', '') AS DOUBLE) END, CAST(NULL AS DOUBLE))"
    )


def _sql_re(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def parse_decimal(c: Column | str, decimal: str = ".") -> Column:
    """Parse CSV text as a number with the given decimal separator (NULL if it is not one)."""
    col = qcol(c) if isinstance(c, str) else c
    text = F.regexp_replace(col, r"^[ \t]+|[ \t]+$", "")
    if decimal != ".":
        text = F.when(~text.contains("."), F.replace(text, F.lit(decimal), F.lit(".")))
    ok = text.rlike(CSV_FLOAT_PATTERN) | text.rlike(CSV_SPECIAL_PATTERN)
    value = F.when(ok, text.try_cast("double"))
    # most numbers need no stripping
    return F.when(col.rlike(CSV_FLOAT_PATTERN), col.try_cast("double")).otherwise(value) if decimal == "." else value


def bin_by_edges(c: Column | str, inner_edges: list[float]) -> Column:
    """Right-closed binning: the number of inner edges strictly below the value (NULL has no bin)."""
    col = qcol(c) if isinstance(c, str) else c
    below = [F.when(col > F.lit(float(e)), 1).otherwise(0) for e in inner_edges]
    return F.when(col.isNotNull(), reduce(add, below, F.lit(0)))


def test_count(n: int, test_size: float) -> int:
    """Rows on the test side: ``max(1, min(n - 1, ceil(n * test_size)))``; needs n >= 2."""
    if n < 2:
        raise RuntimeError("Need at least two samples to perform a train/test split.")
    return max(1, min(n - 1, math.ceil(n * float(test_size))))
