"""Regression metrics (r2, rmse, mae) in ONE aggregation, optionally per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import qcol
from cairn.config import METRICS

# Tolerances of the "all close" rule used when the target is constant.
ALLCLOSE_RTOL = 1e-5
ALLCLOSE_ATOL = 1e-8


def _pair(y: Column, p: Column) -> Column:
    return y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)


def metric_columns(y: Column, p: Column, metrics: tuple[str, ...] = METRICS) -> list[Column]:
    """Aggregate expressions for the requested metrics, in the requested order.

    r2 = 1 - SSE/SST with SST = n * var_pop(y); when the target is constant
    (decided by ``min = max``, not by a float zero test) r2 is 1.0 if every
    prediction is close to the target, else 0.0. Only rows with both values
    (neither NULL nor NaN) count, in every part of every formula; ``n_pairs``
    of :func:`regression_metrics` tells how many there are.
    """
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"Unsupported metric requested: {m}")
    both = _pair(y, p)
    y, p = F.when(both, y), F.when(both, p)
    d = y - p
    n = F.count(d)
    sse = F.sum(d * d)
    out = []
    for m in metrics:
        if m == "r2":
            close = F.bool_and(F.abs(d) <= F.lit(ALLCLOSE_ATOL) + F.lit(ALLCLOSE_RTOL) * F.abs(p))
            r2 = F.when(F.min(y) == F.max(y), F.when(close, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
                F.lit(1.0) - sse / (F.var_pop(y) * n)
            )
            out.append(r2.alias("r2"))
        elif m == "rmse":
            out.append(F.sqrt(sse / n).alias("rmse"))
        else:
            out.append(F.avg(F.abs(d)).alias("mae"))
    return out


def regression_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    metrics: tuple[str, ...] = METRICS,
    group_by: list[str] | None = None,
    with_count: bool = False,
    with_pairs: bool = False,
) -> DataFrame:
    """The metrics as one row (or one per group); ``n`` counts all rows, ``n_pairs`` those that the metrics use."""
    y = qcol(label).cast("double")
    p = qcol(prediction).cast("double")
    aggs = metric_columns(y, p, tuple(metrics))
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("n"))
    if with_pairs:
        aggs.append(F.count_if(_pair(y, p)).alias("n_pairs"))
    if group_by:
        return df.groupBy(*[qcol(g) for g in group_by]).agg(*aggs)
    return df.agg(*aggs)


def metrics_dict(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 metrics: tuple[str, ...] = METRICS) -> dict[str, float]:
    row = regression_metrics(df, label, prediction, metrics).first()
    return {m: (float(row[m]) if row[m] is not None else float("nan")) for m in metrics}


def metrics_log(metrics: tuple[str, ...]) -> str:
    return f"evaluate:{','.join(metrics)}"
