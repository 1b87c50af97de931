"""Benchmark: headline regression workloads on the driver's tables; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced to completion with a ``noop`` write (all rows computed,
nothing collected). A small warm-up on sf0.001 runs first and is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cairn import catalog  # noqa: E402
from cairn.config import MissingPolicy, ModelPolicy, PipelineConfig, ScalingPolicy, SplitPolicy, TargetSpec  # noqa: E402
from cairn.operators.metrics import regression_metrics  # noqa: E402
from cairn.operators.prep import fit_prep  # noqa: E402
from cairn.operators.stats import column_stats, exact_quantiles  # noqa: E402
from cairn.plans import run_regression  # noqa: E402
from cairn.session import local_session  # noqa: E402


def lineitem_run(spark: SparkSession, d: str, kind: str, params: dict, stratify: bool = False) -> DataFrame:
    """Default run on lineitem: no unique key → content-hash order + frozen row id."""
    lm = catalog.lineitem_missing(spark, d).drop("l_orderkey", "l_linenumber")
    cfg = PipelineConfig(target=TargetSpec("explicit", "l_extendedprice"), model=ModelPolicy(kind, params),
                         split=SplitPolicy(stratify_by_target_quantiles=stratify))
    # lm is a row-wise projection of the parquet scan: its file row index is a stable row id
    res = run_regression(spark, cfg, lm, row_id="_metadata")
    return _consume(res)


def prep_fit_all(spark: SparkSession, d: str) -> DataFrame:
    lm = catalog.lineitem_missing(spark, d)
    num = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cat = ["l_returnflag", "l_linestatus"]
    prep = fit_prep(lm, num, cat, MissingPolicy("median"), ScalingPolicy("robust"))
    return prep.columns(lm, keep=["l_orderkey"])


def medians(spark: SparkSession, d: str) -> DataFrame:
    o = catalog._t(spark, d, "orders")
    li = catalog._t(spark, d, "lineitem")
    q1 = exact_quantiles(o, {"o_totalprice": [0.25, 0.5, 0.75]})
    q2 = exact_quantiles(li, {"l_extendedprice": [0.5], "l_quantity": [0.5]})
    rows = [(k, float(v)) for k, vs in (q1 | q2).items() for v in vs]
    return spark.createDataFrame(rows, "column_name string, value double")


HEADLINE = {
    "flagship_part_lr": lambda s, d: _flagship(s, d),
    "lineitem_lr": lambda s, d: lineitem_run(s, d, "linear_regression", {}),
    "lineitem_rf20": lambda s, d: lineitem_run(s, d, "random_forest",
                                               {"n_estimators": 20, "max_depth": 10, "random_state": 42}),
    "lineitem_lr_stratified": lambda s, d: lineitem_run(s, d, "linear_regression", {}, stratify=True),
    "split_stratified_orders": catalog.Q["split_stratified"],
    "prep_fit_transform": prep_fit_all,
    "exact_quantiles": medians,
    "missing_profile": catalog.Q["missing_profile"],
    "metrics_by_group": catalog.Q["metrics_by_group"],
    "csv_roundtrip": catalog.Q["csv_roundtrip"],
    "nnls": catalog.Q["nnls"],
}


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    return _consume(catalog._part_run(spark, d, "linear_regression", {}))


def _consume(res) -> DataFrame:
    """Metrics of a run as a small frame; the run's cached split is released afterwards."""
    rows = regression_metrics(res.predictions, res.target, "prediction", with_count=True).collect()
    res.release()
    return res.predictions.sparkSession.createDataFrame(rows)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="cairn-bench")
    _flagship(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name, fn in HEADLINE.items():
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
