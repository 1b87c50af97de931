"""The regression run: a fixed sequence of Spark jobs replacing the step planner.

load → target (choose, coerce, gate, median-fill) → kinds → [missing profile]
→ exact-count split → fit preprocessing on train → fit model on train →
score test → metrics → [persist]. Each step logs one entry in the workflow's
format; ``run_report`` turns them into a ``(seq, step, detail)`` frame.

Passes over the data for one default run (median + standard + one-hot,
linear model): target quality + median, kinds (CSV only), split histograms,
numeric moments, medians, category counts, model fit, metrics. The split
frame is persisted (MEMORY_AND_DISK) because every later step reads it; its
lineage is deterministic (md5 order of keys and contents), so a lost executor
recomputes exactly the same rows.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import PipelineConfig
from cairn.functions.text import qcol
from cairn.model_kinds import registered
from cairn.operators.metrics import metrics_log, regression_metrics
from cairn.operators.models import SPARK_MAX_DEPTH, build_estimator, model_log
from cairn.operators.prep import FittedPrep, fit_prep
from cairn.operators.profile import column_kinds, missing_ratios
from cairn.operators.split import KEY_COLUMNS, random_split, stratified_split, with_order_keys
from cairn.operators.target import repair_target, resolve_target
from cairn.session import materialize


_LOG = logging.getLogger(__name__)
# a cached split frame of at least this many rows held in fewer partitions than cores is spread over the cores
# (how it is spread changes no result: the forest's input has partitions of its own)
SPREAD_MIN_ROWS = 100_000
# rows of a forest's input partition; its bootstrap follows the partitions, so their number follows the rows alone
FOREST_ROWS = 250_000
FOREST_MIN_PARTITIONS = 8
# identical rows of a forest's input that may lie together: this many, or less where a partition holds few rows
FOREST_COPIES = 1_000
FOREST_PORTIONS = 64
# buckets of keys per ``rows / size``: a bucket holds a fraction of the copies that may lie together
FOREST_BUCKETS = 4


class StepRegistry:
    """Named user steps (``DataFrame -> DataFrame``) applied after loading, in the given order."""

    def __init__(self) -> None:
        self._steps: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if not (name or "").strip():
            raise ValueError("a step needs a name that is not empty")
        if self._steps.setdefault(name, fn) is not fn:
            raise ValueError(f"a step called {name!r} is already registered")

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name in self._steps:
            return self._steps[name]
        raise KeyError(f"no step called {name!r} is registered")

    def names(self) -> list[str]:
        return list(self._steps)


@dataclass
class RunResult:
    metrics: dict[str, float]
    logs: list[str]
    target: str
    kinds: dict[str, str]
    prep: FittedPrep
    prep_model: PipelineModel
    model: PipelineModel
    split: DataFrame
    predictions: DataFrame
    artifacts: tuple[str, str] | None = None
    actions: list[str] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    cached: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached rows once the results have been consumed."""
        if self.cached is not None:
            self.cached.unpersist()


def run_report(spark: SparkSession, logs: list[str]) -> DataFrame:
    """(seq, step, detail) from the run log – values already computed, no extra pass."""
    rows = []
    for i, entry in enumerate(logs):
        cut = min([p for p in (entry.find(":"), entry.find("=")) if p >= 0], default=-1)
        step, detail = (entry, "") if cut < 0 else (entry[:cut], entry[cut + 1:])
        rows.append((i, step, detail))
    return spark.createDataFrame(rows, "seq int, step string, detail string")


class StepFailed(Exception):
    """A step of the run failed: its name, the log and actions so far, and the cause."""

    def __init__(self, step: str, logs: list[str], actions: list[str]):
        super().__init__(step)
        self.step, self.logs, self.actions = step, logs, actions


class _Run:
    """Log, actions and timings of one run; every step runs inside :meth:`step`."""

    def __init__(self) -> None:
        self.logs: list[str] = []
        self.actions: list[str] = []
        self.timings: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        except Exception as exc:
            if entry := getattr(exc, "entry", None):
                self.logs.append(entry)
            raise StepFailed(name, self.logs, self.actions) from exc
        self.actions.append(name)
        self.timings[name] = round(time.perf_counter() - began, 3)


def run_regression(
    spark: SparkSession,
    config: PipelineConfig,
    df: DataFrame | None = None,
    key: list[str] | str | None = None,
    unique_key: bool = False,
    row_id: str | None = None,
    steps: list[str] = (),
    registry: StepRegistry | None = None,
    feature_stages: list = (),
    model_features_col: str = "features",
) -> RunResult:
    """Run the regression workflow; see the module docstring for the steps.

    ``key``/``unique_key``/``row_id`` choose the split's row order (see
    ``cairn.operators.split``). ``steps`` are names in ``registry`` applied to
    the loaded frame in order; ``feature_stages`` are Spark ML stages fitted
    between the preprocessing and the model (they read ``features`` and the
    model reads ``model_features_col``). An error is raised as it is; see
    :func:`run_with_payload` for the step it came from.
    """
    try:
        return _run(spark, config, df, key, unique_key, row_id, steps, registry, feature_stages, model_features_col)
    except StepFailed as failed:
        raise failed.__cause__


def _run(spark: SparkSession, config: PipelineConfig, df: DataFrame | None = None, key: list[str] | str | None = None,
         unique_key: bool = False, row_id: str | None = None, steps: list[str] = (), registry: StepRegistry | None = None,
         feature_stages: list = (), model_features_col: str = "features") -> RunResult:
    run = _Run()
    logs = run.logs
    from_csv = df is None
    if from_csv:
        from cairn.sources.csv import csv_encoding, csv_inventory, read_csv

        if config.file is None:
            raise ValueError("either a DataFrame or config.file is required")
        with run.step("detect_encoding"):
            inventory = csv_inventory(spark, config.file)
            encoding = csv_encoding(spark, config.file, inventory)
            logs.append(f"encoding={encoding}")
        with run.step("load_csv"):
            # parse once: later passes read columnar
            df = materialize(read_csv(spark, config.file, encoding, inventory)[0], "csv-typed")
    for name in steps:
        with run.step(name):
            df = (registry or StepRegistry()).get(name)(df)

    with run.step("identify_target"):
        target = resolve_target(df.columns, config.target)
        logs.append(f"target:{target}")
    with run.step("validate_target_numeric"):
        df, repair = repair_target(df, target, config.target_nan_threshold)
        if from_csv:
            logs.insert(1, f"csv_shape={repair.rows}x{len(df.columns)}")
        logs.append(repair.log)

    key_cols = [key] if isinstance(key, str) else list(key or [])
    with run.step("split_xy"):
        features = [c for c in df.columns if c != target and c not in key_cols]
        kinds = column_kinds(df, features, inspect_text=False)  # CSV text was typed by the source
        logs.append("split_xy")

    if config.check_missing:
        with run.step("check_missing"):
            # one job; the result has one row per feature column
            ratios = sorted(((r["column_name"], float(r["ratio"])) for r in missing_ratios(df, features).collect()),
                            key=lambda t: (-t[1], t[0]))
            top = ",".join(f"{c}:{v:.3f}" for c, v in ratios[:5]) or "none"
            logs.append(f"missing_top5:{top}")
            over = [(c, v) for c, v in ratios if v > config.missing.report_threshold]
            if over:
                _LOG.warning("Missing ratios above threshold %.2f: %s", config.missing.report_threshold,
                             ", ".join(f"{c}:{v:.3f}" for c, v in over))

    with run.step("train_test_split"):
        sp = config.split
        # the rows with their order keys are cached: the cut's passes and every later step read them
        base = with_order_keys(df, sp.random_state, key_cols or None, unique_key, row_id).persist(StorageLevel.MEMORY_AND_DISK)
        if repair.rows >= SPREAD_MIN_ROWS and base.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            # spread rows that sit in fewer partitions than cores (only small inputs do; below SPREAD_MIN_ROWS the
            # shuffle costs more than it saves)
            base.unpersist()
            base = df.repartition(spark.sparkContext.defaultParallelism)
            base = with_order_keys(base, sp.random_state, key_cols or None, unique_key, row_id).persist(StorageLevel.MEMORY_AND_DISK)
        order = dict(key=key_cols or None, unique_key=unique_key, keep_keys=True, row_id=row_id, keyed=True)
        if sp.stratify_by_target_quantiles:
            # with missing targets filled, the statistics before the fill no longer hold
            known = repair.stats if not repair.missing else None
            split = stratified_split(base, target, sp.test_size, sp.random_state, stats=known, **order)
        else:
            split = random_split(base, sp.test_size, sp.random_state, **order)
        train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
        logs.append("train_test_split")

    numeric = [c for c in features if kinds[c] == "numeric"]
    categorical = [c for c in features if kinds[c] == "categorical"]
    with run.step("build_preprocessor"):
        prep = fit_prep(train, numeric, categorical, config.missing, config.scaling, config.category)
        logs.append(prep.log())
    with run.step("fit_transform_preprocessor"):
        prep_model = prep.pipeline_model("features", train)
        logs.append("fit_transform_preprocessor")

    with run.step("train_model"):
        estimator = build_estimator(config.model, prep.feature_count, model_features_col, target, "prediction")
        fit_input = prep_model.transform(train)
        own = registered(config.model.kind)
        if config.model.kind == "random_forest" or (own and own.fixed_partitions):
            fit_input = forest_input(fit_input, repair.rows)
        if config.model.kind == "random_forest":
            wanted = config.model.params.get("max_depth")
            if wanted is None or wanted > SPARK_MAX_DEPTH:
                logs.append(f"forest_depth_limit:{SPARK_MAX_DEPTH}")
        model = Pipeline(stages=[*feature_stages, estimator]).fit(fit_input)
        logs.append(model_log(config.model))

    with run.step("predict"):
        predictions = model.transform(prep_model.transform(test)).drop(*KEY_COLUMNS)
        logs.append("predict")
    with run.step("evaluate"):
        row = regression_metrics(predictions, target, "prediction", config.eval.metrics, with_count=True).first()
        metrics = {m: float(row[m]) if row[m] is not None else float("nan") for m in config.eval.metrics}
        if prep.drop_rows_on:
            # rows kept by drop_rows, from passes that run anyway (fit moments, metrics aggregation)
            logs.append(f"drop_rows:train_kept={prep.train_rows},test_kept={row['n']}")
        logs.append(metrics_log(config.eval.metrics))

    artifacts = None
    if config.persist:
        from cairn.sources.artifacts import save_artifacts

        with run.step("persist_artifacts"):
            artifacts = save_artifacts(prep_model, model, config.artifact_dir(),
                                       config.artifacts.model_name, config.artifacts.preprocessor_name)
            logs.append(f"persist_artifacts:{artifacts[0]},{artifacts[1]}")
    return RunResult(metrics, logs, target, kinds, prep, prep_model, model, split, predictions, artifacts, run.actions, run.timings, base)


def forest_input(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions that follow the rows' order keys and number, not the cluster.

    Spark draws a forest's bootstrap per partition, in row order: with fixed
    partitions the same data and seed give the same trees on any number of
    cores, and a retried task draws the same rows. Where identical rows crowd
    one key, they become one row with a count (pre-aggregated), the counts are
    dealt in portions of up to ``FOREST_COPIES`` and the copies made again there,
    so each still draws for itself in the bootstrap and none meet in one task.
    Rows outside of crowded buckets of keys go to their partitions as they are.
    """
    parts = max(FOREST_MIN_PARTITIONS, -(-rows // FOREST_ROWS))
    keys = [c for c in KEY_COLUMNS if c in df.columns]
    size = max(1, min(FOREST_COPIES, rows // (parts * FOREST_PORTIONS)))
    # a crowded key makes its bucket crowded: the buckets, a quarter of ``size`` rows on average, are counted first
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(max(1, FOREST_BUCKETS * rows // size))))
    crowded = materialize(bucketed.groupBy("__bucket").count().where(F.col("count") > size).select("__bucket"), "forest-crowds")
    if crowded.isEmpty():
        return df.repartition(parts, *keys).sortWithinPartitions(*keys)
    others = [c for c in df.columns if c not in keys]
    plain = [qcol(c) for c in others if not isinstance(df.schema[c].dataType, VectorUDT)]
    # the key of a key column that is not unique after all: rows of one group are equal
    same, row = (F.xxhash64(*plain) if plain else F.lit(0).cast("long")).alias("__same"), F.struct(*map(qcol, others)).alias("__row")
    # at most rows / size buckets; grouped by the row itself, a task holds one entry per different row and sorts nothing
    crowd = bucketed.join(F.broadcast(crowded), "__bucket", "left_semi").select(*keys, same, row)
    groups = materialize(crowd.groupBy(*keys, "__same", "__row").agg(F.count(F.lit(1)).alias("__n")), "forest-copies")
    if groups.groupBy(*keys).agg(F.sum("__n").alias("n")).where(F.col("n") > size).isEmpty():
        return df.repartition(parts, *keys).sortWithinPartitions(*keys)
    portions = groups.withColumn("__portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {size}"))))
    many = portions.select(*keys, "__same", "__row", "__portion", F.least(F.col("__n") - F.col("__portion") * size, F.lit(size).cast("long")).cast("int").alias("__copies"))
    single = bucketed.join(F.broadcast(crowded), "__bucket", "left_anti").select(*keys, same, row, F.lit(0).cast("long").alias("__portion"), F.lit(1).alias("__copies"))
    dealt = many.unionByName(single).repartition(parts, *keys, "__same", "__portion").sortWithinPartitions(*keys, "__same", "__portion")
    return dealt.select(*keys, "__row", F.explode(F.array_repeat(F.lit(True), F.col("__copies"))).alias("__copy")).select(*keys, "__row.*")


# The payload's status and error kinds.
OK, ERROR = "ok", "error"
CONFIGURATION_ERROR, EXECUTION_FAILED, UNEXPECTED_ERROR = "configuration_error", "execution_failed", "unexpected_error"


def run_with_payload(spark: SparkSession, config: PipelineConfig | Callable[[], PipelineConfig], **kwargs) -> tuple[DataFrame, RunResult | None]:
    """Run and return the result payload frame (status, actions, metrics, logs, error).

    ``config`` may be a function that builds the configuration, so that a bad
    setting is reported too. A failing step keeps all log entries and actions
    before it and adds ``action_error:<step>:<error class>:<message>``; the
    payload's ``error`` is its kind: ``configuration_error`` for settings that
    do not hold, ``execution_failed`` for a step, Spark's errors included, and
    ``unexpected_error`` for anything outside of one.
    """
    from cairn.sources.artifacts import result_frame

    try:
        settings = config() if callable(config) else config
    except (ValueError, TypeError, KeyError, NotImplementedError) as exc:
        return result_frame(spark, ERROR, None, [f"configuration:{exc}"], [], CONFIGURATION_ERROR), None
    try:
        res = _run(spark, settings, **kwargs)
        return result_frame(spark, OK, res.metrics, res.logs, res.actions, None), res
    except StepFailed as failed:
        cause = failed.__cause__
        # the first line: Spark's messages go on with the plan and the stack
        message = (str(cause).strip().splitlines() or [""])[0]
        logs = [*failed.logs, f"action_error:{failed.step}:{type(cause).__name__}:{message}"]
        kind = CONFIGURATION_ERROR if isinstance(cause, NotImplementedError) else EXECUTION_FAILED
        return result_frame(spark, ERROR, None, logs, failed.actions, kind), None
    except ValueError as exc:
        return result_frame(spark, ERROR, None, [f"configuration:{exc}"], [], CONFIGURATION_ERROR), None
    except Exception as exc:
        return result_frame(spark, ERROR, None, [f"unexpected:{type(exc).__name__}"], [], UNEXPECTED_ERROR), None
