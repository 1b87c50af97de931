"""Regression models on Spark ML: OLS, non-negative OLS and random forest.

* ``linear_regression`` (``solver="auto"`` or ``"gram"``) and ``positive=True``:
  ONE pass accumulates X'X, X'y per task in ``mapInArrow`` (the non-zero
  entries of a sparse row only), Spark's ``Summarizer`` sums the tasks' rows in
  two levels, and the d x d problem is solved on the driver: the minimum-norm
  least-squares fit (what a rank-deficient design such as full one-hot +
  intercept needs for predictions on unseen categories) or active-set NNLS.
  Columns that lie far from zero are shifted by a data row first, so that
  centring does not cancel; the system is equilibrated before it is solved.
  Narrow designs take one job without a shuffle: every task shifts by its own
  first row, and the driver adds the tasks' co-moments.
  A design wider than ``GRAM_MAX_FEATURES`` has the same problem solved by
  products alone (``cairn.operators.wide_linear``): conjugate gradients to the
  same minimum-norm fit, or projected ones to NNLS with a checked certificate.
  ``solver="spark"`` (Spark's ``LinearRegression``, two passes) is an explicit
  choice. Scoring is a JVM-side dot product over the non-zero entries, wrapped
  in a persistable ML model.
* ``random_forest``: ``RandomForestRegressor`` with the workflow defaults
  (100 trees, fully grown = Spark's deepest, 30; all features per split) and
  the same number of histogram bins at every width.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.config import ModelPolicy
from cairn.model_kinds import registered
from cairn.operators.wide_linear import Design, least_squares, non_negative

_LOG = logging.getLogger(__name__)

# Spark's deepest tree and the forest defaults of the workflow.
SPARK_MAX_DEPTH = 30
DEFAULT_TREES = 100
FOREST_NODE_MEMORY_MB = 1024


def max_features_count(value, n_features: int) -> str:
    """Resolve a max_features setting to Spark's featureSubsetStrategy (an integer as text, or 'all')."""
    d = max(1, int(n_features))
    if value is None:
        k = d
    elif value == "sqrt":
        k = max(1, int(math.floor(math.sqrt(d))))
    elif value == "log2":
        k = max(1, int(math.floor(math.log2(d))))
    elif isinstance(value, int):
        k = min(int(value), d)
    else:
        k = max(1, int(math.floor(float(value) * d)))
    return "all" if k >= d else str(k)


# relative eigenvalue cutoff of the equilibrated normal equations: an exact dependency (full one-hot +
# intercept) shows up near 1e-16; independent directions keep condition numbers up to 1e12
GRAM_RCOND = 1e-12
# the driver holds and solves a d x d matrix (128 MB at this width)
GRAM_MAX_FEATURES = 4096
# coefficients written into a plan one by one
LITERAL_COEFFICIENTS = 1_000
# widths at which a batch of sparse rows is multiplied as a full matrix (the same sums either way)
NARROW = 64


def build_estimator(policy: ModelPolicy, n_features: int, features_col: str = "features",
                    label_col: str = "label", prediction_col: str = "prediction"):
    p = dict(policy.params)
    if own := registered(policy.kind):
        return own.estimator(features_col, label_col, prediction_col, p)
    if policy.kind == "linear_regression":
        fit_intercept = bool(p.get("fit_intercept", True))
        if p.get("positive", False) or policy.solver != "spark":
            return NonNegativeLeastSquares(featuresCol=features_col, labelCol=label_col,
                                           predictionCol=prediction_col, fitIntercept=fit_intercept,
                                           positive=bool(p.get("positive", False)))
        return LinearRegression(featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col,
                                fitIntercept=fit_intercept, regParam=0.0, elasticNetParam=0.0,
                                solver="auto", maxIter=500, tol=1e-10, standardization=True)
    crit = p.get("criterion", "squared_error")
    if crit != "squared_error":
        raise NotImplementedError(f"criterion {crit!r} has no Spark ML counterpart (variance impurity only)")
    if "min_samples_split" in p:
        raise NotImplementedError("min_samples_split has no Spark ML counterpart")
    depth = p.get("max_depth")
    if depth is None or depth > SPARK_MAX_DEPTH:
        _LOG.warning("max_depth %s: trees end at Spark's deepest level, %s", depth or "unlimited", SPARK_MAX_DEPTH)
        depth = SPARK_MAX_DEPTH
    kwargs = dict(
        featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col,
        numTrees=int(p.get("n_estimators", DEFAULT_TREES)), maxDepth=int(depth),
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)), bootstrap=bool(p.get("bootstrap", True)),
        featureSubsetStrategy=max_features_count(p.get("max_features"), n_features),
        maxBins=int(policy.max_bins), impurity="variance",
        # more tree nodes split per pass over the data, and node ids cached (and
        # checkpointed into the shared folder) instead of re-walking every tree
        maxMemoryInMB=FOREST_NODE_MEMORY_MB, cacheNodeIds=True, checkpointInterval=10,
    )
    if p.get("random_state") is not None:
        kwargs["seed"] = int(p["random_state"])
    return RandomForestRegressor(**kwargs)


# ---------------------------------------------------------------------------------------------
# Non-negative least squares


def _entries(features_col: str) -> Column:
    """A vector column as ``struct(size, indices, values)``; a dense vector has null indices."""
    u = F.unwrap_udt(F.col(features_col))
    return F.struct(u["size"].alias("size"), u["indices"].alias("indices"), u["values"].alias("values"))


def shift_row(df: DataFrame, features_col: str, label_col: str) -> tuple[np.ndarray, float] | None:
    """A point near the data: the first row's values, where they are neither 0 nor 1 (indicators stay sparse)."""
    row = df.select(F.col(features_col).alias("x"), F.col(label_col).cast("double").alias("y")).first()
    if row is None:
        return None
    x = row["x"].toArray()
    return np.where((x == 0) | (x == 1) | ~np.isfinite(x), 0.0, x), float(row["y"] or 0.0)


def gram_statistics(df: DataFrame, features_col: str, label_col: str, shift: tuple[np.ndarray, float] | None = None,
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, sum(x), sum(y), y'y, n of the rows less ``shift``, in one pass over ``df``.

    Each task reduces its Arrow batches in NumPy to ONE packed row (upper
    triangle of X'X, then X'y, sum(x), sum(y), y'y, n). Batches of sparse rows
    add the products of their non-zero entries; the shifted columns, which are
    dense, go through one small matrix product. Spark's ``Summarizer`` adds the
    rows element-wise in two levels, first within groups of tasks (``partition
    id mod sqrt(tasks)``), then globally, so no single task merges more than
    about sqrt(tasks) partials of size d(d+1)/2; the input is coalesced to a few
    tasks per core, so the partial count follows the cluster, not the data.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    shift = shift or shift_row(df, features_col, label_col)
    if shift is None:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0, 0
    x0, y0 = shift
    d = len(x0)
    # one d(d+1)/2 partial per task: keep the task count near the cluster's parallelism
    # (coalesce: no shuffle, never increases the partition count)
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(_entries(features_col).alias("x"), F.col(label_col).cast("double").alias("y")).coalesce(tasks)

    def partial(batches):
        import pyarrow as pa

        xtx, xty, sx, tail = np.zeros((d, d)), np.zeros(d), np.zeros(d), np.zeros(3)
        moved = np.flatnonzero(x0)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            y = b.column("y").to_numpy(zero_copy_only=False) - y0
            indices, values = b.column("x").field("indices"), b.column("x").field("values")
            flat = values.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(values.offsets.to_numpy())
            if indices.null_count == n and (sizes == d).all():
                x = flat.reshape(n, d) - x0
                xtx += x.T @ x
                xty += x.T @ y
                sx += x.sum(axis=0)
            else:
                row = np.repeat(np.arange(n), sizes)
                dense = np.asarray(indices.is_null())  # rows stored in full
                cols = np.empty(len(flat), np.int64)
                cols[~dense[row]] = indices.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                cols[dense[row]] = (np.arange(len(flat)) - starts[row])[dense[row]]
                if d <= NARROW:  # a full matrix of the batch is small
                    x = np.tile(-x0, (n, 1))
                    x[row, cols] += flat
                    xtx += x.T @ x
                    xty += x.T @ y
                    sx += x.sum(axis=0)
                    tail += (float(y.sum()), float(y @ y), float(n))
                    continue
                some = flat != 0
                row, cols, flat = row[some], cols[some], flat[some]
                # the shifted columns as one dense block, all others by their non-zero entries
                place = np.full(d, -1)
                place[moved] = np.arange(len(moved))
                block = np.tile(-x0[moved], (n, 1))
                of = place[cols]
                np.add.at(block, (row[of >= 0], of[of >= 0]), flat[of >= 0])
                row, cols, flat = row[of < 0], cols[of < 0], flat[of < 0]
                xtx[np.ix_(moved, moved)] += block.T @ block
                xty[moved] += block.T @ y
                sx[moved] += block.sum(axis=0)
                np.add.at(xty, cols, flat * y[row])
                np.add.at(sx, cols, flat)
                for k, m in enumerate(moved):
                    cross = np.bincount(cols, weights=flat * block[row, k], minlength=d)
                    xtx[m] += cross
                    xtx[:, m] += cross
                count = np.bincount(row, minlength=n)
                begin = np.cumsum(count) - count
                for step in range(int(count.max(initial=0))):  # pairs of entries `step` places apart in their row
                    left = np.arange(len(row))
                    left = left[left - begin[row] + step < count[row]]
                    right = left + step
                    product = flat[left] * flat[right]
                    np.add.at(xtx, (cols[left], cols[right]), product)
                    if step:
                        np.add.at(xtx, (cols[right], cols[left]), product)
            tail += (float(y.sum()), float(y @ y), float(n))
        if tail[2]:
            packed = np.concatenate((xtx[np.triu_indices(d)], xty, sx, tail))
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.list_(pa.float64()))], names=["s"])

    parts = rows.mapInArrow(partial, "s array<double>").select(array_to_vector("s").alias("s"))
    groups = max(1, math.isqrt(tasks))
    level1 = parts.groupBy((F.spark_partition_id() % groups).alias("g")).agg(Summarizer.sum(F.col("s")).alias("s"))
    tot = level1.agg(Summarizer.sum(F.col("s")).alias("s")).first()["s"].toArray()
    iu = np.triu_indices(d)
    m = len(iu[0])
    xtx = np.zeros((d, d))
    xtx[iu] = tot[:m]
    xtx = xtx + np.triu(xtx, 1).T
    xty, sx = tot[m:m + d], tot[m + d:m + 2 * d]
    sy, yy, n = tot[m + 2 * d:]
    return xtx, xty, sx, float(sy), float(yy), int(round(n))


def vector_size(df: DataFrame, features_col: str) -> int | None:
    """Width of a vector column: from its metadata, else from a row (None without one)."""
    attrs = df.schema[features_col].metadata.get("ml_attr", {})
    if attrs.get("num_attrs"):
        return int(attrs["num_attrs"])
    row = df.select(features_col).first()
    return row[0].size if row else None


def narrow_statistics(df: DataFrame, features_col: str, label_col: str, d: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Co-moments of the features, those with the label, both means, and the rows, in one job without a shuffle.

    For narrow designs. Every task takes its own first row as its origin, so
    nothing cancels however far the columns lie from zero, and gives one row of
    (d + 1)(d + 2) / 2 products and sums; the driver adds the tasks' co-moments
    about the common mean (about zero unless ``centred``).
    """
    from pyspark.ml.functions import vector_to_array

    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    # one plain column a feature: nested ones take most of the job's time on their way to Python
    full = df.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y"))
    rows = full.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d)], "y").coalesce(tasks)
    w = d + 1

    def partial(batches):
        import pyarrow as pa

        origin, n, sums, products = None, 0, np.zeros(w), np.zeros((w, w))
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            z = np.empty((k, w))
            for i in range(w):
                z[:, i] = b.column(i).to_numpy(zero_copy_only=False)
            if origin is None:
                origin = np.where(np.isfinite(z[0]), z[0], 0.0) if centred else np.zeros(w)
            z -= origin
            n += k
            sums += z.sum(axis=0)
            products += z.T @ z
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((origin, sums, products[np.triu_indices(w)], [n]))], pa.list_(pa.float64()))], names=["s"])

    n, mean, moments = 0, np.zeros(w), np.zeros((w, w))
    upper = np.triu_indices(w)
    for part in rows.mapInArrow(partial, "s array<double>").toArrow().column("s").to_pylist():
        part = np.asarray(part)
        origin, sums, k = part[:w], part[w : 2 * w], int(part[-1])
        own = np.zeros((w, w))
        own[upper] = part[2 * w : -1]
        own += np.triu(own, 1).T
        if centred:
            own -= np.outer(sums, sums) / k
            gap = origin + sums / k - mean
            moments += own + np.outer(gap, gap) * (n * k / (n + k))
            mean += gap * (k / (n + k))
        else:
            moments += own
        n += k
    return moments[:d, :d], moments[:d, d], mean[:d], float(mean[d]), n


def nnls_gram(g: np.ndarray, b: np.ndarray, tol: float = 1e-10, max_iter: int | None = None) -> np.ndarray:
    """Active-set (Lawson–Hanson) NNLS on the normal equations: min ½β'Gβ − b'β, β ≥ 0."""
    d = len(b)
    x = np.zeros(d)
    passive = np.zeros(d, dtype=bool)
    w = b - g @ x
    it = 0
    max_iter = max_iter or 30 * max(d, 1)
    scale = max(1.0, float(np.max(np.abs(b)))) if d else 1.0
    while (~passive).any() and np.max(np.where(~passive, w, -np.inf)) > tol * scale and it < max_iter:
        j = int(np.argmax(np.where(~passive, w, -np.inf)))
        passive[j] = True
        while True:
            it += 1
            s = np.zeros(d)
            idx = np.flatnonzero(passive)
            s[idx] = np.linalg.lstsq(g[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if it >= max_iter:
                raise RuntimeError(f"non-negative least squares did not settle in {max_iter} steps")
            if (s[idx] > 0).all():
                break
            neg = idx[s[idx] <= 0]
            alpha = np.min(x[neg] / (x[neg] - s[neg]))
            x = x + alpha * (s - x)
            passive &= x > tol
            x[~passive] = 0.0
        x = s
        w = b - g @ x
    return np.maximum(x, 0.0)


def nnls_equilibrated(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """NNLS on the equilibrated normal equations: beta = D z with z >= 0 (D > 0 keeps the signs)."""
    d = np.sqrt(np.clip(np.diag(g), 0.0, None))
    d[d == 0] = 1.0
    return nnls_gram(g / np.outer(d, d), b / d) / d


def min_norm_gram(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations (equals the min-norm least-squares fit).

    The normal equations square the condition number, so features on very different scales
    (1e6 next to 1e-3) would lose the small one. The system is solved equilibrated
    (``D G D z = D b``, ``D = diag(G)^-1/2``) by its eigenvectors. ``D z`` is a least-squares
    solution; where the design is rank-deficient (full one-hot + intercept) its part in the
    null space of ``G``, which is ``D`` times that of ``D G D``, is taken off, and what remains
    has the smallest norm in the original coordinates.
    """
    d = np.sqrt(np.clip(np.diag(g), 0.0, None))
    inverse = np.where(d > 0, 1.0 / np.where(d > 0, d, 1.0), 1.0)
    values, vectors = np.linalg.eigh(g * np.outer(inverse, inverse))
    keep = values > GRAM_RCOND * max(values.max(initial=0.0), 0.0)
    z = vectors[:, keep] @ ((vectors[:, keep].T @ (b * inverse)) / values[keep])
    beta = z * inverse
    if keep.all():
        return beta
    null, _ = np.linalg.qr(vectors[:, ~keep] * inverse[:, None])
    return beta - null @ (null.T @ beta)


class _NnlsParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    fitIntercept = Param(Params._dummy(), "fitIntercept", "fit an unconstrained intercept",
                         typeConverter=TypeConverters.toBoolean)
    positive = Param(Params._dummy(), "positive", "constrain coefficients to be >= 0",
                     typeConverter=TypeConverters.toBoolean)


class NonNegativeLeastSquaresModel(Model, _NnlsParams, DefaultParamsReadable, DefaultParamsWritable):
    coefficients = Param(Params._dummy(), "coefficients", "fitted coefficients", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "fitted intercept", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 fitIntercept=True, positive=True, coefficients=None, intercept=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         fitIntercept=True, positive=True, intercept=0.0, coefficients=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = self.getOrDefault(self.coefficients)
        if len(values) <= LITERAL_COEFFICIENTS:
            coef = F.array(*[F.lit(float(c)) for c in values])
        else:  # one literal that Spark folds to the array, instead of an expression each
            coef = F.from_json(F.lit("[" + ",".join(map(repr, map(float, values))) + "]"), "array<double>")
        x = _entries(self.getOrDefault(self.featuresCol))
        plus = lambda acc, v: acc + v
        dense = F.aggregate(F.zip_with(x["values"], coef, lambda v, c: v * c), F.lit(0.0), plus)
        sparse = F.aggregate(F.zip_with(x["values"], x["indices"], lambda v, i: v * F.get(coef, i)), F.lit(0.0), plus)
        dot = F.when(x["indices"].isNull(), dense).otherwise(sparse)
        return dataset.withColumn(self.getOrDefault(self.predictionCol),
                                  dot + F.lit(float(self.getOrDefault(self.intercept))))


class NonNegativeLeastSquares(Estimator, _NnlsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares from the distributed Gram matrix: NNLS (``positive``) or the minimum-norm solution.

    With ``positive=False`` this is also the default linear solver (one pass over the data; the
    name is kept so saved pipelines keep loading).
    """

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", fitIntercept=True,
                 positive=True):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", fitIntercept=True,
                         positive=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NonNegativeLeastSquaresModel:
        fc, lc = self.getOrDefault(self.featuresCol), self.getOrDefault(self.labelCol)
        with_intercept, positive = self.getOrDefault(self.fitIntercept), self.getOrDefault(self.positive)
        solve = nnls_equilibrated if positive else min_norm_gram
        d = vector_size(dataset, fc)
        shift = None
        if d is not None and d <= NARROW:
            g, c, mx, my, n = narrow_statistics(dataset, fc, lc, d, with_intercept)
            if not n:
                raise ValueError("No training rows to fit the linear model.")
            beta = solve(g, c)
            icpt = my - float(mx @ beta) if with_intercept else 0.0
        else:
            if not with_intercept:  # through the origin: nothing may be moved
                shift = (np.zeros(d), 0.0) if d is not None else None
            shift = shift or shift_row(dataset, fc, lc)
            if shift is None:
                raise ValueError("No training rows to fit the linear model.")
            if len(shift[0]) > GRAM_MAX_FEATURES:
                design = Design(dataset, _entries(fc), lc, len(shift[0]), shift, with_intercept)
                z = non_negative(design) if positive else least_squares(design)
                beta, icpt = design.coefficients(z, with_intercept)
            else:
                xtx, xty, sx, sy, _, n = gram_statistics(dataset, fc, lc, shift)
                mx, my = (sx / n, sy / n) if with_intercept else (np.zeros_like(sx), 0.0)
                beta = solve(xtx - n * np.outer(mx, mx), xty - n * mx * my)
                icpt = float(my + shift[1] - (mx + shift[0]) @ beta) if with_intercept else 0.0
        return NonNegativeLeastSquaresModel(featuresCol=fc, labelCol=lc, predictionCol=self.getOrDefault(self.predictionCol),
                                            fitIntercept=with_intercept, positive=positive,
                                            coefficients=[float(v) for v in beta], intercept=icpt)


def model_log(policy: ModelPolicy) -> str:
    return f"train_model:{policy.kind}"
