"""Least squares and non-negative least squares on designs too wide for a Gram matrix.

Nothing of size d x d exists. The rows are written once as sparse entries; a
pass multiplies the centred, column-scaled normal matrix ``S = D Xc'Xc D`` with
a vector: every task computes ``A v`` for its rows and adds them up to its part
of ``A'(A v)``, and Spark sums the tasks' vectors in two levels. ``D`` gives all
columns unit length, so one-hot blocks of any frequencies are close to the
identity and few passes are needed.

* :func:`least_squares` runs conjugate gradients from zero on ``S z = D Xc'y``
  until the residual is ``TOLERANCE`` of the right-hand side. ``D z`` is a
  least-squares solution; where the design is rank-deficient (full one-hot next
  to an intercept) its part in the null space of ``Xc`` is then taken off by
  conjugate gradients inside that space, so the fit has the smallest norm in the
  original coordinates, as the Gram solver's has.
* :func:`non_negative` minimises over ``z >= 0`` by projected conjugate
  gradients: steps inside the free face, expansions that fix entries at zero,
  and releases along the chopped gradient. The result counts only with its
  certificate: the gradient, computed anew, is zero on the free entries and not
  negative on those at zero.

Both raise if they do not settle; no other method is chosen silently.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

#: Width up to which vectors are kept on the driver and one per task (8 MB each at this width).
MAX_FEATURES = 1_000_000
#: Relative residual at which conjugate gradients stop, and what their null-space part may fall short of.
TOLERANCE = 1e-12
NULL_TOLERANCE = 1e-9
#: Relative size of a gradient entry that the certificate of non-negative least squares lets pass.
CERTIFICATE = 1e-9
#: Certificate from which the free entries are solved for at once.
NEAR = 1e-6
MAX_PASSES = 2_000


class Design:
    """The written rows ``(i, v, y)`` and products with their centred, scaled normal matrix."""

    def __init__(self, df: DataFrame, entries: Column, label_col: str, size: int, shift: tuple[np.ndarray, float], centred: bool):
        if size > MAX_FEATURES:
            raise ValueError(f"{size} features are more than the iterative solver holds ({MAX_FEATURES}); encode categories as ordinals")
        self.size, (self.x0, self.y0) = size, shift
        self.moved = bool(np.any(self.x0))
        e = df.select(entries.alias("e"), F.col(label_col).cast("double").alias("y"))
        places = F.coalesce(F.col("e.indices"), F.sequence(F.lit(0), F.size("e.values") - 1))
        self.rows = materialize(e.select(places.alias("i"), F.col("e.values").alias("v"), "y"), "wide-design")
        self.passes = 0
        d = size
        total = self._sum(self._moments(), 3 * d + 3)
        sx, sxx, xy = total[:d], total[d : 2 * d], total[2 * d : 3 * d]
        sy, self.yy, self.n = total[3 * d :]
        if self.n:
            self.mean_x = sx / self.n if centred else np.zeros(d)
            self.mean_y = sy / self.n if centred else 0.0
            spread = np.clip(sxx - self.n * self.mean_x**2, 0.0, None)
            some = spread > 1e-14 * np.clip(sxx, 1e-300, None)
            self.scale = np.where(some, 1.0 / np.sqrt(np.where(some, spread, 1.0)), 0.0)
            self.right = self.scale * (xy - self.n * self.mean_x * self.mean_y)

    def _sum(self, partial: Callable, width: int) -> np.ndarray:
        """The sum of the tasks' vectors: first within about sqrt(tasks) groups of tasks, then over the groups."""
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        self.passes += 1
        tasks = 4 * self.rows.sparkSession.sparkContext.defaultParallelism
        parts = self.rows.coalesce(tasks).mapInArrow(partial, "s array<double>").select(array_to_vector("s").alias("s"))
        groups = max(1, math.isqrt(tasks))
        level = parts.groupBy((F.spark_partition_id() % groups).alias("g")).agg(Summarizer.sum(F.col("s")).alias("s"))
        row = level.agg(Summarizer.sum(F.col("s")).alias("s")).first()
        return row["s"].toArray() if row["s"] is not None else np.zeros(width)

    def _moments(self) -> Callable:
        d, x0, y0, moved = self.size, self.x0, self.y0, self.moved

        def partial(batches):
            sx, sxx, xy, tail = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros(3)
            for places, values, row, y in _batches(batches):
                y = y - y0
                sx += np.bincount(places, values, d)
                # (v - x0)^2 = x0^2 + v^2 - 2 v x0, of which only entries beside zero need a term of their own
                sxx += np.bincount(places, values * values - 2.0 * values * x0[places] if moved else values * values, d)
                xy += np.bincount(places, values * y[row], d)
                tail += (y.sum(), y @ y, len(y))
            sx -= tail[2] * x0
            sxx += tail[2] * x0 * x0
            xy -= tail[0] * x0
            yield from _vector(np.concatenate((sx, sxx, xy, tail)), tail[2])

        return partial

    def product(self, z: np.ndarray) -> np.ndarray:
        """``S z`` in one pass."""
        d, x0 = self.size, self.x0
        v = self.scale * z
        offset = float((x0 + self.mean_x) @ v)

        def partial(batches):
            out, total, n = np.zeros(d), 0.0, 0
            for places, values, row, y in _batches(batches):
                t = np.bincount(row, values * v[places], len(y)) - offset
                out += np.bincount(places, values * t[row], d)
                total += t.sum()
                n += len(y)
            yield from _vector(np.append(out, total), n)

        total = self._sum(partial, d + 1)
        return self.scale * (total[:d] - total[d] * (x0 + self.mean_x))

    def coefficients(self, z: np.ndarray, fit_intercept: bool) -> tuple[np.ndarray, float]:
        beta = self.scale * z
        return beta, float(self.mean_y + self.y0 - (self.mean_x + self.x0) @ beta) if fit_intercept else 0.0


def _batches(batches):
    """Arrow batches as flat entry places, values, their rows, and the labels."""
    for b in batches:
        if b.num_rows:
            lists = b.column("i")
            sizes = np.diff(lists.offsets.to_numpy())
            yield (lists.flatten().to_numpy(zero_copy_only=False), b.column("v").flatten().to_numpy(zero_copy_only=False),
                   np.repeat(np.arange(b.num_rows), sizes), b.column("y").to_numpy(zero_copy_only=False))


def _vector(s: np.ndarray, n: float):
    import pyarrow as pa

    if n:
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.list_(pa.float64()))], names=["s"])


def conjugate_gradients(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, tolerance: float = TOLERANCE, max_steps: int = MAX_PASSES) -> np.ndarray:
    """The solution of least norm of a consistent positive semidefinite system, from zero."""
    z, r = np.zeros_like(right), right.copy()
    p, rr = r.copy(), float(r @ r)
    goal = tolerance * tolerance * rr
    best, since = rr, 0
    for _ in range(max_steps):
        if rr <= goal or rr == 0.0:
            return z
        q = product(p)
        curvature = float(p @ q)
        if curvature <= 0.0:  # p is in the null space up to rounding: nothing is left to gain
            break
        step = rr / curvature
        z += step * p
        r -= step * q
        new = float(r @ r)
        if new < 0.5 * best:
            best, since = new, 0
        else:
            since += 1
        # rounding is reached: the residual no longer falls
        if since >= 40 and best <= (1e-8) ** 2 * float(right @ right):
            return z
        p = r + (new / rr) * p
        rr = new
    if rr > (1e-8) ** 2 * float(right @ right):
        raise RuntimeError(f"least squares did not settle in {max_steps} passes (relative residual {math.sqrt(rr / float(right @ right)):.1e})")
    return z


def least_squares(design: Design) -> np.ndarray:
    """Scaled coefficients of the least-squares fit of least norm in the original coordinates."""
    z = conjugate_gradients(design.product, design.right)
    square = design.scale**2

    def null_part(x: np.ndarray) -> np.ndarray:
        """The part of ``x`` in the null space of the scaled design."""
        return x - conjugate_gradients(design.product, design.product(x))

    weighted = square * z
    r = null_part(weighted)
    size = float(np.linalg.norm(weighted))
    if np.linalg.norm(r) <= NULL_TOLERANCE * size:
        return z
    # least || D (z - n) || over the null space, whose dimension bounds the steps
    n, p, rr = np.zeros_like(z), r.copy(), float(r @ r)
    goal = (NULL_TOLERANCE * size) ** 2
    while rr > goal:
        q = null_part(square * p)
        curvature = float(p @ q)
        if curvature <= 0.0:
            break
        step = rr / curvature
        n += step * p
        r -= step * q
        new = float(r @ r)
        if new >= rr:
            break
        p = r + (new / rr) * p
        rr = new
    return z - n


def certificate(gradient: np.ndarray, z: np.ndarray, right: np.ndarray) -> float:
    """How far ``z >= 0`` is from optimal: the largest gradient entry that is against the conditions, relative to the right-hand side."""
    against = np.where(z > 0.0, np.abs(gradient), np.maximum(-gradient, 0.0))
    return float(against.max(initial=0.0)) / max(float(np.abs(right).max(initial=0.0)), 1e-300)


def non_negative(design: Design, max_passes: int = MAX_PASSES) -> np.ndarray:
    """Scaled coefficients of the non-negative least-squares fit, with its certificate checked."""
    product, right = design.product, design.right
    if not np.any(right > 0.0):
        return np.zeros_like(right)
    # a step that expansions may take: below 2 / the largest eigenvalue, found by powers
    v = np.abs(right) / np.linalg.norm(right)
    largest = 1.0
    for _ in range(6):
        w = product(v)
        largest = max(largest, float(np.linalg.norm(w)))
        v = w / max(float(np.linalg.norm(w)), 1e-300)
    fixed_step = 1.0 / largest
    z = np.zeros_like(right)
    g = -right.copy()
    free = lambda: np.where(z > 0.0, g, 0.0)
    chopped = lambda: np.where(z > 0.0, 0.0, np.minimum(g, 0.0))
    p = free()
    goal = NEAR
    start = design.passes
    while design.passes - start < max_passes:
        phi, beta = free(), chopped()
        near = certificate(g, z, right)
        if near <= goal:
            # the free entries are likely the right ones: solved for as they are, then judged by a gradient computed anew
            mask = z > 0.0
            exact = z + conjugate_gradients(lambda x: np.where(mask, product(np.where(mask, x, 0.0)), 0.0), np.where(mask, -g, 0.0), 1e-6)
            if exact.min(initial=0.0) >= 0.0:
                g_exact = product(exact) - right
                if certificate(g_exact, exact, right) <= CERTIFICATE:
                    return exact
            g = product(z) - right
            goal = near / 100
            p = free()
            continue
        reduced = np.minimum(z / fixed_step, phi)
        if float(beta @ beta) <= float(reduced @ phi):
            q = product(p)
            curvature = float(p @ q)
            step = float(g @ p) / curvature if curvature > 0.0 else np.inf
            down = p > 0.0
            feasible = float(np.min(z[down] / p[down])) if down.any() else np.inf
            if step <= feasible:
                z = np.maximum(z - step * p, 0.0)
                g = g - step * q
                phi = free()
                p = phi - (float(phi @ q) / curvature) * p
            else:
                z = np.maximum(z - feasible * p, 0.0)
                z[down & (z <= 1e-300)] = 0.0
                g = g - feasible * q
                z = np.maximum(z - fixed_step * free(), 0.0)
                g = product(z) - right
                p = free()
        else:
            q = product(beta)
            step = float(g @ beta) / float(beta @ q)
            z = np.maximum(z - step * beta, 0.0)
            g = g - step * q
            p = free()
    raise RuntimeError(f"non-negative least squares did not settle in {max_passes} passes (certificate {certificate(g, z, right):.1e})")
