"""Training of small sparse linear models on a bounded sample, and its calibration.

The sample's hashed features come from Spark tasks; what is fitted here is
bounded by the sample size, which is a parameter of each operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of a hashed design: row ``i`` has columns ``index[ptr[i]:ptr[i+1]]``."""

    ptr: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    #: Entries worked on at once, so that temporary arrays stay small.
    CHUNK = 1 << 19

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
        ptr = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int64)
        index = np.concatenate([r[0] for r in rows]).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        value = np.concatenate([r[1] for r in rows]).astype(np.float32, copy=False) if rows else np.zeros(0, np.float32)
        return cls(ptr, index, value, width)

    def _parts(self) -> Iterator[tuple[int, int, slice]]:
        """Ranges of rows of about CHUNK entries, with their entries."""
        at, n = 0, len(self.ptr) - 1
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(self.ptr, self.ptr[at] + self.CHUNK, side="right")) - 1))
            yield at, to, slice(int(self.ptr[at]), int(self.ptr[to]))
            at = to

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ptr) - 1)
        for a, b, e in self._parts():
            total = np.concatenate(([0.0], np.cumsum(self.value[e] * w[self.index[e]])))
            p = self.ptr[a : b + 1] - self.ptr[a]
            out[a:b] = total[p[1:]] - total[p[:-1]]
        return out

    def tdot(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b, e in self._parts():
            out += np.bincount(self.index[e], weights=self.value[e] * np.repeat(r[a:b], np.diff(self.ptr[a : b + 1])), minlength=self.width)
        return out

    def rescale(self, scale: np.ndarray) -> None:
        """Multiplies every column in place."""
        for _, _, e in self._parts():
            self.value[e] *= scale[self.index[e]].astype(np.float32)

    def mean_square(self) -> np.ndarray:
        out = np.zeros(self.width)
        for _, _, e in self._parts():
            out += np.bincount(self.index[e], weights=self.value[e].astype(np.float64) ** 2, minlength=self.width)
        return out / max(1, len(self.ptr) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression (accelerated full gradients).

    Columns are brought to one scale by their root mean square first; the
    returned weights are for the raw columns. ``x`` is rescaled in place.
    """
    n = max(1, len(y))
    scale = np.sqrt(x.mean_square())
    scale = 1.0 / (scale + 0.05 * (scale.max(initial=0.0) or 1.0))
    x.rescale(scale)
    z = x
    # the largest curvature: power iteration on Z'Z / 4n
    v = np.ones(x.width) / np.sqrt(x.width)
    top = 1.0
    for _ in range(12):
        u = z.tdot(z.dot(v)) / (4 * n)
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    rate = 1.0 / (1.1 * top + 0.25 + l2)
    w, b = np.zeros(x.width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w0, b0, t0 = w.copy(), b, 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        mw, mb = w + (t0 - 1) / t1 * (w - w0), b + (t0 - 1) / t1 * (b - b0)
        err = (sigmoid(z.dot(mw) + mb) - y) / n
        w0, b0, t0 = w, b, t1
        w, b = mw - rate * (z.tdot(err) + l2 * mw), mb - rate * float(err.sum())
    return w * scale, b


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic calibration (Newton steps on smoothed targets)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if pos == 0 or neg == 0:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit_ftrl(rows: Sparse, y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3) -> np.ndarray:
    """Weights ``[width, classes]`` of a multinomial model by follow-the-regularised-leader.

    Per coordinate: ``z`` gathers gradients less the shift of the step size,
    ``n`` the squared gradients; a weight is zero while ``|z| <= l1`` (elastic
    net: ``l1`` sparsity, ``l2`` shrinkage).
    """
    z = np.zeros((rows.width, classes))
    n = np.zeros((rows.width, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            a, b = rows.ptr[i], rows.ptr[i + 1]
            at, v = rows.index[a:b], rows.value[a:b]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = np.outer(v, p)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss (golden-section search on its logarithm)."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi, b = b, a
            a = hi - g * (hi - lo)
        else:
            lo, a = a, b
            b = lo + g * (hi - lo)
    return float(np.exp((lo + hi) / 2))
