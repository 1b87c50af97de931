"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a place in a chain with the states bad and good. Its
emission score is linear in features of the line itself, of its two
neighbouring lines and of its place; transition and start scores are learned
too. Documents carry the labels and the lines' states are latent in learning:
forward-backward gives each line's probability of being good, the document's
quality is their mean weighted by line length, and the gradient of the labels'
likelihood goes through that mean to the chain's scores. The quality is brought
to a probability by a logistic calibration on a fifth of the sample that the fit
does not see.

Learning uses a bounded sample (``SAMPLE`` labelled documents by a hash of the
id, whole texts); scoring is one Arrow pass without a shuffle. Chains of a
batch run side by side, so a step of the recursion is one vector operation over
all documents that are long enough.

Defined cases: null text and text without words have no line and score 0;
without both labels in the learning rows every other text scores 0.5; labels
other than 0 and 1 and rows with a null id are not learned; of a document's labels
that disagree the smallest counts; repeated rows score alike; other columns play
no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import map_arrow, text_of, with_text
from cairn.llm.linear import fit_platt, sigmoid

SAMPLE = 2_500
PREDICT_FROM = 0.3
L2 = 1e-3
STEPS = 120
#: Gradient steps in which the lines' states are latent.
LATENT_STEPS = 60

_CLASS = {name: np.zeros(256, bool) for name in ("symbol", "digit", "upper", "mark", "wide")}
_CLASS["symbol"][list(b"#*$%&|<>@^~_=+\\{}[]")] = True
_CLASS["digit"][list(b"0123456789")] = True
_CLASS["upper"][list(range(65, 91))] = True
_CLASS["mark"][list(b".,;:!?'\"()-")] = True
_CLASS["wide"][128:] = True


def lines_of(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that have a word, and the line range of each text."""
    breaks = np.flatnonzero(texts.data == 10)
    lo = np.sort(np.concatenate((texts.offsets[:-1], breaks + 1)))
    hi = np.sort(np.concatenate((texts.offsets[1:], breaks)))
    starts = texts.words[0]
    some = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[some], hi[some]
    return lo, hi, np.searchsorted(lo, texts.offsets)


def _repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the key was seen before in its group."""
    order = np.lexsort((key, group))
    again = np.zeros(len(key), bool)
    if len(key) > 1:
        again[order[1:]] = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    return again


def line_features(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, previous, next, place), their lengths, and the line range of each text."""
    lo, hi, first = lines_of(texts)
    n = len(lo)
    starts, ends, _ = texts.words
    w0, w1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    words = np.maximum(w1 - w0, 1).astype(float)
    size = np.maximum(hi - lo, 1).astype(float)
    cols = [np.log1p(words), np.log1p(size), (size - words + 1) / words / 10]
    for flags in _CLASS.values():
        total = np.concatenate(([0], np.cumsum(flags[texts.data])))
        share = (total[hi] - total[lo]) / size
        cols += [share, np.sqrt(share)]
    h = texts.ph.spans(starts, ends)
    line_of = np.repeat(np.arange(n), w1 - w0) if n else np.zeros(0, np.int64)  # all words lie in a line
    text_of = np.repeat(np.arange(texts.n), np.diff(first))
    for flags in (
        np.concatenate(([False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1]))) if len(h) else np.zeros(0, bool),
        _repeats(line_of, h),
        (ends - starts) == 1,
        _CLASS["symbol"][texts.data[ends - 1]] if len(ends) else np.zeros(0, bool),
    ):
        total = np.concatenate(([0], np.cumsum(flags)))
        cols.append((total[w1] - total[w0]) / words)
    window, wfirst = texts.word_grams(3)
    repeated = _repeats(np.repeat(np.arange(texts.n), np.diff(wfirst)), window)
    total = np.concatenate(([0], np.cumsum(repeated)))
    shift = (texts.words[2][:-1] - wfirst[:-1])[text_of] if n else np.zeros(0, np.int64)
    g0, g1 = np.clip(w0 - shift, 0, len(repeated)), np.clip(w1 - shift, 0, len(repeated))
    cols.append((total[g1] - total[g0]) / words)
    cols.append(_repeats(text_of, texts.ph.spans(lo, hi)).astype(float))
    last = texts.data[ends[w1 - 1] - 1] if n else np.zeros(0, np.uint8)
    cols.append(np.isin(last, list(b".!?\"")).astype(float))
    cols.append(_CLASS["upper"][texts.data[starts[w0]]].astype(float) if n else np.zeros(0))
    own = np.stack(cols, axis=1) if n else np.zeros((0, len(cols)))
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    some = np.diff(first) > 0
    is_first[first[:-1][some]] = True
    is_last[first[1:][some] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[is_first], after[is_last] = 0, 0
    place = np.stack([is_first, is_last, np.ones(n)], axis=1).astype(float)
    return np.concatenate([own, before, after, place], axis=1).astype(np.float32), size, first


N_FEATURES = line_features(tv.Texts(np.frombuffer(b"a b c", np.uint8), np.array([0, 5])))[0].shape[1]


@dataclass
class Chains:
    """Chains laid side by side: ``place[t]`` are the lines at position ``t`` of the chains that long."""

    order: np.ndarray
    place: list[np.ndarray]

    @classmethod
    def of(cls, first: np.ndarray) -> Chains:
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        length, begin = length[order], first[:-1][order]
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        return cls(order, [begin[:k] + t for t, k in enumerate(alive)])


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emit: np.ndarray, start: float, trans: np.ndarray, chains: Chains, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the good state for every line, and (if asked) the expected transition counts.

    ``emit`` is the good state's score over the bad one's, ``start`` the same
    for a chain's first line, ``trans[s, t]`` the score of going from s to t.
    """
    n = len(emit)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t, at in enumerate(chains.place):
        if t == 0:
            alpha[at, 1] = start
        else:
            prev = alpha[at - 1]
            alpha[at, 0] = _lse(prev[:, 0] + trans[0, 0], prev[:, 1] + trans[1, 0])
            alpha[at, 1] = _lse(prev[:, 0] + trans[0, 1], prev[:, 1] + trans[1, 1])
        alpha[at, 1] += emit[at]
    for at in reversed(chains.place[1:]):
        b0, b1 = beta[at, 0], beta[at, 1] + emit[at]
        beta[at - 1, 0] = _lse(trans[0, 0] + b0, trans[0, 1] + b1)
        beta[at - 1, 1] = _lse(trans[1, 0] + b0, trans[1, 1] + b1)
    good = sigmoid(alpha[:, 1] + beta[:, 1] - alpha[:, 0] - beta[:, 0])
    counts = np.zeros((2, 2))
    if expect:
        z = _lse(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
        for at in chains.place[1:]:
            for s in (0, 1):
                for u in (0, 1):
                    counts[s, u] += np.exp(alpha[at - 1, s] + trans[s, u] + u * emit[at] + beta[at, u] - z[at]).sum()
    return good, counts


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    start: float
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of every line to be good."""
        emit = ((x - self.mean) * self.scale) @ self.weights
        return forward_backward(emit, self.start, self.trans, Chains.of(first))[0]

    def quality(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities, as log odds; NaN without lines."""
        good = self.lines(x, first)
        total = tv.range_sums(size, first)
        share = tv.range_sums(size * good, first) / np.where(total > 0, total, np.nan)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        odds = self.quality(x, size, first)
        return np.where(np.isnan(odds), 0.0, sigmoid(self.slope * np.nan_to_num(odds) + self.shift))


def latent_gradient(emit: np.ndarray, start: float, trans: np.ndarray, chains: Chains, share: np.ndarray, first: np.ndarray, y: np.ndarray,
                    ) -> tuple[np.ndarray, np.ndarray, float]:
    """How the log likelihood of the documents' labels changes with every line's score, and with the transitions.

    ``share`` is each line's part of its document's length, ``y`` a label per
    chain. A document is good with its length-weighted marginal s. The change of
    s with a parameter is the covariance of that parameter's feature with the
    weighted number of good lines, which is the change of the feature's
    expectation as all lines' scores move by their shares: the difference of two
    forward-backward runs. Returns the two gradients and the log likelihood.
    """
    good, _ = forward_backward(emit, start, trans, chains)
    s = np.clip(tv.range_sums(share * good, first), 1e-4, 1 - 1e-4)
    some = np.diff(first) > 0
    pull = np.where(some, np.where(y == 1, 1 / s, -1 / (1 - s)), 0.0)
    push = share * np.repeat(pull, np.diff(first))
    step = 1e-4 / max(float(np.abs(push).max(initial=0.0)), 1e-300)
    up, up_counts = forward_backward(emit + step * push, start, trans, chains, expect=True)
    down, down_counts = forward_backward(emit - step * push, start, trans, chains, expect=True)
    likelihood = float(np.log(np.where(y == 1, s, 1 - s))[some].sum())
    return (up - down) / (2 * step), (up_counts - down_counts) / (2 * step), likelihood


def fit_chain(x: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray) -> LineModel:
    """Likelihood of the documents' labels, the lines' states being latent, by gradient steps with momentum (Adam).

    The emission scores start from a fit of single lines in which each line has
    its document's state; from there only the documents' labels count.
    """
    mean, std = x.mean(axis=0), x.std(axis=0)
    mean[-1], std[-1] = 0.0, 1.0  # the constant
    scale = 1.0 / np.where(std > 1e-6, std, 1.0)
    z = ((x - mean) * scale).astype(np.float64)
    length = np.diff(first)
    state = np.repeat(y, length).astype(float)
    chains = Chains.of(first)
    head = chains.place[0] if chains.place else np.zeros(0, np.int64)
    total = tv.range_sums(size, first)
    share = size / np.maximum(1e-300, np.repeat(total, length))
    n, documents = max(1, len(state)), max(1, int((length > 0).sum()))
    w = np.zeros(z.shape[1] + 5)  # weights, start, transitions
    for steps, rate, latent in ((STEPS, 0.1, False), (LATENT_STEPS, 0.05, True)):
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            weights, start, trans = w[:-5], w[-5], w[-4:].reshape(2, 2)
            emit = z @ weights
            if latent:
                lines, moves, _ = latent_gradient(emit, start, trans, chains, share, first, y)
                g = np.concatenate((z.T @ lines, [lines[head].sum()], moves.ravel())) / documents - L2 * w
            else:
                g = np.concatenate((z.T @ (state - sigmoid(emit)) / n, np.zeros(5))) - L2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(mean, scale, w[:-5], float(w[-5]), w[-4:].reshape(2, 2))


def _sample_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, sizes = [], []
    for _, _, texts in tv.texts_of(batch.column("text")):
        x, size, first = line_features(texts)
        for i in range(texts.n):
            rows.append(x[first[i] : first[i + 1]].tobytes())
            sizes.append(size[first[i] : first[i + 1]].astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("held"), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["y", "held", "x", "size"])


def _stack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, N_FEATURES)
    size = np.frombuffer(b"".join(r["size"] for r in rows), np.float32).astype(float)
    first = np.concatenate(([0], np.cumsum([len(r["size"]) // 4 for r in rows]))).astype(np.int64)
    return x, size, first, np.array([r["y"] for r in rows], dtype=np.int64)


def fit(sample: DataFrame) -> LineModel | None:
    """Learns from ``(text, y, held)``; ``None`` without both labels."""
    rows = map_arrow(sample.select("text", "y", "held"), _sample_batch, "y int, held boolean, x binary, size binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["size"]), key=lambda r: (r["y"], r["size"], r["x"]))
    learn, held = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
    if len({r["y"] for r in learn}) < 2:
        return None
    x, size, first, y = _stack(learn)
    model = fit_chain(x, size, first, y)
    if held:
        x, size, first, y = _stack(held)
        model.slope, model.shift = fit_platt(model.quality(x, size, first), y)
    return model


def score(docs: DataFrame, model: LineModel | None, keep: tuple[str, ...] = ("doc_id",), predict_from: float = PREDICT_FROM) -> DataFrame:
    """``keep`` columns with ``score``, ``predicted`` and ``n_lines``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, scores, lines = shared.value, [], []
        for _, _, texts in tv.texts_of(text_of(batch)):
            x, size, first = line_features(texts)
            lines.append(np.diff(first))
            scores.append(m.score(x, size, first) if m else np.where(lines[-1] > 0, 0.5, 0.0))
        s = np.concatenate(scores)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s), pa.array((s >= predict_from).astype(np.int32)), pa.array(np.concatenate(lines).astype(np.int64))], names=[*names, "score", "predicted", "n_lines"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return map_arrow(with_text(docs, names), run, fields + "score double, predicted int, n_lines long")


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted; learned without the held-out rows."""
    from cairn.llm.language_id import fold
    from cairn.llm.quality_rules import labelled

    held = F.coalesce(F.pmod(fold(), F.lit(5)) == 0, F.lit(False))
    model = fit(labelled(docs, labels.where(~held), "quality", sample))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held)
    return score(base, model, ("doc_id", "held_out"))
