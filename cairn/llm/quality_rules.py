"""Quality rules: fixed base counts, and a calibrated hashed n-gram logistic regression against a fixed threshold.

* Base counts of the whole text: words ``[^\\x20\\x09-\\x0D]+``, their code
  points, symbols ``[#*$%&|<>]``, repeated lines, words in repeated 3-word
  windows; the base rule fails under 50 words or with more than half of the
  words in repeated windows.
* Learned verdict: relative frequencies of hashed word 1- and 2-grams and of
  runs of 2 to 4 code points, logistic regression fitted on a bounded sample of
  labelled rows (``SAMPLE``, drawn by a hash of the id), whose design goes slice by
  slice into arrays of known size, calibrated (Platt) on a fifth of the sample
  that the fit does not see. A document that the base rule
  passes is kept if the calibrated probability reaches ``KEEP_FROM``.
* Everything runs in one Arrow pass over the documents, without a shuffle.

Defined cases: null text has no words (base rule fails); without labelled rows,
or with one label only, the base rule decides alone; rows without an id or
label are not learned; of a document's labels that disagree the smallest counts;
repeated rows get the same verdict; other columns play no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import ROW, as_row, map_arrow, text_of, with_text, written
from cairn.llm.linear import Sparse, fit_logistic, fit_platt, sigmoid

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: A document is kept from this calibrated probability on.
KEEP_FROM = 0.3
#: Labelled rows of which the model is learned.
SAMPLE = 4_000
#: Slices in which the sample's design reaches the driver: only one is held beside the arrays it goes into.
SLICES = 16
BITS = 17
WORD_ORDERS = (1, 2)
CHAR_ORDERS = (2, 3, 4)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass
class QualityModel:
    weights: np.ndarray  # one per hashed column
    bias: float
    slope: float
    shift: float

    def probability(self, texts: tv.Texts) -> np.ndarray:
        total = np.full(texts.n, self.bias)
        for at, first in _columns(texts):
            total += tv.range_sums(self.weights[at], first) / np.maximum(np.diff(first), 1)
        return sigmoid(self.slope * total + self.shift)


def _columns(texts: tv.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed columns of the word and character grams; each family is a relative frequency of its own."""
    out = []
    for make, orders, salt in ((texts.word_grams, WORD_ORDERS, 100), (texts.char_grams, CHAR_ORDERS, 200)):
        for n in orders:
            h, first = make(n)
            out.append((((h * tv.U64(2 * (salt + n) + 1)) >> tv.U64(64 - BITS)).astype(np.int64), first))
    return out


def base_counts(texts: tv.Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = texts.words
    data, offsets = texts.data, texts.offsets
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    chars = tv.range_sums((lead[ends] - lead[starts]).astype(float), first)
    h, wfirst = texts.word_grams(3)
    text_of = np.repeat(np.arange(texts.n), np.diff(wfirst))
    order = np.lexsort((h, text_of))
    ho, to = h[order], text_of[order]
    same = (ho[1:] == ho[:-1]) & (to[1:] == to[:-1])
    twice = np.zeros(len(h), bool)
    twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else False
    covered = np.zeros(len(starts), bool)
    at = first[text_of] + (np.arange(len(h)) - wfirst[text_of])  # word at which a window starts
    for k in range(3):
        covered[at[twice] + k] = True
    dup = np.zeros(texts.n, np.int64)
    breaks = np.flatnonzero(data == 10)
    lo, hi = np.concatenate((offsets[:-1], breaks + 1)), np.concatenate((offsets[1:], breaks))
    lo, hi = np.sort(lo), np.sort(hi)  # lines of all texts in order
    with_word = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[with_word], hi[with_word]
    line = texts.ph.spans(lo, hi)
    line_text = np.searchsorted(offsets, lo, side="right") - 1
    o = np.lexsort((line, line_text))
    again = (line[o][1:] == line[o][:-1]) & (line_text[o][1:] == line_text[o][:-1])
    np.add.at(dup, line_text[o][1:][again], 1)
    return {
        "n_words": np.diff(first), "word_chars": chars.astype(np.int64), "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]],
        "n_dup_lines": dup, "n_repeat_words": tv.range_sums(covered.astype(float), first).astype(np.int64),
    }


def _sample_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols, vals, order = [], [], []
    for _, _, texts in tv.texts_of(batch.column("text")):
        grams = _columns(texts)
        for i in range(texts.n):
            at = np.concatenate([g[f[i] : f[i + 1]] for g, f in grams])
            v = np.concatenate([np.full(f[i + 1] - f[i], 1.0 / max(1, f[i + 1] - f[i])) for _, f in grams])
            keys, inverse = np.unique(at, return_inverse=True)
            cols.append(keys.astype(np.int32).tobytes())
            vals.append(np.bincount(inverse, weights=v, minlength=len(keys)).astype(np.float32).tobytes())
            order.append(int.from_bytes(hashlib.blake2b(cols[-1] + vals[-1], digest_size=7).digest(), "little"))
    return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("held"), pa.array(cols, pa.binary()), pa.array(vals, pa.binary()), pa.array(order, pa.int64())], names=["y", "held", "cols", "vals", "order"])


def gather(design: DataFrame, slices: int = SLICES) -> tuple[tuple[Sparse, np.ndarray], tuple[Sparse, np.ndarray]]:
    """The written design's rows to learn from and the held ones, each with labels; the order of arrival plays no part."""
    size = {r["held"]: (r["n"], r["entries"]) for r in design.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("cols") / 4).cast("long").alias("entries")).collect()}
    sides = []
    for held in (False, True):
        n, entries = size.get(held, (0, 0))
        sides.append((Sparse(np.zeros(n + 1, np.int64), np.empty(entries, np.int32), np.empty(entries, np.float32), 1 << BITS), np.zeros(n)))
    at = [0, 0]
    for k in range(slices):
        rows = design.where(F.pmod("order", F.lit(slices)) == k).toArrow()
        keys = [rows.column(c).to_numpy() for c in ("y", "order", "held")]
        cols, vals = rows.column("cols").combine_chunks(), rows.column("vals").combine_chunks()
        for i in np.lexsort(keys[:2]).tolist():  # by order, then label
            side = int(keys[2][i])
            x, y = sides[side]
            row = at[side]
            index, value = np.frombuffer(cols[i].as_buffer(), np.int32), np.frombuffer(vals[i].as_buffer(), np.float32)
            a, b = int(x.ptr[row]), int(x.ptr[row]) + len(index)
            x.index[a:b], x.value[a:b], x.ptr[row + 1], y[row] = index, value, b, keys[0][i]
            at[side] += 1
    return sides[0], sides[1]


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``(doc_id, text, y, held)`` of about ``sample`` labelled documents; ``held``: left out of the fit.

    The draw hashes the id, so it does not depend on row order; only the drawn
    ids (at most a few more than ``sample``) are broadcast to the documents.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1e6 < min(1.0, sample / max(1, n)))
    held = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").withColumn("held", held)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """Fits and calibrates; ``None`` if there are not both labels to learn from."""
    rows = map_arrow(labelled(docs, labels, "quality", sample).select("text", "y", "held"), _sample_batch, "y int, held boolean, cols binary, vals binary, order long")
    (learn, y), (unseen, y_held) = gather(written(rows, "design"))
    if not 0 < y.sum() < len(y):
        return None
    w, b = fit_logistic(learn, y)
    margin = unseen.dot(w) + b
    slope, shift = fit_platt(margin, y_held)
    return QualityModel(w.astype(np.float32), b, slope, shift)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: QualityModel | None, keep: tuple[str, ...] = ("doc_id",), keep_from: float = KEEP_FROM) -> DataFrame:
    """``keep`` columns with the counts, ``base_failed``, ``kept`` and the calibrated ``probability``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, parts = shared.value, []
        for _, _, texts in tv.texts_of(text_of(batch)):
            c = base_counts(texts)
            p = m.probability(texts) if m else np.ones(texts.n)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            parts.append([*[c[k].astype(np.int64) for k in COUNTS], failed, ~failed & (p >= keep_from), p])
        out = [pa.array(np.concatenate(x)) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *out], names=[*names, *COUNTS, "base_failed", "kept", "probability"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return map_arrow(with_text(docs, names), run, fields + VERDICT)


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(base, fit(docs, labels, sample))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(as_row(docs), fit(docs, labels, sample), (ROW,)).where("kept").select(f"{ROW}.*")
