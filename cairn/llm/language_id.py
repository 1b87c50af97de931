"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

* Features: runs of 1 to 3 code points of the whole text, hashed to
  ``2**BITS`` columns; weight = relative frequency × inverse document frequency.
  The document frequencies are counted over **all** documents of the learning
  fold (each task adds up one count per column, Spark sums the tasks' counts).
* Model: follow-the-regularised-leader with an elastic-net penalty on a bounded
  sample (``PER_LANG`` texts a language, taken by a hash of the id), which keeps
  few columns; a fifth of the sample is left out and sets a temperature.
* Scoring: the weights of a text's grams are looked up and summed, batch by batch.

Defined cases: null text or text without a letter is ``und`` with score 0; with
no labelled text to learn from every text is ``und``; languages that are null
are not learned; ties go to the language first in the alphabet; repeated rows
get the same answer; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import ROW, as_row, bounded_batches, map_arrow, text_of, with_text
from cairn.llm.linear import Sparse, fit_ftrl, fit_temperature

BITS = 16
ORDERS = (1, 2, 3)
#: Texts per language of which the model is learned.
PER_LANG = 600
#: A language may not be left out of the sample for being frequent; more languages than this are refused.
MAX_LANGS = 500
#: In the pipeline: texts below this confidence are rejected.
MIN_CONFIDENCE = 0.3


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [2**BITS, languages], idf multiplied in
    bias: np.ndarray
    temperature: float

    def scores(self, texts: tv.Texts) -> np.ndarray:
        total, length = np.zeros((texts.n, len(self.languages))), np.zeros(texts.n)
        for n in ORDERS:
            h, first = texts.char_grams(n)
            total += tv.range_sums(self.table[_column(h, n)], first)
            length += np.diff(first)
        return total / np.maximum(length, 1)[:, None] + self.bias


def _column(h: np.ndarray, order: int) -> np.ndarray:
    return ((h + tv.U64(order)) >> tv.U64(64 - BITS)).astype(np.int64)


def fold(ident: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(ident).cast("string").cast("binary"))


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
    for batch in batches:
        for _, _, texts in tv.texts_of(batch.column("text")):
            grams = [(lambda h, first: (_column(h, k), first))(*texts.char_grams(k)) for k in ORDERS]
            for i in range(texts.n):
                for at, first in grams:
                    seen[at[first[i] : first[i + 1]]] = True
                counts += seen
                seen[:] = False
            n += texts.n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["col", "n"])


def document_frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each column, and the number of texts; 2**BITS rows at most reach the driver."""
    rows = bounded_batches(learn.select("text")).mapInArrow(_count_documents, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    known = rows[rows.col >= 0]
    df[known.col.to_numpy()] = known.n.to_numpy()
    return df, int(rows[rows.col < 0].n.sum())


def _grams_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols, vals = [], []
    for _, _, texts in tv.texts_of(batch.column("text")):
        grams = [(lambda h, first: (_column(h, k), first))(*texts.char_grams(k)) for k in ORDERS]
        for i in range(texts.n):
            at, count = np.unique(np.concatenate([g[f[i] : f[i + 1]] for g, f in grams]), return_counts=True)
            cols.append(at.astype(np.int32).tobytes())
            vals.append((count / max(1, count.sum())).astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("held"), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names=["lang", "held", "cols", "vals"])


def fit(learn: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Learns from ``learn`` (doc_id, text, lang): rows with a null language or text are not used."""
    learn = learn.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, per_lang / c))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1e6
    held = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    sample = map_arrow(learn.where(draw < share[F.col("lang")]).select("text", "lang", held.alias("held")), _grams_batch, "lang string, held boolean, cols binary, vals binary")
    rows = sample.toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["cols"], r["vals"]))  # the order of arrival plays no part
    design, bias_col = [], 1 << BITS
    for r in rows:
        at = np.frombuffer(r["cols"], np.int32).astype(np.int64)
        v = np.frombuffer(r["vals"], np.float32) * idf[at]
        design.append((np.append(at, bias_col), np.append(v * SCALE, 1.0)))
    y = np.array([languages.index(r["lang"]) for r in rows], dtype=np.int64)
    fit_on = [i for i, r in enumerate(rows) if not r["held"]] or list(range(len(rows)))
    w = fit_ftrl(Sparse.of([design[i] for i in fit_on], bias_col + 1), y[fit_on], len(languages))
    table, bias = w[:bias_col] * (idf * SCALE)[:, None], w[bias_col]
    left = [i for i, r in enumerate(rows) if r["held"]]
    s = np.array([design[i][1] @ w[design[i][0]] for i in left]).reshape(len(left), len(languages))
    return LanguageModel(languages, table.astype(np.float32), bias, fit_temperature(s, y[left]))


#: Brings relative frequencies (sum 1) to the order of 1 for the step sizes of the fit.
SCALE = 30.0


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        best, score = [], []
        ok = batch.column("_letter").to_numpy(zero_copy_only=False)
        for a, b, texts in tv.texts_of(text_of(batch)):
            if not m.languages:
                best += ["und"] * (b - a)
                score += [0.0] * (b - a)
                continue
            s = m.scores(texts) / m.temperature
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            best += [m.languages[k] if good else "und" for k, good in zip(top, ok[a:b])]
            score += [float(p[i, k]) if good else 0.0 for i, (k, good) in enumerate(zip(top, ok[a:b]))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    text = F.col(f"{ROW}.text") if ROW in names else F.col("text")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return map_arrow(with_text(docs, names, letter), run, fields + ", lang_pred string, score double")


def digest(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score; learned without the held-out rows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.pmod(fold(), F.lit(4)) == 2, F.lit(False))
    model = fit(base.where(~held), per_lang)
    return predict(base.withColumn("held_out", held), model, ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, per_lang: int = PER_LANG) -> DataFrame:
    """Documents whose language is found with enough confidence; a null ``lang`` becomes the found one.

    Texts that are null or have no letter are rejected. If there is no labelled
    text to learn from, all others stay.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(base, per_lang)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(as_row(docs), model, (ROW,))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_confidence))
    own = [F.col(f"{ROW}.`{c}`") for c in docs.columns]
    return found.select(*[F.coalesce(v, F.col("lang_pred")).alias(c) if c == "lang" else v.alias(c) for c, v in zip(docs.columns, own)])
