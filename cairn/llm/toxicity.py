"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

* **Lexicon.** Nobody lists the abusive words of every language, so the terms
  come from the labels. In all labelled documents (but the sampled ones kept for
  calibration) every word and every word beginning is counted once per document;
  terms that toxic documents have and others hardly do are taken if they occur in
  so many different surroundings (copies of one passage count once, wherever they
  lie) that chance does not explain it (``EVIDENCE``). Surroundings are only told
  apart for terms whose occurrences could be enough. A beginning shared by many
  endings is kept as a **stem**; otherwise the whole word is.
* **Matching.** Text is folded to lower case and cut into words at once for a
  whole batch. A misspelling within ``e`` edits leaves one of ``e + 1`` parts of
  the term intact (cut between characters, and looked for ``e`` characters either
  way), so bit tables over the parts' hashes and then the hashes themselves let
  nearly all words pass by; the others run the Levenshtein automaton of the word
  against the trie of terms (distance 1 from 4 letters on, if under 6 letters the
  labels show that such matches are toxic, 2 from 12; stems match with any ending).
* **Context.** Each match is weighed by its term's log odds and its distance,
  down where the window around it shows quotation (quotation marks, reporting
  words), up where it addresses somebody. Sum, maximum and density of the
  weights go through a small logistic regression fitted on a bounded sample, and
  a calibration on a held-out fifth of it.

Scoring is one Arrow pass without a shuffle.

Defined cases: null and empty texts have no match and get the score of a clean
text; without toxic labels to learn from the lexicon is empty and all scores
are equal; of a document's labels that disagree the smallest counts; repeated
rows score alike; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import map_arrow, text_of, with_text, written
from cairn.llm.linear import fit_platt, sigmoid

#: Labelled documents of which the scores' weights are learned: toxic ones and others.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 8_000
#: Up to so many labels (16 bytes each) are broadcast to the documents; with more of them the texts are shuffled.
BROADCAST_LABELS = 8_000_000
#: Least log odds of a term, and least log likelihood ratio of its surroundings against chance (about 1e-6).
MIN_ODDS = 2.5
EVIDENCE = 13.8
#: Terms of fewer letters forgive an edit only if the labels support it.
SHORT = 6
#: Log likelihood ratio that settles whether a term's inexact matches are chance (20 to 1).
NEAR_EVIDENCE = 3.0
#: Shortest stem.
MIN_STEM = 4
#: A beginning gives way to a longer one that keeps this share of its documents.
KEEP_SHARE = 0.75
PREDICT_FROM = 0.3
#: Words on each side that make up a match's surroundings.
WINDOW = 8
#: Words that report speech or speak about a word, and words that address somebody.
REPORTING = frozenset("said says wrote writes quote quoted quotes called term word words phrase meaning sagte schrieb zitat wort dit écrit mot citation dijo escribió palabra cita".split())
ADDRESSING = frozenset("you your youre u du dein deine ihr euch tu toi vous votre te tú usted eres".split())
QUOTES = frozenset("\"“”„«»‹›‘’`")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORDISH = np.zeros(256, bool)
_WORDISH[97:123] = _WORDISH[48:58] = _WORDISH[128:] = True
_WORDISH[[36, 64]] = True  # $ and @ stand in for letters
_BITS = 18


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for À-Þ."""
    out = _FOLD[data]
    after = np.concatenate(([False], data[:-1] == 0xC3))
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 0x20
    return out


def tokens(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tv.PolyHash]:
    """Folded bytes, word starts and ends, each text's word range, and the hash over the folded bytes."""
    data = fold_case(texts.data)
    blank = np.where(_WORDISH[data], data, np.uint8(32))
    general = texts.data == 0xE2  # typographic marks U+2000..U+206F are no letters
    for k in (0, 1, 2):
        at = np.flatnonzero(general) + k
        lead = np.flatnonzero(general)
        ok = (lead + 2 < len(data))
        punct = ok & (texts.data[np.minimum(lead + 1, len(data) - 1)] <= 0x81)
        blank[at[punct]] = 32
    for second in (0xAB, 0xBB):  # « and »
        lead = np.flatnonzero((texts.data[:-1] == 0xC2) & (texts.data[1:] == second))
        blank[lead] = blank[lead + 1] = 32
    starts, ends, first = tv.split_words(blank, texts.offsets)
    ph = tv.PolyHash(data)
    ph.chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    return data, starts, ends, first, ph


# ---- lexicon trie and Levenshtein automaton ------------------------------------------------

@dataclass
class Trie:
    """Terms by letter; a node's ``term`` is the index of the term that ends there."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: list[int] = field(default_factory=lambda: [-1])

    def add(self, word: str, index: int) -> None:
        node = 0
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.term.append(-1)
            node = self.next[node][c]
        self.term[node] = index


def allowed(length: int) -> int:
    """Edits that a term of this length forgives at most."""
    return 0 if length < 4 else 1 if length < 12 else 2


def _hash_of(piece: bytes) -> int:
    return int(tv.PolyHash(np.frombuffer(piece, np.uint8)).spans(np.array([0]), np.array([len(piece)]))[0])


class Lexicon:
    """Terms ``(text, is_stem, weight, edits it forgives)`` with the trie and the bit tables of their parts."""

    def __init__(self, terms: list[tuple[str, bool, float, int]]):
        self.terms = terms
        self.trie = Trie()
        for i, (word, _, _, _) in enumerate(terms):
            self.trie.add(word, i)
        self.found: dict[str, tuple[int, int] | None] = {}
        # by place and length in characters: bit table, sorted hashes of parts, shortest and longest word of each
        self.tables: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        parts: dict[tuple[str, int, int], dict[int, tuple[int, int]]] = {}
        for word, stem, _, edits in terms:
            n = len(word)
            shortest, longest = n - edits, 1 << 60 if stem else n + edits
            cut = [n * k // (edits + 1) for k in range(edits + 2)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                h = _hash_of(word[a:b].encode())
                if k == 0:
                    looks = [("head", 0, b - a)]
                elif k == edits and not stem:
                    looks = [("tail", 0, b - a)]
                else:
                    looks = [("head", a + shift, b - a) for shift in range(-edits, edits + 1) if a + shift >= 0]
                for look in looks:
                    known = parts.setdefault(look, {})
                    lo, hi = known.get(h, (shortest, longest))
                    known[h] = (min(lo, shortest), max(hi, longest))
        for look, known in parts.items():
            hashes = np.array(sorted(known), np.uint64)
            table = np.zeros(1 << _BITS, bool)
            table[(hashes >> tv.U64(64 - _BITS)).astype(np.int64)] = True
            self.tables[look] = (table, hashes, *(np.array([known[h][k] for h in sorted(known)], np.int64) for k in (0, 1)))

    def candidates(self, ph: tv.PolyHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indices of the words that keep a part of some term; the others cannot match."""
        begin, end = np.searchsorted(ph.chars, starts), np.searchsorted(ph.chars, ends)
        size = end - begin
        hit = np.zeros(len(starts), bool)
        for (kind, shift, n), (table, hashes, shortest, longest) in self.tables.items():
            at = np.flatnonzero(size >= shift + n)
            lo = begin[at] + shift if kind == "head" else end[at] - n
            h = ph.spans(ph.chars[lo], ph.chars[lo + n])
            some = np.flatnonzero(table[(h >> tv.U64(64 - _BITS)).astype(np.int64)])
            at, h = at[some], h[some]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit[at[(hashes[place] == h) & (size[at] >= shortest[place]) & (size[at] <= longest[place])]] = True
        return np.flatnonzero(hit)

    def match(self, word: str) -> tuple[int, int] | None:
        """Best term of a folded word and its distance; remembered for recent words."""
        if word not in self.found:
            if len(self.found) >= 200_000:
                self.found.clear()
            self.found[word] = self._intersect(word)
        return self.found[word]

    def _intersect(self, word: str) -> tuple[int, int] | None:
        """Walks the trie with the states of the word's Levenshtein automaton.

        A state maps positions in the word to edits used; it dies when empty. A
        stem is accepted at any position (any ending may follow), a whole term
        only at the word's end.
        """
        most = 2
        best: tuple[float, int, int] | None = None
        stack = [(0, {k: k for k in range(min(most, len(word)) + 1)})]
        while stack:
            node, state = stack.pop()
            t = self.trie.term[node]
            if t >= 0:
                term, stem, weight, edits = self.terms[t]
                used = min(state.values()) if stem else state.get(len(word), 99)
                if used <= edits and (best is None or (used, -weight) < (best[2], -self.terms[best[1]][2])):
                    best = (weight, t, used)
            for letter, child in self.trie.next[node].items():
                after: dict[int, int] = {}
                for at, used in state.items():
                    if at < len(word):
                        cost = used + (word[at] != letter)
                        if cost <= most and cost < after.get(at + 1, 99):
                            after[at + 1] = cost
                    if used + 1 <= most and used + 1 < after.get(at, 99):
                        after[at] = used + 1
                for at in sorted(after):  # letters of the word that the term lacks
                    if at < len(word) and after[at] + 1 <= most and after[at] + 1 < after.get(at + 1, 99):
                        after[at + 1] = after[at] + 1
                if after:
                    stack.append((child, after))
        return None if best is None else (best[1], best[2])


# ---- learning the lexicon ------------------------------------------------------------------

#: The term that every document has.
ANY = ""


def _terms(word: str) -> list[str]:
    """A word's terms: the whole word (``word$``) and its beginnings."""
    return ([word + "$"] if len(word) <= 40 else []) + [word[:k] for k in range(MIN_STEM, min(len(word), 12))]


def _different(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Of every word its hash, its document and its number among the different words, and those words' terms."""
    data, starts, ends, first, ph = tokens(texts)
    h = ph.spans(starts, ends)
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return h, np.repeat(np.arange(texts.n), np.diff(first)), word, [_terms(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[at].tolist(), ends[at].tolist())]


def _counts_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per batch: each term's toxic and clean documents and its occurrences in toxic ones."""
    toxic, clean, times = Counter(), Counter(), Counter()
    ys = np.array(batch.column("y").to_pylist(), np.int64)
    for at, to, texts in tv.texts_of(batch.column("text")):
        _, doc, word, terms = _different(texts)
        y = ys[at:to]
        pairs = np.unique(doc * max(1, len(terms)) + word)
        in_doc, which = pairs // max(1, len(terms)), pairs % max(1, len(terms))
        bounds = np.searchsorted(in_doc, np.arange(texts.n + 1)).tolist()
        which = which.tolist()
        for i in range(texts.n):
            seen: set[str] = set()
            for w in which[bounds[i] : bounds[i + 1]]:
                seen.update(terms[w])
            (toxic if y[i] else clean).update([ANY, *seen])
        often = np.bincount(word[y[doc] == 1], minlength=len(terms))
        for w in np.flatnonzero(often).tolist():
            for t in terms[w]:
                times[t] += int(often[w])
    keys = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean, times)]], names=["term", "toxic", "clean", "times"])


def _around_batch(wanted: frozenset[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per batch: the different surroundings (words before and after) of each wanted term."""
    found: set[tuple[str, int]] = set()
    for _, _, texts in tv.texts_of(batch.column("text")):
        h, doc, word, terms = _different(texts)
        terms = [[t for t in x if t in wanted] for x in terms]
        same = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
        after = np.where(same, np.roll(h, -1), tv.U64(0))
        before = np.where(np.roll(same, 1), np.roll(h, 1), tv.U64(0))
        around = tv.mix64(before * tv.U64(0x9E3779B97F4A7C15) + tv.mix64(after)).view(np.int64)
        hot = np.flatnonzero(np.array([bool(x) for x in terms], bool)[word])
        for w, a in zip(word[hot].tolist(), around[hot].tolist()):
            found.update((t, a) for t in terms[w])
    terms_, arounds = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(terms_, pa.string()), pa.array(arounds, pa.int64())], names=["term", "around"])


def learn_lexicon(known: DataFrame, toxic: DataFrame) -> Lexicon:
    """The terms of ``(text, y)``; ``toxic`` are its rows with ``y = 1``."""
    counts = map_arrow(known.select("text", "y"), _counts_batch, "term string, toxic long, clean long, times long")
    total = written(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "times")]), "terms")
    every = total.where(F.col("term") == ANY).first()
    if not every or not every["toxic"]:
        return Lexicon([])
    n1, n0 = every["toxic"], every["clean"]
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    p = (n1 + 1) / (n0 + n1 + 2)  # share of toxic documents: what chance gives any word

    def evident(k: Column) -> Column:
        k, c = k.cast("double"), F.col("clean").cast("double")
        evidence = k * F.log(k / (k + c) / p) + F.when(c > 0, c * F.log(c / (k + c) / (1 - p))).otherwise(0.0)
        return (k > p * (k + c)) & (evidence >= EVIDENCE)

    # no term has more surroundings than occurrences
    likely = total.where((F.col("term") != ANY) & (F.col("times") > 0) & (F.col("toxic") > 0)).withColumn("odds", odds).where((F.col("odds") >= MIN_ODDS) & evident(F.col("times")))
    wanted = toxic.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in likely.select("term").collect()))
    if not wanted.value:
        return Lexicon([])
    around = map_arrow(toxic.select("text"), lambda b: _around_batch(wanted.value, b), "term string, around long")
    contexts = around.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))
    rows = likely.join(contexts, "term").where(evident(F.col("contexts"))).collect()
    return Lexicon(choose_terms({r["term"]: (r["toxic"], r["contexts"], r["odds"]) for r in rows}))


def _near_batch(lexicon: Lexicon, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms with an inexact match, by label: once per document."""
    seen: Counter = Counter()
    ys, base = batch.column("y").to_pylist(), 0
    for _, _, texts in tv.texts_of(batch.column("text")):
        data, starts, ends, first, ph = tokens(texts)
        raw, pairs = data.tobytes(), set()
        hits = lexicon.candidates(ph, starts, ends)
        for k, i in zip(hits.tolist(), (np.searchsorted(first, hits, side="right") - 1).tolist()):
            found = lexicon.match(raw[starts[k] : ends[k]].decode("utf-8", "replace"))
            if found and found[1]:
                pairs.add((i, found[0]))
        seen.update((t, ys[base + i]) for i, t in pairs)
        base += texts.n
    rows = [(t, y, n) for (t, y), n in seen.items()]
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["term", "y", "n"])


def without_chance_neighbours(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """Terms whose inexact matches turn up by chance, as the sample shows, are matched exactly only.

    The ratio compares that a term's inexact matches are as toxic as a term must
    be with that they are as toxic as any word: ``NEAR_EVIDENCE`` against them
    withdraws the edits, and terms of under ``SHORT`` letters need as much for them.
    """
    if not lexicon.terms:
        return lexicon
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)
    n1, n0 = (sample.where(F.col("y") == y).count() for y in (1, 0))
    near = map_arrow(sample.select("text", "y"), lambda b: _near_batch(shared.value, b), "term int, y int, n long")
    seen = {(r["term"], r["y"]): r["n"] for r in near.groupBy("term", "y").agg(F.sum("n").alias("n")).collect()}

    p = (n1 + 1) / (n0 + n1 + 2)
    q = 1 / (1 + (1 - p) / p * math.exp(-MIN_ODDS))

    def kept(i: int, word: str) -> bool:
        ratio = seen.get((i, 1), 0) * math.log(q / p) + seen.get((i, 0), 0) * math.log((1 - q) / (1 - p))
        return ratio >= NEAR_EVIDENCE if len(word) < SHORT else ratio > -NEAR_EVIDENCE

    return Lexicon([(w, stem, weight, edits if edits and kept(i, w) else 0) for i, (w, stem, weight, edits) in enumerate(lexicon.terms)])


def choose_terms(rows: dict[str, tuple[int, int, float]]) -> list[tuple[str, bool, float, int]]:
    """Whole words and stems from counted words (``word$``) and beginnings.

    A beginning leads to its most frequent extension while that keeps
    ``KEEP_SHARE`` of its surroundings; where it forks into several endings it
    is a stem. Extensions of a chosen stem are part of it.
    """
    children: dict[str, list[str]] = {}
    for t in rows:
        for parent in ([t[:-1], t[:-2]] if t.endswith("$") else [t[:-1]]):
            if parent in rows:
                children.setdefault(parent, []).append(t)
                break
    roots = [t for t in rows if not any(p in rows for p in ([t[:-1], t[:-2]] if t.endswith("$") else [t[:-1]]))]
    out: list[tuple[str, bool, float, int]] = []
    for t in roots:
        while not t.endswith("$"):
            longer = max(children.get(t, []), key=lambda c: (rows[c][1], c), default=None)
            if longer is None or rows[longer][1] < KEEP_SHARE * rows[t][1]:
                break
            t = longer
        word, stem = t.rstrip("$"), not t.endswith("$")
        if len(word) >= (MIN_STEM if stem else 3):
            out.append((word, stem, rows[t][2], allowed(len(word))))
    return sorted(out, key=lambda x: (-x[2], x[0]))


# ---- scores --------------------------------------------------------------------------------

N_FEATURES = 6


def features(texts: tv.Texts, lexicon: Lexicon) -> np.ndarray:
    """Per text: log1p sum, maximum and density of the weights, quoted share, matches, exact share."""
    out = np.zeros((texts.n, N_FEATURES))
    data, starts, ends, first, ph = tokens(texts)
    hits = lexicon.candidates(ph, starts, ends) if lexicon.terms else np.zeros(0, np.int64)
    if not len(hits):
        return out
    raw = data.tobytes()
    text_of = np.searchsorted(first, hits, side="right") - 1
    rows: dict[int, list[tuple[float, float, int]]] = {}
    for k, i in zip(hits.tolist(), text_of.tolist()):
        found = lexicon.match(raw[starts[k] : ends[k]].decode("utf-8", "replace"))
        if found is None:
            continue
        a, b = max(k - WINDOW, int(first[i])), min(k + WINDOW + 1, int(first[i + 1]))
        lead = raw[starts[a] : starts[k]].decode("utf-8", "replace")
        tail = raw[ends[k] : ends[b - 1]].decode("utf-8", "replace")
        around = {raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in range(a, b) if j != k}
        quoted = 0.6 * (any(c in QUOTES for c in lead[-40:]) and any(c in QUOTES for c in tail[:40])) + 0.3 * bool(around & REPORTING)
        weight = lexicon.terms[found[0]][2] * (1.0, 0.7, 0.4)[found[1]] * (1 - quoted) * (1.3 if around & ADDRESSING else 1.0)
        rows.setdefault(i, []).append((weight, quoted, found[1]))
    words = np.maximum(np.diff(first), 1)
    for i, found_here in rows.items():
        w = [x[0] for x in found_here]
        out[i] = (math.log1p(sum(w)), max(w), min(1.0, 10 * sum(w) / words[i] / 10), sum(x[1] for x in found_here) / len(w), math.log1p(len(w)), sum(x[2] == 0 for x in found_here) / len(w))
    return out


@dataclass
class ToxicModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weights + self.bias

    def score(self, texts: tv.Texts) -> np.ndarray:
        return sigmoid(self.slope * self.margin(features(texts, self.lexicon)) + self.shift)


def fit_scores(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps on standardised features."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    scale = 1.0 / np.where(std > 1e-9, std, 1.0)
    z = np.column_stack([(x - mean) * scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 0.05 * len(x) / 100)
    ridge[-1] = 1e-3
    for _ in range(40):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(text, y, held)`` of about ``toxic`` toxic and ``clean`` other labelled documents, drawn by a hash of the id;
    all labelled documents but the drawn ones that are held; the toxic ones of these."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, toxic / max(1, counts.get(1, 0)))).otherwise(min(1.0, clean / max(1, counts.get(0, 0))))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1e6 < share
    held = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = known.where(~(drawn & held))
    small = F.broadcast if sum(counts.values()) <= BROADCAST_LABELS else lambda df: df
    return texts.join(F.broadcast(known.where(drawn)), "doc_id").withColumn("held", held), texts.join(small(learned), "doc_id"), texts.join(small(learned.where("y = 1")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    sample, learned, toxic = labelled(docs, labels)
    sample = sample.persist()
    try:
        lexicon = learn_lexicon(learned, toxic)
        lexicon = without_chance_neighbours(lexicon, sample.where(~F.col("held")))
        shared = docs.sparkSession.sparkContext.broadcast(lexicon)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(texts, shared.value) for _, _, texts in tv.texts_of(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("held"), pa.array([r.tobytes() for p in x for r in p], pa.binary())], names=["y", "held", "x"])

        rows = map_arrow(sample.select("text", "y", "held"), run, "y int, held boolean, x binary").toArrow().to_pylist()
    finally:
        sample.unpersist()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float64).reshape(-1, N_FEATURES)
    y = np.array([r["y"] for r in rows], float)
    held = np.array([r["held"] for r in rows], bool)
    if not 0 < y[~held].sum() < (~held).sum():
        rate = float((y.sum() + 1) / (len(y) + 2))
        return ToxicModel(Lexicon([]), np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), math.log(rate / (1 - rate)))
    model = ToxicModel(lexicon, *fit_scores(x[~held], y[~held]))
    if held.any():
        model.slope, model.shift = fit_platt(model.margin(x[held]), y[held])
    return model


def score(docs: DataFrame, model: ToxicModel, keep: tuple[str, ...] = ("doc_id",), predict_from: float = PREDICT_FROM) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([shared.value.score(texts) for _, _, texts in tv.texts_of(text_of(batch))])
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s), pa.array((s >= predict_from).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return map_arrow(with_text(docs, names), run, fields + "score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), score, predicted; learned without the held-out rows."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs, labels.where(~held))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held), model, ("doc_id", "held_out"))
