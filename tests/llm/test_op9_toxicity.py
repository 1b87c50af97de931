"""Toxicity: the automaton against plain edit distances, context, held-out accuracy, defined cases."""

import random

import numpy as np
import pyarrow as pa

from cairn.llm import textvec as tv
from cairn.llm import toxicity as tx
from llm_tables import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = [("worthless", False, 3.0), ("idiot", False, 2.0), ("patheticness", False, 4.0), ("lowei", True, 3.0), ("lostraxy", True, 2.0)]


def lexicon():
    return tx.Lexicon([(w, stem, x, tx.allowed(len(w))) for w, stem, x in TERMS])


def misspelled(rng):
    w = list(rng.choice(TERMS)[0] + rng.choice(["", "", "abc"]))
    for _ in range(rng.randint(0, 3)):
        k, how = rng.randrange(len(w)) if w else 0, rng.random()
        if how < 0.3 and w:
            w.pop(k)
        elif how < 0.6 or not w:
            w.insert(k, rng.choice("aeioéwxyz"))
        else:
            w[k] = rng.choice("aeioéwxyz")
    return "".join(w)


def test_automaton_and_part_filter_equal_edit_distances():
    rng, lex = random.Random(1), lexicon()
    words = [misspelled(rng) for _ in range(3_000)]
    words = [w for w in words if w]
    want = []
    for w in words:
        ds = [min(distance(w[:k], t) for k in range(len(w) + 1)) if stem else distance(w, t) for t, stem, _ in TERMS]
        ok = [d for d, (t, _, _) in zip(ds, TERMS) if d <= tx.allowed(len(t))]
        want.append(min(ok) if ok else None)
        found = lex.match(w)
        assert (found and found[1]) == want[-1]
    _, _, texts = next(tv.texts_of(pa.array([" ".join(words)])))
    _, starts, ends, _, ph = tx.tokens(texts)
    assert set(np.flatnonzero([d is not None for d in want])) <= set(lex.candidates(ph, starts, ends).tolist())


def test_quotation_weighs_less_than_abuse():
    texts = next(tv.texts_of(pa.array(["You are an IDIOT, a wort4less one", 'The word “idiot” was quoted; he wrote "worthless" there', "nothing here", ""])))[2]
    f = tx.features(texts, lexicon())
    assert f[0, 1] > f[1, 1] > 0 and f[0, 3] == 0 < f[1, 3] and not f[2:].any()


def test_held_out_documents(spark, table):
    rows = tx.digest(table("documents"), table("labels")).join(table("labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.02 * len(held)
    assert sum(r.predicted for r in held if r.toxic == 1) >= 0.6 * sum(r.toxic for r in held)


def test_lexicon_of_words_and_stems_and_defined_cases(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words.insert(rng.randrange(40), rng.choice(["zapper", "vequ" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "zapper"), (902, "ZAPPER! " * 20_000), (903, "the zaper"), (903, "the zaper")], clashes=True)
    model = tx.fit(docs, lab)
    assert {(w, s) for w, s, _, _ in model.lexicon.terms} == {("zapper", False), ("vequ", True)}
    got = {(r.doc_id, r.predicted) for r in tx.digest(docs, lab).collect()}
    assert {(900, 0), (901, 0), (None, 1), (902, 1), (903, 1)} <= got
    assert {r.predicted for r in tx.digest(docs, lab.limit(0)).collect()} == {1} or len({r.score for r in tx.digest(docs, lab.limit(0)).collect()}) == 1
    assert tx.digest(docs.limit(0), lab).count() == 0


ACCENTED = [("imbécile", False, 3.0), ("ärgerlich", True, 2.0), ("estúpidamente", False, 4.0), ("дурак", False, 3.0), ("идиотский", True, 2.0), ("crétin", False, 2.0), ("niño", False, 2.0), ("añ", False, 2.0)]


def test_part_filter_keeps_every_misspelling_of_accented_and_cyrillic_terms():
    rng, lex = random.Random(2), tx.Lexicon([(w, stem, x, tx.allowed(len(w))) for w, stem, x in ACCENTED])
    words = ["imbecile", "crétin"]
    for _ in range(3_000):
        w = list(rng.choice(ACCENTED)[0] + rng.choice(["", "", "абв", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            k, how = rng.randrange(len(w)) if w else 0, rng.random()
            if how < 0.3 and w:
                w.pop(k)
            elif how < 0.6 or not w:
                w.insert(k, rng.choice("aeéñыж中🙂"))
            else:
                w[k] = rng.choice("aeéñыж中🙂")
        words += ["".join(w)] if w else []
    want = []
    for w in words:
        ds = [min(distance(w[:k], t) for k in range(len(w) + 1)) if stem else distance(w, t) for t, stem, _ in ACCENTED]
        ok = [d for d, (t, _, _) in zip(ds, ACCENTED) if d <= tx.allowed(len(t))]
        want.append(min(ok) if ok else None)
        found = lex.match(w)
        assert (found and found[1]) == want[-1]
    _, _, texts = next(tv.texts_of(pa.array([" ".join(words)])))
    _, starts, ends, _, ph = tx.tokens(texts)
    assert len(starts) == len(words) and want[0] == 1
    assert set(np.flatnonzero([d is not None for d in want])) <= set(lex.candidates(ph, starts, ends).tolist())


def test_short_terms_forgive_an_edit_where_the_labels_support_it(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[10:10] = ["zonk", "zonk"[: i % 3 + 1] + rng.choice("qruvwxyz") + "zonk"[i % 3 + 2 :] if i % 10 == 0 else "zonk", word(), "wurp"]
        elif i % 5 == 1:
            words.insert(10, rng.choice(["warp", "worp"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    terms = {w: edits for w, _, _, edits in tx.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).lexicon.terms}
    assert terms["zonk"] == 1 and terms["wurp"] == 0


def test_lexicon_counts_all_labelled_rows_and_copies_once_wherever_they_lie(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    copied = " ".join([word(), *("xq" + word() for _ in range(30)), word()])  # one passage in many toxic documents
    rows, labels = [], []
    for i in range(11_000):
        words = [word() for _ in range(8)]
        if i % 5 == 0:  # 2,200 toxic documents, of which 1,500 are sampled
            words += [copied] * (i % 50 == 0) + ["klmnopqrst"[i // 5 % 10] + "zzvwk"] * (i // 5 < 130) + ["zapper"] * (i % 3 == 0)
            rng.shuffle(words)
        elif i == 7:
            words.append("zaqper")  # one chance neighbour in a clean document
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    lexicons = []
    for parts in (2, 40):
        _, learned, toxic = tx.labelled(docs.repartition(parts), lab)
        lexicons.append(tx.learn_lexicon(learned, toxic).terms)
    assert lexicons[0] == lexicons[1]
    assert not any(w.startswith("xq") for w, *_ in lexicons[0])
    assert "zapper" in {w for w, *_ in lexicons[0]}
    assert sum(c + "zzvwk" in {w for w, *_ in lexicons[0]} for c in "klmnopqrst") >= 7  # 13 documents each, some held for calibration
    sample = spark.createDataFrame([("zaqper", 0)] + [("ab", 0)] * 40 + [("zapper", 1)] * 10, "text string, y int")
    near = tx.without_chance_neighbours(tx.Lexicon([("zapper", False, 3.0, 1)]), sample)
    assert near.terms[0][3] == 1
