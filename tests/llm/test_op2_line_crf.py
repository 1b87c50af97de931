"""Line CRF: recursion against all state sequences, held-out accuracy, defined cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import line_crf as lc
from cairn.llm import textvec as tv
from llm_tables import documents


def test_forward_backward_equals_all_sequences():
    rng = np.random.default_rng(0)
    for _ in range(20):
        first = np.concatenate(([0], np.cumsum(rng.integers(0, 6, 4))))
        emit, trans, start = rng.normal(size=first[-1]), rng.normal(size=(2, 2)), rng.normal()
        good, counts = lc.forward_backward(emit, start, trans, lc.Chains.of(first), expect=True)
        want, pairs = np.zeros(len(emit)), np.zeros((2, 2))
        for a, b in zip(first, first[1:]):
            total, states, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for s in itertools.product((0, 1), repeat=int(b - a)) if b > a else ():
                p = np.exp(s[0] * start + sum(emit[a + k] for k, x in enumerate(s) if x) + sum(trans[x, y] for x, y in zip(s, s[1:])))
                total, states = total + p, states + p * np.array(s)
                for x, y in zip(s, s[1:]):
                    moves[x, y] += p
            if b > a:
                want[a:b], pairs = states / total, pairs + moves / total
        assert np.allclose(good, want) and np.allclose(counts, pairs)


def test_latent_gradient_equals_differences_of_the_likelihood():
    """Of the labels' likelihood through the length-weighted marginals, by brute force over all line states."""
    rng = np.random.default_rng(3)
    first = np.array([0, 3, 3, 4, 8])
    size, y = rng.random(8) + 0.1, np.array([1, 0, 0, 1])
    share = size / np.repeat([size[a:b].sum() for a, b in zip(first, first[1:])], np.diff(first))

    def likelihood(emit, start, trans):
        out = 0.0
        for d, (a, b) in enumerate(zip(first, first[1:])):
            if a == b:
                continue
            total = good = 0.0
            for s in itertools.product((0, 1), repeat=int(b - a)):
                p = np.exp(s[0] * start + sum(emit[a + k] for k, x in enumerate(s) if x) + sum(trans[x, u] for x, u in zip(s, s[1:])))
                total, good = total + p, good + p * sum(share[a + k] for k, x in enumerate(s) if x)
            out += np.log(good / total if y[d] else 1 - good / total)
        return out

    for _ in range(5):
        emit, start, trans = rng.normal(size=8), rng.normal(), rng.normal(size=(2, 2))
        lines, moves, value = lc.latent_gradient(emit, start, trans, lc.Chains.of(first), share, first, y)
        assert np.isclose(value, likelihood(emit, start, trans))
        for i in range(8):
            e = np.eye(8)[i] * 1e-5
            assert np.isclose(lines[i], (likelihood(emit + e, start, trans) - likelihood(emit - e, start, trans)) / 2e-5, atol=1e-5)
        for a, b in itertools.product((0, 1), repeat=2):
            e = np.zeros((2, 2))
            e[a, b] = 1e-5
            assert np.isclose(moves[a, b], (likelihood(emit, start, trans + e) - likelihood(emit, start, trans - e)) / 2e-5, atol=1e-5)


def test_lines_of_mixed_documents_split(spark, table):
    """Half good and half bad text in one document: the lines' states follow the halves."""
    known = table("documents").join(table("labels").select("doc_id", F.col("quality").alias("y")).where("y IS NOT NULL"), "doc_id")
    model = lc.fit(known.withColumn("held", F.pmod("doc_id", F.lit(5)) == 0))
    texts = {y: sorted(r.text for r in known.where(F.col("y") == y).collect() if r.text and len(r.text) > 300) for y in (0, 1)}
    right = total = 0
    for good, bad in list(zip(texts[1] * 3, texts[0] * 3))[:40]:
        halves = [[line for line in t.split("\n") if line.split()][:8] for t in (good, bad)]
        raw = "\n".join(halves[0] + halves[1]).encode()
        x, size, first = lc.line_features(tv.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        p = model.lines(x, first)
        k = len(halves[0])
        total += 1
        right += np.average(p[:k], weights=size[:k]) > 0.5 > np.average(p[k:], weights=size[k:])
    assert total >= 10 and right >= 0.9 * total


def test_held_out_documents_are_told_apart(spark, table):
    got = lc.digest(table("documents"), table("labels"))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table("labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert got.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).where("not held_out").count() == 0


def test_defined_cases(spark, table):
    model = lc.fit(table("documents").join(table("labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("held", F.pmod("doc_id", F.lit(5)) == 0))
    docs = documents(spark, [(1, None), (2, ""), (3, "\n \n"), (4, "One line."), (4, "One line."), (None, "x"), (5, "a b\n" * 50_000)], clashes=True)
    got = [(r.doc_id, r.score) for r in lc.score(docs, model).collect()]
    assert [s for i, s in got if i in (1, 2, 3)] == [0.0] * 3
    assert len({s for i, s in got if i == 4}) == 1 and len(got) == 7
    assert lc.score(docs.limit(0), model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in lc.digest(documents(spark, [(1, "words here"), (2, None)]), no_labels).collect()} == {0.5, 0.0}
