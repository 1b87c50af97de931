"""Nearest neighbours against brute force, the error bound, defined cases."""

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import one_bit_ann as ann


def exact(ids, x, top=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        o = [k for k in np.lexsort((ids, -s)) if ids[k] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[k]), float(s[k])) for k in o]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_whole_table(spark, table):
    v = table("embeddings")
    p = v.toPandas()
    want = exact(p.vec_id.to_numpy(), np.array(p.embedding.tolist(), dtype=np.float64))
    got = found(ann.digest(v).collect())
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[q])[i]) < 1e-12 for q in want for i, s in got[q] if i in dict(want[q]))


def test_many_blocks_uneven_norms_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 33)) * rng.uniform(0.1, 5, size=(400, 1)) + 0.5
    x[50:90] = x[50]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(np.arange(400), x)
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0, data_block=64, query_block=7).collect())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.97 * 20 * len(want)
    assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for rows in got.values() for a, b in zip(rows, rows[1:]))


def test_estimates_lie_within_their_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3_000, 33)) + 0.5
    centre, q = x.mean(axis=0), rng.normal(size=33)
    est, bound = ann.estimates(q, centre, *ann.encode(x, centre))
    assert (np.abs(est - x @ q) <= bound).mean() > 0.97


def test_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (1, [2.0, 1.0]), (2, [1.0, None]), (None, [1.0, 1.0]),
            (3, [1.0, 2.0, 3.0]), (80, [1.0, 2.0, 3.0]), (100, []), (4, [float("inf"), 1.0]), (5, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, d string")
    got = [tuple(r)[:4] for r in ann.digest(df).collect()]
    assert sorted(got) == [(0, 1, 1, 4.0), (0, 2, 5, 4.0), (80, 1, 3, 14.0)]
    assert ann.digest(df.limit(0)).count() == 0
