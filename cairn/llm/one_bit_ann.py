"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Vectors are centred on the mean of all vectors, rotated by one random
orthogonal matrix and kept as one bit per dimension, with two scalars each:
the length of the centred vector and its inner product with its own code. For a query the inner product with a vector is
estimated from table look-ups over the packed bits and these scalars; the
estimate's error shrinks with the dimension and its bound is known
(``ERRORS`` standard errors). In every block the vectors with the best
estimates are reranked exactly, which gives a threshold; every further vector
whose upper bound reaches the threshold is reranked too. So only vectors that
are worse than the threshold by more than the bound are left out.

Work is dealt as blocks: vectors in blocks of ``DATA_BLOCK`` rows, which are
shuffled once; the stated query set in small blocks of ``QUERY_BLOCK``, each sent
to every data block. A task reads a data block's vectors, encodes them, and
answers the query blocks as they pass; each query's best of all blocks are
merged. Block numbers come from a hash of the row's id and vector, so equal
vectors do not gather.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without an id, take no part; vectors are compared with
those of the same dimension; all rows with the query's own id are left out as
its candidates; repeated rows are candidates of their own; ties go to the
smaller vec_id; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.llm.common import shuffle_partitions, written

TOP = 20
#: Error bounds in standard errors of the estimate.
ERRORS = 2.5
DATA_BLOCK = 8_192
QUERY_BLOCK = 64
SEED = 11


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


_ROTATIONS: dict[int, np.ndarray] = {}


def _rotate(x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    if d not in _ROTATIONS:
        _ROTATIONS[d] = rotation(d)
    return x @ _ROTATIONS[d]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, centred lengths, and inner products of unit vector and code."""
    o = _rotate(x - centre)
    length = np.linalg.norm(o, axis=1)
    agree = np.abs(o).sum(axis=1) / (np.where(length > 0, length, 1) * np.sqrt(x.shape[1]))
    return np.packbits(o > 0, axis=1), length, np.where(length > 0, agree, 1.0)


_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1).T  # 8 x 256


def estimates(q: np.ndarray, centre: np.ndarray, codes: np.ndarray, length: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of one query with all codes, and the bound of their error."""
    d = len(q)
    rotated = np.zeros(codes.shape[1] * 8)
    rotated[:d] = _rotate(q[None, :])[0]
    tables = rotated.reshape(-1, 8) @ _SIGNS  # partial sums for each byte value
    raw = np.zeros(len(codes))  # bits beyond the dimension carry no weight
    for k in range(codes.shape[1]):
        raw += tables[k][codes[:, k]]
    size = np.linalg.norm(q)
    error = length * size * np.sqrt(np.maximum(0.0, 1 - agree**2)) / (agree * np.sqrt(max(1, d - 1)))
    return q @ centre + length * raw / (np.sqrt(d) * agree), ERRORS * error


def search_block(ids: np.ndarray, x: np.ndarray, code: tuple, centre: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int) -> list[tuple[int, int, float]]:
    """For every query its ``top`` best of the block as ``(query, vec, score)``."""
    out: list[tuple[int, int, float]] = []
    codes, length, agree = code
    order = np.argsort(ids, kind="stable")
    ids, x, codes, length, agree = (a[order] for a in (ids, x, codes, length, agree))
    for qid, q in zip(query_ids.tolist(), queries):
        est, bound = estimates(q, centre, codes, length, agree)
        own = slice(*np.searchsorted(ids, (qid, qid + 1)))
        est[own] = -np.inf
        n = len(ids) - (own.stop - own.start)
        if n <= 0:
            continue
        k = min(top, n)
        first = np.argpartition(-est, k - 1)[:k]
        threshold = (x[first] @ q).min()
        near = np.flatnonzero(est + bound >= threshold)
        exact = x[near] @ q
        best = np.lexsort((ids[near], -exact))[:k]
        out += [(qid, int(ids[near[b]]), float(exact[b])) for b in best]
    return out


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v, d)``: the vectors that take part, as doubles with their dimension."""
    base = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return base.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0)).withColumn("d", F.size("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centres(vectors: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """Mean and count of the vectors of each dimension (one sum per task and dimension)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            d = batch.column("d").to_numpy()
            for k in np.unique(d).tolist():
                m = _matrix(batch.column("v").filter(pa.array(d == k)))
                sums[k] = sums.get(k, 0.0) + m.sum(axis=0)
                counts[k] = counts.get(k, 0) + len(m)
        rows = [(k, i, float(v), counts[k]) for k, s in sums.items() for i, v in enumerate(s)]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["d", "i", "s", "n"])

    rows = vectors.select("v", "d").mapInArrow(add, "d int, i int, s double, n long").groupBy("d", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d", "i").collect()
    out: dict[int, tuple[np.ndarray, int]] = {}
    for k in {r["d"] for r in rows}:
        mine = [r for r in rows if r["d"] == k]
        out[k] = (np.array([r["s"] for r in mine]) / mine[0]["n"], mine[0]["n"])
    return out


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, ident: str = "vec_id", vector: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row that ``is_query`` (an expression over ``vec_id``) selects."""
    spark = vectors.sparkSession
    base = written(usable(vectors, ident, vector), "vectors")
    means = centres(base)
    queries_of = {r["d"]: r["n"] for r in base.where(is_query).groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame(
        [(d, max(1, -(-n // data_block)), max(1, -(-queries_of.get(d, 0) // query_block))) for d, (_, n) in means.items()] or [(0, 1, 1)], "d int, blocks int, query_blocks int")
    shared = spark.sparkContext.broadcast({d: c for d, (c, _) in means.items()})
    parts = max(1, shuffle_partitions(vectors))
    spread = F.xxhash64("vec_id", "v")
    data = base.join(F.broadcast(sizes), "d").select("d", F.pmod(spread, F.col("blocks")).cast("int").alias("b"), "vec_id", "v")
    once = base.where(is_query).groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("x")).select("vec_id", "x.*")
    asked = once.join(F.broadcast(sizes), "d").select("d", F.pmod(spread, F.col("query_blocks")).cast("int").alias("b"), "vec_id", "v")
    queries = _query_blocks(asked, parts).join(F.broadcast(sizes.select("d", "blocks")), "d")
    # every data block gets its vectors (kind 0) and then, one after the other, all blocks of the stated queries (kind 1)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = data.select("d", "b", F.lit(0).alias("kind"), none("qb", "int"), "vec_id", "v", none("qids", "binary"), none("qvs", "binary"))
    sent = queries.select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("kind"), "qb", none("vec_id", "long"), none("v", "array<double>"), "qids", "qvs")
    dealt = rows.unionByName(sent).repartition(parts, "d", "b").sortWithinPartitions("d", "b", "kind", "qb")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        block = None
        for batch in batches:
            d, b, kind = (batch.column(c).to_numpy() for c in ("d", "b", "kind"))
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
                if (d[lo], b[lo]) != key:
                    key, ids, vs, block = (d[lo], b[lo]), [], [], None
                if kind[lo] == 0:
                    ids.append(batch.column("vec_id").slice(lo, hi - lo).to_numpy())
                    vs.append(_matrix(batch.column("v").slice(lo, hi - lo)))
                    continue
                if not ids:
                    continue
                centre = shared.value[int(key[0])]
                if block is None:
                    x = np.concatenate(vs)
                    block = (np.concatenate(ids), x, encode(x, centre))
                found = []
                for i in range(lo, hi):
                    qids, qvs = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("qids", np.int64), ("qvs", np.float64)))
                    found += search_block(*block, centre, qids, qvs.reshape(len(qids), -1), top)
                cols = list(zip(*found)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """One row per query block ``(d, qb)``: ids and vectors, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs = None, [], []

        def out() -> pa.RecordBatch:
            cols = [[now[0]], [now[1]], [np.array(ids, np.int64).tobytes()], [np.concatenate(vs).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["d", "qb", "qids", "qvs"])

        for batch in batches:
            for d, b, i, v in zip(batch.column("d").to_pylist(), batch.column("b").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("v")):
                if (d, b) != now:
                    if ids:
                        yield out()
                    now, ids, vs = (d, b), [], []
                ids.append(i)
                vs.append(v.values.to_numpy())
        if ids:
            yield out()

    return rows.repartition(parts, "d", "b").sortWithinPartitions("d", "b").mapInArrow(pack, "d int, qb int, qids binary, qvs binary")


def digest(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
