"""Jaccard self-join of documents on sets of 5-word shingles: banded MinHash, then exact verification.

1. One Arrow pass turns each text into its set of 5-word shingles (64-bit
   hashes), a 128-bit identity of the set, ``TREES`` signature prefixes and an
   80-byte sketch. Documents with the same set are one **node** from here on
   (pre-aggregated, so a text copied a million times is one row).
2. Fixed bands in place of an LSH forest: each of ``TREES`` trees has one prefix
   of ``DEPTH`` labels, the longest up to ``MAX_DEPTH`` at which a pair at the
   similarity bound is found with ``TARGET_RECALL`` in some tree
   (``prefix_depth``, no data play a part); nodes with equal prefixes share a
   trie node. Trie nodes with the same members (found in several trees) are
   looked at once; a crowded one is not refined by further labels.
3. Inside a trie node sketches are compared block by block. Pairs whose sketch
   agreement lies more than 5 standard deviations below the bound are dropped
   (chance of losing a link below 1e-6); of the rest only the edges of a
   spanning forest leave the task. Their connected components are small groups
   in which every real link must lie.
4. Exact verification: each component's shingle sets (read once from the text)
   are compared pair by pair, as sorted sets or as blocks of a 0/1 matrix. A
   task returns each node's number of links and a spanning forest of the links,
   never the pairs. Groups beyond ``BLOCK`` members are cut into blocks, and
   pairs of blocks go to different tasks.
5. Components of the links are the classes.

Result: one row per document: ``class_id`` (smallest doc_id of its class),
``n_links`` (other distinct shingle sets with Jaccard >= 0.8), ``n_copies``
(documents with the same set, itself included).

Defined cases: a text of 1 to 4 words has one shingle (all its words); a text
without words (null, empty, white space) has no partner and is a class of its
own; repeated rows are copies; null ids take part like others (a class of null
ids only has a null class_id); other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import ROW, as_row, map_arrow, row_key, shuffle_partitions, text_frame, text_key, written
from cairn.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 20
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
#: Sketch agreement below which a pair cannot reach the similarity (0.8 - 5.5 standard deviations of 80 draws).
SKETCH_CUT = 0.55
#: Members of a trie node or component compared in one task; larger ones are dealt out as pairs of blocks.
BLOCK = 512


def prefix_depth(trees: int = TREES, longest: int = MAX_DEPTH, similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> int:
    """Shortens the matched prefix from ``longest`` until the trees together reach the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


DEPTH = prefix_depth()
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * tv.U64(2)
_MUL = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * tv.U64(2) + tv.U64(1)


def shingle_sets(texts: tv.Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    h, first = texts.word_grams(SHINGLE)
    words = np.diff(texts.words[2])
    sets = [np.unique(h[first[i] : first[i + 1]]) for i in range(texts.n)]
    for i in np.flatnonzero((words > 0) & (words < SHINGLE)):
        k = int(words[i])
        g, gf = texts.word_grams(k)
        sets[i] = tv.mix64(g[gf[i] : gf[i] + 1] + tv.U64(k))
    return sets


PROFILE = "doc_id long, k1 long, k2 long, rid long, node binary, n_shingles int, bands array<long>, sketch binary"


def _profile_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes: list[bytes | None] = []
    sizes, bands, sketches = [], [], []
    for _, _, texts in tv.texts_of(batch.column("text")):
        sets = shingle_sets(texts)
        n = np.array([len(s) for s in sets])
        some = np.flatnonzero(n)
        h = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, tv.U64)
        at = np.concatenate(([0], np.cumsum(n[some])))[:-1].astype(np.int64)
        low = np.empty((TREES * DEPTH, len(some)), tv.U64)
        if len(some):
            for k in range(TREES * DEPTH):
                low[k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], at)
            one, two = np.add.reduceat(tv.mix64(h), at), np.add.reduceat(tv.mix64(h ^ tv.U64(0x5DEECE66D)), at)
        low = tv.mix64(low)
        label = np.zeros((TREES, len(some)), tv.U64)
        for t in range(TREES):
            label[t] = t + 1
            for d in range(DEPTH):
                label[t] = tv.mix64(label[t] * tv.U64(0x9E3779B97F4A7C15) + low[t * DEPTH + d])
        sketch = (low & tv.U64(255)).astype(np.uint8).T
        place = dict(zip(some.tolist(), range(len(some))))
        for i in range(texts.n):
            k = place.get(i)
            sizes.append(int(n[i]))
            if k is None:
                nodes.append(None)
                bands.append(None)
                sketches.append(None)
            else:
                nodes.append(int(one[k]).to_bytes(8, "big") + int(two[k] ^ tv.U64(n[i])).to_bytes(8, "big"))
                # fewer than 4 shingles: only an equal set reaches 0.8, no prefix is needed
                bands.append(label[:, k].view(np.int64) if n[i] > 3 else None)
                sketches.append(sketch[k].tobytes())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in ("doc_id", "k1", "k2", "rid")], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
        names=["doc_id", "k1", "k2", "rid", "node", "n_shingles", "bands", "sketch"])


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def in_blocks(members: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """Deals the members of each group to pairs of blocks ``(bi, bj)`` with ``bi <= bj``; ``mine``: the member's block.

    A group of up to ``block`` members is one pair; of a larger one each member
    goes to as many tasks as there are blocks.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = members.withColumn("_b", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_o")
    return (dealt.select("*", other)
            .withColumns({"bi": F.least("mine", "_o").cast("int"), "bj": F.greatest("mine", "_o").cast("int")}).drop("_b", "_o"))


def grouped(df: DataFrame, keys: list[str], fn: Callable[[tuple, list[tuple]], list[tuple]], fields: list[str], schema: str, out_types: list[pa.DataType]) -> DataFrame:
    """Runs ``fn`` on the rows (``fields``) of every group of ``keys``; groups follow one another in sorted partitions."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out_types)], names=names)
            out.clear()
            return made

        for batch in batches:
            ks = zip(*(batch.column(c).to_pylist() for c in keys))
            for k, row in zip(ks, zip(*(batch.column(c).to_pylist() for c in fields))):
                if k != now:
                    if len(rows) > 1:
                        out += fn(now, rows)
                    now, rows = k, []
                rows.append(row)
            if len(out) > 10_000:
                yield flush()
        if len(rows) > 1:
            out += fn(now, rows)
        yield flush()

    parts = max(1, shuffle_partitions(df))
    return df.select(*keys, *fields).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sketch_edges(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Spanning forest of the pairs whose sketches agree often enough."""
    rows = list({r[0]: r for r in rows}.values())
    cross = key[1] != key[2]
    s = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
    mine = np.array([r[2] for r in rows])
    need = int(np.ceil(SKETCH_CUT * s.shape[1]))
    trees, edges = Forest(len(rows)), []
    for i in range(len(rows) - 1):
        near = (s[i + 1 :] == s[i]).sum(axis=1) >= need
        if cross:
            near &= mine[i + 1 :] != mine[i]
        for j in np.flatnonzero(near) + i + 1:
            if trees.join(i, int(j)):
                edges.append((rows[i][0], rows[int(j)][0]))
    return edges


def _count_shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocks of a 0/1 matrix over the shingles that several sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = count > 1
    number = np.cumsum(useful) - 1
    keep = useful[col]
    owner, col = owner[keep], number[col[keep]]
    shared = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = 4096
    for at in range(0, int(useful.sum()), step):
        a, b = np.searchsorted(col, (at, at + step))
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], col[a:b] - at] = 1
        shared += m @ m.T
    return shared


def _verify(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Exact links of a group: ``(node, links, null)`` per node and ``(a, 0, b)`` per edge of a spanning forest."""
    rows = list({r[0]: r for r in rows}.values())
    cross = key[1] != key[2]
    sets = [np.frombuffer(r[1], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets])
    mine = np.array([r[2] for r in rows])
    links, trees, out = np.zeros(len(rows), np.int64), Forest(len(rows)), []
    if len(rows) <= 6:
        shared = np.zeros((len(rows), len(rows)))
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        shared = _count_shared(sets)
    for i in range(len(rows) - 1):
        linked = 9 * shared[i, i + 1 :] >= 4 * (n[i] + n[i + 1 :])  # i / (n1 + n2 - i) >= 4 / 5
        if cross:
            linked &= mine[i + 1 :] != mine[i]
        js = np.flatnonzero(linked) + i + 1
        links[i] += len(js)
        links[js] += 1
        out += [(rows[i][0], 0, rows[int(j)][0]) for j in js if trees.join(i, int(j))]
    return out + [(r[0], int(k), None) for r, k in zip(rows, links) if k]


def _sets_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [s.tobytes() for _, _, texts in tv.texts_of(batch.column("text")) for s in shingle_sets(texts)]
    names = ["root", "size", "node"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sets, pa.binary())], names=[*names, "shingles"])


def _joined(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents' profiles, and per node its root, links, copies and smallest id."""
    base = text_frame(docs).select("doc_id", *text_key(), row_key(), "text")
    profile = written(map_arrow(base, _profile_batch, PROFILE), "profile")
    known = profile.where("node is not null")
    at = F.min(F.struct("k1", "k2", "rid")).alias("at")
    nodes = written(known.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_copies"), at), "nodes")
    prefixes = written(known.where("bands is not null").select("node", F.explode("bands").alias("band")).distinct(), "prefixes")
    tries = prefixes.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("first")).where("size > 1")
    once = written(tries.groupBy("size", "mark", "first").agg(F.min("band").alias("band")).select("band", "size"), "tries")
    sketches = known.where("bands is not null").dropDuplicates(["node"]).select("node", "sketch")
    members = prefixes.join(once, "band").join(sketches, "node")
    near = grouped(in_blocks(members, "band", "size", block), ["band", "bi", "bj"], _sketch_edges, ["node", "sketch", "mine"], "a binary, b binary", [pa.binary(), pa.binary()])
    groups = components(near)
    groups = written(groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root"), "groups")
    wanted = groups.join(nodes, "node").select("node", "root", "size", "at.*")
    sets = map_arrow(base.join(wanted, ["k1", "k2", "rid"]).select("text", "root", "size", "node"), _sets_batch, "root binary, size long, node binary, shingles binary")
    found = written(grouped(in_blocks(sets, "root", "size", block), ["root", "bi", "bj"], _verify, ["node", "shingles", "mine"], "node binary, links long, other binary", [pa.binary(), pa.int64(), pa.binary()]), "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = nodes.join(classes, "node", "left").join(links, "node", "left").select(
        "node", "low", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return profile, written(joined, "classes")


def jaccard_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_shingles."""
    profile, joined = _joined(docs, block)
    ids = joined.groupBy("root").agg(F.min("low").alias("class_id"))
    by_node = joined.join(ids, "root").select("node", "class_id", "n_links", "n_copies")
    return profile.select("doc_id", "node", "n_shingles").join(by_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.col("n_shingles").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of every class (the smallest id; equal ids: one of the rows), with the documents' own columns.

    Documents without words are no copies of each other and all stay.
    """
    profile, joined = _joined(docs, block)
    rows = profile.where("node is not null").groupBy("node", "k1", "k2", "rid", "doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    first = (rows.join(joined.select("node", "root"), "node")
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "rid", "_rows")).alias("s"))
             .select("s.k1", "s.k2", "s.rid", "s._rows"))
    first = written(first.unionByName(profile.where("node is null").select("k1", "k2", "rid", F.lit(0).cast("long").alias("_rows")).distinct()), "first")
    kept = as_row(docs).select(ROW, *[k.alias(c) for k, c in zip([*text_key(f"{ROW}.text"), row_key(f"{ROW}.doc_id")], ("k1", "k2", "rid"))]).join(first, ["k1", "k2", "rid"])
    single = kept.where("_rows <= 1").select(ROW)
    several = kept.where("_rows > 1").dropDuplicates(["k1", "k2", "rid"]).select(ROW)
    return single.unionByName(several).select(f"{ROW}.*")
