"""Merkle manifest of a table of documents, with a tampered version per marked leaf.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests enter it
as hex text. A document's leaf is ``H`` of doc_id, source, lang, n_chars and
text (``-`` for null, else byte count, ``:``, value). Per source the leaves
ascend by doc_id, and while several nodes remain every ``WIDTH`` consecutive
ones (the last run fewer) become their ``H``; what remains is the source's
subroot. The subroots, ordered by source, give the root in the same way.

The tree is persistent and lives in aligned blocks of ``WIDTH **
LEVELS`` = 4,096 consecutive nodes, which is three levels:

1. The leaves (32 bytes each, hashed in the JVM) are ordered by source and
   doc_id over all tasks by ranges, so a source with most of the rows is spread
   over many. A node's place is its row number in its range plus what its source
   has in the ranges before: one small row per range and source.
2. A block's nodes meet in one task and become one row with the block's digest.
   The digests are the nodes of the next three levels, until a source has one
   node; the sources' subroots go on in the same way. Each round is a
   4,096th of the one before.
3. From the top down every block learns its *path*: the siblings of its digest
   on each level up to the root, one row per block.
4. In its leaf block every tampered leaf makes a version (:class:`Tree`): only
   the ancestors inside the aligned block are copied, all other nodes are
   shared; the copied top goes on along the block's path through the distributed
   upper levels to the version's root. Nothing but the root's digest and the
   number of nodes per round reaches the driver.

Defined cases: nulls are ``-`` in a leaf; a null source is a source of its own
and comes first; a null doc_id comes first in its source and is never tampered
with; rows that share a doc_id go by their leaf's digest; other columns play no
part; a single leaf is its source's subroot, and its proof may be empty (the
hash of nothing); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import written

WIDTH = 16
#: Levels inside a block, and its nodes.
LEVELS = 3
#: One document in so many is tampered with.
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Tree:
    """The levels of hex digests over a block's nodes; versions share them and copy ancestors only."""

    def __init__(self, nodes: list[bytes], n: int, depth: int):
        """A block of a source of ``n`` nodes; if it holds all of them, it ends as soon as one remains."""
        self.levels = [nodes]
        while len(self.levels) <= depth and not (n <= WIDTH**depth and len(self.levels[-1]) == 1):
            below = self.levels[-1]
            self.levels.append([H(b"".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        """What stands left and right of node ``i`` in its run."""
        first = i - i % WIDTH
        return b"".join(self.levels[level][first:i]), b"".join(self.levels[level][i + 1 : first + WIDTH])

    def paths(self, above: list[tuple[bytes, bytes]]) -> list[list[tuple[bytes, bytes]]]:
        """Every member's siblings level by level, then those of the block's digest (``above``)."""
        paths = [above]
        for level in range(len(self.levels) - 2, -1, -1):
            paths = [[self.siblings(level, i), *paths[i // WIDTH]] for i in range(len(self.levels[level]))]
        return paths

    def version(self, i: int, leaf: bytes) -> list[bytes]:
        """A version with ``leaf`` in place ``i``: its copied nodes from the leaf to the block's top; all others are this tree's."""
        copied = [leaf]
        for nodes in self.levels[:-1]:
            first = i - i % WIDTH
            run = nodes[first : first + WIDTH]
            run[i - first] = copied[-1]
            copied.append(H(b"".join(run)))
            i //= WIDTH
        return copied


def continued(top: bytes, above: list[tuple[bytes, bytes]]) -> bytes:
    """The root of a version whose block has ``top``: one copied ancestor per upper level, next to that level's shared nodes."""
    for left, right in above:
        top = H(left + top + right)
    return top


# ---- leaves ------------------------------------------------------------------------------------

def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, changed): the source, the leaf's digest and, for a tampered row, that of its tampered text."""
    head = [_field(F.col(c)) for c in FIELDS[:-1]]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.col("text").cast("string")
    leaf = F.sha2(F.concat(*head, _field(text)).cast("binary"), 256)
    other = F.sha2(F.concat(*head, _field(F.translate(text, upper, upper.lower()))).cast("binary"), 256)
    ident = F.col("doc_id").cast("long")
    marked = F.crc32(ident.cast("string").cast("binary")) % TAMPER == 0
    return docs.select(F.col("source").cast("string").alias("g"), ident.alias("doc_id"), F.unhex(leaf).alias("digest"),
                       F.when(marked, F.unhex(other)).alias("changed"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the group ``g`` by ``order``, and ``n``, the group's size; no group meets in one task."""
    at = written(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
                 .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "manifest-order")
    runs = at.groupBy("g", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("k"))
    group = Window.partitionBy("g")
    before = F.sum("k").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(F.col("g").alias("_g"), F.col("part").alias("_part"), (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"),
                               F.sum("k").over(group).alias("n")), "manifest-runs")
    return at.join(runs, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part"))).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


# ---- blocks ------------------------------------------------------------------------------------

BLOCK_SCHEMA = "g string, n long, block long, top binary, ids array<long>, digests binary, changed array<binary>"


def _packed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows in block order → one row per block with its digest."""
    schema = pa.schema([("g", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("top", pa.binary()), ("ids", pa.list_(pa.int64())),
                        ("digests", pa.binary()), ("changed", pa.list_(pa.binary()))])

    def block_row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        first = parts[0]
        digests = table.column("digest").to_pylist()
        n = first.column("n")[0].as_py()
        tree = Tree([d.hex().encode() for d in digests], n, depth)
        row = {"g": first.column("g")[0].as_py(), "n": n, "block": first.column("block")[0].as_py(), "top": bytes.fromhex(tree.top.decode()),
               "ids": table.column("doc_id").to_pylist(), "digests": b"".join(digests), "changed": table.column("changed").to_pylist()}
        return pa.RecordBatch.from_pylist([row], schema)

    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        sources = batch.column("g").dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (sources[1:] != sources[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(int(lo), int(hi - lo))
            own = (part.column("g")[0].as_py(), int(blocks[lo]))
            if held and own != key:
                yield block_row(held)
                held = []
            key = own
            held.append(part)
    if held:
        yield block_row(held)


def blocks_of(nodes: DataFrame, name: str, depth: int) -> DataFrame:
    """``nodes`` (g, doc_id, digest, changed, pos, n) as aligned blocks, written."""
    keyed = nodes.withColumn("block", F.expr(f"pos div {WIDTH**depth}"))
    ordered = keyed.repartition("g", "block").sortWithinPartitions("g", "block", "pos").select("g", "n", "block", "doc_id", "digest", "changed")
    return written(ordered.mapInArrow(lambda batches: _packed(batches, depth), BLOCK_SCHEMA), name)


def next_nodes(blocks: DataFrame, depth: int) -> DataFrame:
    return blocks.select("g", F.lit(None).cast("long").alias("doc_id"), F.col("top").alias("digest"), F.lit(None).cast("binary").alias("changed"),
                         F.col("block").alias("pos"), F.expr(f"(n + {WIDTH**depth - 1}) div {WIDTH**depth}").alias("n"))


@dataclass
class Forest:
    """The written rounds of blocks, from the lowest up, and the nodes that remain (one per group)."""

    rounds: list[DataFrame]
    tops: DataFrame


def grown(nodes: DataFrame, name: str, depth: int) -> Forest:
    rounds = [blocks_of(nodes, f"{name}-0", depth)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > WIDTH**depth:
        rounds.append(blocks_of(next_nodes(rounds[-1], depth), f"{name}-{len(rounds)}", depth))
    return Forest(rounds, next_nodes(rounds[-1], depth))


# ---- paths, from the top down ------------------------------------------------------------------

PATH = "array<struct<l:binary,r:binary>>"
PATH_SCHEMA = f"g string, pos long, path {PATH}, subroot binary"


def _hexes(raw: bytes) -> list[bytes]:
    return [raw[i : i + 32].hex().encode() for i in range(0, len(raw), 32)]


def _above(row: dict) -> list[tuple[bytes, bytes]]:
    return [(p["l"], p["r"]) for p in row["path"]]


def _member_paths(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))), ("subroot", pa.binary())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            nodes = _hexes(row["digests"])
            for i, path in enumerate(Tree(nodes, row["n"], depth).paths(_above(row))):
                yield pa.RecordBatch.from_pylist([{"g": row["g"], "pos": row["block"] * WIDTH**depth + i, "path": [{"l": a, "r": b} for a, b in path],
                                                   "subroot": row["subroot"] or nodes[i]}], schema)


def member_paths(blocks: DataFrame, depth: int) -> DataFrame:
    return blocks.mapInArrow(lambda batches: _member_paths(batches, depth), PATH_SCHEMA)


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """``blocks`` with the path of their digest; ``paths`` has one row per block."""
    p = paths.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), "path", "subroot")
    return blocks.join(p, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_pos"))).select(*blocks.columns, "path", "subroot")


def descended(forest: Forest, paths: DataFrame, name: str, depth: int) -> DataFrame:
    """Paths of the lowest round's blocks, from those of the groups' tops."""
    for k in range(len(forest.rounds) - 1, 0, -1):
        paths = written(member_paths(_with_paths(forest.rounds[k], paths), depth), f"{name}-{k}")
    return paths


# ---- the manifest ------------------------------------------------------------------------------

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _documents(batches: Iterator[pa.RecordBatch], root: str, depth: int) -> Iterator[pa.RecordBatch]:
    """Leaf blocks with their paths → one row per document."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            above, nodes = _above(row), _hexes(row["digests"])
            tree = Tree(nodes, row["n"], depth)
            proofs = [H(b"".join(side for pair in path for side in pair)).decode() for path in tree.paths(above)]
            folded = [continued(tree.version(i, leaf if changed is None else changed.hex().encode())[-1], above).decode()
                      for i, (leaf, changed) in enumerate(zip(nodes, row["changed"]))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["ids"], pa.int64()), "leaf": [x.decode() for x in nodes], "subroot": [row["subroot"].decode()] * len(nodes),
                "root": [root] * len(nodes), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def manifest(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    spark = docs.sparkSession
    lower = grown(placed(written(leaves(docs), "manifest-leaves"), ["doc_id", "digest"]), "manifest-blocks", depth)
    # the sources' subroots are the nodes of one more group, in the order of the sources
    subroots = lower.tops.select(F.lit("sources").alias("g"), F.col("g").alias("source"), "doc_id", "digest", "changed")
    order = written(placed(subroots, ["source"]), "manifest-sources")
    top = grown(order.drop("source"), "manifest-top", depth)
    last = top.tops.first()
    if last is None:
        return spark.createDataFrame([], RESULT)
    root = last["digest"].hex()
    start = spark.range(1).select(F.lit("sources").alias("g"), F.lit(0).cast("long").alias("pos"), F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    members = member_paths(_with_paths(top.rounds[0], descended(top, start, "manifest-source-paths", depth)), depth)
    of_source = members.select(F.col("pos").alias("_pos"), "path")
    sources = order.join(of_source, F.col("pos") == F.col("_pos")).select(F.col("source").alias("g"), F.lit(0).cast("long").alias("pos"), "path",
                                                                         F.encode(F.lower(F.hex("digest")), "utf-8").alias("subroot"))
    paths = descended(lower, written(sources, "manifest-source-roots"), "manifest-paths", depth)
    return _with_paths(lower.rounds[0], paths).mapInArrow(lambda batches: _documents(batches, root, depth), RESULT)
