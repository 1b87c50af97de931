"""Removal of byte passages that occur twice: a sparse suffix array ordered by deep-shallow sorting.

A byte goes if a string of ``span`` bytes (``SPAN`` = 400 unless asked otherwise)
that covers it also starts anywhere else (another document, or another place of
the same one). Matches never cross documents and are judged on the input.

*Which suffixes are sorted.* Of the gram hashes (two fifths of the span) inside
every window of ``span`` bytes the smallest one is an **anchor**. Two equal windows have
the same anchors at the same places, so every repeated window shows as two
anchors with the same gram: only suffixes (and reversed prefixes) at anchors
are compared, about one in 120 bytes at a span of 400, and only where the gram occurs twice.

1. One Arrow pass emits an anchor's gram hash and the hash of its context (all
   bytes a window over the anchor can reach). A pre-aggregated count by gram
   drops anchors that stand alone. Grams whose contexts are all equal (copies)
   are covered whole, without any sort.
2. Grams with different contexts: one representative per distinct context
   (pre-aggregated, so a passage copied a million times is a few rows) brings
   its bytes. Within a gram the texts after it and the reversed texts before it
   are put in suffix order by multikey quicksort down to a shallow depth; what
   is still tied there is ordered by blind tries. The neighbours' common
   prefix lengths then give how far each context matches another one to the
   right and to the left; both together must reach ``span`` bytes.
3. A gram with more than ``HOT_CONTEXTS`` different contexts is not handled
   in one task: its windows are counted by a plain pre-aggregated ``groupBy``
   on the window hash, which deals them evenly. Both ways give the same spans.
4. Spans meet per text and are cut from it in an Arrow pass.

Defined cases: null text counts as empty; texts under ``span`` bytes lose
nothing by themselves; repeated rows count as other places, so exact copies
lose everything; columns other than the id and text play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.common import ROW, as_row, map_arrow, row_key, shuffle_partitions, text_frame, text_key, written

SPAN = 400


def gram_of(span: int) -> int:
    """Bytes of the grams whose hashes choose the anchors: two fifths of the span (160 of 400)."""
    return 2 * span // 5


#: A gram with more different contexts than this (about 70 MB of bytes) is counted by window hashes instead of in one task.
HOT_CONTEXTS = 100_000
#: Depth to which multikey quicksort orders before blind tries take over.
SHALLOW = 8
#: Groups up to this size look at the common prefixes of all their members.
FEW = 24


# ---- deep-shallow sorting ------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching places only: each node has the depth where its strings part.

    ``add`` descends by the branching bytes alone (blindly), compares with one
    string found there, and puts the new leaf where the two really part.
    """

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # inner node: [depth, {byte: child}]; leaf: (first, [equal strings])

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [-1, {-2: (k, [k])}]
            return
        node, path = self.root[1][-2], []
        while isinstance(node, list):
            path.append(node)
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(k)
            return
        above, key = self.root, -2
        node = above[1][key]
        while isinstance(node, list) and node[0] < depth:
            above, key = node, s[node[0]] if node[0] < len(s) else -1
            if key not in node[1]:
                break
            node = node[1][key]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node, list) and node[0] == depth:
            node[1][mine] = (k, [k])
        else:
            theirs = other[depth] if depth < len(other) else -1
            above[1][key] = [depth, {mine: (k, [k]), theirs: node}]

    def order(self) -> Iterator[tuple[int, int]]:
        """The strings in order, each with the length it shares with the one before (the first: -1)."""
        if self.root is None:
            return
        shared, stack = -1, [(self.root[1][-2], -1)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                children = sorted(node[1].items())
                stack += [(child, node[0]) for _, child in reversed(children[1:])]
                stack.append((children[0][1], before))
                continue
            shared = before
            for j, k in enumerate(node[1]):
                yield k, shared if j == 0 else len(self.strings[k])


def suffix_order(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with the one before (the first: -1).

    Three-way multikey quicksort on one byte after another; a group that is
    still together at depth ``shallow`` is ordered by a blind trie.
    """
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            order += part
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for k in part:
                trie.add(k)
            order += [k for k, _ in trie.order()]
        else:
            bytes_at = [strings[k][depth] if depth < len(strings[k]) else -1 for k in part]
            pivot = sorted(bytes_at[:: max(1, len(part) // 9)])[-1 // 2] if len(part) > 9 else bytes_at[0]
            less = [k for k, b in zip(part, bytes_at) if b < pivot]
            same = [k for k, b in zip(part, bytes_at) if b == pivot]
            more = [k for k, b in zip(part, bytes_at) if b > pivot]
            if more:
                stack.append((more, depth))
            if pivot == -1:
                order_same = same  # all end here: equal
                if less:  # cannot be: -1 is the smallest
                    stack.append((less, depth))
                order += order_same
                continue
            if same:
                stack.append((same, depth + 1))
            if less:
                stack.append((less, depth))
    lcp = [-1] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return order, lcp


# ---- reach of the contexts of one gram -----------------------------------------------------

def reaches(before: list[bytes], after: list[bytes], need: int) -> tuple[list[int], list[int]]:
    """For every context how far it is covered to the left and right of its gram (-1: not at all).

    ``before`` are the reversed bytes left of the gram, ``after`` those right
    of it. A context is covered by another one if they share ``left`` bytes
    before and ``right`` bytes after with ``left + right >= need``.
    """
    n = len(before)
    if n == 2:
        left, right = common_prefix(*before), common_prefix(*after)
        return ([left] * 2, [right] * 2) if left + right >= need else ([-1] * 2, [-1] * 2)
    order_l, lcp_l = suffix_order(before)
    order_r, lcp_r = suffix_order(after)
    if n <= FEW:
        return _reaches_few(n, order_l, lcp_l, order_r, lcp_r, need)
    # classes at every split of the window: rank intervals in both orders
    at_l, at_r = np.empty(n, np.int64), np.empty(n, np.int64)
    at_l[order_l], at_r[order_r] = np.arange(n), np.arange(n)
    low_l, low_r = np.array(lcp_l), np.array(lcp_r)
    left, right = np.full(n, -1), np.full(n, -1)
    for l in range(need + 1):
        r = need - l
        code = np.cumsum(low_l < l)[at_l] * (n + 1) + np.cumsum(low_r < r)[at_r]
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        left[hit] = l
        first = hit & (right < 0)
        right[first] = r
    return left.tolist(), right.tolist()


def _reaches_few(n: int, order_l: list[int], lcp_l: list[int], order_r: list[int], lcp_r: list[int], need: int) -> tuple[list[int], list[int]]:
    shared = {}
    for i in range(n):
        low, a = 1 << 30, order_l[i]
        for j in range(i + 1, n):
            low = min(low, lcp_l[j])
            if low < 0:
                break
            b = order_l[j]
            shared[(a, b) if a < b else (b, a)] = low
    left, right = [-1] * n, [-1] * n
    for i in range(n):
        low, a = 1 << 30, order_r[i]
        for j in range(i + 1, n):
            low = min(low, lcp_r[j])
            b = order_r[j]
            l = shared[(a, b) if a < b else (b, a)]
            if l + low >= need:
                for k in (a, b):
                    left[k], right[k] = max(left[k], l), max(right[k], low)
    return left, right


# ---- Spark jobs ----------------------------------------------------------------------------

ANCHORS = "k1 long, k2 long, rid long, pos int, hi int, kh long, ch long"


def _anchor_batch(batch: pa.RecordBatch, span: int) -> pa.RecordBatch | None:
    data, offsets = tv.utf8(batch.column("text"))
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "rid")]
    out = []
    gram = gram_of(span)
    back = span - gram
    for a, b in tv.chunks(offsets):
        o = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        if np.diff(o).max(initial=0) < span:
            continue
        ph = tv.PolyHash(part)
        grams = ph.grams(gram) | tv.U64(1)
        doc_of_start = np.repeat(np.arange(b - a), np.diff(o))
        ends = o[1:][doc_of_start]
        lows = tv.window_min(grams, back + 1)
        place = np.arange(len(lows))
        lows[place + span > ends[: len(lows)]] = 0  # windows over a document's end
        top = np.zeros(len(grams) + back, dtype=tv.U64)
        top[back : back + len(lows)] = lows
        is_anchor = (tv.window_max(top, back + 1) == grams)
        at = np.flatnonzero(is_anchor)
        at = at[at + gram <= ends[at]]
        if not len(at):
            continue
        doc = doc_of_start[at]
        lo, hi = np.maximum(at - back, o[doc]), np.minimum(at + span, ends[at])
        context = tv.mix64(ph.spans(lo, hi) + (at - lo).astype(tv.U64) * tv.U64(0x2545F4914F6CDD1D))
        out.append([*[k[a:b][doc] for k in keys], (at - o[doc]).astype(np.int32), (hi - o[doc]).astype(np.int32), grams[at].view(np.int64), context.view(np.int64)])
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["k1", "k2", "rid", "pos", "hi", "kh", "ch"])


CONTEXTS = "kh long, ch long, before binary, after binary"


def _context_batch(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """The bytes around the asked anchors of each text: reversed before the gram, plain after it."""
    texts = batch.column("text")
    kh, ch, before, after = [], [], [], []
    gram = gram_of(span)
    back = span - gram
    for i, asked in enumerate(batch.column("asked").to_pylist()):
        raw = texts[i].as_py().encode()
        for x in asked:
            p = x["pos"]
            kh.append(x["kh"])
            ch.append(x["ch"])
            before.append(raw[max(0, p - back) : p][::-1])
            after.append(raw[p + gram : p + span])
    return pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(ch, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["kh", "ch", "before", "after"])


REACH = "kh long, ch long, l int, r int"


def _solve(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Reach of every context; the rows come sorted by gram, so groups follow one another."""
    now: int | None = None
    group: dict[int, tuple[bytes, bytes]] = {}
    out: list[tuple[int, int, int, int]] = []

    def close() -> None:
        if now is not None and len(group) > 1:
            left, right = reaches([x[0] for x in group.values()], [x[1] for x in group.values()], span - gram_of(span))
            out.extend((now, c, l, r) for c, l, r in zip(group, left, right) if l >= 0)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[], [], [], []]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["kh", "ch", "l", "r"])
        out.clear()
        return made

    for batch in batches:
        for k, c, b, a in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if k != now:
                close()
                now, group = k, {}
            group[c] = (b, a)
        if len(out) > 20_000:
            yield flush()
    close()
    yield flush()


def _window_batch(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """All windows of the contexts of hot grams, by their split and hash."""
    kh, ch, ls, hs = [], [], [], []
    need = span - gram_of(span)
    for k, c, b, a in zip(*(batch.column(i).to_pylist() for i in range(4))):
        raw = b[::-1] + a
        ph = tv.PolyHash(np.frombuffer(raw, np.uint8))
        l = np.arange(max(0, need - len(a)), min(len(b), need) + 1)
        if len(l):
            kh.append(np.full(len(l), k))
            ch.append(np.full(len(l), c))
            ls.append(l)
            hs.append(ph.spans(len(b) - l, len(b) - l + need).view(np.int64))
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(kh, pa.int64()), cat(ch, pa.int64()), cat([x.astype(np.int32) for x in ls], pa.int32()), cat(hs, pa.int64())], names=["kh", "ch", "l", "wh"])


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal runs that the spans cover, and the remaining bytes."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    keep, at = [], 0
    for lo, hi in runs:
        keep.append(raw[at:lo])
        at = hi
    keep.append(raw[at:])
    return [(lo, hi) for lo, hi in runs], b"".join(keep)


REMOVED = "k1 long, k2 long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<lo:int,hi:int>>"


def _cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], [], [], [], []]
    texts = batch.column("text")
    for i, (k1, k2, hits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "hits")))):
        raw = texts[i].as_py().encode()
        runs, kept = _cut(raw, [(h["lo"], h["hi"]) for h in hits])
        for col, v in zip(cols, (k1, k2, len(raw) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in runs])):
            col.append(v)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, span: int = SPAN) -> DataFrame:
    """Covered spans ``(k1, k2, rid, lo, hi)`` in bytes, for every text with a repeated passage of ``span`` bytes."""
    gram = gram_of(span)
    keyed = text_frame(docs).select(*text_key(), row_key(), "text")
    long_texts = keyed.where(F.octet_length("text") >= span)
    anchors = written(map_arrow(long_texts, partial(_anchor_batch, span=span), ANCHORS), "anchors")
    heads = written(
        anchors.groupBy("kh").agg(F.count(F.lit(1)).alias("n"), F.min("ch").alias("c0"), F.max("ch").alias("c1")).where("n > 1")
        .select("kh", (F.col("c0") != F.col("c1")).alias("mixed")), "grams")
    shared = written(anchors.join(heads, "kh"), "shared")  # anchors whose gram occurs twice
    mixed = shared.where("mixed")
    contexts = written(
        mixed.groupBy("kh", "ch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "rid", "pos")).alias("at")), "contexts")
    hot = contexts.groupBy("kh").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > hot_contexts).select("kh", F.lit(True).alias("hot"))
    asked = (contexts.select("kh", "ch", "at.*").groupBy("k1", "k2", "rid")
             .agg(F.collect_list(F.struct("kh", "ch", "pos")).alias("asked")))
    around = map_arrow(long_texts.join(asked, ["k1", "k2", "rid"]).select("text", "asked"), partial(_context_batch, span=span), CONTEXTS)
    around = written(around.join(hot, "kh", "left"), "around")
    parts = max(1, shuffle_partitions(docs))
    cool = around.where("hot is null").select("kh", "ch", "before", "after")
    solved = cool.repartition(parts, "kh").sortWithinPartitions("kh").mapInArrow(lambda batches: _solve(batches, span), REACH)
    windows = map_arrow(around.where("hot").select("kh", "ch", "before", "after").dropDuplicates(["kh", "ch"]), partial(_window_batch, span=span), "kh long, ch long, l int, wh long")
    again = windows.groupBy("kh", "l", "wh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh", "l", "wh")
    crowded = (windows.join(again, ["kh", "l", "wh"]).groupBy("kh", "ch")
               .agg(F.max("l").alias("l"), (F.lit(span - gram) - F.min("l")).cast("int").alias("r")))
    reach = solved.unionByName(crowded)
    copies = contexts.where("n > 1").select("kh", "ch", F.lit(span).alias("l"), F.lit(span).alias("r"))
    reach = written(copies.unionByName(reach).groupBy("kh", "ch").agg(F.max("l").cast("int").alias("l"), F.max("r").cast("int").alias("r")), "reach")
    partly = mixed.join(reach, ["kh", "ch"])
    whole = shared.where("not mixed").withColumns({"l": F.lit(span), "r": F.lit(span)})
    back = span - gram
    return whole.unionByName(partly).select(
        "k1", "k2", "rid",
        F.greatest(F.lit(0), F.col("pos") - F.least(F.col("l"), F.lit(back))).cast("int").alias("lo"),
        F.least(F.col("hi"), F.col("pos") + gram + F.col("r")).cast("int").alias("hi"))


def _removed(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, span: int = SPAN) -> DataFrame:
    """One row per text (not per document) that loses bytes, with what remains."""
    keyed = text_frame(docs).select(*text_key(), row_key(), "text")
    hits = (repeated_spans(docs, hot_contexts, span).groupBy("k1", "k2")
            .agg(F.min("rid").alias("rid"), F.collect_set(F.struct("lo", "hi")).alias("hits")))
    cut = map_arrow(keyed.join(hits, ["k1", "k2", "rid"]).select("k1", "k2", "text", "hits"), _cut_batch, REMOVED)
    return written(cut.dropDuplicates(["k1", "k2"]), "removed")


def digest(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Per document: bytes, removed bytes and runs, SHA-256 of what is left."""
    removed = _removed(docs, hot_contexts).select("k1", "k2", "n_removed", "n_spans", "kept_sha256")
    base = text_frame(docs).select("doc_id", *text_key(), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return base.join(removed, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, span: int = SPAN) -> DataFrame:
    """The documents with repeated passages of at least ``span`` bytes cut out of ``text`` (``n_chars`` follows).

    A cut through a character drops the character's remaining bytes. All other
    columns and all rows stay; documents without repeats are untouched.
    """
    removed = _removed(docs, hot_contexts, span).select("k1", "k2", F.col("kept").alias("_kept"))
    whole = F.try_validate_utf8(F.col("_kept").cast("string"))
    new = F.coalesce(whole, F.regexp_replace(F.make_valid_utf8(F.col("_kept").cast("string")), "\ufffd", ""))
    rows = as_row(docs).select(ROW, *text_key(f"{ROW}.text")).join(removed, ["k1", "k2"], "left").withColumn("_new", new)

    def column(name: str) -> Column:
        own = F.col(f"{ROW}.`{name}`")
        if name == "text":
            return F.when(F.col("_kept").isNull(), own).otherwise(F.col("_new")).alias(name)
        if name == "n_chars":
            return F.when(F.col("_kept").isNull(), own).otherwise(F.length("_new").cast("long")).alias(name)
        return own.alias(name)

    return rows.select(*[column(c) for c in docs.columns])
