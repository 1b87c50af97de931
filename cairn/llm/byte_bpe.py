"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary's byte strings (hash and
displace: keys are dealt to buckets, and each bucket gets the displacement that
puts its keys on free places) answers for a whole pre-token with one key
comparison. Tier 2: pre-tokens that are not in the vocabulary are merged over a
doubly linked list of their bytes, the next merge taken from a heap by rank and
then place, which is the order the ranks prescribe.

Ids of recent pre-tokens are remembered by the Python worker in two generations
of bounded size. Decoding concatenates the ids' byte strings. One Arrow pass, no
shuffle; the tokenizer file is read once per worker from ``ranks_path``.

Defined cases: null text counts as empty and has no ids; special tokens are
ordinary text; repeated rows encode alike; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from cairn.llm.common import map_arrow, text_frame

#: Pre-tokens remembered in each of the two generations.
REMEMBERED = 500_000
_MASK = (1 << 64) - 1


def _spread(h: int, d: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK
    return x ^ (x >> 32)


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: ``n`` keys on ``n`` places."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        self.moves = [0] * self.buckets
        self.place: list[int] = [-1] * self.n
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != self.n:
            raise ValueError("two keys have one 64-bit hash")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        free = list(range(self.n))
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            if len(members[b]) == 1:  # a single key takes any free place: a negative move names it
                while self.place[free[-1]] >= 0:
                    free.pop()
                at = free.pop()
                self.moves[b], self.place[at] = -at - 1, members[b][0]
                continue
            d = 1
            while True:
                at = [_spread(hashes[i], d) % self.n for i in members[b]]
                if len(set(at)) == len(at) and all(self.place[p] < 0 for p in at):
                    break
                d += 1
            self.moves[b] = d
            for p, i in zip(at, members[b]):
                self.place[p] = i

    def slot(self, key: bytes) -> int:
        """The only index in the key list that ``key`` can have."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.buckets]
        return self.place[-d - 1 if d < 0 else _spread(h, d) % self.n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a byte string by merging neighbours in rank order, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # the symbol at i covers piece[i:end[i]]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], alive[j] = stop, False
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Known(dict):
    """Ids of recent pre-tokens: this dict and the generation before it."""

    def __init__(self, codec: "Codec"):
        self.codec = codec
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token) or self.codec.piece(token)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[token] = ids
        return ids


class Codec:
    """Encoder and decoder for one ranks file and pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.keys = list(self.ranks)
        self.ids = [self.ranks[k] for k in self.keys]
        self.table = PerfectHash(self.keys)
        self.bytes_of = dict(zip(self.ids, self.keys))
        self.text_of = {i: str(i) for i in self.ids}
        self.known = Known(self)

    def piece(self, token: str) -> tuple[int, ...]:
        """Ids of one pre-token: the perfect hash first, merging else."""
        raw = token.encode()
        at = self.table.slot(raw)
        return (self.ids[at],) if self.keys[at] == raw else tuple(merge(raw, self.ranks))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.text_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str | None = None, pattern: str | None = None) -> Codec:
    """The worker's codec; without arguments the public multilingual ranks."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path, pattern)
        ids = [np.array(c.encode(t.as_py()), np.int32) for t in batch.column(1)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return map_arrow(text_frame(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; bytes that are no UTF-8 become replacement characters."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path, pattern)
        texts = [c.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the listed ids and of the decoded bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path, pattern)
        n, listed, decoded = [], [], []
        for t in batch.column(1):
            ids = c.encode(t.as_py())
            n.append(len(ids))
            listed.append(hashlib.sha256(c.listed(ids).encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(listed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(text_frame(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
