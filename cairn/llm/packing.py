"""Hierarchical multi-length packing of token sequences.

Every document becomes its token ids plus the end id. Whole ``WINDOW``-token
runs are sequences of their own; what is left of a document is routed to the
smallest context size (tier: 512, 1024, 2048, 4096) that holds it. Each tier
packs windows of its size: a piece opens a window, the gap is filled with the
largest shorter pieces that fit, and the last gap with a cut from a shorter
piece whose rest goes back to its own tier. All windows are therefore full and
their lengths powers of two; only the last few tokens of a partition end in
shorter powers of two. Nothing is padded.

Windows of one tier are dealt to step groups of about ``STEP_TOKENS`` tokens in
alternating order of their attention cost (sum of squared piece lengths), which
balances the groups.

The work is one Arrow pass without a shuffle: every partition packs its own
documents, ``POOL_TOKENS`` at a time, so memory is bounded; sequence ids carry
the partition number. Losing an executor repeats whole partitions.

Defined cases: null text counts as empty and is one end token; the ids are those
of the unmodified tokenizer, so the letters of a special token in a text
(``<|endoftext|>``) are that token; null ids and repeated rows are documents of their own; other columns play no part; an empty
table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm.common import bounded_batches, text_frame

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens packed at a time, and of a step group.
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
#: Words whose ids a Python worker keeps in each of two generations.
KNOWN_WORDS = 400_000

# Letters, digits and white space below U+0250, where lower-casing
# needs no composition; texts with other characters go through the tokenizer's own normaliser.
_LETTERS = "a-zªµºß-öø-ÿĀ-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_SPACE = r"\x09-\x0d \x85\xa0"
_PLAIN = re.compile("[^\x00-ɏ]")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


class WordIds(dict):
    """Little-endian 32-bit ids of a pre-token, asked from the tokenizer once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.old: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.single = Tokenizer.from_file(path)
        self.single.normalizer = normalizers.Sequence([])
        # a text that holds one of these is not a sequence of plain words
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.single.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        lower = text.lower()
        if _PLAIN.search(lower) or _PLAIN.search(text) or any(t in text for t in self.added):  # some capitals have their small letter above U+024F
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _WORD.findall(lower)))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "start", "ids", "tokens")

    def __init__(self, doc: int | None, start: int, ids: bytes, tokens: int):
        self.doc, self.start, self.ids, self.tokens = doc, start, ids, tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * length], self.tokens), Piece(self.doc, self.start + length, self.ids[4 * length :], self.tokens)


class Pool:
    """Pieces in order of length."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=len)
        self.lengths = [len(p) for p in self.pieces]

    def take(self, at: int) -> Piece:
        self.lengths.pop(at)
        return self.pieces.pop(at)

    def put(self, piece: Piece) -> None:
        at = bisect.bisect_left(self.lengths, len(piece))
        self.lengths.insert(at, len(piece))
        self.pieces.insert(at, piece)


def fill_windows(pieces: list[Piece]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows ``(tier, pieces)``, and the pieces that could not fill one yet."""
    pool, windows, left = Pool(pieces), [], []
    while pool.pieces:
        window = [pool.take(len(pool.pieces) - 1)]
        size = tier_of(len(window[0]))
        gap = size - len(window[0])
        while gap and pool.pieces:
            fits = bisect.bisect_right(pool.lengths, gap) - 1
            if fits >= 0:
                window.append(pool.take(fits))
            else:  # every piece is longer than the gap: the shortest one is cut
                part, rest = pool.take(0).cut(gap)
                window.append(part)
                pool.put(rest)
            gap -= len(window[-1])
        if gap:
            left += window
        else:
            windows.append((size, window))
    return windows, left


def last_windows(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """What a partition has left: full windows, then one of each power of two of the rest."""
    rest, queue, windows = sum(map(len, pieces)), list(reversed(pieces)), []
    while rest:
        size = min(WINDOW, 1 << (rest.bit_length() - 1))
        window, gap = [], size
        while gap:
            piece = queue.pop()
            if len(piece) > gap:
                piece, after = piece.cut(gap)
                queue.append(after)
            window.append(piece)
            gap -= len(piece)
        windows.append((size, window))
        rest -= size
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]]) -> list[int]:
    """A step group for each window: groups hold one tier, about STEP_TOKENS tokens and like costs."""
    group, used = [0] * len(windows), 0
    for size in sorted({s for s, _ in windows}):
        mine = [i for i, (s, _) in enumerate(windows) if s == size]
        mine.sort(key=lambda i: -sum(len(p) ** 2 for p in windows[i][1]))
        steps = max(1, -(-len(mine) * size // STEP_TOKENS))
        for k, i in enumerate(mine):  # there and back again
            turn, at = divmod(k, steps)
            group[i] = used + (at if turn % 2 == 0 else steps - 1 - at)
        used += steps
    return group


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        known, end = word_ids(path), END_ID.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        pending: list[Piece] = []
        whole: list[tuple[int, list[Piece]]] = []
        tokens = sequences = steps = 0

        def out(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal sequences, steps
            groups = step_groups(windows)
            rows: list[tuple] = []
            ids: list[bytes] = []
            for (size, window), g in zip(windows, groups):
                offset = 0
                for p in window:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.tokens, base + sequences, offset, size, base + steps + g))
                    ids.append(p.ids)
                    offset += len(p)
                sequences += 1
            steps += max(groups, default=-1) + 1
            cols = [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if with_ids:
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.encode(text.as_py()) + end
                n = len(ids) // 4
                at = 0
                while n - at >= WINDOW:
                    whole.append((WINDOW, [Piece(doc, at, ids[4 * at : 4 * (at + WINDOW)], n)]))
                    at += WINDOW
                if at < n:
                    pending.append(Piece(doc, at, ids[4 * at :], n))
                tokens += n
                if tokens >= POOL_TOKENS:
                    windows, pending = fill_windows(pending)
                    if windows or whole:
                        yield out(whole + windows)
                    whole, tokens = [], 0
        windows, pending = fill_windows(pending)
        if windows := whole + windows + last_windows(pending):
            yield out(windows)

    return bounded_batches(text_frame(docs)).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
