"""NumPy views of Arrow text batches shared by the corpus operators.

A batch of texts is handled as one UTF-8 byte array plus document offsets
(the Arrow layout itself, so no Python string is made). ``PolyHash`` gives the
hash of any byte span in O(1) from prefix sums; ``split_words`` finds the words
``[^\\x20\\x09-\\x0D]+`` of all texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 64)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class PolyHash:
    """Hashes of byte spans of one buffer; equal bytes give equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes at every position that has ``n`` bytes."""
        if len(self.prefix) <= n:
            return np.zeros(0, dtype=U64)
        return mix64((self.prefix[n:] - self.prefix[:-n]) * self.down[: len(self.prefix) - n])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together (a longer document alone)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the word range of each document.

    Returns ``(starts, ends, first)``: document ``i`` has the words
    ``first[i] .. first[i + 1] - 1``.
    """
    n = len(data)
    solid = np.ones(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    rise = solid[1:] & ~solid[:-1]  # position i starts a word
    fall = solid[:-1] & ~solid[1:]  # a word ends before position i
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = inner[solid[inner] & solid[inner + 1]]  # a word may not run over a document's end
    rise[joined] = True
    fall[joined] = True
    starts, ends = np.flatnonzero(rise[: n + 1]), np.flatnonzero(fall)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(ph: PolyHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ph.spans(starts, ends)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (block prefix and suffix minima)."""
    return _window(values, width, np.minimum, np.iinfo(np.uint64).max)


def window_max(values: np.ndarray, width: int) -> np.ndarray:
    return _window(values, width, np.maximum, 0)


def _window(values: np.ndarray, width: int, what: np.ufunc, neutral: int) -> np.ndarray:
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    grid = np.full(rows * width, neutral, dtype=U64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    head = what.accumulate(grid, axis=1).ravel()
    tail = what.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return what(tail[: n - width + 1], head[width - 1 : n])


class Texts:
    """One chunk of texts with the pieces that the gram features need, made when asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.ph = PolyHash(data)
        self._chars: tuple[np.ndarray, np.ndarray] | None = None
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of every code point (and the end of the data), and the first code point of each text."""
        if self._chars is None:
            starts = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
            self._chars = starts, np.searchsorted(starts, self.offsets)
        return self._chars

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = split_words(self.data, self.offsets)
        return self._words

    def char_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` code points, and the range of each text in them."""
        starts, first = self.chars
        if len(starts) <= n:
            return np.zeros(0, U64), np.zeros(self.n + 1, np.int64)
        h = self.ph.spans(starts[:-n], starts[n:])
        return _without_crossing(h, first, n)

    def word_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words (white space between them does not count), and each text's range."""
        starts, ends, first = self.words
        w = self.ph.spans(starts, ends)
        if len(w) < n:
            return np.zeros(0, U64), np.zeros(self.n + 1, np.int64)
        h = w[: len(w) - n + 1]
        for k in range(1, n):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        return _without_crossing(h, first, n)


def _without_crossing(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Drops the runs that reach into the next text."""
    if n == 1:
        return h, np.minimum(first, len(h))
    keep = np.ones(len(h), dtype=bool)
    for k in range(1, n):
        at = first[1:] - k
        at = at[(at >= 0) & (at < len(h))]
        keep[at] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], kept[np.minimum(first, len(h))]


def texts_of(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Chunks ``(from, to, Texts)`` of a text column."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets, most):
        yield a, b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def range_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range (also of several columns)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
