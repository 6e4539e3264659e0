"""Vectorised words, word hashes and word windows of an Arrow column of texts.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. These are
ASCII, so words can be found in UTF-8 bytes without decoding. All functions
treat a null text as an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the size of temporary arrays.
SEGMENT = 1 << 19

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])

_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True

_Q = 0xD6E8FEB86659FD93

#: Two families of constants, for two independent sums of 64 bits: seed of places, and two factors.
_FAMILIES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93 ^ 0x5851F42D4C957F2C | 1))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def is_separator(data: np.ndarray) -> np.ndarray:
    return _IS_SEPARATOR[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    if values is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a word never runs from one row into the next
    at = offsets[:-1][(offsets[:-1] < len(data))]
    first[at] = inside[at]
    before = offsets[1:][offsets[1:] > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """A sum over the 8-byte pieces of each span, each mixed with its place; ``data`` has 8 more bytes than the spans need."""
    seed, one, two = map(np.uint64, _FAMILIES[family])
    length = ends - starts
    many = (length + 7) >> 3
    single = int(many.max(initial=1)) <= 1
    # 8 bytes from every position on; what is beyond a span's end is masked
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    if single:
        v = eight[starts]
        v &= _MASKS[length]
        v ^= mix(np.array([seed]))[0]
    else:
        many = np.maximum(many, 1)
        first = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(first, many)
        v = eight[np.repeat(starts, many) + (place << 3)]
        v &= _MASKS[np.minimum(np.repeat(length, many) - (place << 3), 8)]
        v ^= mix(seed * (place.astype(np.uint64) + np.uint64(1)))
    v *= one
    v ^= v >> np.uint64(32)
    v *= two
    v ^= v >> np.uint64(29)
    h = v if single else np.add.reduceat(v, first)
    h += length.astype(np.uint64) * np.uint64(_Q)
    return mix(h)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each span (spans are in order); the two families are independent of each other."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        part = data[low : int(ends[j - 1])]
        part = np.concatenate([part, np.zeros(8, np.uint8)])
        out[i:j] = _sums(part, starts[i:j] - low, ends[i:j] - low, family)
        i = j
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span ``other`` of it."""
    length = ends - starts
    if not np.array_equal(length, length[other]):
        return False
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at, to, left = starts, starts[other], length
    while len(at):
        differ = eight[at] ^ eight[to]
        differ &= _MASKS[np.minimum(left, 8)]
        if differ.any():
            return False
        more = np.flatnonzero((left > 8) & (at != to))
        if len(more) < 32 and len(more):  # few long spans
            return all(np.array_equal(data[a : a + n], data[b : b + n]) for a, b, n in zip(at[more], to[more], left[more]))
        at, to, left = at[more] + 8, to[more] + 8, left[more] - 8
    return True


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words in a sequence of word hashes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)

    def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        # the shift makes it no polynomial, under which long regular sequences would collide
        out = left * np.uint64(pow(_Q, width, 1 << 64))
        out += right
        out ^= out >> np.uint64(31)
        return out

    made, covered, width, part = None, 0, 1, words
    while True:  # by powers of two: log2(size) passes over the words
        if size & width:
            if made is None:
                made, covered = part, width
            else:
                n = len(words) - covered - width + 1
                made = joined(made[:n], part[covered : covered + n], width)
                covered += width
        if covered == size:
            return mix(made[: len(words) - size + 1].copy())
        n = len(words) - 2 * width + 1
        part = joined(part[:n], part[width : width + n], width)
        width *= 2


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SEGMENT * 2):
    """Slices of a batch with about ``limit`` bytes of text each (a longer row stays whole)."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = column_bytes(texts)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of a column of texts, with row ``i`` at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, texts: pa.Array):
        self.data, self.byte_offsets = column_bytes(texts)
        self.starts, self.ends, self.offsets = word_spans(self.data, self.byte_offsets)
        self.counts = np.diff(self.offsets)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows inside rows, and the index of each one's first word."""
        h = window_hashes(self.hashes, size)
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(row[: len(h)] == row[size - 1 :]) if len(h) else np.zeros(0, np.int64)
        return h[at], at

    @functools.cached_property
    def others(self) -> np.ndarray:
        """64 more bits of each word, independent of its hash."""
        return span_hashes(self.data, self.starts, self.ends, 1)

    def checks(self, size: int, at: np.ndarray) -> np.ndarray:
        """64 more bits of the windows that start at the words ``at``, independent of their hashes."""
        return window_hashes(self.others, size)[at]

    def text(self, row: int) -> bytes:
        return self.data[self.byte_offsets[row] : self.byte_offsets[row + 1]].tobytes()
