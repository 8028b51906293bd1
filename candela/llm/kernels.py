"""Vectorised text kernels used inside Arrow tasks.

Texts are processed as UTF-8 byte buffers, about half a megabyte of whole documents at
a time, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
CHUNK_BYTES = 1 << 19
_SPREAD, _ODD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: The low bytes of a little-endian number that belong to a word of so many bytes.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: The half of a hash by which anchors are chosen.
_UPPER = U(0xFFFFFFFF00000000)
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 64

#: space and \t \n \v \f \r
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def join(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash of two: multiplied, rotated, added and mixed, so that no algebra of sums is left
    in which structured strings could cancel out."""
    y = h * _SPREAD
    y = (y << U(27)) | (y >> U(37))
    y += x
    return mix(y)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).copy()


class SliceHash:
    """64-bit fingerprints of slices of a sequence, by chained mixing of its windows.

    codes[i] stands for the `unit` elements from i on: the numbers of elements themselves, or
    eight bytes at a time."""

    def __init__(self, codes: np.ndarray, unit: int = 1, step: int = 4):
        self._levels, self._unit, self.step, self._n = {unit: codes}, unit, step, len(codes)

    @classmethod
    def of_bytes(cls, data: np.ndarray, key: int) -> "SliceHash":
        """Eight bytes at a time, mixed with a key: without it, nobody can write bytes whose
        fingerprints meet."""
        codes = eights(data)[: max(0, len(data) - 7)]
        codes ^= U(key)
        codes *= mix(np.array([key], np.uint64))[0] | U(1)
        codes ^= codes >> U(32)
        return cls(codes, 8, 16)

    def fixed(self, k: int) -> np.ndarray:
        """Fingerprint of every slice of length k; k is at least the unit."""
        if k in self._levels:
            return self._levels[k]
        half = self._unit
        while half * 2 < k:
            half *= 2
        low = self.fixed(half)  # two windows of a power of two that overlap, if they must
        n = max(0, len(low) - (k - half))
        self._levels[k] = join(low[:n] + U(k), low[k - half : k - half + n])
        return self._levels[k]

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Fingerprints of any slices, from their windows of `step` elements."""
        size = end - start
        out = mix((size.astype(np.uint64) + U(seed)) * _ODD)
        step = self.step
        window = self.fixed(step)
        at = start.astype(np.int64)
        todo = np.flatnonzero(size >= step)
        offset = 0
        while len(todo):
            last = np.minimum(at[todo] + offset, end[todo] - step)
            out[todo] = join(out[todo], window[last])
            offset += step
            todo = todo[at[todo] + offset < end[todo]]
        short = np.flatnonzero((size < step) & (size > 0))
        if len(short):
            out[short] = self._short(start[short], end[short], out[short])
        return out

    def _short(self, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> np.ndarray:
        unit = self._levels[self._unit]
        if self._unit > 1:
            raise ValueError(f"slices of bytes have at least {self.step}")
        for i in range(self.step - 1):
            todo = np.flatnonzero(start + i < end)
            out[todo] = join(out[todo], unit[start[todo] + i])
        return out


def new_key() -> int:
    """A key for one run. Fingerprints that decide what is equal are made with one, which no
    writer of texts knows; all tasks of the run share it, also when they run again."""
    return secrets.randbits(63) | 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; long words by xxhash. Without a key it is
    the same in every run, for features and sketches."""
    size = end - start
    eight = eights(data)
    first = eight[start] & _LOW[np.minimum(size, 8)]
    if key:
        out = join(mix(first ^ U(key)), size.astype(np.uint64) * _ODD)
    else:
        out = mix((first ^ U(0x5851F42D4C957F2D)) + size.astype(np.uint64) * _ODD)
    todo, offset = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(todo):
        left = np.minimum(size[todo] - offset, 8)
        out[todo] = join(out[todo], eight[start[todo] + offset] & _LOW[left])
        offset += 8
        todo = todo[size[todo] > offset]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), 0x27D4EB2F ^ key)
    return out


def whole(column: pa.Array) -> pa.Array:
    """The string column with nulls as empty texts, as one plain array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole documents of about limit bytes."""
    column = whole(column)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a chunk: byte starts and ends, and per document offsets into them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        sep = SEPARATOR[data]
        n = len(data)
        before = np.ones(n, bool)
        before[1:] = sep[:-1]
        after = np.ones(n, bool)
        after[:-1] = sep[1:]
        first = off[:-1][off[:-1] < off[1:]]
        last = off[1:][off[:-1] < off[1:]] - 1
        before[first] = True
        after[last] = True
        word = ~sep
        self.data, self.byte_off = data, off
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)

    def hashes(self, key: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, key)

    def doc_end(self) -> np.ndarray:
        """For each word, where its document's words end."""
        return np.repeat(self.off[1:], self.count)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and their starts and ends there."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        out = np.full(int(size.sum() + len(size)), 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[end] = False
        out[inside] = self.data[~SEPARATOR[self.data]]
        return out.tobytes(), end - size, end


def _leftmost_least(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the first least value of each x[i : i + w], by the upper halves of the values.

    A position fills the lower half, so that one minimum carries both."""
    at = np.arange(len(x), dtype=np.uint64)
    best, size = (x & _UPPER) | at, 1
    while size < w:
        step = min(size, w - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    return (best & ~_UPPER).view(np.int64)


def cells(grams: np.ndarray, end: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows that share an anchor.

    A window is w + k - 1 consecutive units of one document; its anchor is the first
    least of its w grams, so equal windows have their anchor at the same place in them.
    grams[i] covers units i to i + k; end[i] is where i's document ends."""
    n, span = len(grams), w + k - 1
    if n < span:
        return (np.zeros(0, np.int64),) * 3
    at = _leftmost_least(grams, w)[: n - span + 1]
    window = np.flatnonzero(np.arange(len(at)) + span <= end[: len(at)])
    at = at[window]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    return at[new], window[new], window[np.concatenate([new[1:], [len(at)]]) - 1]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(start: np.ndarray, count: np.ndarray, length: int, n: int) -> np.ndarray:
    """Units of n that lie in some window of the runs: count windows of the given length
    from each start. Runs that do not fit are left out."""
    fits = (start >= 0) & (start + count - 1 + length <= n)
    start, count = start[fits], count[fits]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + count - 1 + length, -1)
    return np.cumsum(mark)[:n] > 0
