"""Vectorised scanning of words and hashing of words and word n-grams over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text handled at once; a longer single document is handled whole.
SLICE_BYTES = 2 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes than these are numbered one by one.
_LONG = 64
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def same_bytes(x: np.ndarray, i: np.ndarray, n: np.ndarray, y: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n bytes of x from i on are the m bytes of y from j on, for arrays of places in padded buffers."""
    out = n == m
    at, k = np.flatnonzero(out), 0
    while len(at) and k < _LONG:
        mask = _LOW_BYTES[np.minimum(n[at] - k, 8)]
        differs = ((_eights(x)[i[at] + k] ^ _eights(y)[j[at] + k]) & mask) != 0
        out[at[differs]] = False
        k += 8
        at = at[~differs & (n[at] > k)]
    for a in at.tolist():
        out[a] = bool((x[i[a] : i[a] + n[a]] == y[j[a] : j[a] + n[a]]).all())
    return out


def padded(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([buf, np.zeros(8, np.uint8)])


def _eights(pad: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a padded buffer on, as numbers."""
    return np.ndarray(max(len(pad) - 7, 0), dtype="<u8", buffer=pad.data, strides=(1,))


class Words:
    """Words of an array of texts: byte ranges start..end in buf; words of text i are at[i]:at[i+1]."""

    __slots__ = ("at", "base", "buf", "end", "start")

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "") if texts.type != pa.string() or texts.null_count else texts
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.buf, self.base = raw, off - off[0]
        inner = ~_IS_SPACE[raw]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[self.base[:-1]] = True  # a text's first byte never continues a word
        after = np.empty(len(raw) + 1, dtype=bool)
        after[:-1], after[-1] = inner, False
        before = np.empty(len(raw) + 1, dtype=bool)
        before[0], before[1:] = False, inner
        self.start = np.flatnonzero(after & (~before | first))
        last = np.zeros(len(raw) + 1, dtype=bool)
        last[self.base[1:]] = True
        self.end = np.flatnonzero(before & (~after | last))
        self.at = np.searchsorted(self.start, self.base)

    def __len__(self) -> int:
        return len(self.start)

    def lengths(self) -> np.ndarray:
        """Words by text."""
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def lower(self) -> Words:
        self.buf = _LOWER[self.buf]
        return self

    def hashes(self) -> np.ndarray:
        """A 64-bit number of each word; equal words have equal numbers.

        Each eight bytes are mixed in by a bijection, so that words of at most eight bytes and one
        length never share a number; longer ones do with a chance of about 2**-64 a pair. Words of
        more than _LONG bytes are numbered by xxh3.
        """
        n, pad = self.end - self.start, padded(self.buf)
        eight = _eights(pad)
        h = mix(eight[self.start] & _LOW_BYTES[np.minimum(n, 8)] ^ mix(n.astype(np.uint64)))
        more, k = np.flatnonzero((n > 8) & (n <= _LONG)), 8
        while len(more):
            h[more] = mix(h[more] ^ (eight[self.start[more] + k] & _LOW_BYTES[np.minimum(n[more] - k, 8)]))
            k += 8
            more = more[n[more] > k]
        for i in np.flatnonzero(n > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.text(i))
        return h

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def code_points(self) -> np.ndarray:
        """Code points in words, by text."""
        lead = ((self.buf & 0xC0) != 0x80) & ~_IS_SPACE[self.buf]
        total = np.concatenate([[0], np.cumsum(lead)])
        return total[self.base[1:]] - total[self.base[:-1]]


def text_of(batch: pa.RecordBatch, column: str = "_row") -> pa.Array:
    """The text in a column of whole rows."""
    return pc.struct_field(batch.column(column), [batch.schema.field(column).type.get_field_index("text")])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about limit bytes of text, one row at least; of whole rows their text counts."""
    if batch.num_rows == 0:
        return
    texts = text_of(batch, column) if pa.types.is_struct(batch.schema.field(column).type) else batch.column(column)
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = n[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(n, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def windows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all n-word windows within texts, in order, and their bounds by text."""
    lens = np.maximum(np.diff(at) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * _BASE % (1 << 64)
        total += h[k : k + len(total)] * np.uint64(factor)
    keep = window_starts(at, n)
    return mix(total[keep]), bounds


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each n-word window within texts."""
    lens = np.maximum(np.diff(at) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    return np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], lens)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in an n-word window that begins at one of starts."""
    change = np.zeros(size + n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + n, -1)
    return np.cumsum(change)[:size] > 0


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), but a text with 1..n-1 words has one window of all its words."""
    w, bounds = windows(h, at, n)
    size = np.diff(at)
    short = np.flatnonzero((size > 0) & (size < n))
    if not len(short):
        return w, bounds
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(n - 1):
        has = size[short] > k
        part = h[at[short[has]] + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        extra[has] += part
    extra = mix(extra + size[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    lens = np.diff(bounds)
    lens[short] = 1
    new = np.concatenate([[0], np.cumsum(lens)])
    out = np.empty(new[-1], dtype=np.uint64)
    is_short = np.zeros(len(size), dtype=bool)
    is_short[short] = True
    flag = np.repeat(is_short, lens)
    out[flag], out[~flag] = extra, w
    return out, new


def listed(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
