"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Words are told apart
by 64-bit hashes: a polynomial over the bytes, then a finalizer. Null texts count as empty.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20  # texts handled at once; one longer text is a slice of its own
BASE = 0x9E3779B97F4A7C15
_SPACES = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    first: int            # row of the first text in the column
    data: np.ndarray      # lower-cased bytes of the texts
    text_at: np.ndarray   # byte offset of each text, and the end
    starts: np.ndarray    # byte offsets of the words
    ends: np.ndarray
    offsets: np.ndarray   # for each text the index of its first word, and the end
    sums: tuple | None = None

    def __len__(self) -> int:
        return len(self.text_at) - 1

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """One hash a word, of its first bytes only if a number is given."""
        ends = self.ends if first_bytes is None else np.minimum(self.ends, self.starts + first_bytes)
        if self.sums is None:
            self.sums = _sums(self.data)
        total, inverse = self.sums
        return mix((total[ends] - total[self.starts]) * inverse[self.starts] + (ends - self.starts).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and the offsets of each text's runs. A text with
        fewer words has its whole sequence as one run, a text without words has none."""
        h, n = self.hashes(), np.diff(self.offsets)
        runs = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
        offsets = np.concatenate(([0], np.cumsum(runs)))
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], runs) + np.repeat(self.offsets[:-1], runs)
        width = np.repeat(np.minimum(n, size), runs)
        out = np.zeros(len(at), np.uint64)
        short = bool((width < size).any())
        for k in range(size):
            step = mix(out * np.uint64(BASE) + h[np.minimum(at + k, len(h) - 1)] + np.uint64(k + 1)) if len(h) else out
            out = np.where(k < width, step, out) if short else step
        return out, offsets


def _sums(data: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte times power of the base, and the inverse powers."""
    n = len(data)
    power = np.ones(n + 1, np.uint64)
    power[1:] = base
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    power[0] = 1
    power[1:] = pow(base, -1, 1 << 64)
    np.cumprod(power, out=power)
    return total, power


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """One hash for each span of bytes."""
    total, inverse = _sums(data, base)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def words(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, between: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column, in slices of whole texts of about ``limit`` bytes.
    ``between`` (256 flags) names other bytes than white space that part words."""
    space = np.zeros(256, bool)
    space[list(_SPACES)] = True
    if between is not None:
        space = between
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data, offsets = raw(column)
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        inside = ~space[part]
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < len(part)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(i, lower[part], at, starts, ends, np.searchsorted(starts, at))
        i = j
