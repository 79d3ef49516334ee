"""Vectorised scans of text columns: words, word hashes and window hashes of Arrow batches.

Everything works on the UTF-8 bytes of a batch at once. Batches are cut into slices of whole
documents of a few MB, so that a worker's memory is bounded by the slice and the longest text.

A hash of a byte or word sequence x_0 .. x_n is the sum of T[x_i] * R**i modulo 2**64, with the
power of R taken out by its inverse, and then mixed. Hashes choose candidates; operators that need
certainty compare the words themselves or hashes that are independent of the first.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice.
SLICE = 4 << 20
_MASK = (1 << 64) - 1
_BASES = {"byte": 0x9E3779B97F4A7C15 | 5, "word": 0xD1342543DE82EF95, "word2": 0x2545F4914F6CDD1D}
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_KEPT = 8 << 20  # longer power tables are made anew


def _powers_of(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**0 .. R**(n-1), and the inverses."""
    got = _powers.get(name)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 20)
        got = []
        for base in (_BASES[name], pow(_BASES[name], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            got.append(np.multiply.accumulate(p))
        got = tuple(got)
        if n <= _KEPT:
            _powers[name] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _sums(values: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers_of(name, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    return total, inverse


def separator_table(separators: set[int]) -> np.ndarray:
    """True for bytes of words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs without white space: [^\x20\x09-\x0D]+
WHITE = separator_table({0x20, *range(0x09, 0x0E)})
#: Words are runs of 0-9, a-z and what is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = separator_table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte range."""
    total, inverse = _sums(_BYTE_CODES[data], "byte")
    return mix((total[end] - total[start]) * inverse[start])


class Slice:
    """Some whole texts: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int) -> None:
        self.data, self.ends, self.first, self.rows = data, ends, first, len(ends) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE, lower: bool = False) -> Iterator[Slice]:
    """Slices of a string or binary column; null is empty text. lower: A-Z in lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        to = min(to, n)
        part = data[ends[at] : ends[to]]
        yield Slice(_LOWER[part] if lower else part, ends[at : to + 1] - ends[at], at)
        at = to


class Words:
    """The words of a slice: byte ranges, and the first word of each row."""

    def __init__(self, of: Slice, table: np.ndarray) -> None:
        data, ends = of.data, of.ends
        self.of = of
        self.inside = inside = table[data]
        edge = inside.copy()
        if len(data):
            before = np.zeros(len(data), dtype=bool)
            before[1:] = inside[:-1]
            rows = ends[:-1][ends[:-1] < len(data)]
            before[rows] = False
            self.start = np.flatnonzero(inside & ~before)
            after = np.zeros(len(data), dtype=bool)
            after[:-1] = inside[1:]
            last = ends[1:][ends[1:] > 0] - 1
            after[last] = False
            self.end = np.flatnonzero(edge & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, ends)  # words of row i: first[i] .. first[i + 1]
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return hashes(self.of.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.of.rows), self.count)

    def bytes_of(self, a: int, b: int) -> bytes:
        """The words a .. b of one row, joined by one space."""
        data = self.of.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))

    def array(self) -> pa.Array:
        """The words as binary values."""
        sizes = self.end - self.start
        where = np.zeros(len(sizes) + 1, dtype=np.int32)
        np.cumsum(sizes, out=where[1:])
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(where), pa.py_buffer(self.of.data[self.inside])])

    def joined(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's kept words joined by one space: all bytes, and where each row begins and ends."""
        start, end, first = self.start, self.end, self.first
        data, keep = self.of.data.copy(), self.inside.copy()
        if kept is not None and not kept.all():
            keep[self.inside] = np.repeat(kept, end - start)
            index = np.flatnonzero(kept)
        else:
            index = np.arange(len(start))
        row = self.rows()[index]
        gap = end[index[:-1][row[:-1] == row[1:]]] if len(index) > 1 else np.zeros(0, dtype=np.int64)
        data[gap], keep[gap] = 0x20, True
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=total[1:])
        return data[keep], total[self.of.ends]


def window_hashes(words: np.ndarray, n: int, name: str = "word") -> np.ndarray:
    """The hash of words i .. i + n for each i, across rows too."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total, inverse = _sums(words, name)
    last = len(words) - n + 1
    return mix((total[n:] - total[:last]) * inverse[:last] + np.uint64(n))


def within_rows(first: np.ndarray, n: int) -> np.ndarray:
    """For each possible window start of window_hashes, whether the window is of one row."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(total - n + 1) + n <= end[: total - n + 1]


def covered(starts: np.ndarray, n: int | np.ndarray, total: int) -> np.ndarray:
    """Which of so many words are in a window that begins at one of the starts."""
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def tidy(run: Callable) -> Callable:
    """run, a map over batches, that gives back the memory it has freed when its task ends; workers go on to other tasks."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
