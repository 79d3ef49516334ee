"""Texts cut into parts that a byte-level tokenizer encodes apart, each different part encoded once.

The pattern of such a tokenizer never joins some neighbours, whatever surrounds them: Latin letters, digits
and marks of different kinds (apostrophes apart), a space that no white space follows and what is before
it, and a lone line feed and its neighbours. A part may still hold several matches of the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from docugauge.llm import scan

#: Bytes of parts, ids and places that a worker remembers, and bytes of a part that is worth remembering.
MOST_BYTES, LONGEST = 64 << 20, 64


def _classes() -> np.ndarray:
    """Of bytes: 1 letter (of ASCII here, of Latin-1 in _cuts), 2 digit, 3 ASCII mark but apostrophe, 4 space, 5 line feed, 6 first byte of a character that is surely not white space, 0 other."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[0x21:0x7F] = 3
    kind[0x30:0x3A] = 2
    kind[0x41:0x5B] = kind[0x61:0x7B] = 1
    kind[0x27], kind[0x20], kind[0x0A] = 0, 4, 5
    kind[0xC3:0xE1] = kind[0xE4:0xF5] = 6
    return kind


_KIND = _classes()


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.held, self.n = np.zeros(1 << 12, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(max(self.n // 2, len(more)) + len(more), dtype=self.held.dtype)))
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def cut(self, n: int) -> None:
        self.n = n
        if len(self.held) > 2 * n + (1 << 20):
            self.held = self.held[: n + (1 << 12)].copy()

    def __getitem__(self, at):
        return self.held[: self.n][at]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places begin .. begin + size, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat((begin - (ends - size)).astype(np.int32), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class Parts:
    """Parts that were encoded before, with their ids: found by hash in sorted arrays, compared byte by byte."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2  # the many, and those since they were sorted last
        self.text, self.begin, self.size = Grown(np.uint8), Grown(np.int32), Grown(np.int32)
        self.ids, self.first, self.count = Grown(self.kind), Grown(np.int32), Grown(np.int32)

    def __len__(self) -> int:
        return self.begin.n

    def held_bytes(self) -> int:
        """What the known parts take."""
        return self.text.n + self.ids.n * self.kind.itemsize + 28 * self.begin.n

    def forget(self, n: int) -> None:
        """All but the first n, which must not be among those that are found."""
        text, ids = (int(self.begin[n]), int(self.first[n])) if n < len(self) else (self.text.n, self.ids.n)
        for held, size in ((self.text, text), (self.ids, ids), *((x, n) for x in (self.begin, self.size, self.first, self.count))):
            held.cut(size)

    def find(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each part, -1 for new ones."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        for known, number in self.sorted:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = number[at[hit]]
        held = np.flatnonzero(out >= 0)
        same = self.size[out[held]] == size[held]
        out[held[~same]] = -1
        held = held[same]
        if len(held):
            differ = self.text[spread(self.begin[out[held]], size[held])] != data[spread(begin[held], size[held])]
            if differ.any():
                out[held[np.repeat(np.arange(len(held)), size[held])[differ]]] = -1
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray, found: bool = True) -> np.ndarray:
        """Their numbers. found: whether find() will know them."""
        number = np.arange(self.begin.n, self.begin.n + len(hashes), dtype=np.int32)
        self.begin.add(self.text.n + np.cumsum(size) - size)
        self.size.add(size)
        self.text.add(data[spread(begin, size)])
        self.first.add(self.ids.n + np.cumsum(count) - count)
        self.count.add(count)
        self.ids.add(ids)
        if not found:
            return number
        many, recent = self.sorted
        recent = self._merged(recent, (hashes, number))
        self.sorted = [self._merged(many, recent), (recent[0][:0], recent[1][:0])] if 4 * len(recent[0]) > len(many[0]) else [many, recent]
        return number

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        h, number = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(h, kind="stable")
        return h[order], number[order]


class PartEncoder:
    """Encodes slices of texts; ``encode_new`` gives the ids of each of some parts that are new.

    ``whole``: strings that the tokenizer takes out of a text before anything else; they are parts of their own.
    Parts beyond LONGEST bytes are hardly met again and are forgotten with their slice; all are beyond ``most`` bytes.
    """

    def __init__(self, kind: str, encode_new: Callable[[list[str]], list[list[int]]], most: int = MOST_BYTES, whole: list[str] = ()) -> None:
        self.kind, self.encode_new, self.most = np.dtype(kind), encode_new, most
        self.whole = re.compile(b"|".join(re.escape(w.encode()) for w in sorted(whole, key=len, reverse=True))) if whole else None
        self.parts = Parts(self.kind)

    def encode(self, part: scan.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin and end."""
        if not len(part.data):
            return np.zeros(0, self.kind), np.zeros(part.rows + 1, dtype=np.int64)
        cut = self._cuts(part.data, part.ends)
        cut[part.ends[:-1][part.ends[:-1] < len(part.data)]] = True
        begin = np.flatnonzero(cut)
        where = np.append(begin, len(part.data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(where), pa.py_buffer(part.data)]).dictionary_encode()
        number = self._numbers(coded.dictionary)
        unit = number[coded.indices.to_numpy()]
        size = self.parts.count[unit]
        out = self.parts.ids[spread(self.parts.first[unit], size)]
        self.parts.forget(self.lasting)
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        return out, ends[np.searchsorted(begin, part.ends)]

    def _apart(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """Where the strings that are parts of their own begin and end, text by text."""
        if self.whole is None or self.whole.search(data) is None:
            return []
        return [m.span() for a, b in zip(ends.tolist(), ends[1:].tolist()) for m in self.whole.finditer(data, a, b)]

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = np.zeros(len(data) + 2, dtype=np.uint8)
        kind[1:-1] = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # the letters of Latin-1, but not its two signs
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead + 1] = kind[lead + 2] = 1
        apart = self._apart(data, ends)
        for a, b in apart:
            kind[a + 1 : b + 1] = 0  # what is known of neighbours ends here as it does at a text's end
        before, here, after = kind[:-2], kind[1:-1], kind[2:]
        solid = (after == 1) | (after == 2) | (after == 3) | (after == 6)
        solid[:-1] |= data[1:] == 0x27
        known = (here >= 1) & (here <= 3)
        cut = known & (before >= 1) & (before <= 3) & (before != here)
        cut |= (here == 4) & solid
        line = (here == 5) & solid & (((before >= 1) & (before <= 3)))
        cut |= line
        cut[1:] |= line[:-1]
        for a, b in apart:
            cut[a + 1 : b] = False
            cut[[a, *([b] if b < len(cut) else [])]] = True
        return cut

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The number among the known parts of each unit; new ones are encoded first."""
        if self.parts.held_bytes() > self.most:
            self.parts.clear()
        _, where, held = units.buffers()
        where = np.frombuffer(where, dtype=np.int32)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(held, dtype=np.uint8)
        begin, size = where[:-1], np.diff(where)
        hashes = scan.hashes(data, begin, where[1:])
        number = self.parts.find(hashes, data, begin, size)
        new = number < 0
        short = size <= LONGEST
        for lasts in (True, False):  # those to be forgotten come last
            some_new = np.flatnonzero(new & (short == lasts))
            for at in range(0, len(some_new), 1 << 12):
                some = some_new[at : at + (1 << 12)]
                found = self.encode_new([u.decode() for u in units.take(pa.array(some)).to_pylist()])
                count = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
                ids = np.fromiter(chain.from_iterable(found), dtype=self.kind, count=int(count.sum()))
                number[some] = self.parts.add(hashes[some], data, begin[some], size[some], ids, count, lasts)
            if lasts:
                self.lasting = len(self.parts)
        return number
