"""SuperMinHash signatures of word shingle sets.

Each element walks through a random permutation of the signature's places, one place a round: in round
j it offers j plus a random fraction to the place it has come to, and each place keeps the least offer.
The ranks within an element are correlated, which lowers the variance against independent hashes, and
once every place of a set holds less than j the later rounds can't change it, so the set stops there.
A set of n elements takes about m log(m) / n rounds instead of m hashes an element.
"""

from __future__ import annotations

import hashlib

import numpy as np

from docugauge.llm import scan

#: Bits of an offer below the round, and of the draw that chooses a place.
_FRACTION, _DRAW = 40, 24


def shingle_sets(words: scan.Words, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles of k words as sorted hashes; with fewer words, but not none, the whole row is one."""
    hashes = words.hashes()
    windows, first = scan.window_hashes(hashes, k), words.first.tolist()
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        else:
            out.append(scan.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m places for each set; empty sets keep the highest value."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return out
    elements = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * m, sizes)  # where the set's row begins in flat
    drawn: list[np.ndarray] = []
    for j in range(m):
        x = scan.mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        place = (j + (((x & np.uint64((1 << _DRAW) - 1)) * np.uint64(m - j)) >> np.uint64(_DRAW)).astype(np.int64)).astype(np.int32)
        at = place.copy()
        for i in range(j - 1, -1, -1):  # what the earlier exchanges brought to that place
            at[at == drawn[i]] = i
        np.minimum.at(flat, base + at, (x >> np.uint64(64 - _FRACTION)) | np.uint64(j << _FRACTION))
        rows = np.unique(base) // m
        done = np.zeros(len(sets), dtype=bool)
        done[rows] = out[rows].max(axis=1) < np.uint64((j + 1) << _FRACTION)
        if j + 1 < m:
            keep = ~done[base // m]
            if not keep.any():
                break
            drawn.append(place)
            if not keep.all():
                elements, base, drawn = elements[keep], base[keep], [d[keep] for d in drawn]
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each row and band, as signed integers; bands never share a hash but by chance."""
    rows, m = signature.shape
    parts = scan.mix(signature).reshape(rows, bands, m // bands)
    total = np.zeros((rows, bands), dtype=np.uint64)
    for i in range(m // bands):
        total = scan.mix(total * np.uint64(0xD1342543DE82EF95) + parts[:, :, i])
    return scan.mix(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
