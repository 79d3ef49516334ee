"""Subword lattices: the probability of a word, summed over all its segmentations into vocabulary pieces.

A word is its characters after a word mark. Arcs are pieces of the vocabulary; a character without a
piece of its own is an arc of byte pieces. The forward recursion runs in log space over all words of
the same length at once; long words run alone. Pieces that only begin words and pieces that never do
share one distribution with the end piece, so the words of a text and its end sum to one.

Scores that are logarithms of probabilities are used as they are. The scores of a merge vocabulary are
ranks (0, -1, -2, ...); such a piece weighs 1 / (SHIFT + rank), as word frequencies fall with rank.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from docugauge.llm import scan

MARK = "▁"
#: Added to ranks; words of more characters run alone; scores below are of pieces that no segmentation uses.
SHIFT, LONG, NEVER = 3.0, 48, -1e8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


class Pieces:
    """A vocabulary with log weights, found by hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > NEVER]
        names, scores = [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids])
        if np.all(scores == np.round(scores)):
            scores = -np.log(SHIFT - scores)
        self.set_weights(names, scores, scores.min(), scores.max())

    def set_weights(self, names: list[str], scores: np.ndarray, byte: float, end: float) -> None:
        total = np.logaddexp.reduce(np.concatenate((scores, [end], np.full(256, byte))))
        self.names, self.scores, self.byte, self.end = names, scores - total, byte - total, end - total
        self.by_name = dict(zip(names, self.scores.tolist()))
        self.longest = max(map(len, names))
        hashes = np.array([self._hash(n) for n in names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.at = hashes[order], order
        self.sorted_scores = self.scores[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(name: str) -> int:
        codes = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)[None, :].astype(np.uint64)
        return int(_substrings(*_prefix(codes), 0, codes.shape[1])[0])

    def arcs(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Of words of one length (a row of characters each): for each begin and end that any has a piece for, the log weights, -inf for none."""
        length, out = codes.shape[1], {}
        prefix, power = _prefix(codes)
        for i in range(length):
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = _substrings(prefix, power, i, j)
                maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                weights = None
                if len(maybe):
                    at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                    found = self.hashes[at] == h[maybe]
                    if found.any():
                        weights = np.full(len(codes), -np.inf)
                        weights[maybe[found]] = self.sorted_scores[at[found]]
                if j == i + 1:
                    weights = np.full(len(codes), -np.inf) if weights is None else weights
                    none = np.isneginf(weights)
                    c = codes[none, i]
                    weights[none] = self.byte * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
                if weights is not None:
                    out[i, j] = weights
        return out

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each word of one length."""
        arcs, length = self.arcs(codes), codes.shape[1]
        alpha = [np.zeros(len(codes))]
        for j in range(1, length + 1):
            total = None
            for i in range(max(0, j - self.longest), j):
                if (w := arcs.get((i, j))) is not None:
                    total = alpha[i] + w if total is None else np.logaddexp(total, alpha[i] + w)
            alpha.append(total)
        return alpha[length]

    def alone(self, word: str) -> float:
        """The same for one word of any length."""
        text, alpha = MARK + word, [0.0]
        for j in range(1, len(text) + 1):
            terms = [alpha[i] + s for i in range(max(0, j - self.longest), j) if (s := self.by_name.get(text[i:j])) is not None]
            if text[j - 1] not in self.by_name:
                terms.append(alpha[j - 1] + self.byte * len(text[j - 1].encode("utf-8", "surrogatepass")))
            high = max(terms)
            alpha.append(high + math.log(sum(math.exp(t - high) for t in terms)))
        return alpha[-1]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word (UTF-8, no white space)."""
        out = np.zeros(len(words))
        if not words:
            return out
        codes = np.frombuffer((MARK + ("\n" + MARK).join([w.decode() for w in words]) + "\n").encode("utf-32-le"), dtype=np.uint32)
        ends = np.flatnonzero(codes == 10)
        begin = np.concatenate(([0], ends[:-1] + 1))
        size = ends - begin
        for length in np.unique(size).tolist():
            some = np.flatnonzero(size == length)
            if length > LONG:
                out[some] = [self.alone(words[i].decode()) for i in some.tolist()]
                continue
            for at in range(0, len(some), 1 << 14):
                part = some[at : at + (1 << 14)]
                out[part] = self.forward(codes[begin[part][:, None] + np.arange(length)[None, :]].astype(np.uint64))
        return out


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes by place, then row; and powers of the base."""
    prefix = np.zeros((codes.shape[1] + 1, len(codes)), dtype=np.uint64)
    for i in range(codes.shape[1]):
        prefix[i + 1] = prefix[i] * _BASE + codes[:, i] + np.uint64(1)
    power = np.full(codes.shape[1] + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    return prefix, np.multiply.accumulate(power)


def _substrings(prefix: np.ndarray, power: np.ndarray, i: int, j: int) -> np.ndarray:
    return scan.mix(prefix[j] - prefix[i] * power[j - i])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
