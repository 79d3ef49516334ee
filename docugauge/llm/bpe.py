"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

Greedy merging by rank has two properties that make it a left-to-right relation. The encoding of a
prefix that ends at a token boundary is a prefix of the encoding; and a token sequence is an encoding
if and only if each token, and each two neighbours, encode to themselves. So for every byte position
there is exactly one last token whose left neighbour allows it.

A state of the transducer holds the positions that a later token may still begin at: for each, the
node of the vocabulary trie that the bytes read since then lead to, and the tokens that are chosen up
to there but not all agreed on. Reading a byte moves every position one node down, drops those that
no token continues, finds the one token that ends here, and emits the tokens that all positions
agree on. A position lives no longer than the longest token, which bounds both the lookahead and what
is held back. States and transitions are made when a text first needs them, and are thrown away and
made anew when there are many; that changes time, never the ids.

Texts are cut by the public pattern and each match goes through the transducer on its own; a match
that is a token as a whole is that token. Null texts are empty, empty texts have no ids, texts of any
length and repeated rows are encoded whole, row by row; other columns pass through, and a new column
whose name is taken gets an underscore before it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docugauge.llm import scan
from docugauge.llm.frames import fresh
from docugauge.llm.parts import PartEncoder, spread

RANKS, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
#: Transitions that a worker holds before it begins anew.
MOST_TRANSITIONS = 300_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Feeds bytes, gets token ids. One for a vocabulary; encode() may be called any number of times."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_TRANSITIONS) -> None:
        self.ranks, self.most = ranks, most
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.down: dict[int, int] = {}  # node << 8 | byte to node
        self.ends, self.inner = array("i", [-1]), bytearray(1)  # a node's token; whether it goes on
        for token, i in ranks.items():
            node = 0
            for b in token:
                if (to := self.down.get(node << 8 | b)) is None:
                    to = self.down[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = to
            self.ends[node] = i
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # States are numbers; what one stands for is kept packed, as it is only read to make a transition.
        self.cores: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}  # state << 8 | byte to state << 24 | number of what is emitted
        self.outs: list[tuple] = [()]
        self.out_numbers: dict[tuple, int] = {(): 0}
        self._state(-1, [(0, ())])

    def _state(self, last: int, live: list[tuple[int, tuple]]) -> int:
        core = array("i", [last, *(x for node, chain in live for x in (node, len(chain), *chain))]).tobytes()
        if (number := self.numbers.get(core)) is None:
            number = self.numbers[core] = len(self.cores)
            self.cores.append(core)
        return number

    def _unpacked(self, state: int) -> tuple[int, list[tuple[int, tuple]]]:
        last, *flat = array("i", self.cores[state])
        live, i = [], 0
        while i < len(flat):
            n = flat[i + 1]
            live.append((flat[i], tuple(flat[i + 2 : i + 2 + n])))
            i += 2 + n
        return last, live

    def _allowed(self, before: int, token: int) -> bool:
        """Whether the token can follow: it and, after another, both together encode to themselves."""
        if before < 0:
            if (known := self.own.get(token)) is None:
                known = self.own[token] = merge(self.bytes_of[token], self.ranks) == [token]
            return known
        if not self._allowed(-1, token):
            return False
        key = before << 32 | token
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = merge(self.bytes_of[before] + self.bytes_of[token], self.ranks) == [before, token]
            if len(self.pairs) > 2 * self.most:
                self.pairs.clear()
        return known

    def _move(self, state: int, byte: int) -> int:
        """Makes the transition: the next state, and the number of what is emitted."""
        last, live = self._unpacked(state)
        there, here = [], None
        for node, chain in live:
            if (to := self.down.get(node << 8 | byte)) is None:
                continue
            token = self.ends[to]
            if here is None and token >= 0 and self._allowed(chain[-1] if chain else last, token):
                here = chain + (token,)
            if self.inner[to]:
                there.append((to, chain))
        if here is None:
            raise ValueError(f"the vocabulary lacks the byte {byte}")
        there.append((0, here))
        agreed, chains = 0, [chain for _, chain in there]
        shortest = min(map(len, chains))
        while agreed < shortest and all(c[agreed] == chains[0][agreed] for c in chains):
            agreed += 1
        out = here[:agreed]
        last = out[-1] if out else last
        to = self._state(last if shortest == agreed else -2, [(node, chain[agreed:]) for node, chain in there])
        if (number := self.out_numbers.get(out)) is None:
            number = self.out_numbers[out] = len(self.outs)
            self.outs.append(out)
        self.moves[state << 8 | byte] = step = to << 24 | number
        return step

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one match that comes in chunks, each as soon as it is certain. Only the state outlives a clearing, within a match too."""
        at, moves, outs = 0, self.moves, self.outs
        for chunk in chunks:
            for byte in chunk:
                step = moves.get(at << 8 | byte)
                if step is None:
                    if len(moves) > self.most:
                        here = self._unpacked(at)
                        self._clear()
                        at, moves, outs = self._state(*here), self.moves, self.outs
                    step = self._move(at, byte)
                at = step >> 24
                if emitted := step & 0xFFFFFF:
                    yield from outs[emitted]
        yield from self._unpacked(at)[1][-1][1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return list(self.stream([piece]))


class Utf8Machine:
    """Decodes bytes that come in pieces: holds back an unfinished character, replaces what can't become one."""

    #: Lead byte ranges: first, last, bytes that follow, and the range of the first of those.
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """Bytes at the end that begin a character which later bytes may finish."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                for first, final, more, low, high in cls.LEADS:
                    if first <= byte <= final and back <= more and (back == 1 or low <= data[-back + 1] <= high):
                        return back
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class _Table:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.fromiter(map(len, strings), dtype=np.int32, count=len(strings))
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        """The strings of all ids, and where each row begins and ends."""
        size = self.size[ids]
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        return memoryview(self.data[spread(self.begin[ids], size)]), total[ends].tolist()


class Codec:
    """Encodes texts to ids and back."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.bytes_table, self.decimal_table = _Table(self.tokens), _Table([b"%d " % i for i in range(len(self.tokens))])
        self.by_parts = PartEncoder("<u4", lambda new: [self._ids(t) for t in new]) if pattern == PATTERN else None

    def _ids(self, text: str) -> list[int]:
        encode = self.transducer.encode
        return [i for match in self.pattern.findall(text) for i in encode(match.encode())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._ids(text), dtype="<u4")

    def encode_slice(self, part: scan.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin and end."""
        if self.by_parts is not None:
            return self.by_parts.encode(part)
        ids = [self.encode(part.text(i).decode()) for i in range(part.rows)]
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))

    def decode(self, ids: Iterable[int], piece: int = 4096) -> Iterator[str]:
        """Texts that together are the decoded text, as the ids come."""
        machine, tokens, ids = Utf8Machine(), self.tokens, list(ids)
        for i in range(0, len(ids), piece):
            yield machine.feed(b"".join(map(tokens.__getitem__, ids[i : i + piece])))
        yield machine.close()

    def decode_slice(self, ids: np.ndarray, ends: np.ndarray, piece: int = 1 << 16) -> Iterator[Iterator[str]]:
        """For each row the pieces of its decoded text."""
        data, at = self.bytes_table.joined(ids, ends)
        for a, b in zip(at, at[1:]):
            yield _streamed(data[a:b], piece)


def _streamed(data: memoryview, piece: int) -> Iterator[str]:
    machine = Utf8Machine()
    for i in range(0, len(data), piece):
        yield machine.feed(bytes(data[i : i + piece]))
    yield machine.close()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each vocabulary and worker."""
    return Codec(path)


_IDS = T.ArrayType(T.IntegerType())


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encoded(docs: DataFrame, *, ranks: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array of int). ranks: the vocabulary's path on every machine."""
    return _mapped(docs, text, [T.StructField(ids, _IDS)], ranks, lambda c, part: [_id_lists(*c.encode_slice(part))])


def round_trips(docs: DataFrame, *, ranks: str | None = None, text: str = "text", names: tuple[str, str] = ("ids", "round_trip")) -> DataFrame:
    """docs with the ids, and whether they decode to the text."""

    def run(c: Codec, part: scan.Slice) -> list[pa.Array]:
        ids, ends = c.encode_slice(part)
        same = [b"".join(p.encode() for p in pieces) == part.text(i) for i, pieces in enumerate(c.decode_slice(ids, ends))]
        return [_id_lists(ids, ends), pa.array(same, pa.bool_())]

    return _mapped(docs, text, [T.StructField(names[0], _IDS), T.StructField(names[1], T.BooleanType())], ranks, run)


def digests(docs: DataFrame, *, ranks: str | None = None, text: str = "text", names: tuple[str, str, str] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """docs with the number of ids, the SHA-256 of the decimal ids joined by one space, and that of the ids' decoded bytes."""

    def run(c: Codec, part: scan.Slice) -> list[pa.Array]:
        ids, ends = c.encode_slice(part)
        data, at = c.decimal_table.joined(ids, ends)
        own = [sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
        back = []
        for pieces in c.decode_slice(ids, ends):
            digest = sha256()
            for p in pieces:
                digest.update(p.encode())
            back.append(digest.hexdigest())
        return [pa.array(np.diff(ends)), pa.array(own, pa.string()), pa.array(back, pa.string())]

    return _mapped(docs, text, [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.StringType())], ranks, run)


def _mapped(docs: DataFrame, column: str, fields: list[T.StructField], ranks: str | None, of) -> DataFrame:
    at, width, path = docs.columns.index(column), len(docs.columns), ranks or public_tokenizers.path(RANKS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(fresh(docs, *(f.name for f in fields)), fields))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in scan.slices(batch.column(at), scan.SLICE // 4):
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns[:width], *of(own, part)], names=names)

    return docs.mapInArrow(scan.tidy(run), schema)


def decoded(docs: DataFrame, *, ranks: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a column of the text of their ids; null ids are empty."""
    at, width, path = docs.columns.index(ids), len(docs.columns), ranks or public_tokenizers.path(RANKS)
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh(docs, text)[0], T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = ["".join(own.decode(x.as_py() or [])) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(scan.tidy(run), schema)
