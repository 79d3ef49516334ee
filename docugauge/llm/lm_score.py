"""LM scoring: the marginal probability of a text over all segmentations, with what the corpus teaches.

A text is its words (A-Z in lower case) and one end. Each token is a lattice: all its segmentations into
pieces of an existing vocabulary, weighted by its scores, beside one arc for the whole token as often as
the training part of the corpus holds it. With N training tokens, V of them different, a token seen c
times has probability

    (c + V * p(token)) / (N + V)

where p sums over the segmentations: what is kept back for new tokens (Witten and Bell) goes to the
subwords. A text's probability is the product. The base score is an add-0.1 unigram over the same tokens.

Documents are held out if crc32 of the id as text, modulo 10, is 0; the others train. Counts cover every
training document. The most frequent tokens, HEAD at most, are broadcast; all others meet their counts
in a join, a row for each document and token, so nothing grows with the vocabulary. Tokens are
told apart by a 64-bit hash.

Null texts are empty and have an end only. A null id trains. Repeated rows train and are scored row by
row. Texts may be of any length, words too. Without training documents N = V = 0 and the subwords have
all weight. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docugauge.llm import lattice, scan
from docugauge.llm.frames import stored

MODEL = "piece_bpe_32k.model"
#: Tokens in the broadcast, words that a task counts at once, and bytes of words whose probabilities a worker remembers.
HEAD, CHUNK, MOST_BYTES = 1_000_000, 2 << 20, 48 << 20
#: Bytes of a word that is worth remembering, and what a remembered one takes besides its own.
LONGEST, _ENTRY = 64, 140
_END = np.uint64(0)  # the hash of the end; no word's, as it is mixed from none
_LN10 = math.log(10)


class _Remembered:
    """Log probabilities of words by the lattice; words are forgotten all at once beyond MOST_BYTES, long ones with their slice."""

    def __init__(self) -> None:
        self.held: dict[bytes, float] = {}
        self.bytes = 0

    def of(self, vocabulary: lattice.Pieces, words: list[bytes]) -> np.ndarray:
        if self.bytes > MOST_BYTES:
            self.held, self.bytes = {}, 0
        new = [w for w in words if w not in self.held]
        found = dict(zip(new, vocabulary.words(new).tolist()))
        short = {w: x for w, x in found.items() if len(w) <= LONGEST}
        self.held.update(short)
        self.bytes += sum(map(len, short)) + _ENTRY * len(short)
        return np.fromiter((found[w] if w in found else self.held[w] for w in words), dtype=np.float64, count=len(words))


_known: dict[str, _Remembered] = {}


def held_out(doc_id: str):
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10
    return F.coalesce(remainder == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (hash, count), equal hashes of some millions of words together."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for part in scan.slices(batch.column(0), scan.SLICE // 2, lower=True):
            held += [scan.Words(part, scan.WHITE).hashes(), np.full(part.rows, _END)]
            if sum(map(len, held)) >= CHUNK:
                yield counted()
                held = []
    if held:
        yield counted()


def _scorer(path: str, head, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (hashes, counts) = lattice.pieces(path), head.value
        known = _known.setdefault(path, _Remembered())

        def frequent(h: np.ndarray) -> np.ndarray:
            """Counts of those in the head, -1 of others."""
            if not len(hashes):
                return np.full(len(h), -1)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            return np.where(hashes[at] == h, counts[at], -1)

        c_end = int(frequent(np.array([_END]))[0])
        for batch in batches:
            for part in scan.slices(batch.column(2), scan.SLICE // 4, lower=True):
                words = scan.Words(part, scan.WHITE)
                coded = words.array().dictionary_encode()
                index = coded.indices.to_numpy()
                different = len(coded.dictionary)
                first = np.zeros(different, dtype=np.int64)
                first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
                h = words.hashes()[first]
                logs, c = known.of(vocabulary, coded.dictionary.to_pylist()), frequent(h)
                seen = c >= 0
                with np.errstate(divide="ignore"):
                    own = np.where(seen, log_probability(np.maximum(c, 0), logs, n, v), 0) / _LN10
                    base = np.where(seen, np.log10((np.maximum(c, 0) + 0.1) / (n + 0.1 * (v + 1))), 0)
                ends = words.first
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[index])))[ends]) if len(index) else np.zeros(part.rows)
                per_row = lambda x: np.array([x[index[a:b]].sum() for a, b in zip(ends.tolist(), ends[1:].tolist())]) if len(index) else np.zeros(part.rows)
                uid = np.asarray(batch.column(0).slice(part.first, part.rows))
                m = part.rows
                tokens, known_n = words.count + 1, total(seen.astype(np.int64)).astype(np.int64) + (c_end > 0)
                scores, bases = per_row(own), per_row(base)
                if c_end >= 0:
                    scores = scores + log_probability(np.array([c_end]), np.array([vocabulary.end]), n, v)[0] / _LN10
                    bases = bases + math.log10((c_end + 0.1) / (n + 0.1 * (v + 1)))
                yield _rows(uid, np.ones(m, np.int32), -1 - uid, np.zeros(m), tokens, known_n, bases, scores, *(batch.column(i).slice(part.first, m) for i in (1, 3)))
                rest = np.flatnonzero(~seen[index]) if len(index) else np.zeros(0, np.int64)
                pairs, times = np.unique(words.rows()[rest] * max(1, different) + index[rest], return_counts=True)  # a row for each text and token
                line, what = np.divmod(pairs, max(1, different))
                uids, hs, xs = uid[line], h[what].view(np.int64), logs[what]
                if c_end < 0:
                    uids, hs, xs, times = np.concatenate((uids, uid)), np.concatenate((hs, np.zeros(m, np.int64))), np.concatenate((xs, np.full(m, vocabulary.end))), np.concatenate((times, np.ones(m, np.int64)))
                if len(uids):
                    none = np.zeros(len(uids), np.int64)
                    yield _rows(uids, np.zeros(len(uids), np.int32), hs, xs, none, times.astype(np.int64), none.astype(float), none.astype(float))

    return run


def log_probability(c: np.ndarray, logs: np.ndarray, n: int, v: int) -> np.ndarray:
    """Natural logarithm of a token's probability, by its count and its lattice."""
    if n + v == 0:
        return logs
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c.astype(np.float64)), math.log(v) + logs if v else -np.inf) - math.log(n + v)


_SCHEMA = "u long, kind int, h long, x double, tokens long, known long, base double, score double, id long, out boolean"


def _rows(*columns) -> pa.RecordBatch:
    last = [pa.nulls(len(columns[0]), pa.int64()), pa.nulls(len(columns[0]), pa.bool_())][len(columns) - 8 :]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in [*columns, *last]], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def scored(docs: DataFrame, *, model: str | None = None, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 both)."""
    spark, path = docs.sparkSession, model or public_tokenizers.path(MODEL)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    lexicon = stored(own.where("NOT held_out").select("text").mapInArrow(scan.tidy(_counts), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lexicon")
    n, v = lexicon.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # One row for each different count: no more than the square root of twice the tokens.
    upto = F.sum("count").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    found = lexicon.groupBy("c").count().withColumn("upto", upto).where(F.col("upto") <= head).agg(F.min("c")).first()[0]
    least = 1 << 62 if found is None else found
    top = lexicon.where(F.col("c") >= least).toArrow()
    order = np.argsort(top["h"].to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((top["h"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order]) if top.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    numbered = own.withColumn("u", F.monotonically_increasing_id())
    # A row's id travels with one of its parts; all parts of a row are made by one task, from one read.
    parts = numbered.select("u", F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(scan.tidy(_scorer(path, shared, n, v)), _SCHEMA)
    rest = lexicon.where(F.col("c") < least).select("h", "c", F.lit(0).alias("kind"))
    met = parts.join(rest, ["h", "kind"], "left")
    c, tail = F.coalesce(F.col("c"), F.lit(0)), F.col("kind") == 0
    spread = F.log10(c + v * F.exp("x"))
    new = (F.lit(math.log10(v)) if v else F.lit(float("-inf"))) + F.col("x") / _LN10
    own_score = F.when(c > 0, spread).otherwise(new) - (math.log10(n + v) if n + v else 0) if n + v else F.col("x") / _LN10
    base = F.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    sums = met.groupBy("u").agg(F.sum("tokens").alias("n_tokens"), F.sum(F.when(tail & (c == 0), 0).otherwise(F.col("known"))).alias("n_known"), F.sum(F.when(tail, F.col("known") * base).otherwise(F.col("base"))).alias("base_score"), F.sum(F.when(tail, F.col("known") * own_score).otherwise(F.col("score"))).alias("score"), F.max("id").alias("id"), F.max("out").alias("held_out"))
    return sums.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
