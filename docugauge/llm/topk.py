"""Exact top-k by inner product: global score histograms, refined until each query's k-th score is known.

Components become integers, floor(scale * x), and scores are exact integers. Queries are taken in
blocks of a stated size; for each, all candidates are scored again and again, and each pass counts the
scores by bins that split the interval that holds the query's k-th highest score. Counts are summed per
query and bin across tasks, so what comes to the driver is bounded by block, not by table. When the
interval is one score wide, the last pass keeps scores above it, and of those equal to it as many with
the smallest ids as are missing.

Vectors that are null, or hold null or a value that isn't finite, take no part, as query or candidate.
A query is scored against vectors of its own length, and never against rows of its own id, however
often that is repeated; repeated candidates are candidates of their own. Query rows that share an id are
queries of their own: each has its results, ranked apart. A null id sorts below all others as a
candidate and is no query. Fewer candidates than k: all. No rows: no results.

Products whose sums doubles can't hold exactly are made of 64-bit integers, and beyond those of Python's.
Scores are compared as if they ended at the ends of 64 bits; only a result at an end is an error, as a
long can't hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Queries of a block, and bins of a histogram.
BLOCK, BINS = 4096, 256
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def vectors(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors: their rows, and whole components: doubles, or Python's integers if any is large."""
    valid = ~np.asarray(column.is_null())
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    values = column.flatten()
    at = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    flat = np.asarray(values.cast(pa.float64()).fill_null(float("nan"))) if len(values) else np.zeros(0)
    for size in np.unique(sizes[valid]).tolist():
        rows = np.flatnonzero(sizes == size)
        held = flat[at[rows][:, None] + np.arange(size)[None, :]]
        good = np.isfinite(held).all(axis=1)
        large = good & (np.abs(held) * abs(scale) >= 2**53).any(axis=1)
        if (good & ~large).any():
            yield rows[good & ~large], np.floor(scale * held[good & ~large])
        if large.any():
            exact = [[floor(scale * x) if isfinite(scale * x) else floor(Fraction(scale) * Fraction(x)) for x in v] for v in held[large].tolist()]
            yield rows[large], np.array(exact, dtype=object).reshape(-1, size)


def _most(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, those beyond their ends at the ends; by doubles where those are exact."""
    bound = _most(queries) * _most(rows) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = [[sum(a * b for a, b in zip(q, r)) for r in _integers(rows)] for q in _integers(queries)]
    return np.array([[min(max(s, _LOWEST), _HIGHEST) for s in line] for line in exact], dtype=np.int64).reshape(len(queries), len(rows))


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def _integers(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in line] for line in x.tolist()]


def top_k(vecs: DataFrame, queries: DataFrame, k: int = 5, *, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each query, ties to the smaller vec_id."""
    spark = vecs.sparkSession
    rows = vecs.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>"))
    asked = queries.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i IS NOT NULL AND v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("times"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("i", "v"), F.lit(blocks)) == b)
        held = [(batch, at, whole) for batch in part.toArrow().to_batches() for at, whole in vectors(batch.column(1), scale)]
        # Those of one length and kind of numbers go together, so that few large vectors don't slow the others down.
        for size, kind in sorted({(whole.shape[1], whole.dtype.kind) for _, _, whole in held}):
            some = [x for x in held if (x[2].shape[1], x[2].dtype.kind) == (size, kind)]
            ids, times = (np.concatenate([batch.column(c).to_numpy()[at] for batch, at, _ in some]) for c in (0, 2))
            found = _block(rows, ids, times, np.concatenate([whole for _, _, whole in some]), size, k, scale, bins)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _block(rows: DataFrame, ids: np.ndarray, times: np.ndarray, asked: np.ndarray, size: int, k: int, scale: float, bins: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((ids, asked))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Candidate ids, scores by query and candidate, and which of those count."""
        own, vectors_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for line, held in vectors(some.column(1), scale):
                    if held.shape[1] == size:
                        names = some.column(0).take(pa.array(line))
                        other = (own[:, None] != names.fill_null(0).to_numpy(zero_copy_only=False)[None, :]) | names.is_null().to_numpy(zero_copy_only=False)[None, :]
                        yield names, scores(vectors_of, held), other

    def bounds(batches):
        low, high, n = np.full(len(ids), 2**63 - 1), np.full(len(ids), _LOWEST), np.zeros(len(ids), dtype=np.int64)
        for _, s, ok in each(batches):
            low, high, n = np.minimum(low, np.where(ok, s, 2**63 - 1).min(axis=1)), np.maximum(high, np.where(ok, s, _LOWEST).max(axis=1)), n + ok.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(low), pa.array(high), pa.array(n)], names=["q", "low", "high", "n"])

    got = rows.mapInArrow(bounds, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow().sort_by("q")
    low, high, n = (np.zeros(len(ids), dtype=np.int64) if not got.num_rows else got[c].to_numpy() for c in ("low", "high", "n"))
    low, high = np.where(n > 0, low, 0), np.where(n > 0, high, 0)
    want = np.minimum(k, n)  # the k-th highest of those in [low, high]
    above = np.zeros(len(ids), dtype=np.int64)  # how many are higher than high
    while (open_ := (want > 0) & (low < high)).any():
        width = np.maximum(1, -(-(high.astype(object) - low.astype(object) + 1) // bins)).astype(np.int64)
        state = sc.broadcast((low, high, width, open_))

        def counts(batches, state=state):
            lo, hi, w, live = state.value
            lines = np.flatnonzero(live)
            total = np.zeros((len(lines), bins), dtype=np.int64)
            for _, s, ok in each(batches):
                s = s[lines]
                inside = ok[lines] & (s >= lo[lines, None]) & (s <= hi[lines, None])
                line, at = np.nonzero(inside)
                far = _unsigned(s[line, at]) - _unsigned(lo[lines[line]])  # the difference may take all 64 bits
                cell = line * bins + (far // _unsigned(w[lines[line]])).astype(np.int64)
                total += np.bincount(cell, minlength=total.size).reshape(total.shape)
            line, cell = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lines[line]), pa.array(cell), pa.array(total[line, cell])], names=["q", "bin", "n"])

        seen = rows.mapInArrow(counts, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((len(ids), bins), dtype=np.int64)
        table[seen["q"].to_numpy(), seen["bin"].to_numpy()] = seen["n"].to_numpy()
        higher = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]  # in this bin or a higher one
        at = (higher >= (want - above)[:, None]).sum(axis=1) - 1
        q = np.flatnonzero(open_)
        above[q] += higher[q, at[q]] - table[q, at[q]]
        low[q] = low[q] + at[q] * width[q]
        beyond = _unsigned(high[q]) - _unsigned(low[q]) > _unsigned(width[q] - 1)
        high[q] = np.where(beyond, low[q] + np.where(beyond, width[q] - 1, 0), high[q])
    state = sc.broadcast((low, want - above, want))

    def kept(batches):
        kth, missing, live = state.value
        ties: dict[int, list] = {}
        order = lambda i: (i is not None, i or 0)

        def batch_of(q, names, s) -> pa.RecordBatch:
            if np.isin(s, (_LOWEST, _HIGHEST)).any():
                raise ValueError("a score among the highest is too large for a long")
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[q]), pa.array(names, pa.int64()), pa.array(s, pa.int64()), pa.array(times[q])], names=["q", "query_id", "vec_id", "score", "times"])

        for names, s, ok in each(batches):
            q, c = np.nonzero(ok & (s > kth[:, None]) & (live > 0)[:, None])
            yield batch_of(q, names.take(pa.array(c)), s[q, c])
            q, c = np.nonzero(ok & (s == kth[:, None]) & (live > 0)[:, None])
            for line in np.unique(q).tolist():
                ties[line] = sorted(ties.get(line, []) + names.take(pa.array(c[q == line])).to_pylist(), key=order)[: missing[line]]
        flat = [(line, i, kth[line]) for line, found in ties.items() for i in found]
        if flat:
            q, names, s = zip(*flat)
            yield batch_of(np.array(q), list(names), np.array(s))

    found = rows.mapInArrow(kept, "q int, query_id long, vec_id long, score long, times long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("vec_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")
