"""Substring dedup over a De Bruijn graph of words: long repeated spans go, first occurrences stay.

Words are runs without white space. Every window of ``K`` consecutive words is an edge of the graph,
from the node of its first K - 1 words to that of its last. An edge that occurs again is a repeat; of all its
occurrences the one at the smallest document id, then the earliest start, is the source, and every word of
every other occurrence goes.

1. A scan cuts each document into paths of consecutive edges with the same minimizer, the least hash
   of a shorter word run within the edge. Equal edges have equal minimizers, so a path travels to its
   minimizer's partition as one row with 48 bits of each of its nodes' hashes. Edges that a task has met
   before among the CHUNK words at hand don't travel: their source there stands for them, with a mark. So a
   passage copied any number of times is a row for each CHUNK words of a task. Edges of a minimizer that a
   sample shows to be common (a short line of many documents) travel by place and nodes.
2. Edges meet by minimizer, place and nodes. Repeats that follow each other, and whose sources do, come back as
   runs; the sources of all repeats come back as fragments of the graph of repeated edges, each edge once.
3. Nodes of fragments are grouped, and their in- and out-degrees counted. Fragments that meet end to end are
   compacted, and joined with the nodes that branch, at which they are cut: what is left are the maximal
   nonbranching paths, at source coordinates. Runs are compacted in their documents and cut at the same nodes.
4. Each such span of a copy, in pieces of PIECE words at most, is compared with its source's by a 128-bit
   digest of the words, each computed in its own document. Should two different edges ever share minimizer
   and nodes, that shows which copies are wrong. They and their sources alone meet again, by other hashes; all
   other rows stay.

Null, empty and short texts have no edges and stay whole. A null id sorts before all others. Rows that
repeat an id are documents with the same place in the order, so neither is a source of the other at an
equal start. Texts may be of any length; no rows, no repeats. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docugauge.llm import scan
from docugauge.llm.frames import discard, fresh, let, row_order, stored

#: Words of an edge, words of a minimizer, words that a task compares at once, words of a compared piece.
K, MINIMIZER, CHUNK, PIECE = 20, 6, 1 << 19, 256
#: Paths of a minimizer beyond which its edges part; the share of documents that tells, 1 of so many.
HOT, SHARE = 1 << 17, 64
_PLACE = 24  # bits of a place in a block of minimizers

_ROW = [("h", pa.int64()), ("o", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()), ("lead", pa.int32()), ("prints", pa.binary())]
_RUN = [("o", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()), ("edges", pa.int32()), ("so", pa.int64()), ("sseq", pa.int32()), ("sstart", pa.int32()), ("nodes", pa.list_(pa.int64()))]
_ROW_SQL = "h long, o long, seq int, start int, lead int, prints binary"
_RUN_SQL = "o long, seq int, start int, edges int, so long, sseq int, sstart int"
_MET_SQL = f"{_RUN_SQL}, nodes array<long>"
_DROPPED, _MARKED = np.uint64(16), 64  # bits of a node that don't travel; added to the lead of a path with marked edges


def _batch(columns: list, fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of so many hashes, the place of the least; the first of equal ones."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    low = np.uint64((1 << _PLACE) - 1)
    step = (1 << _PLACE) - width
    for a in range(0, n, step):
        part = hashes[a : a + step + width - 1]
        least, span = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        out[a : a + len(least)] = a + (least & low).astype(np.int64)
    return out


def _paths(seed: int, k: int, m: int):
    """Batches of (o, seq, text) to rows: paths, and runs that repeat within a chunk (lead below 0, the source in prints)."""

    def chunk(o: np.ndarray, seq: np.ndarray, counts: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.concatenate(([0], np.cumsum(counts)))
        if len(words) < k:
            return
        edges, valid = scan.window_hashes(words ^ np.uint64(seed), k), scan.within_rows(first, k)
        at = np.flatnonzero(valid)
        if not len(at):
            return
        row = np.repeat(np.arange(len(counts)), counts)[at]
        start = at - first[row]
        order = np.argsort(edges[at], kind="stable")
        sorted_ = edges[at][order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        source = np.empty(len(at), dtype=np.int64)
        source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # rows come by id, so the first is the least
        repeat = (o[row] > o[row[source]]) | (start > start[source])
        yield from _runs(o, seq, row, start, source, repeat)
        marked = np.zeros(len(at), dtype=bool)
        marked[source[repeat]] = True
        keep = np.flatnonzero(~repeat)
        del order, sorted_, new, source, repeat, edges
        short = scan.window_hashes(words ^ np.uint64(seed), m, "word2")
        nodes = scan.window_hashes(words ^ np.uint64(seed), k - 1) >> _DROPPED
        yield from _rows(o, seq, row[keep], start[keep], at[keep], minimizers(short, k - m + 1)[at[keep]], short, nodes, marked[keep])

    def _runs(o, seq, row, start, source, repeat) -> Iterator[pa.RecordBatch]:
        i = np.flatnonzero(repeat)
        if not len(i):
            return
        a, n = joined(row[i], start[i], row[source[i]], start[source[i]])
        r, s = row[i[a]], row[source[i[a]]]
        packed = np.empty(len(a), dtype=[("so", "<i8"), ("sseq", "<i4"), ("sstart", "<i4")])
        packed["so"], packed["sseq"], packed["sstart"] = o[s], seq[s], start[source[i[a]]]
        h = scan.mix(o[r].view(np.uint64) * np.uint64(3) + start[i[a]].astype(np.uint64)).view(np.int64)
        yield _batch([h, o[r], seq[r], start[i[a]], -n, _binary(packed.view(np.uint8), np.arange(len(a) + 1) * 16)], _ROW)

    def _rows(o, seq, row, start, at, place, hashes, nodes, marked) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
        a = np.flatnonzero(new)
        n = np.diff(np.append(a, len(at)))
        any_ = np.logical_or.reduceat(marked, a)
        prints = _packed(nodes[_spread(at[a], n + 1)], marked[_spread(a, n * any_)], n, any_)
        yield _batch([hashes[place[a]].view(np.int64), o[row[a]], seq[row[a]], start[a], place[a] - at[a] + _MARKED * any_, prints], _ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, held = np.argsort(np.asarray(batch.column(0)), kind="stable"), []
            for at in range(0, batch.num_rows, 512):
                some = batch.take(pa.array(order[at : at + 512]))
                o, seq = np.asarray(some.column(0)), np.asarray(some.column(1))
                for part in scan.slices(some.column(2), scan.SLICE // 4):
                    words = scan.Words(part, scan.WHITE)
                    own = slice(part.first, part.first + part.rows)
                    held.append((o[own], seq[own], words.count, _others(words, seed) if seed else words.hashes()))
                    del words
                    if sum(len(x[3]) for x in held) >= CHUNK:
                        yield from chunk(*map(np.concatenate, zip(*held)))
                        held = []
            if held:
                yield from chunk(*map(np.concatenate, zip(*held)))

    return run


def _binary(data: np.ndarray, where: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(where) - 1, [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places begin .. begin + size, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _packed(nodes: np.ndarray, marks: np.ndarray, n: np.ndarray, marked: np.ndarray) -> pa.Array:
    """For each path of n edges its n + 1 nodes in 6 bytes each, and a byte for each edge of a marked path."""
    of_nodes = 6 * (n + 1)
    where = np.concatenate(([0], np.cumsum(of_nodes + n * marked)))
    out = np.empty(where[-1], dtype=np.uint8)
    out[_spread(where[:-1], of_nodes)] = nodes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()
    out[_spread(where[:-1] + of_nodes, n * marked)] = marks
    return _binary(out, where)


def _unpacked(prints: pa.Array, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of each path, all nodes, and the mark of each edge."""
    _, where, data = prints.buffers()
    where = np.frombuffer(where, dtype=np.int32)[prints.offset : prints.offset + len(prints) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)
    size = np.diff(where)
    n = np.where(marked, (size - 6) // 7, size // 6 - 1)
    held = np.zeros((int((n + 1).sum()), 8), dtype=np.uint8)
    held[:, :6] = data[_spread(where[:-1], 6 * (n + 1))].reshape(-1, 6)
    marks = np.zeros(int(n.sum()), dtype=bool)
    marks[np.repeat(marked, n)] = data[_spread(where[:-1] + 6 * (n + 1), n * marked)] > 0
    return n, held.view("<u8").ravel(), marks


def _others(words: scan.Words, seed: int) -> np.ndarray:
    """Hashes of words that don't depend on those of the first attempt."""
    key = seed.to_bytes(8, "little")
    return np.array([int.from_bytes(hashlib.blake2b(words.bytes_of(i, i + 1), digest_size=8, key=key).digest(), "little") for i in range(len(words))], dtype=np.uint64)


def _key(h: np.ndarray, place: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """What edges meet by."""
    return scan.mix(scan.mix(scan.mix(h.view(np.uint64) + place.astype(np.uint64)) ^ tail) ^ (head * np.uint64(0x9E3779B97F4A7C15)))


def _parted(paths, hot: np.ndarray):
    """paths, with one row for each edge of a hot minimizer, by its place and nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in paths(batches):
            h, o, seq, start, lead = (np.asarray(c) for c in batch.columns[:5])
            many = (lead >= 0) & np.isin(h, hot)
            if not many.any():
                yield batch
                continue
            yield batch.filter(pa.array(~many))
            i = np.flatnonzero(many)
            n, nodes, marks = _unpacked(batch.column(5).take(pa.array(i)), lead[i] >= _MARKED)
            i, step = np.repeat(i, n), _spread(np.zeros(len(n), dtype=np.int64), n)
            tail = _spread(np.cumsum(n + 1) - n - 1, n)
            at = _key(h[i], lead[i] % _MARKED - step, nodes[tail], nodes[tail + 1]).view(np.int64)
            one = np.ones(len(i), dtype=np.int64)
            prints = _packed(np.column_stack((nodes[tail], nodes[tail + 1])).ravel(), marks[marks], one, marks)
            yield _batch([at, o[i], seq[i], start[i] + step.astype(np.int32), _MARKED * marks, prints], _ROW)

    return run


def _hot(rows: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimizers of about HOT paths or more, by a share of the documents; there are no more than paths / HOT."""
    share = rows.where(F.pmod(F.xxhash64(F.lit(9), "o", "seq"), F.lit(SHARE)) == 0)
    paths = share.mapInArrow(scan.tidy(_paths(0, k, m)), _ROW_SQL).where("lead >= 0")
    return np.array([r.h for r in paths.groupBy("h").count().where(F.col("count") >= max(HOT // SHARE, 1)).select("h").collect()], dtype=np.int64)


def joined(row: np.ndarray, start: np.ndarray, source_row: np.ndarray, source_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin of repeats that follow each other as their sources do, and their lengths; the input is by row and start."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (source_row[1:] != source_row[:-1]) | (source_start[1:] != source_start[:-1] + 1)
    a = np.flatnonzero(new)
    return a, np.diff(np.concatenate((a, [len(row)])))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by minimizer to runs of repeats (nodes null), and to fragments of their sources (so null)."""

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, o, seq, start, lead = (table[c].to_numpy() for c in ("h", "o", "seq", "start", "lead"))
        prints = table["prints"].combine_chunks()
        done = np.flatnonzero(lead < 0)
        if len(done):
            packed = np.frombuffer(b"".join(prints.take(pa.array(done)).to_pylist()), dtype=[("so", "<i8"), ("sseq", "<i4"), ("sstart", "<i4")])
            yield _batch([o[done], seq[done], start[done], -lead[done], packed["so"], packed["sseq"], packed["sstart"], pa.nulls(len(done), _RUN[-1][1])], _RUN)
        i = np.flatnonzero(lead >= 0)
        if not len(i):
            return
        first = np.flatnonzero(np.concatenate(([True], h[i][1:] != h[i][:-1])))
        many = np.diff(np.append(first, len(i)))
        marked = np.logical_or.reduceat(lead[i] >= _MARKED, first)
        i = i[np.repeat((many > 1) | marked, many)]
        if not len(i):
            return
        i = i[np.lexsort((start[i], o[i]))]
        size, nodes, marks = _unpacked(prints.take(pa.array(i)), lead[i] >= _MARKED)
        path = np.repeat(np.arange(len(i)), size)
        step = _spread(np.zeros(len(i), dtype=np.int64), size)
        tail = _spread(np.cumsum(size + 1) - size - 1, size)  # the place of each edge's first node
        key = _key(h[i][path], lead[i][path] % _MARKED - step, nodes[tail], nodes[tail + 1])
        own_o, own_start = o[i][path], start[i][path] + step
        # paths are by id and start, but the edges of one path start later than those of the next may
        order = np.lexsort((own_start, own_o, key))
        head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        source = np.empty(len(key), dtype=np.int64)
        source[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        again = (own_o > own_o[source]) | (own_start > own_start[source])
        repeat = np.flatnonzero(again)
        if len(repeat):
            s = source[repeat]
            a, n = joined(path[repeat], own_start[repeat], path[s], own_start[s])
            r, s = repeat[a], s[a]
            yield _batch([own_o[r], seq[i][path[r]], own_start[r], n, own_o[s], seq[i][path[s]], own_start[s], pa.nulls(len(r), _RUN[-1][1])], _RUN)
        twice = np.zeros(len(key), dtype=bool)
        twice[source[again | marks]] = True
        at = np.flatnonzero(twice)
        if len(at):
            a, n = joined(path[at], own_start[at], path[at], own_start[at])
            r = at[a]
            held = nodes[_spread(tail[r], n + 1)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n + 1))).astype(np.int32)), pa.array(held))
            none = pa.nulls(len(r), pa.int32())
            yield _batch([own_o[r], seq[i][path[r]], own_start[r], n, pa.nulls(len(r), pa.int64()), none, none, lists], _RUN)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 17:
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1], side="left"))  # the last minimizer may go on
            if cut:
                yield from meet(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield from meet(pa.Table.from_batches(held))


def _paths_of(fragments: DataFrame) -> DataFrame:
    """(o, seq, start, edges) of the maximal nonbranching paths of the graph of repeated edges, at their sources.

    fragments: (o, seq, start, edges, nodes), each edge of the graph in one of them.
    """
    passes = fragments.select("o", "seq", "start", "edges", F.posexplode("nodes").alias("pos", "node"))
    degrees = passes.groupBy("node").agg(F.count_if(F.col("pos") > 0).alias("ins"), F.count_if(F.col("pos") < F.col("edges")).alias("outs"))
    branching = degrees.where("ins > 1 OR outs > 1").select("node")
    cuts = passes.join(branching, "node", "left_semi").groupBy("o", "seq").agg(F.collect_set(F.col("start") + F.col("pos")).alias("cuts"))
    # Fragments that meet end to end are one; a document's are no more than its words.
    own = Window.partitionBy("o", "seq").orderBy("start")
    parted = fragments.select("o", "seq", "start", (F.col("start") + F.col("edges")).alias("end")).withColumn("_new", (~F.col("start").eqNullSafe(F.lag("end").over(own))).cast("int")).withColumn("_n", F.sum("_new").over(own))
    whole = parted.groupBy("o", "seq", "_n").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("a")) & (c < F.col("b")))
    pieces = _between(F.concat(F.array("a"), F.array_sort(inner)), F.col("b"))
    return whole.join(cuts, ["o", "seq"], "left").select("o", "seq", F.explode(pieces).alias("p")).select("o", "seq", F.col("p.a").alias("start"), (F.col("p.b") - F.col("p.a")).alias("edges"))


def _between(points: Column, end: Column) -> Column:
    """Structs (a, b) of each point and the next, the last with the end."""
    return let(points, lambda ps: F.zip_with(ps, F.concat(F.slice(ps, F.lit(2), F.size(ps)), F.array(end)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _compacted(runs: DataFrame) -> DataFrame:
    """Runs of each document, joined where copy and source both go on."""
    own = Window.partitionBy("o", "seq").orderBy("start", "so", "sseq", "sstart")
    shift = F.col("start") - F.col("sstart")
    before = lambda c: F.lag(c).over(own)
    goes_on = (before("so") == F.col("so")) & (before("sseq") == F.col("sseq")) & (before(shift) == shift) & (F.col("start") <= before(F.col("start") + F.col("edges")))
    parted = runs.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_n", F.sum("_new").over(own))
    out = parted.groupBy("o", "seq", "so", "sseq", "_n").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges")).alias("_end"), F.min("sstart").alias("sstart"))
    return out.select("o", "seq", "start", (F.col("_end") - F.col("start")).alias("edges"), "so", "sseq", "sstart")


def _pieces(runs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(o, seq, at, so, sseq, a, b): runs cut where nonbranching paths of their source begin, and at multiples of PIECE of its words.

    So what is asked of a document is bounded by its length and its paths, however many copies it has.
    """
    starts = paths.groupBy(F.col("o").alias("so"), F.col("seq").alias("sseq")).agg(F.collect_list("start").alias("starts"))
    end = F.col("sstart") + F.col("edges") + (k - 1)
    first = ((F.floor(F.col("sstart") / PIECE) + 1) * PIECE).cast("int")
    grid = F.when(first < end, F.sequence(first, end - 1, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    inner = F.filter(F.coalesce("starts", F.array().cast("array<int>")), lambda c: (c > F.col("sstart")) & (c < end))
    points = F.array_sort(F.array_distinct(F.concat(F.array("sstart"), grid, inner)))
    cut = runs.join(starts, ["so", "sseq"], "left").select("o", "seq", "so", "sseq", "start", "sstart", F.explode(_between(points, end)).alias("p"))
    return cut.select("o", "seq", (F.col("start") + F.col("p.a") - F.col("sstart")).alias("at"), "so", "sseq", "p.a", "p.b")


def _digest(words: scan.Words, a: int, b: int) -> bytes:
    return hashlib.blake2b(words.bytes_of(a, b), digest_size=16).digest()


_PROOF = T.ArrayType(T.StructType([T.StructField("o", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("d", T.BinaryType()), T.StructField("own", T.BooleanType())]))
_PROOF_ARROW = pa.list_(pa.struct([("o", pa.int64()), ("seq", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("d", pa.binary()), ("own", pa.bool_())]))


def _finish(width: int, text_at: int, names: list[str], keep_text: bool):
    """Rows of (own columns, o, seq, marks, asked) to own columns, o, seq, words, removed words, SHA-256 of what is left, proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch.column(text_at), scan.SLICE // 4):
                own = batch.slice(part.first, part.rows)
                words = scan.Words(part, scan.WHITE)
                kept = np.ones(len(words), dtype=bool)
                proofs: list[list] = []
                for row in range(part.rows):
                    base, found = int(words.first[row]), []
                    for m in own.column(width + 2)[row].as_py() or []:
                        begin = base + m["at"]
                        end = begin + m["b"] - m["a"]
                        kept[begin:end] = False
                        found.append({"o": m["so"], "seq": m["sseq"], "a": m["a"], "b": m["b"], "d": _digest(words, begin, end), "own": False})
                    o, seq = (own.column(i)[row].as_py() for i in (width, width + 1))
                    found += [{"o": o, "seq": seq, "a": x["a"], "b": x["b"], "d": _digest(words, base + x["a"], base + x["b"]), "own": True} for x in own.column(width + 3)[row].as_py() or []]
                    proofs.append(found)
                data, ends = words.joined(kept)
                view, ends = memoryview(data), ends.tolist()
                total = np.concatenate(([0], np.cumsum(~kept)))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                columns = own.columns[:width]
                if keep_text:
                    old = columns[text_at]
                    cut = [bytes(view[a:b]).decode() if n else None for a, b, n in zip(ends, ends[1:], removed.tolist())]
                    columns[text_at] = pa.array([old[i].as_py() if c is None else c for i, c in enumerate(cut)], old.type)
                yield pa.RecordBatch.from_arrays([*columns, *own.columns[width : width + 2], pa.array(words.count), pa.array(removed), pa.array(digests), pa.array(proofs, _PROOF_ARROW)], names=names)

    return run


def deduplicated(docs: DataFrame, *, k: int = K, minimizer: int = MINIMIZER, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """docs without the words of repeated spans, and the names of three more columns: words, removed words, SHA-256 of what is left.

    A text that loses words is its other words joined by one space; other texts stay as they are.
    keep_text False: the texts aren't returned.
    """
    columns = [c for c in docs.columns if keep_text or c != text]
    o, seq, marks, asked, n_words, n_removed, left, proofs = fresh(docs, "o", "seq", "marks", "asked", "n_words", "n_removed", "kept_sha256", "proofs")
    keyed, used = _keyed(docs, doc_id, text, o, seq)
    of = lambda df: df.select(F.col(o).alias("o"), F.col(seq).alias("seq"), F.col(f"`{text}`").alias("text"))
    own = docs.schema
    schema = T.StructType([*own.fields, T.StructField(o, T.LongType()), T.StructField(seq, T.IntegerType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()), T.StructField(left, T.StringType()), T.StructField(proofs, _PROOF)])
    hot = _hot(of(keyed), k, minimizer)
    part, right, outs = keyed, None, []
    for attempt in range(20):
        cut = _paths(attempt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, k, minimizer)
        paths = of(part).mapInArrow(scan.tidy(_parted(cut, hot) if len(hot) and not attempt else cut), _ROW_SQL)
        met = stored(paths.repartition("h").sortWithinPartitions("h").mapInArrow(scan.tidy(_meet), _MET_SQL), "met")
        runs = met.where("nodes IS NULL").drop("nodes")
        held = stored(_compacted(runs if right is None else runs.unionByName(right)), "runs")
        graph = met.where("nodes IS NOT NULL").select("o", "seq", "start", "edges", "nodes")
        spans = stored(_pieces(held, _paths_of(graph), k), "spans")
        discard(met)
        own_marks = spans.groupBy("o", "seq").agg(F.collect_list(F.struct("at", "so", "sseq", "a", "b")).alias("marks"))
        wanted = spans.select("so", "sseq", "a", "b").distinct().groupBy(F.col("so").alias("o"), F.col("sseq").alias("seq")).agg(F.collect_list(F.struct("a", "b")).alias("asked"))
        both = own_marks.join(wanted, ["o", "seq"], "full").select(F.col("o").alias(o), F.col("seq").alias(seq), F.col("marks").alias(marks), F.col("asked").alias(asked))
        full = part.join(both, [o, seq], "left").select(*[F.col(f"`{c}`") for c in docs.columns], o, seq, marks, asked)
        out = full.mapInArrow(scan.tidy(_finish(len(docs.columns), docs.columns.index(text), schema.names, keep_text)), schema)
        out = stored(out.select(*[F.col(f"`{c}`") for c in columns], o, seq, n_words, n_removed, left, proofs), "kept")
        discard(spans)
        seen = out.select(F.explode(proofs).alias("p")).groupBy("p.o", "p.seq", "p.a", "p.b").agg(F.min("p.d").alias("x"), F.max("p.d").alias("y"), F.min(F.when(F.col("p.own"), F.col("p.d"))).alias("source"))
        seen = seen.where("x <> y")
        if seen.isEmpty():
            for table in (held, *used):
                discard(table)
            whole = out
            for found in outs:
                whole = whole.unionByName(found)
            return whole.drop(o, seq, proofs), [n_words, n_removed, left]
        copies = out.select(F.col(o).alias("by"), F.col(seq).alias("by_seq"), F.explode(proofs).alias("p")).select("by", "by_seq", "p.*").where("not own")
        wrong = stored(copies.join(seen.drop("x", "y"), ["o", "seq", "a", "b"]).where("not d <=> source").select("by", "by_seq", "o", "seq", "a", "b").distinct(), "wrong")
        ids = stored(wrong.select(F.col("by").alias(o), F.col("by_seq").alias(seq)).union(wrong.select("o", "seq")).distinct(), "ids")
        outs.append(out.join(ids, [o, seq], "left_anti").select(*out.columns))
        part = part.join(ids, [o, seq], "left_semi").select(*part.columns)
        right = _right(held, wrong, ids.toDF("o", "seq"), k)
        discard(held)
        discard(wrong)
    raise RuntimeError("no hashes were found that tell all edges apart")


def _right(held: DataFrame, wrong: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The runs of some documents without those that touch a wrong piece; the edges of these have their sources in the same documents."""
    bad = wrong.select(F.col("by").alias("o"), F.col("by_seq").alias("seq"), F.col("o").alias("so"), F.col("seq").alias("sseq"), "a", "b")
    own = held.join(ids, ["o", "seq"], "left_semi")
    same = F.lit(True)
    for c in ("o", "seq", "so", "sseq"):
        same = same & (own[c] == bad[c])
    touches = (bad["a"] < own["sstart"] + own["edges"] + (k - 1)) & (bad["b"] > own["sstart"])
    return stored(own.join(bad, same & touches, "left_anti"), "right")


def _keyed(docs: DataFrame, doc_id: str, text: str, o: str, seq: str) -> tuple[DataFrame, list[DataFrame]]:
    """docs with the id as a number and, where rows repeat an id, a number for each of its texts; and the stored tables that this reads."""
    out = docs.withColumn(o, row_order(doc_id))
    again = out.groupBy(o).agg(F.count("*").alias("n")).where("n > 1").select(o)
    if again.isEmpty():
        return out.withColumn(seq, F.lit(0)), []
    (digest,) = fresh(out, "digest")
    out = out.withColumn(digest, F.xxhash64(F.col(f"`{text}`")))
    texts = stored(out.join(again, o, "left_semi").select(o, digest).distinct(), "texts")
    numbers = stored(texts.withColumn(seq, F.row_number().over(Window.partitionBy(o).orderBy(digest))), "numbers")
    return out.join(numbers, [o, digest], "left").withColumn(seq, F.coalesce(F.col(seq), F.lit(0))).drop(digest), [texts, numbers]
