"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training text.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. A window is ``n``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Every
document window is looked up by hash, and what is found is compared word by word before it counts.

The index is flat: the items' words in one buffer, and for each window its hash, place and item, about 30
bytes a word of benchmark. The benchmark is measured before it is broadcast. Beyond ``block_bytes`` of text
it is dealt into blocks by a hash of its items, and the documents pass through one scan per block, each
adding its hits to the row and storing it, before the next block is built: neither driver nor workers hold
more than one block, or one longer item. No row is shuffled either way.

Null and empty texts have no words, no hits, and are never contaminated. Repeated rows are judged one
by one and stay repeated. An item with a null id hits words but isn't counted or named; repeated items
count once. An empty benchmark hits nothing. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docugauge.llm import scan
from docugauge.llm.frames import discard, fresh, stored

#: Words of a window, and benchmark text in one broadcast.
N, BLOCK_BYTES = 13, 16 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def hit_columns(docs: DataFrame, benchmark: DataFrame, *, n: int = N, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """docs with three more columns: words, ranges of words in hit windows, and ids of the items hit (sorted strings).

    The names are changed, as by ``fresh``, only if docs has them already; read them off the last three columns.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = fresh(docs, *names)
    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], SPAN), T.StructField(names[2], T.ArrayType(T.StringType()))]
    schema, out = T.StructType([*docs.schema.fields, *added]), docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(build_index(part.toArrow(), n))
        before, out = out, out.mapInArrow(scan.tidy(_scanner(index, docs.columns.index(text), schema.names, k > 0)), schema)
        if k + 1 < blocks:
            out = stored(out, "hits")
            index.destroy()
            if k:
                discard(before)
    return out


class Index:
    """The windows of some items: hashes in order, and where each is in a buffer of words joined by one space.

    Equal windows follow each other as one run, or more if another of their hash is between; items of run r: item[run_start[r]] .. item[run_start[r + 1]].
    """

    def __init__(self, size: int, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, buffer: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")  # windows come by place
        self.size, self.item = size, item[order]
        hashes, begin, end = hashes[order], begin[order], end[order]
        new = np.ones(len(hashes), dtype=bool)
        for i in np.flatnonzero(hashes[1:] == hashes[:-1]).tolist():
            new[i + 1] = not np.array_equal(buffer[begin[i] : end[i]], buffer[begin[i + 1] : end[i + 1]])
        self.run_start = np.append(np.flatnonzero(new), len(hashes))
        self.known, self.run_begin, self.run_end = (x[self.run_start[:-1]] for x in (hashes, begin, end))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def runs(self, windows: np.ndarray) -> np.ndarray:
        """Of the windows that may be known, their places, and the first run with their hash."""
        maybe = np.flatnonzero(self.bits[(windows >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, windows[maybe]), len(self.known) - 1)
        good = self.known[at] == windows[maybe]
        return maybe[good], at[good]


def build_index(items: pa.Table, n: int) -> tuple[np.ndarray, list, list[Index]]:
    """The buffer, the items' ids, and an index for each length of windows."""
    found: dict[int, list[tuple]] = {}
    buffers, base, first_item = [], 0, 0
    for column in items["text"].chunks:
        for part in scan.slices(column, scan.SLICE // 8, lower=True):
            words = scan.Words(part, scan.ALNUM)
            data, ends = words.joined()
            hashes, length, row = words.hashes(), words.end - words.start, words.rows()
            place = np.arange(len(words)) - words.first[row]
            before = np.concatenate(([0], np.cumsum(length)))
            begin = base + ends[row] + before[:-1] - before[words.first[row]] + place
            whole = np.flatnonzero(scan.within_rows(words.first, n))
            for size, at in [(n, whole)] + [(m, words.first[:-1][words.count == m]) for m in range(1, n)]:
                if len(at):
                    last = at + size - 1
                    found.setdefault(size, []).append((scan.window_hashes(hashes, size)[at], begin[at].astype(np.uint32), (begin[last] + length[last]).astype(np.uint32), (first_item + part.first + row[at]).astype(np.int32)))
            buffers.append(data)
            base += len(data)
        first_item += len(column)
    buffer = np.concatenate([*buffers, np.zeros(0, np.uint8)])
    if base >= 1 << 32:
        raise ValueError("a block of the benchmark is beyond 4 GB")
    return buffer, items["item"].to_pylist(), [Index(size, *map(np.concatenate, zip(*parts)), buffer) for size, parts in found.items()]


def window_hits(words: scan.Words, hashes: np.ndarray, built: tuple) -> list[tuple[int, int, int, int]]:
    """(first word, words, number of the index, run) of each window of the slice that the index holds, compared byte by byte."""
    buffer, _, indexes = built
    out = []
    for number, index in enumerate(indexes):
        maybe, runs = index.runs(scan.window_hashes(hashes, index.size))
        ends = words.first[np.searchsorted(words.first, maybe, side="right")]
        inside = maybe + index.size <= ends
        for i, run in zip(maybe[inside].tolist(), runs[inside].tolist()):
            text, h = words.bytes_of(i, i + index.size), index.known[run]
            while run < len(index.known) and index.known[run] == h:
                if buffer[index.run_begin[run] : index.run_end[run]].tobytes() == text:
                    out.append((i, index.size, number, run))
                run += 1
    return out


def _items(hits: list[tuple], built: tuple) -> set:
    """The ids of the items that hold any of the runs; each run is looked up once."""
    _, ids, indexes = built
    return {ids[i] for number, run in {h[2:] for h in hits} for i in indexes[number].item[indexes[number].run_start[run] : indexes[number].run_start[run + 1]].tolist()}


def _scanner(index, text_at: int, names: list[str], again: bool):
    width = len(names) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, begins, items = [], [], []
            for part in scan.slices(batch.column(text_at), scan.SLICE // 2, lower=True):
                words = scan.Words(part, scan.ALNUM)
                hits: dict[int, list] = {}
                for hit in window_hits(words, words.hashes(), index.value):
                    hits.setdefault(int(np.searchsorted(words.first, hit[0], side="right")) - 1, []).append(hit)
                n_words += words.count.tolist()
                for row in range(part.rows):
                    got = hits.get(row, [])
                    found, seen = [], _items(got, index.value)
                    if again:
                        found = [(s["begin"], s["end"]) for s in batch.column(width + 1)[part.first + row].as_py()]
                        seen |= set(batch.column(width + 2)[part.first + row].as_py())
                    if got:
                        begin = int(words.first[row])
                        found += [(i - begin, i - begin + size) for i, size, _, _ in got]
                    begins.append([{"begin": a, "end": b} for a, b in _merged(found)])
                    items.append(sorted(x for x in seen if x is not None))
            made = [pa.array(n_words, pa.int64()), pa.array(begins, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:width] + made, names=names)

    return run


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judged(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> tuple[DataFrame, list[str]]:
    """docs with words, hit spans, hit items, hit words and whether contaminated: hit, and share * hits >= words. Second: those five names."""
    hits = hit_columns(docs, benchmark, **options)
    n_words, spans, items = hits.columns[-3:]
    n_hit, bad = fresh(hits, "n_hit", "contaminated")
    total = F.aggregate(F.col(f"`{spans}`"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    out = hits.withColumn(n_hit, total)
    return out.withColumn(bad, (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))), [n_words, spans, items, n_hit, bad]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns and whole texts."""
    out, names = judged(docs, benchmark, **options)
    return out.where(~F.col(names[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents; from those that were hit, the hit spans go, and what is left is lower-cased words joined by one space."""
    hits = hit_columns(docs, benchmark, text=text, **options)
    _, spans, _ = hits.columns[-3:]
    words = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    left = F.filter(words, lambda w, i: ~F.exists(F.col(f"`{spans}`"), lambda s: (s["begin"] <= i) & (i < s["end"])))
    cut = F.when(F.size(F.col(f"`{spans}`")) > 0, F.array_join(left, " ")).otherwise(F.col(f"`{text}`"))
    return hits.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
