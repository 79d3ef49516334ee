"""Connected components of a table of edges, without gathering it anywhere.

Each partition first contracts its own edges with union-find to one edge per node. Then large-star and
small-star steps alternate: each node's larger, then its smaller neighbours are hung below the least of
them, until nothing changes and every node hangs below the least node of its component. A step's least
neighbours are pre-aggregated and stored before they are joined back, so that Spark may split the rows
of a node with very many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docugauge.llm.frames import discard, stored


def union_find(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The least node of each node's component."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(above)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    for batch in batches:
        pairs = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if a is not None and b is not None]
        held = union_find([*held.items(), *pairs])
    out = [(x, r) for x, r in held.items() if x != r]
    for at in range(0, len(out), 1 << 16):
        x, r = zip(*out[at : at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(r, pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """The next edges, stored; edges (a, b) with a > b."""
    if large:
        ways = edges.union(edges.select("b", "a"))  # (a, b): b is a neighbour of a
        least = stored(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
        out = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
        out = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    done = stored(out.where("a <> b").distinct(), "edges")
    discard(least)
    return done


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge, root the least node that can be reached. Loops, repeated and null edges change nothing."""
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    now = stored(pairs.mapInArrow(_contract, "a long, b long"), "edges")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))))
    seen = now.agg(mark).first()[0]
    while True:
        held = _star(now, large=True)
        new = _star(held, large=False)
        was, seen = seen, new.agg(mark).first()[0]
        discard(held)
        discard(now)
        now = new
        if seen == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
