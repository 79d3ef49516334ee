"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A document's set holds its distinct shingles of ``k`` words; with fewer words, but not none, the whole
sequence is the one shingle. Documents are linked if the Jaccard similarity of their sets is at least
``percent`` hundredths, and a group is what links connect.

1. One scan gives each document its set's size and 128-bit digest and the band hashes of its signature.
   Documents with equal sets become one node, so exact copies cost one pre-aggregated row.
2. Nodes that share a band are candidates. In each bucket the hub is the node with most company in all
   its buckets, and every other node is compared with it on full sets. A family of edited copies meets
   at its original that way, in as many comparisons as there are nodes.
3. Buckets where nodes other than the hub are still in different groups go on to an exact search that
   emits no pairs of one group: a prefix join, rarest shingles first, with bounds on size and position
   that no linked pair can miss. What it finds is compared on full sets too.

32 bands of 4 places miss a link of similarity 0.85 with probability 6e-11, of 0.8 with 5e-8.

Null, empty and blank texts have no set, no links and are their own group. Rows with a null id are
documents whose id is below all others. Repeated rows and ids are documents of their own that may
share an id. No rows: no groups. Texts are never cut. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docugauge.llm import scan, superminhash
from docugauge.llm.components import components
from docugauge.llm.frames import discard, fresh, row_order, stored

PLACES, BANDS = 128, 32
_LOWEST = -(2**63)


def _sketches(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch.column(2), scan.SLICE // 2, lower):
                sets = superminhash.shingle_sets(scan.Words(part, scan.WHITE), k)
                bands = superminhash.band_hashes(superminhash.signatures(sets, PLACES), BANDS)
                names = [superminhash.digest(s) for s in sets]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                where = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(where), pa.array(bands[size > 0].reshape(-1)))
                own = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(size), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), held], names=["o", "th", "n", "d1", "d2", "bands"])

    return run


def _checked(k: int, lower: bool, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x, y = ([s for part in scan.slices(some.column(i), lower=lower) for s in superminhash.shingle_sets(scan.Words(part, scan.WHITE), k)] for i in (2, 3))
                counts = [superminhash.jaccard_counts(a, b) for a, b in zip(x, y)]
                linked = pa.array([len(a) > 0 and 100 * both >= percent * either for a, (both, either) in zip(x, counts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(linked)

    return run


def _exploded(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch.column(2), scan.SLICE // 4, lower):
                sets = superminhash.shingle_sets(scan.Words(part, scan.WHITE), k)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                own = batch.slice(part.first, part.rows)
                line = np.repeat(np.arange(len(sets)), size)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(line)), own.column(1).take(pa.array(line)), pa.array(size[line]), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "c", "n", "e"])

    return run


def groups(docs: DataFrame, *, k: int, percent: int, lower: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: o (its id, null as the smallest long), th (xxhash64 of its text), n (set size), g (a number of its group, null without a set), root (the least o of its group)."""
    rows = docs.select(row_order(doc_id).alias("o"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    members = stored(rows.mapInArrow(scan.tidy(_sketches(k, lower)), "o long, th long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    first = F.min(F.struct("o", "th")).alias("first")
    nodes = members.where("n > 0").groupBy("d1", "d2").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("d1", "d2", "first.o", "first.th", "n", "bands").withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _links(rows, nodes, k, percent, lower)
    roots = components(links, "a", "b")
    joined = nodes.select("d1", "d2", "o", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(joined.groupBy("root").agg(F.min("o").alias("least")), "roots")
    fate = stored(joined.join(least, "root").select("d1", "d2", F.col("root").alias("g"), F.col("least").alias("root")), "fates")
    for used in (nodes, links, roots, least):
        discard(used)
    out = members.select("o", "th", "n", "d1", "d2").join(fate, ["d1", "d2"], "left")
    return out.select("o", "th", "n", "g", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("o")).alias("root"))


def _links(rows: DataFrame, nodes: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """Verified links (a, b) that connect what all links connect."""
    bands = nodes.select("node", "n", F.explode("bands").alias("h"))
    buckets = stored(bands.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = stored(bands.join(buckets, "h"), "met")
    company = stored(met.groupBy("node").agg(F.sum("size").alias("company")), "company")
    ranked = met.join(company, "node")
    hubs = stored(ranked.groupBy("h").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"), F.col("n").alias("hub_n"))).alias("x")).select("h", (-F.col("x.minus")).alias("hub"), "x.hub_n"), "hubs")
    with_hub = met.join(hubs, "h").where("node <> hub")
    pairs = stored(with_hub.where(_near_in_size("n", "hub_n", percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    texts = stored(rows.join(nodes.select("o", "th", "node").join(company.select("node"), "node", "left_semi"), ["o", "th"]).dropDuplicates(["o", "th", "node"]).select("node", "text"), "texts")
    links = stored(_verified(pairs, texts, k, percent, lower), "links")
    roots = components(links, "a", "b")
    others = stored(with_hub.where("size > 2").select("h", "node").join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("c")), "others")
    split = stored(others.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h"), "split")
    rest = others.join(split, "h", "left_semi").select("node", "c").distinct()
    more = _prefix_pairs(texts.join(rest, "node").select("node", "c", "text"), k, percent, lower)
    out = stored(links.union(_verified(more, texts, k, percent, lower)), "links")
    for used in (buckets, met, company, hubs, pairs, texts, links, roots, others, split, more):
        discard(used)
    return out


def _near_in_size(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= percent * F.greatest(F.col(a), F.col(b))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(scan.tidy(_checked(k, lower, percent)), "a long, b long")


def _prefix_pairs(nodes: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """Pairs (a, b), stored, of nodes of different groups c that may be linked: every pair that is, and few others.

    Linked sets of sizes x and y share at least s = percent * (x + y) / (100 + percent) shingles. In any
    one order of all shingles, the first that both hold is at places i and j with i <= x - s and j <= y - s.
    """
    held = stored(nodes.mapInArrow(scan.tidy(_exploded(k, lower)), "node long, c long, n long, e long"), "shingles")
    often = stored(held.groupBy("e").agg(F.count("*").alias("f")).where("f > 1"), "often")
    # Shingles of one node alone come first in the order; they are only counted.
    shared = held.join(often, "e").groupBy("node", "c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s"))
    own = F.col("n") - F.size("s")
    first = (F.floor((100 - percent) * F.col("n") / 100) + 1).cast("int")  # with the other set no smaller than percent hundredths
    placed = shared.select("node", "c", "n", F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), first - own).cast("int"))), own.alias("own")).select("node", "c", "n", F.col("col.e").alias("e"), (F.col("own") + F.col("pos")).alias("i"))
    placed = stored(placed, "prefixes")
    x, y = (placed.select("e", *[F.col(c).alias(f"{c}{s}") for c in ("node", "c", "n", "i")]) for s in "xy")
    least = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent) - 1e-9)
    fits = (F.col("nodex") < F.col("nodey")) & (F.col("cx") != F.col("cy")) & _near_in_size("nx", "ny", percent) & (F.col("ix") <= F.col("nx") - least) & (F.col("iy") <= F.col("ny") - least)
    found = stored(x.join(y, (x.e == y.e) & fits).select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct(), "pairs")
    for used in (held, often, placed):
        discard(used)
    return found


def unique_documents(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """docs with one row of each group: that of the smallest id. Rows without a set stay; rows of one id and text count once."""
    o, th = fresh(docs, "o", "th")
    found = groups(docs, k=k, percent=percent, lower=lower, doc_id=doc_id, text=text)
    least = found.where("n > 0").groupBy("g").agg(F.min(F.struct("o", "th")).alias("x")).select("x.o", "x.th")
    stay = stored(least.union(found.where("n = 0").select("o", "th")).select(F.col("o").alias(o), F.col("th").alias(th)), "stay")
    keyed = docs.withColumn(o, row_order(doc_id)).withColumn(th, F.xxhash64(F.col(f"`{text}`")))
    return keyed.join(stay, [o, th], "left_semi").dropDuplicates([o, th]).select(*[F.col(f"`{c}`") for c in docs.columns])
