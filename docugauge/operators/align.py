"""Sequence alignment that tolerates one shift, neighbour correction, and baselines of the same sheet.

An alignment is relational: the three hypotheses (no shift, one observed item too many, one expected item
missing, each from the first disagreement on) are joins of two numbered sequences at an offset, and a
hypothesis holds if all its later places agree. Batches are independent, so all are aligned at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docugauge.functions.text import NEAR

Match = Callable[[Column, Column], Column]


def _equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def align(observed: DataFrame, expected: DataFrame, batch: str = "batch", place: str = "place", value: str = "value", matches: Match = _equal) -> DataFrame:
    """batch, observed place, expected place: pairs, and unpaired places with a null on the other side. Places count from 0.

    If exactly one single shift at the first disagreement explains every later place, that is the alignment.
    Otherwise places that agree as they are pair, and the others don't.
    """
    o = observed.select(F.col(batch).alias("b"), F.col(place).cast("int").alias("op"), F.col(value).alias("ov"))
    e = expected.select(F.col(batch).alias("b"), F.col(place).cast("int").alias("ep"), F.col(value).alias("ev"))
    sizes = o.groupBy("b").agg(F.count("*").alias("n")).join(e.groupBy("b").agg(F.count("*").alias("m")), "b", "full").fillna(0, ["n", "m"])
    same = o.join(e, (o.b == e.b) & (o.op == e.ep)).select(o.b.alias("b"), "op", "ep", F.coalesce(matches(F.col("ov"), F.col("ev")), F.lit(False)).alias("ok"))
    first = same.where("NOT ok").groupBy("b").agg(F.min("op").alias("f"))
    info = sizes.join(first, "b", "left").withColumn("f", F.coalesce("f", F.least("n", "m")).cast("int"))
    straight = (F.col("f") >= F.least("n", "m")) & (F.col("n") == F.col("m"))

    def explains(o_off: int, e_off: int) -> DataFrame:
        """Batches in which a shift pairs all later places, and they agree."""
        right = F.col("n") - o_off == F.col("m") - e_off
        pairs = o.join(info.where(right & ~straight).select("b", "f"), "b").where(F.col("op") >= F.col("f") + o_off)
        pairs = pairs.join(e.withColumnRenamed("b", "eb"), (F.col("b") == F.col("eb")) & (F.col("ep") == F.col("op") - o_off + e_off), "left")
        bad = pairs.groupBy("b").agg(F.count_if(~F.coalesce(matches(F.col("ov"), F.col("ev")), F.lit(False))).alias("bad"))
        return info.where(right & ~straight).select("b").join(bad, "b", "left").where(F.coalesce("bad", F.lit(0)) == 0).select("b", F.lit(True).alias(f"s{o_off}{e_off}"))

    choice = info.join(explains(1, 0), "b", "left").join(explains(0, 1), "b", "left")
    choice = choice.withColumn("shift", F.when(straight, 0).when(F.col("s10") & F.col("s01").isNull(), 1).when(F.col("s01") & F.col("s10").isNull(), -1))
    choice = choice.select("b", "f", "shift", "n", "m")
    moved = o.join(choice, "b").withColumn("want", F.when(F.col("shift").isNull() | (F.col("shift") == 0) | (F.col("op") < F.col("f")), F.col("op")).when((F.col("shift") == 1) & (F.col("op") == F.col("f")), F.lit(None)).otherwise(F.col("op") - F.col("shift")))
    joined = moved.join(e.withColumnRenamed("b", "eb"), (F.col("b") == F.col("eb")) & (F.col("want") == F.col("ep")), "left")
    agree = F.coalesce(matches(F.col("ov"), F.col("ev")), F.lit(False)) & F.col("ep").isNotNull()
    paired = joined.where(agree).select("b", "op", "ep")
    lone_o = o.select("b", "op").join(paired, ["b", "op"], "left_anti").select("b", "op", F.lit(None).cast("int").alias("ep"))
    lone_e = e.select("b", "ep").join(paired, ["b", "ep"], "left_anti").select("b", F.lit(None).cast("int").alias("op"), "ep")
    return paired.unionByName(lone_o).unionByName(lone_e).select(F.col("b").alias(batch), F.col("op").alias("observed"), F.col("ep").alias("expected"))


def neighbour_fix(rows: DataFrame, batch: Sequence[str], order: str, observed: str, expected: str, matches: Match) -> DataFrame:
    """rows with ``fixed`` (0 its own row, -1 the previous, 1 the next whose expectation it meets) or null if none does."""
    w = Window.partitionBy(*batch).orderBy(order)
    back, ahead = F.lag(expected).over(w), F.lead(expected).over(w)
    ok = lambda e: F.coalesce(matches(F.col(observed), e), F.lit(False))
    out = rows.withColumns({"_back": back, "_ahead": ahead})
    return out.withColumn("fixed", F.when(ok(F.col(expected)), 0).when(ok(F.col("_back")), -1).when(ok(F.col("_ahead")), 1)).drop("_back", "_ahead")


def added_words(words: DataFrame, printed: DataFrame, by: Sequence[str], text: str = "text", x: str = "cx", y: str = "cy", radius: float = NEAR) -> DataFrame:
    """The words that no printed one of the same page, text and place accounts for; null texts and places match nothing.

    Words meet by page, text and cell of a grid as wide as the radius, a printed one in its cell and those
    around it, so that a word which a page is full of is compared with its neighbours alone.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    known = printed.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(text).alias("_t"), F.col(x).alias("_px"), F.col(y).alias("_py"), F.explode(near).alias("_n"))
    known = known.withColumns({"_kx": cell("_px") + F.col("_n.i"), "_ky": cell("_py") + F.col("_n.j")}).drop("_n")
    held = words.withColumns({"_cx": cell(x), "_cy": cell(y)})
    same = (F.col(text) == F.col("_t")) & (F.col("_cx") == F.col("_kx")) & (F.col("_cy") == F.col("_ky"))
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    apart = (F.col(x) - F.col("_px")) * (F.col(x) - F.col("_px")) + (F.col(y) - F.col("_py")) * (F.col(y) - F.col("_py"))
    return held.join(known, same & (apart <= radius * radius), "left_anti").drop("_cx", "_cy")


def against_baseline(rows: DataFrame, sheet: Sequence[str], step: str, order: str, value: str) -> DataFrame:
    """rows with the value of their own sheet's last row at step 0."""
    base = rows.where(F.col(step) == 0).groupBy(*sheet).agg(F.max_by(value, order).alias("baseline"))
    return rows.join(base, list(sheet), "left")


def ingest(captures: DataFrame, checklist: DataFrame, batch: str = "batch", name_matches: Match | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and excluded rows with a reason; every capture and every checklist line is in one of them.

    captures: batch, file, ts, code, name. checklist: batch, line, sheet_code, identity, piece, variant, instance, mark_step, dpi, name.
    """
    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1)
    seen, lines = number(captures, ["ts", "file"]), number(checklist, ["line"])
    pairs = align(seen.withColumnRenamed("code", "value"), lines.withColumnRenamed("sheet_code", "value"), batch)
    s = seen.select(batch, F.col("place").alias("observed"), "file", "ts", "code", F.col("name").alias("seen_name"))
    c = lines.withColumnRenamed("place", "expected")
    both = pairs.join(s, [batch, "observed"], "left").join(c, [batch, "expected"], "left")
    lost = both.where("observed IS NULL OR expected IS NULL").select(batch, F.when(F.col("expected").isNull(), "sheet code did not pair").otherwise("checklist line has no capture").alias("reason"), "file", "line")
    kept = both.where("observed IS NOT NULL AND expected IS NOT NULL")
    if name_matches is None:
        return kept.select(batch, "file", "ts", *[x for x in checklist.columns if x != batch]), lost
    fixed = neighbour_fix(kept, [batch], "expected", "seen_name", "name", name_matches)
    wrong = fixed.where("fixed IS NULL").select(batch, F.lit("identity mismatch").alias("reason"), "file", "line")
    place = Window.partitionBy(batch).orderBy("expected")
    own = fixed.withColumn("_n", F.row_number().over(place))
    target = own.where("fixed IS NOT NULL").select(batch, "file", "ts", (F.col("_n") + F.col("fixed")).alias("_n"))
    rows = own.select(batch, "_n", *[x for x in checklist.columns if x != batch])
    return target.join(rows, [batch, "_n"]).drop("_n"), lost.unionByName(wrong)
