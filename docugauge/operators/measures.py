"""What a threshold is worth: per target, per dossier, per factor, per crossing of factors.

All of it is two-level: targets are counted per dossier key first, which is a partial aggregation with
map-side combine, and everything else is sums over those small rows. Breakdowns over several factors are
one pass of grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docugauge.functions.stats import ratio, wilson
from docugauge.operators.curves import BUDGET, chosen_point, curve

RECALL_FLOOR, NOISY = 0.95, 8


def _above(threshold: Column | float) -> Column:
    return F.coalesce(F.col("score") > (F.lit(threshold) if not isinstance(threshold, Column) else threshold), F.lit(False))


def per_key(scores: DataFrame, keys: Sequence[str], threshold: Column | float, spine: DataFrame | None = None) -> DataFrame:
    """Counts per key; undecided scores count nowhere. spine: all keys, those without any target too."""
    decided, fired = F.col("score").isNotNull(), _above(threshold)
    out = scores.groupBy(*keys).agg(
        F.count_if(F.col("positive") & decided).alias("n_pos"), F.count_if(F.col("positive") & fired).alias("tp"),
        F.count_if(~F.col("positive") & decided).alias("n_neg"), F.count_if(~F.col("positive") & fired).alias("fp"),
    )
    if spine is not None:
        out = spine.select(*keys).distinct().join(out, list(keys), "left").fillna(0, ["n_pos", "tp", "n_neg", "fp"])
    return out.withColumn("hit", (F.col("fp") > 0).cast("long"))


def _summed(grouped, *more: Column) -> DataFrame:
    return grouped.agg(*more, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "n_pos", "n_neg", "hit")], F.count("*").alias("n_dossiers"))


def with_intervals(sums: DataFrame, digits: int | None = None) -> DataFrame:
    """Rates and their Wilson intervals. digits: of the irrational bounds."""
    show = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = sums.withColumns({"recall": ratio(F.col("tp"), F.col("n_pos")), "fpr": ratio(F.col("fp"), F.col("n_neg")), "dossier_fpr": ratio(F.col("hit"), F.col("n_dossiers"))})
    for name, k, n in (("recall", "tp", "n_pos"), ("fpr", "fp", "n_neg"), ("dossier_fpr", "hit", "n_dossiers")):
        low, high = wilson(F.col(k), F.col(n))
        out = out.withColumns({f"{name}_low": show(low), f"{name}_high": show(high)})
    return out.drop("hit")


def measure(scores: DataFrame, threshold: Column | float, keys: Sequence[str], by: Sequence[str] = (), spine: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """tp, fp, sizes, recall, fpr, the share of dossiers with any false alarm, and three intervals."""
    return with_intervals(_summed(per_key(scores, [*by, *[k for k in keys if k not in by]], threshold, spine).groupBy(*by)), digits)


def by_factor(scores: DataFrame, threshold: Column | float, keys: Sequence[str], axes: Sequence[str], digits: int | None = None) -> DataFrame:
    """measure for each value of each axis: axis, value, recall, n, fpr, dossier_fpr and the recall's interval."""
    rows = per_key(scores, list(dict.fromkeys([*keys, *axes])), threshold)
    out = with_intervals(_summed(rows.groupingSets([[a] for a in axes], *axes), *_axis(axes)), digits)
    return out.select("axis", "value", "recall", F.col("n_pos").alias("n"), "fpr", "dossier_fpr", F.col("recall_low").alias("low"), F.col("recall_high").alias("high"))


def _axis(axes: Sequence[str]) -> tuple[Column, Column]:
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in axes:
        name, value = F.when(F.grouping(a) == 0, a).otherwise(name), F.when(F.grouping(a) == 0, F.col(a).cast("string")).otherwise(value)
    return name.alias("axis"), value.alias("value")


def factor_sums(scores: DataFrame, threshold: Column | float, axes: Sequence[str]) -> DataFrame:
    """tp and n_pos per cell, a cell being a value of every axis; replicates are pooled."""
    decided = F.col("score").isNotNull() & F.col("positive")
    return scores.groupBy(*axes).agg(F.count_if(decided & _above(threshold)).alias("tp"), F.count_if(decided).alias("n"))


def fallen_cells(scores: DataFrame, threshold: Column | float, axes: Sequence[str], least: float = RECALL_FLOOR) -> DataFrame:
    """All cells with recall (0 without positives) and whether it is below the floor."""
    recall = F.col("tp") / F.greatest(F.col("n"), F.lit(1))
    return factor_sums(scores, threshold, axes).withColumn("recall", recall).withColumn("fallen", F.col("recall") < least)


def frontier(cells: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Fallen and all cells per value of each axis."""
    sums = cells.groupingSets([[a] for a in axes], *axes).agg(*_axis(axes), F.count_if("fallen").alias("fallen"), F.count("*").alias("cells"))
    return sums.select("axis", "value", "fallen", "cells")


def worst_conjunctions(scores: DataFrame, threshold: Column | float, axes: Sequence[str], how_many: int = 3, digits: int | None = None) -> DataFrame:
    """The crossings of two factors with the least recall, so many for each pair; ties by the values."""
    pairs = list(combinations(axes, 2))
    cells = factor_sums(scores, threshold, axes)
    out = cells.groupingSets([list(p) for p in pairs], *axes).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.grouping_id(*axes).alias("_g"))
    full = (1 << len(axes)) - 1
    pair, left, right = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, b in pairs:
        here = F.col("_g") == full - (1 << (len(axes) - 1 - axes.index(a))) - (1 << (len(axes) - 1 - axes.index(b)))
        pair, left, right = F.when(here, f"{a} x {b}").otherwise(pair), F.when(here, F.col(a).cast("string")).otherwise(left), F.when(here, F.col(b).cast("string")).otherwise(right)
    out = out.select(pair.alias("pair"), left.alias("left_value"), right.alias("right_value"), (F.col("tp") / F.greatest(F.col("n"), F.lit(1))).alias("recall"), "tp", "n")
    rank = F.row_number().over(Window.partitionBy("pair").orderBy("recall", "left_value", "right_value"))
    low, high = wilson(F.col("tp"), F.col("n"))
    show = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return out.withColumns({"rank": rank, "low": show(low), "high": show(high)}).where(F.col("rank") <= how_many).drop("tp")


def noisy_targets(scores: DataFrame, threshold: Column | float, target: Sequence[str], how_many: int = NOISY) -> DataFrame:
    """The clean targets that fire most often: fired and seen; ties by the target."""
    out = scores.where(~F.col("positive") & F.col("score").isNotNull()).groupBy(*target).agg(F.count_if(_above(threshold)).alias("fired"), F.count("*").alias("seen"))
    return out.where("fired > 0").orderBy(F.desc("fired"), *target).limit(how_many)


def full_recall_threshold(scores: DataFrame, by: Sequence[str] = (), floor: float = RECALL_FLOOR) -> DataFrame:
    """Just below the positive score at the rank that keeps the recall floor: an exact order statistic.

    The rank is rounded half to even. Equal scores are counted together first and found by a running sum.
    """
    by = list(by)
    pos = scores.where(F.col("positive") & F.col("score").isNotNull()).groupBy(*by, "score").agg(F.count("*").alias("k"))
    part = Window.partitionBy(*by)
    upto = F.sum("k").over(part.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("k").over(part)
    place = F.least(n - 1, F.bround((1 - floor) * n, 0).cast("long"))
    ranked = pos.withColumns({"_upto": upto, "_place": place}).where(F.col("_upto") > F.col("_place"))
    return ranked.groupBy(*by).agg((F.min("score") - 1e-9).alias("full_recall"))


def certifiability(scores: DataFrame, target: Sequence[str], by: Sequence[str] = (), budget: float = BUDGET, floor: float = RECALL_FLOOR) -> DataFrame:
    """Each clean target's rate of firing at full recall, and whether the tool can certify it."""
    least = full_recall_threshold(scores, by, floor)
    neg = scores.where(~F.col("positive") & F.col("score").isNotNull())
    joined = neg.join(least, list(by)) if by else neg.crossJoin(F.broadcast(least))
    out = joined.groupBy(*by, *target).agg(F.count_if(F.col("score") > F.col("full_recall")).alias("fired"), F.count("*").alias("seen"))
    return out.withColumn("rate", F.col("fired") / F.col("seen")).withColumn("certifiable", F.col("rate") <= budget)


def restricted(scores: DataFrame, kept: DataFrame, target: Sequence[str]) -> DataFrame:
    """Positives, and of the negatives those of kept targets."""
    return scores.where("positive").unionByName(scores.where(~F.col("positive")).join(kept.select(*target), list(target), "left_semi").select(*scores.columns))


def restricted_to_certifiable(scores: DataFrame, target: Sequence[str], keys: Sequence[str], calibrate: Column, report: Column, budget: float = BUDGET, digits: int | None = None) -> DataFrame:
    """What the check is worth if it is only asked about targets it can certify; no row if it can certify none or all."""
    rated = certifiability(scores.where(calibrate), target, budget=budget)
    sizes = rated.agg(F.count_if("certifiable").alias("kept_targets"), F.count("*").alias("total_targets"))
    some = restricted(scores, rated.where("certifiable"), target)
    point = chosen_point(curve(some.where(calibrate)), budget=budget).select("threshold")
    rows = some.where(report).crossJoin(F.broadcast(point))
    out = measure(rows, F.col("threshold"), keys, ["threshold"], digits=digits)
    return out.crossJoin(F.broadcast(sizes)).where((F.col("kept_targets") > 0) & (F.col("kept_targets") < F.col("total_targets")))


def crosstalk(trials: DataFrame, digits: int | None = None) -> DataFrame:
    """trials (check, defect, dossier, instance, score, threshold): for each check and other check's defect, how often any target fires.

    A trial is one instance of one dossier; undecided scores don't fire. The diagonal is left out.
    """
    one = trials.where("check <> defect").groupBy("check", "defect", "dossier", "instance").agg(F.max(F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).cast("int")).alias("fired"))
    out = one.groupBy("check", "defect").agg(F.sum("fired").cast("long").alias("fired"), F.count("*").alias("n"))
    low, high = wilson(F.col("fired"), F.col("n"))
    show = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return out.withColumns({"rate": ratio(F.col("fired"), F.col("n")), "low": show(low), "high": show(high)})


def duel(scores: DataFrame, setting: str, axis: str, keys: Sequence[str], budget: float = BUDGET, digits: int | None = None) -> DataFrame:
    """Every setting at its own operating point, per value of an axis, with its overall recall and rank."""
    points = chosen_point(curve(scores, [setting]), [setting], budget).select(setting, "threshold", F.col("recall").alias("global_recall"), F.col("fpr").alias("global_fpr"))
    rows = scores.join(points, setting)
    out = measure(rows, F.col("threshold"), keys, [setting, axis, "threshold", "global_recall", "global_fpr"], digits=digits)
    rank = F.dense_rank().over(Window.orderBy(F.desc("global_recall"), "global_fpr", setting))
    ranks = points.withColumn("place", rank).select(setting, "place")  # one row a setting
    return out.join(ranks, setting)


def duel_verdicts(scores: DataFrame, setting: str, axis: str, keys: Sequence[str], budget: float = BUDGET) -> DataFrame:
    """Per value of the axis the winners, and whether several settings tie for best overall."""
    table = duel(scores, setting, axis, keys, budget)
    best = F.max("recall").over(Window.partitionBy(axis))
    winners = table.withColumn("_best", best).where(F.col("recall") == F.col("_best")).groupBy(axis).agg(F.array_join(F.array_sort(F.collect_set(setting)), "+").alias("winners"), F.max("recall").alias("recall"))
    overall = table.groupBy(setting).agg(F.first("global_recall").alias("r"), F.first("global_fpr").alias("f"))
    top = overall.agg(F.max(F.struct("r", (-F.col("f")).alias("m"))).alias("x"))
    ties = overall.crossJoin(F.broadcast(top)).where((F.col("r") == F.col("x.r")) & (F.col("f") == -F.col("x.m"))).agg((F.count("*") > 1).alias("tie"))
    return winners.crossJoin(F.broadcast(ties))


def drops(table: DataFrame, setting: str, axis: str, clean: str, dirty: str) -> DataFrame:
    """How much recall each setting loses from one value of the axis to another."""
    value = lambda v: F.max(F.when(F.col(axis).cast("string") == v, F.col("recall")))
    return table.groupBy(setting).agg(value(clean).alias("clean_recall"), value(dirty).alias("dirty_recall")).withColumn("drop", F.col("clean_recall") - F.col("dirty_recall"))


def frozen_report(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """measure of rows scored at frozen thresholds, without the abstained, which are counted beside it."""
    decided = rows.where(F.col("score").isNotNull())
    out = measure(decided, F.col("threshold"), keys, [*by, "threshold"], digits=digits)
    abstained = rows.groupBy(*by, "threshold").agg(F.count_if(F.col("positive") & F.col("score").isNull()).alias("abstained_pos"), F.count_if(~F.col("positive") & F.col("score").isNull()).alias("abstained_neg"))
    return abstained.join(out, [*by, "threshold"], "left").withColumn("recall_abstention_as_miss", ratio(F.coalesce("tp", F.lit(0)), F.coalesce("n_pos", F.lit(0)) + F.col("abstained_pos")))


def grouped_rates(rows: DataFrame, fired: Column, sets: Sequence[Sequence[str]], digits: int | None = None, present: Sequence[str] = ()) -> DataFrame:
    """Fired, n, rate and interval for each of several groupings in one pass, named in ``grouping``; a column that a grouping lacks is null there.

    present: a grouping that has one of these columns leaves out the rows where it is null.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.withColumn("_fired", F.coalesce(fired, F.lit(False))).groupingSets([list(s) for s in sets], *names).agg(F.count_if("_fired").alias("fired"), F.count("*").alias("n"), F.grouping_id(*names).alias("_set"))
    has = {c: F.col("_set").bitwiseAND(1 << (len(names) - 1 - i)) == 0 for i, c in enumerate(names)}
    for c in present:
        out = out.where(~has[c] | F.col(c).isNotNull())
    low, high = wilson(F.col("fired"), F.col("n"))
    show = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    named = F.concat_ws("+", *[F.when(has[c], F.lit(c)) for c in names])
    return out.withColumns({"grouping": named, "rate": ratio(F.col("fired"), F.col("n")), "low": show(low), "high": show(high)}).drop("_set")


def shape_split(rows: DataFrame, fired: Column, level: str = "level", shape: str = "shape", digits: int | None = None) -> DataFrame:
    """Rates per level over all shapes, and per level and shape. A row without a shape (no ink was laid) counts in the former only."""
    return grouped_rates(rows, fired, [[level], [level, shape]], digits, [shape])
