"""Precision and recall curves over scores, and the operating point under a false-positive budget.

A scores table is long: a row per target with ``positive`` and ``score`` (higher: more reason to reject;
null: undecided), any key columns, and any grouping columns.

Counts above every threshold are one running sum over distinct scores, which are pre-aggregated first.
Scores are dealt into value ranges by approximate percentiles, so that the running sum of one group is
many tasks: sums within a range, plus the totals of the ranges above. The percentiles only place the
borders; every count is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docugauge.functions.stats import PREVALENCE, balanced_precision, prevalence_precision, ratio

#: False positives per target that a point may cost; ranges of a running sum (0: as many as a shuffle has partitions); what an empty dossier scores.
BUDGET, RANGES, NOTHING = 0.002, 0, -1e18


def _ranged(counts: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """counts with a range number that rises with the score; borders are the same for all rows of a group."""
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges <= 1:
        return counts.withColumn("_range", F.lit(0))
    shares = [i / ranges for i in range(1, ranges)]
    borders = counts.groupBy(*by).agg(F.percentile_approx("score", shares, 1000).alias("_borders"))
    joined = counts.crossJoin(F.broadcast(borders)) if not by else counts.join(borders, by)  # one row, or one a group
    return joined.withColumn("_range", F.size(F.filter("_borders", lambda b: b < F.col("score")))).drop("_borders")


def curve(scores: DataFrame, by: Sequence[str] = (), *, positive: str = "positive", score: str = "score", prevalence: float = PREVALENCE, ranges: int = RANGES) -> DataFrame:
    """All operating points: below the least score, between neighbouring scores, above the highest; ``fires`` is score > threshold.

    Columns: by, threshold, recall, fpr, grid_precision (tp of all that fire; 1 if none), prevalence_precision, tp, fp, n_pos, n_neg.
    Null scores and those of empty dossiers take no part.
    """
    by = list(by)
    own = scores.where(F.col(score).isNotNull() & (F.col(score) > NOTHING)).select(*by, F.col(positive).alias("positive"), F.col(score).cast("double").alias("score"))
    counts = own.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    # Always true, but so the borders need both counts as well, and all branches share one scan and shuffle.
    counts = counts.where(F.col("p") + F.col("n") > 0)
    counts = _ranged(counts, by, ranges)
    totals = counts.groupBy(*by, "_range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"), F.max("score").alias("top"))
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*by).orderBy("_range")
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *by, "_range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n_above"), F.lag("top").over(below).alias("top_below"),
        F.sum("rp").over(whole).alias("n_pos"), F.sum("rn").over(whole).alias("n_neg"), F.max("top").over(whole).alias("top"),
    )
    joined = counts.join(totals, [*by, "_range"])
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by, "_range").orderBy("score")
    before = F.coalesce(F.lag("score").over(up), F.col("top_below"))
    points = joined.select(*by, F.coalesce((before + F.col("score")) / 2, F.col("score") - 1.0).alias("threshold"), (F.col("p_above") + F.sum("p").over(down)).alias("tp"), (F.col("n_above") + F.sum("n").over(down)).alias("fp"), "n_pos", "n_neg")
    last = totals.select(*by, (F.col("top") + 1.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg").distinct()
    return with_rates(points.unionByName(last), prevalence)


def with_rates(points: DataFrame, prevalence: float = PREVALENCE) -> DataFrame:
    out = points.withColumns({"recall": ratio(F.col("tp"), F.col("n_pos")), "fpr": ratio(F.col("fp"), F.col("n_neg"))})
    out = out.withColumns({"grid_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "prevalence_precision": prevalence_precision(F.col("recall"), F.col("fpr"), prevalence)})
    last = ["threshold", "recall", "fpr", "grid_precision", "prevalence_precision", "tp", "fp", "n_pos", "n_neg"]
    return out.select(*[c for c in points.columns if c not in last], *last)


def balanced(points: DataFrame) -> DataFrame:
    return points.withColumn("balanced_precision", balanced_precision(F.col("recall"), F.col("fpr")))


def chosen_point(points: DataFrame, by: Sequence[str] = (), budget: float = BUDGET) -> DataFrame:
    """Of the points within the budget the one of highest recall, then least fpr; of equal ones the middle by threshold."""
    by = list(by)
    best = points.where(F.col("fpr") <= budget).groupBy(*by).agg(F.max(F.struct("recall", (-F.col("fpr")).alias("minus"))).alias("_best"))
    near = points.where(F.col("fpr") <= budget)
    near = near.crossJoin(F.broadcast(best)) if not by else near.join(best, by)
    near = near.where((F.col("recall") == F.col("_best.recall")) & (F.col("fpr") == -F.col("_best.minus"))).drop("_best")
    order = Window.partitionBy(*by).orderBy("threshold")
    size = F.count("*").over(Window.partitionBy(*by))
    return near.withColumns({"_n": size, "_i": F.row_number().over(order) - 1}).where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_n", "_i")


def operating_point(scores: DataFrame, by: Sequence[str] = (), budget: float = BUDGET, **options) -> DataFrame:
    return chosen_point(curve(scores, by, **options), by, budget)


def dossier_score(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """The highest score of each dossier; what an empty one scores if all are undecided."""
    return scores.groupBy(*by).agg(F.coalesce(F.max(score), F.lit(NOTHING)).alias("dossier_score"))


def fires(score: Column, threshold: Column) -> Column:
    """Strictly above; an undecided score doesn't fire and isn't compliant either."""
    return F.coalesce(score > threshold, F.lit(False))
