"""The measuring protocol: from complete dossiers to thresholds, domains, frozen scores and reports.

Every step is a query over the long table of labelled scores (operators.dossiers.labelled), in which all
settings of a check are side by side; nothing is swept in a loop, and no step changes what another reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docugauge.functions.stats import ratio, wilson
from docugauge.operators import curves, measures
from docugauge.operators.broadcasts import small
from docugauge.operators.checks import Dimensions, scored
from docugauge.operators.curves import BUDGET
from docugauge.operators.dossiers import labelled
from docugauge.operators.measures import RECALL_FLOOR
from docugauge.schema import CHECKS, READING_CHECKS

# Resolutions that a domain may begin at, and how many estimator errors the floor keeps below it.
DOMAINS, MARGIN, LEAST_MARGIN = (96, 150, 200, 300), 10, 0.01


def sweep(dossiers: DataFrame, dims: Dimensions, settings: DataFrame, damaged: DataFrame, keys: Sequence[str], checks: Sequence[str] = CHECKS, legacy: Sequence[str] = ()) -> DataFrame:
    """Labelled scores of every target under every setting, abstention off, undecided ones left out."""
    found = scored(dossiers, dims, settings, [*keys, "variant"], checks, abstention=False).where("score IS NOT NULL")
    out = None
    for check in checks:
        part = labelled(found.where(F.col("check") == check), damaged, check, keys, legacy)
        out = part if out is None else out.unionByName(part)
    return out


def best_setting(scores: DataFrame, by: Sequence[str] = (), budget: float = BUDGET, setting: str = "setting_id") -> DataFrame:
    """The setting of highest recall, then least fpr, at its own point on calibration rows (is_cal); the first of equal ones."""
    points = curves.operating_point(scores.where("is_cal"), [*by, setting], budget)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("recall"), "fpr", setting))
    return points.withColumn("_r", rank).where("_r = 1").drop("_r")


def best_setting_at(scores: DataFrame, threshold: float, keys: Sequence[str], by: Sequence[str] = (), setting: str = "setting_id") -> DataFrame:
    """For a threshold that is fixed by definition: the setting that recalls best at it."""
    at = measures.measure(scores.where("is_cal"), threshold, keys, [*by, setting])
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("recall"), "fpr", setting))
    return at.withColumn("_r", rank).where("_r = 1").drop("_r").withColumn("threshold", F.lit(float(threshold)))


def ranking(scores: DataFrame, by: Sequence[str] = (), budget: float = BUDGET, setting: str = "setting_id") -> DataFrame:
    """All settings with their own points, best first."""
    points = curves.operating_point(scores.where("is_cal"), [*by, setting], budget)
    return points.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("recall"), "fpr", setting)))


def choose_domain(scores: DataFrame, checks: Sequence[str] = READING_CHECKS, domains: Sequence[int] = DOMAINS, floor: float = RECALL_FLOOR, budget: float = BUDGET) -> DataFrame:
    """Per domain the least calibrated recall of the checks that read, and the one chosen.

    The lowest resolution from which all hold the floor; failing that the least bad, the lowest of equal ones.
    Domains without rows are not tried. One pass: each row belongs to every domain at or below its resolution.
    """
    table = scores.sparkSession.createDataFrame([(d,) for d in domains], "domain int")
    need = scores.where(F.col("check").isin(*checks))
    rows = need.crossJoin(F.broadcast(table)).where(F.col("dpi") >= F.col("domain"))
    best = best_setting(rows, ["domain", "check"], budget)
    wanted = rows.select("domain", "check").distinct()
    worst = wanted.join(best.select("domain", "check", "recall"), ["domain", "check"], "left").groupBy("domain").agg(F.min(F.coalesce("recall", F.lit(0.0))).alias("worst_recall"))
    order = Window.orderBy(F.desc(F.col("worst_recall") >= floor), F.when(F.col("worst_recall") >= floor, F.lit(0.0)).otherwise(-F.col("worst_recall")), "domain")
    return worst.withColumn("chosen", F.row_number().over(order) == 1)


def estimator_error(clean: DataFrame, estimate: Column, truth: Column) -> DataFrame:
    return clean.agg(F.max(F.abs(estimate - truth) / truth).alias("max_error"))


def operational_floor(domain: DataFrame, error: DataFrame) -> DataFrame:
    """domain (one row, ``domain``), error (one row, ``max_error``): the resolution threshold that keeps a margin below the domain."""
    margin = F.greatest(F.lit(LEAST_MARGIN), MARGIN * F.col("max_error"))
    return domain.select("domain").crossJoin(F.broadcast(error)).withColumn("margin", margin).withColumn("threshold", -(F.col("domain") * (1 - F.col("margin"))))


def analysis(scores: DataFrame, keys: Sequence[str], axes: Sequence[str], target: Sequence[str], budget: float = BUDGET) -> dict[str, DataFrame]:
    """Everything that is published about one check: its point, and what that point is worth on either side, overall and broken down."""
    point = best_setting(scores, budget=budget)
    chosen = scores.join(F.broadcast(point.select("setting_id", "threshold")), "setting_id")  # one row
    t = F.col("threshold")
    return {
        "point": point, "ranking": ranking(scores, budget=budget),
        "calibration": measures.measure(chosen.where("is_cal"), t, keys, ["threshold"]), "validation": measures.measure(chosen.where("is_rep"), t, keys, ["threshold"]), "overall": measures.measure(chosen, t, keys, ["threshold"]),
        "factors": measures.by_factor(chosen, t, keys, axes), "cells": measures.fallen_cells(chosen, t, axes), "frontier": measures.frontier(measures.fallen_cells(chosen, t, axes), axes),
        "conjunctions": measures.worst_conjunctions(chosen, t, axes), "noisy": measures.noisy_targets(chosen, t, target), "certifiability": measures.certifiability(chosen, target, budget=budget),
    }


def remeasure(scores: DataFrame, threshold: float, keys: Sequence[str], axes: Sequence[str], target: Sequence[str]) -> dict[str, DataFrame]:
    """The same at a published threshold."""
    return {
        "calibration": measures.measure(scores.where("is_cal"), threshold, keys), "validation": measures.measure(scores.where("is_rep"), threshold, keys), "overall": measures.measure(scores, threshold, keys),
        "factors": measures.by_factor(scores, threshold, keys, axes), "cells": measures.fallen_cells(scores, threshold, axes), "conjunctions": measures.worst_conjunctions(scores, threshold, axes), "noisy": measures.noisy_targets(scores, threshold, target),
    }


def by_level(scores: DataFrame, threshold: Column | float, keys: Sequence[str], level: str = "parasite") -> DataFrame:
    return measures.measure(scores, threshold, keys, [level])


def clean_points_on_all(scores: DataFrame, keys: Sequence[str], budget: float = BUDGET) -> DataFrame:
    """Points chosen on rows without foreign ink, measured on all levels."""
    clean = scores.where((F.coalesce(F.col("parasite"), F.lit(0.0)) == 0) & F.col("is_cal"))
    points = curves.operating_point(clean, ["setting_id"], budget).select("setting_id", "threshold")
    return measures.measure(scores.join(F.broadcast(points), "setting_id"), F.col("threshold"), keys, ["setting_id", "parasite", "threshold"])


def frozen_rows(dossiers: DataFrame, dims: Dimensions, settings: DataFrame, thresholds: Mapping[str, float], damaged: DataFrame, keys: Sequence[str], checks: Sequence[str] = CHECKS, legacy: Sequence[str] = (), abstention: bool = True) -> DataFrame:
    """Labelled scores at frozen settings and thresholds; abstentions stay, as nulls."""
    found = scored(dossiers, dims, settings, [*keys, "variant"], checks, floor=-thresholds["resolution"], abstention=abstention)
    out = None
    for check in checks:
        part = labelled(found.where(F.col("check") == check), damaged, check, keys, legacy).withColumn("threshold", F.lit(float(thresholds[check])))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"fires": curves.fires(F.col("score"), F.col("threshold")), "abstained": F.col("score").isNull()})


def felt_rate(findings: DataFrame, dossier: Sequence[str]) -> DataFrame:
    """The share of clean dossiers on which anything fires."""
    one = findings.groupBy(*dossier).agg(F.max(F.col("fires").cast("int")).alias("fired"))
    return one.agg(F.sum("fired").cast("long").alias("fired"), F.count("*").alias("n")).withColumn("rate", F.col("fired") / F.greatest(F.col("n"), F.lit(1)))


def step_split(scores: DataFrame, threshold: Column | float, axis: str, step: float) -> DataFrame:
    """Recall per value of an axis, and below and from a step on."""
    pos = scores.where("positive AND score IS NOT NULL").withColumn("_side", F.when(F.col(axis) < step, "below").otherwise("from"))
    out = pos.groupingSets([[F.col(axis)], [F.col("_side")]], axis, "_side").agg(F.count_if(F.col("score") > threshold).alias("tp"), F.count("*").alias("n"))
    return out.withColumnRenamed("_side", "side").withColumn("recall", F.col("tp") / F.col("n"))


def follow_up(sets: Mapping[str, DataFrame], threshold: Column | float, axis: str, step: float, combined: Sequence[str]) -> DataFrame:
    """Recall of each set of scores, below and from a step of an axis on, with its interval; and of some sets together, as ``combined``.

    One pass: a row of a combined set counts twice. Null scores take no part; a set without positives has no row.
    """
    out = None
    for name, scores in sets.items():
        names = F.array(*[F.lit(x) for x in (name, *(["combined"] if name in combined else []))])
        rows = scores.where("positive AND score IS NOT NULL").select(F.explode(names).alias("set"), (F.col("score") > threshold).alias("_hit"), (F.col(axis) < step).alias("_below"))
        out = rows if out is None else out.unionByName(rows)
    counts = out.groupBy("set").agg(
        F.count_if("_hit").alias("tp"), F.count("*").alias("n"), F.count_if(F.col("_hit") & F.col("_below")).alias("tp_below"), F.count_if("_below").alias("n_below"),
        F.count_if(F.col("_hit") & ~F.col("_below")).alias("tp_from"), F.count_if(~F.col("_below")).alias("n_from"),
    )
    low, high = wilson(F.col("tp"), F.col("n"))
    return counts.withColumns({"recall": ratio(F.col("tp"), F.col("n")), "low": low, "high": high})


def published(results: DataFrame, evidence: Sequence[DataFrame]) -> DataFrame:
    """results by check with what other studies say about it beside it."""
    for more in evidence:
        results = results.join(small(more), "check", "left")
    return results
