"""Dossiers: completeness by relational division, overlays, damaged targets, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docugauge.operators.broadcasts import small

CLEAN = "clean"


def last_wins(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of rows with one key the one that came last."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def divided(rows: DataFrame, keys: Sequence[str], member: str, expected: DataFrame) -> DataFrame:
    """The keys that hold every expected member: counts of distinct expected ones against their number."""
    wanted = expected.select(member).distinct()
    total = wanted.agg(F.count("*").alias("_total"))
    held = rows.join(small(wanted), member, "left_semi").select(*keys, member).distinct().groupBy(*keys).agg(F.count("*").alias("_held"))
    return held.crossJoin(F.broadcast(total)).where("_held = _total").select(*keys)


def complete(rows: DataFrame, keys: Sequence[str], expected: DataFrame, pieces: int) -> DataFrame:
    """Dossiers of every expected variant, of keys that hold them all and as many clean pieces: clean pieces overlaid by edited ones.

    rows: keys, variant, piece and anything else. A dossier's rows carry its variant, whichever piece they come from.
    """
    whole = divided(rows, keys, "variant", expected)
    enough = rows.where(F.col("variant") == CLEAN).groupBy(*keys).agg(F.countDistinct("piece").alias("_n")).where(F.col("_n") >= pieces).select(*keys)
    null_safe = lambda a, b: a.join(b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), _same(keys), "left_semi")
    kept = null_safe(null_safe(rows, whole), enough)
    wanted = small(expected.select("variant").distinct().where(F.col("variant") != CLEAN))
    edited = kept.join(wanted, "variant", "left_semi")
    base = kept.where(F.col("variant") == CLEAN)
    others = base.drop("variant").crossJoin(wanted)
    covered = edited.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("variant").alias("_v"), F.col("piece").alias("_p"))
    untouched = others.join(covered, _same(keys) & (F.col("variant") == F.col("_v")) & (F.col("piece") == F.col("_p")), "left_anti")
    return base.unionByName(edited).unionByName(untouched.select(*base.columns))


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def labelled(scores: DataFrame, damaged: DataFrame, check: str, keys: Sequence[str], legacy: Sequence[str] = ()) -> DataFrame:
    """Scores of whole dossiers, as positives and negatives of one check.

    Positives are targets that a variant of the check damages; negatives are all targets of clean dossiers.
    Where a legacy variant has no damaged target with a score, all its targets count as positives.
    """
    own = damaged.where(F.col("check") == check).select("variant", "piece", "target").distinct()
    variants = small(own.select("variant").distinct())
    faulty = scores.where(F.col("variant") != CLEAN).join(variants, "variant", "left_semi")
    marked = faulty.join(small(own.withColumn("_hit", F.lit(True))), ["variant", "piece", "target"], "left")
    part = Window.partitionBy(*keys, "setting_id", "variant")
    any_hit = F.max(F.coalesce(F.col("_hit") & F.col("score").isNotNull(), F.lit(False))).over(part)
    marked = marked.withColumn("_any", any_hit)
    old = F.col("variant").isin(*legacy) if legacy else F.lit(False)
    positives = marked.where(F.coalesce(F.col("_hit"), F.lit(False)) | (old & ~F.col("_any"))).withColumn("positive", F.lit(True))
    negatives = scores.where(F.col("variant") == CLEAN).withColumn("positive", F.lit(False))
    return positives.drop("_hit", "_any").unionByName(negatives.select(*scores.columns, "positive"))


def not_done(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is wanted and not done yet; null keys match null keys."""
    return wanted.join(done.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), _same(keys), "left_anti")


def regrouped(missing: DataFrame, task: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row per task with its missing parts, sorted."""
    return missing.groupBy(*task).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("missing"))
