"""The driver's tables in the shapes of the operators, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as targets: share of odd characters as score, low quality as positive.

    dossier: source; replicate: seed = doc_id % 3 (2 reports, the others calibrate); factors: lang, bucket, toxic.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels")
    odd = F.length(F.translate("text", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ", ""))
    score = F.expr("odd * 1000 div size").cast("double")
    rows = docs.select("doc_id", "lang", "source", odd.cast("long").alias("odd"), F.greatest(F.length("text"), F.lit(1)).cast("long").alias("size")).join(labels, "doc_id")
    bucket = (F.regexp_extract("source", "[0-9]+", 0).cast("int") % 4).alias("bucket")
    return rows.select("doc_id", "lang", "source", bucket, "toxic", (F.col("doc_id") % 3).cast("int").alias("seed"), (F.col("quality") == 0).alias("positive"), score.alias("score"), "size", "odd")


B = """b AS (SELECT doc_id, lang, source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 4 AS bucket, toxic, CAST(doc_id % 3 AS INTEGER) AS seed, quality = 0 AS positive,
  CAST(odd * 1000 // size AS DOUBLE) AS score, size, odd
  FROM (SELECT doc_id, lang, source, length(regexp_replace(text, '[0-9A-Za-z ]', '', 'g')) AS odd, greatest(length(text), 1) AS size FROM documents) d JOIN labels USING (doc_id))"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same targets under four score definitions, side by side as settings."""
    rows = scores(spark, sf_dir)
    table_ = F.array(F.struct(F.lit(0).alias("setting_id"), F.col("score").alias("score")), F.struct(F.lit(1).alias("setting_id"), (-F.col("size")).cast("double").alias("score")), F.struct(F.lit(2).alias("setting_id"), F.col("odd").cast("double").alias("score")), F.struct(F.lit(3).alias("setting_id"), (F.col("score") - F.least(F.col("size"), F.lit(500)) / 10).alias("score")))
    return rows.withColumn("s", F.explode(table_)).select(*[c for c in rows.columns if c != "score"], F.col("s.setting_id").alias("setting_id"), F.col("s.score").alias("score"))


S = B + """, s AS (SELECT * REPLACE (CAST(CASE k WHEN 0 THEN score WHEN 1 THEN -size WHEN 2 THEN odd ELSE score - least(size, 500) / 10 END AS DOUBLE) AS score), CAST(k AS INTEGER) AS setting_id FROM b, range(4) r(k))"""

#: A curve, per group if columns are given; over a relation with positive and score.
POINTS = """SELECT {g} threshold, tp, fp, n_pos, n_neg, CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pos END AS recall, CASE WHEN n_neg = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / n_neg END AS fpr FROM (
  SELECT {g} coalesce((lag(score) OVER ({p} ORDER BY score) + score) / 2, score - 1.0) AS threshold, CAST(sum(p) OVER ({p} ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER ({p} ORDER BY score DESC) AS BIGINT) AS fp, CAST(sum(p) OVER ({w}) AS BIGINT) AS n_pos, CAST(sum(n) OVER ({w}) AS BIGINT) AS n_neg
  FROM (SELECT {g} score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM {rel} WHERE score IS NOT NULL GROUP BY {g} score) c
  UNION ALL SELECT {g} max(score) + 1.0, 0, 0, count(*) FILTER (positive), count(*) FILTER (NOT positive) FROM {rel} WHERE score IS NOT NULL {by}) q"""


def points(rel: str, *by: str) -> str:
    g, cols = "".join(f"{c}, " for c in by), ", ".join(by)
    return POINTS.format(rel=rel, g=g, p=f"PARTITION BY {cols}" if by else "", w=f"PARTITION BY {cols}" if by else "", by=f"GROUP BY {cols}" if by else "")


def chosen(rel: str, *by: str, budget: float = 0.002) -> str:
    """The operating points of a relation of points."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""SELECT * EXCLUDE (best_recall, best_fpr, plateau, place) FROM (SELECT *, count(*) OVER ({part}) AS plateau, row_number() OVER ({part} ORDER BY threshold) - 1 AS place FROM (
  SELECT *, first_value(recall) OVER ({part} ORDER BY recall DESC, fpr) AS best_recall, first_value(fpr) OVER ({part} ORDER BY recall DESC, fpr) AS best_fpr FROM {rel} WHERE fpr <= {budget}) WHERE recall = best_recall AND fpr = best_fpr) WHERE place = plateau // 2"""


def wilson(k: str, n: str, low: str, high: str) -> str:
    """Two columns, rounded to 9 digits."""
    low_, high_ = (f"(({k} * 1.0::DOUBLE / {n} + 3.8416::DOUBLE / (2 * {n})) / (1 + 3.8416::DOUBLE / {n}) {s} 1.96::DOUBLE * sqrt({k} * 1.0::DOUBLE / {n} * (1 - {k} * 1.0::DOUBLE / {n}) / {n} + 3.8416::DOUBLE / (4 * CAST({n} AS DOUBLE) * {n})) / (1 + 3.8416::DOUBLE / {n}))" for s in "-+")
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(greatest(0.0, {low_}), 9) END AS {low}, CASE WHEN {n} = 0 THEN 1.0 ELSE round(least(1.0, {high_}), 9) END AS {high}"


def keyed(rel: str, threshold: str, keys: str) -> str:
    """Counts per key."""
    return f"SELECT {keys}, count(*) FILTER (positive AND score IS NOT NULL) AS n_pos, count(*) FILTER (positive AND score > {threshold}) AS tp, count(*) FILTER (NOT positive AND score IS NOT NULL) AS n_neg, count(*) FILTER (NOT positive AND score > {threshold}) AS fp FROM {rel} GROUP BY {keys}"


SUMS = "CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n_pos), 0) AS BIGINT) AS n_pos, CAST(coalesce(sum(n_neg), 0) AS BIGINT) AS n_neg, count(*) FILTER (fp > 0) AS hit, count(*) AS n_dossiers"


def rate(k: str, n: str, name: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE CAST({k} AS DOUBLE) / {n} END AS {name}"


MEASURED = ", ".join(["tp, fp, n_pos, n_neg, n_dossiers", rate("tp", "n_pos", "recall"), rate("fp", "n_neg", "fpr"), rate("hit", "n_dossiers", "dossier_fpr"), wilson("tp", "n_pos", "recall_low", "recall_high"), wilson("fp", "n_neg", "fpr_low", "fpr_high"), wilson("hit", "n_dossiers", "dossier_fpr_low", "dossier_fpr_high")])
