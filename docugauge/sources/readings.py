"""Measurement files: JSON lines, plain or gzip, with keys that older files lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.operators.dossiers import last_wins
from docugauge.schema import KEY, KEY_DEFAULTS, RAW_MEASUREMENTS, WORD_DDL, struct


def word(raw: Column) -> Column:
    """A word as the files write it, [text, cx, cy, conf, added], as a struct."""
    plain = lambda i: F.bround(F.get(raw, F.lit(i)).try_cast("double"), 0).cast("int")
    return F.struct(F.get(raw, F.lit(0)).alias("text"), plain(1).alias("cx"), plain(2).alias("cy"), plain(3).alias("conf"), F.coalesce(F.get(raw, F.lit(4)).try_cast("boolean"), F.lit(False)).alias("added")).cast(WORD_DDL)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each key, variant and piece. Lines are ordered by file name, then place in the file."""
    raw = spark.read.schema(struct(RAW_MEASUREMENTS)).option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}).where("variant IS NOT NULL AND piece IS NOT NULL")
    named = raw.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in KEY_DEFAULTS.items()})
    r = F.col("reading")
    words = F.transform(r["words"], word)
    zones = F.transform_values(r["zone_words_by_field"], lambda _, ws: F.transform(ws, word))
    named = named.withColumn("reading", r.withField("words", words).withField("zone_words_by_field", zones))
    named = named.withColumn("_ordinal", F.struct("_file", "_block", "_line"))
    return last_wins(named, [*KEY, "variant", "piece"], "_ordinal").drop("_ordinal", "_file", "_block", "_line")


def keys(readings: DataFrame) -> DataFrame:
    return readings.select(*KEY).distinct()


def dump_summary(rows: DataFrame) -> DataFrame:
    """What a dump of runs with foreign ink holds: rows, rows by shape, cells, levels and seeds. Rows without ink have no shape.

    rows: cell, parasite, seed, shape.
    """
    shapes = rows.where("shape IS NOT NULL").groupBy("shape").agg(F.count("*").alias("k"))
    held = shapes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "k")))).alias("shapes"))
    total = rows.agg(F.count("*").alias("rows"), F.countDistinct("cell").alias("cells"), F.array_sort(F.collect_set("parasite")).alias("levels"), F.array_sort(F.collect_set("seed")).alias("seeds"))
    return total.crossJoin(held)  # a row each


def dump_digest(spark: SparkSession, path: str) -> DataFrame:
    """The SHA-256 of each plain or gzip dump's uncompressed bytes."""

    def run(batches):
        import gzip
        import hashlib

        import pandas as pd

        for batch in batches:
            plain = [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "sha256": [hashlib.sha256(p).hexdigest() for p in plain], "bytes": [len(p) for p in plain]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sha256 string, bytes long")


