"""Measurements as a stream: new files are read as they come, each reading once, aggregates kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docugauge.schema import KEY, KEY_DEFAULTS, RAW_MEASUREMENTS, struct


def stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Readings from new files of a folder; so many files a batch at most."""
    raw = spark.readStream.schema(struct(RAW_MEASUREMENTS)).option("maxFilesPerTrigger", files).json(path)
    named = raw.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in KEY_DEFAULTS.items()})
    return named.withColumn("at", F.try_to_timestamp("ts"))


def once(readings: DataFrame, late: str = "1 hour", keys: Sequence[str] = (*KEY, "variant", "piece")) -> DataFrame:
    """The first of readings with one key, among those not later than that; state is dropped as the watermark passes."""
    return readings.withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))


def rates(scores: DataFrame, threshold: float, by: Sequence[str], window: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Fired and seen per window of event time (column ``at``) and group."""
    frame = F.window("at", window, slide) if slide else F.window("at", window)
    return scores.withWatermark("at", late).groupBy(frame, *by).agg(F.count_if(F.col("score") > threshold).alias("fired"), F.count("*").alias("seen"))


def append(readings: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to a Parquet table; restarts go on where they stopped."""
    writer = readings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
