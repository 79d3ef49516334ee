"""CSV inputs: image manifests, checked whole before anything is read, checklists, and captured images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docugauge.functions.text import blank_to_null
from docugauge.operators.broadcasts import small
from docugauge.operators.design import numbered as in_order

# Columns that a manifest must have, its sources, and the columns of its rows' keys.
REQUIRED = ("image_path", "source", "identity", "piece", "variant", "instance", "seed", "dpi", "capture", "mark_step", "ts")
SOURCES = ("g1", "x2", "naf")
ROW_KEY = ("identity", "source", "seed", "dpi", "capture", "mark_step", "variant", "piece", "instance")
CHECKLIST = "line INT, sheet_code STRING, identity STRING, piece STRING, variant STRING, instance STRING, mark_step STRING, device STRING, dpi INT, capture_index INT, sign STRING, must_not_sign STRING, physical_action STRING, label STRING"
IMAGES = "*.{png,PNG,tif,tiff,TIF,TIFF,jpg,jpeg,JPG,JPEG}"


class ManifestError(ValueError):
    """A manifest with violations; nothing was read."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blanks null, with the line each row is on (from 2); other columns stay."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    if lacking := [c for c in REQUIRED if c not in rows.columns]:
        raise ManifestError(f"missing column(s) {', '.join(lacking)}")
    numbered = rows.withColumns({c: blank_to_null(F.col(f"`{c}`")) for c in rows.columns}).withColumn("_id", F.monotonically_increasing_id())
    return in_order(numbered, ["_id"], "line").withColumn("line", (F.col("line") + 2).cast("int")).drop("_id")


def violations(rows: DataFrame, pieces: DataFrame, variants: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(line, problem) of every rule that a row breaks, found in one pass: dimensions are joined as marks.

    A row whose identity isn't known breaks that rule and maybe the source's; its other columns mean nothing
    then, and its key isn't taken. Of rows with one key, each but the first names the one before it.
    """
    mark = lambda df, name, *on: small(df.select(*on).distinct().withColumn(name, F.lit(True)))
    held = rows.join(mark(pieces, "_who", "identity"), "identity", "left").join(mark(pieces, "_piece", "identity", "piece"), ["identity", "piece"], "left").join(mark(variants, "_variant", "identity", "variant"), ["identity", "variant"], "left")
    held = held.join(existing.select(F.col("path").alias("image_path")).distinct().withColumn("_there", F.lit(True)), "image_path", "left") if existing is not None else held.withColumn("_there", F.lit(True))
    known = F.col("_who").isNotNull()
    earlier = F.lag("line").over(Window.partitionBy("_who", *ROW_KEY).orderBy("line"))
    broken = lambda rule, *text: F.when(rule, F.concat(*[F.lit(t) if isinstance(t, str) else F.coalesce(t.cast("string"), F.lit("nothing")) for t in text]))
    rules = [
        broken(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "no such source: ", F.col("source")),
        broken(~known, "no reference for ", F.col("identity")),
        broken(known & F.col("_piece").isNull(), "the reference lacks the piece ", F.col("piece")),
        broken(known & F.col("_variant").isNull() & ~F.coalesce(F.col("variant") == "clean", F.lit(False)), "not in the catalogue: ", F.col("variant")),
        broken(known & (F.coalesce(F.col("dpi").try_cast("int"), F.lit(0)) == 0), "resolution lacks"),
        broken(known & F.col("_there").isNull(), "nothing at ", F.col("image_path")),
        broken(known & F.col("_earlier").isNotNull(), "repeats line ", F.col("_earlier")),
    ]
    found = held.withColumn("_earlier", earlier).select("line", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("problem"))
    return found


def checked(rows: DataFrame, pieces: DataFrame, variants: DataFrame, existing: DataFrame | None = None, shown: int = 20) -> DataFrame:
    """rows with typed columns, or ManifestError with how many problems there are and the first few."""
    found = violations(rows, pieces, variants, existing)
    total = found.count()
    if total:
        first = found.orderBy("line", "problem").limit(shown).collect()
        raise ManifestError(f"refused for {total} broken rules, among them " + "; ".join(f"{r.problem} ({r.line})" for r in first))
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("seed", "dpi", "mark_step")})


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKLIST).option("header", True).csv(path).orderBy("line")


def expected_quarter_turns(quarter_turns: Column) -> Column:
    return F.pmod(4 - quarter_turns, F.lit(4))


def orientation(found: Column, expected: Column) -> Column:
    return F.struct(found.alias("quarter_turns"), expected.alias("expected_quarter_turns"), (found != expected).alias("wrong_quarter_turn"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Raster files as they are: path, modification time, length and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(path)


def capture_time(pdf_date: Column, exif_original: Column, exif: Column, modified: Column) -> Column:
    """When a page was captured: the PDF's creation date, the picture's own times, or the file's, in that order."""
    part = lambda i, width: F.rpad(F.regexp_extract(pdf_date, r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?", i), width, "0")
    made = F.when(pdf_date.rlike(r"^D:\d{8}"), F.try_to_timestamp(F.concat(*[part(i, 4 if i == 1 else 2) for i in range(1, 7)]), F.lit("yyyyMMddHHmmss")))
    shot = lambda c: F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(made, shot(exif_original), shot(exif), modified)
