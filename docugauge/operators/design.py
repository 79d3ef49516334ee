"""Experiment designs: defect instances, factor grids, readings to make, draws that replay, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docugauge.functions import text as X
from docugauge.operators.broadcasts import small
from docugauge.operators.checks import Dimensions
from docugauge.operators.dossiers import CLEAN

# The factor levels of the full grid, the foreign-ink levels, the seeds, and the shapes of foreign ink.
ANGLES, DPIS, JPEGS, SIGMAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0), (96, 150, 200, 300), (30, 55, 75, 95), (0.0, 3.0, 6.0, 12.0)
PARASITE_LEVELS, SEEDS, SHAPES = (0.0, 0.002, 0.01, 0.04), (11, 23, 37), ("fold", "speck", "stroke")
# One variant per check, by the names that older files use, with the check and piece of each.
LEGACY = {
    "empty_required_field": ("required_field", "employment"), "unchecked_box": ("required_checkbox", "tax"), "missing_signature": ("signature", "employment"), "expired_date": ("expiry", "employment"),
    "diverging_address": ("consistency", "identity"), "forbidden_value": ("forbidden_value", "employment"), "low_resolution": ("resolution", "tax"), "cropped_page": ("cropped_page", "tax"), "rotated_page": ("rotated_page", "tax"),
}
PAGE_DEFECTS = {"low_resolution": "resolution", "cropped_page": "cropped_page", "rotated_page": "rotated_page"}
EXPIRED_DAYS, NUMBER_ROLES = (1, 365), ("tax_id", "ssn")


def legacy_variants(spark: SparkSession) -> DataFrame:
    rows = [(CLEAN, None, None), *[(name, check, piece) for name, (check, piece) in LEGACY.items()]]
    return spark.createDataFrame(rows, "variant string, `check` string, piece string").withColumn("legacy", F.lit(True))


def enumerate_variants(dims: Dimensions, replacements: Mapping[str, str] | None = None) -> DataFrame:
    """One instance for each defect that an identity's pieces can have: identity, variant, check, piece, role, detail.

    A union over declared dimensions: each required field, box and signature; each expiration date a day and a
    year past; each declared disagreement, on its last piece; a forbidden number on each piece with a field for
    one; three page defects on each piece.
    """
    fields = dims.ref_pieces.select("identity", "piece", "template").join(dims.template_fields, "template")
    roles = fields.select("identity", "piece", "role", "kind", "required", "date_kind").distinct()
    cols = lambda df, name, check, detail=F.lit(None).cast("string"): df.select("identity", name.alias("variant"), F.lit(check).alias("check") if isinstance(check, str) else check.alias("check"), "piece", F.col("role"), detail.alias("detail"))
    at = lambda prefix: F.concat(F.lit(f"{prefix}@"), F.col("piece"), F.lit("."), F.col("role"))
    out = cols(roles.where("kind = 'field' AND required"), at("empty_required_field"), "required_field")
    out = out.unionByName(cols(roles.where("kind = 'box' AND required"), at("unchecked_box"), "required_checkbox"))
    out = out.unionByName(cols(roles.where("kind = 'signature' AND required"), at("missing_signature"), "signature"))
    days = roles.where("date_kind = 'expiration'").withColumn("days", F.explode(F.array(*[F.lit(d) for d in EXPIRED_DAYS])))
    out = out.unionByName(cols(days, F.concat(at("expired_date"), F.lit("."), F.col("days").cast("string"), F.lit("d")), "expiry", F.col("days").cast("string")))
    order = F.array_position(F.array(*[F.lit(r) for r in NUMBER_ROLES]), F.col("role"))
    numbers = roles.where(F.col("role").isin(*NUMBER_ROLES)).groupBy("identity", "piece").agg(F.min_by("role", order).alias("role"))
    value = dims.ref_forbidden.groupBy("identity").agg(F.min_by("value", F.regexp_count("value", F.lit("[^0-9-]"))).alias("value"))
    out = out.unionByName(cols(numbers.join(value, "identity"), F.concat(F.lit("forbidden_value@"), F.col("piece")), "forbidden_value", F.col("value")))
    pages = dims.ref_pieces.select("identity", "piece").crossJoin(F.broadcast(_pairs(dims, PAGE_DEFECTS))).withColumn("role", F.lit(None).cast("string"))
    out = out.unionByName(cols(pages, F.concat(F.col("name"), F.lit("@"), F.col("piece")), F.col("defect_check")))
    last = dims.ref_consistency.groupBy("identity", "data").agg(F.max_by("piece", "ord").alias("piece"), F.max_by("field", "ord").alias("role"))
    return out.unionByName(cols(last, F.concat(F.lit("diverging_"), F.col("data"), F.lit("@"), F.col("piece")), "consistency", F.col("data")))


def _pairs(dims: Dimensions, table: Mapping[str, str]) -> DataFrame:
    return dims.ref_pieces.sparkSession.createDataFrame(list(table.items()), "name string, defect_check string")


def damaged_targets(variants: DataFrame, dims: Dimensions) -> DataFrame:
    """identity, variant, check, piece, target: what each instance really damages."""
    fields = dims.ref_pieces.select("identity", "piece", "template").join(dims.template_fields, "template").select("identity", "piece", "role", "field_id", "kind", "date_kind")
    by_role = variants.where(F.col("check").isin("required_field", "required_checkbox")).join(fields, ["identity", "piece", "role"])
    signed = variants.where("check = 'signature'").drop("role").join(fields.where("kind = 'signature'"), ["identity", "piece"])
    dated = variants.where("check = 'expiry'").drop("role").join(fields.where("date_kind = 'expiration'"), ["identity", "piece"])
    out = None
    for df in (by_role, signed, dated):
        part = df.select("identity", "variant", "check", "piece", F.col("field_id").alias("target"))
        out = part if out is None else out.unionByName(part)
    values = variants.where("check = 'forbidden_value'").join(dims.ref_forbidden, "identity").where("value = detail").select("identity", "variant", "check", "piece", F.col("value").alias("target"))
    sides = dims.ref_consistency.select("identity", "data", "ord", "piece")
    pairs = sides.alias("a").join(sides.alias("b"), (F.col("a.identity") == F.col("b.identity")) & (F.col("a.data") == F.col("b.data")) & (F.col("a.ord") < F.col("b.ord")))
    pairs = pairs.select("a.identity", "a.data", F.concat(F.col("a.piece"), F.lit("+"), F.col("b.piece")).alias("both"))
    apart = variants.where("check = 'consistency'").drop("piece").join(pairs, "identity").select("identity", "variant", "check", F.col("both").alias("piece"), F.col("data").alias("target"))
    pages = variants.where(F.col("check").isin(*PAGE_DEFECTS.values())).select("identity", "variant", "check", "piece", F.lit("").alias("target"))
    return out.unionByName(values).unionByName(apart).unionByName(pages).distinct()


def readings_to_make(variants: DataFrame, dims: Dimensions) -> DataFrame:
    """(identity, variant, piece): the clean pieces, and each instance's own piece."""
    clean = dims.ref_pieces.select("identity", F.lit(CLEAN).alias("variant"), "piece")
    return clean.unionByName(variants.where(F.col("variant") != CLEAN).select("identity", "variant", "piece"))


def watched_zones(dims: Dimensions) -> DataFrame:
    """Per template and check family, the declared zones that a check reads, sorted."""
    family = F.when((F.col("kind") == "field") & F.col("required"), "required_field").when((F.col("kind") == "box") & F.col("required"), "required_checkbox").when((F.col("kind") == "signature") & F.col("required"), "signature")
    tagged = dims.template_fields.withColumn("family", F.filter(F.array(family, F.when(F.col("date_kind") == "expiration", "expiry")), lambda x: x.isNotNull())).withColumn("family", F.explode("family"))
    zones = dims.zones.select("template", F.col("name").alias("field_id"))
    return tagged.join(zones, ["template", "field_id"], "left_semi").groupBy("template", "family").agg(F.array_sort(F.collect_set("field_id")).alias("zones"))


def grid(spark: SparkSession, factors: Mapping[str, Sequence]) -> DataFrame:
    """The full crossing of factor levels, numbered in the factors' order."""
    out = None
    for name, levels in factors.items():
        one = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], f"_{name} int, {name} {'int' if isinstance(levels[0], int) else 'double' if isinstance(levels[0], float) else 'string'}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    index, size = F.lit(0).cast("long"), 1
    for name, levels in reversed(list(factors.items())):
        index, size = index + F.col(f"_{name}") * size, size * len(levels)
    return out.select(index.alias("cell_index"), *factors)


def full_grid(spark: SparkSession) -> DataFrame:
    return grid(spark, {"angle": ANGLES, "dpi": DPIS, "jpeg": JPEGS, "sigma": SIGMAS})


def parasite_grid(spark: SparkSession) -> DataFrame:
    """The sub-grid that the foreign-ink axis is crossed with."""
    return grid(spark, {"angle": (0.0, 0.5, 1.0, 4.0), "dpi": (150, 200, 300), "jpeg": (30, 75, 95), "sigma": (0.0, 6.0, 12.0)})


def systematic_sample(rows: DataFrame, order: Sequence[str], how_many: int) -> DataFrame:
    """Every (rows // how_many)-th row, from the first, at most so many."""
    n = rows.count()
    if how_many <= 0 or not n:
        return rows.limit(0)
    step = max(1, n // how_many)
    return numbered(rows, order, "_i").where((F.col("_i") % step == 0) & (F.col("_i") < step * how_many)).drop("_i")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n", ranges: int | None = None) -> DataFrame:
    """rows with 0, 1, 2, ... in an order, by many tasks: ranges of the order's first column are counted, then numbered.

    As many ranges as a shuffle has partitions, so tasks don't grow with the table if those are set to it.
    """
    first = order[0]
    ranges = ranges or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    borders = rows.agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 1000).alias("_b"))
    dealt = rows.crossJoin(F.broadcast(borders)).withColumn("_range", F.size(F.filter("_b", lambda b: b < F.col(first)))).drop("_b")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_k"))
    before = sizes.select("_range", F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "_range").withColumn(name, place + F.col("_before")).drop("_range", "_before")


def rotated(items: Column, index: Column) -> Column:
    """The item that a draw number comes to, going round."""
    return F.element_at(items, (F.pmod(index, F.size(items)) + 1).cast("int"))


def shape_for(seed: Column, cell_index: Column, all_shapes: bool) -> Column:
    """The shape of foreign ink of a seed; with all_shapes the cell moves it on, so that each shape is drawn."""
    return rotated(F.array(*[F.lit(s) for s in SHAPES]), seed + cell_index if all_shapes else seed)


def draw(seed: Column, level: Column, piece: Column) -> Column:
    return X.draw_seed(F.concat_ws("|", seed.cast("string"), level.cast("string"), piece))


def capture_rows(sheets: DataFrame, devices: Mapping[str, int]) -> DataFrame:
    """Each sheet once per capture of each device."""
    table = sheets.sparkSession.createDataFrame(list(devices.items()), "device string, captures int")
    return sheets.crossJoin(F.broadcast(table)).withColumn("capture_index", F.explode(F.sequence(F.lit(1), F.col("captures")))).drop("captures")


def renderer_rows(variants: DataFrame, pipelines: Sequence[str], levels: Sequence[int], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Rows for a renderer of degradations: pipelines x variants (ord, variant) x levels x seeds, numbered in that order."""
    spark = variants.sparkSession
    other = spark.createDataFrame([(i, p, x, s) for i, p in enumerate(pipelines) for x in levels for s in seeds], "_p int, pipeline string, level int, seed int")
    rows = small(variants).crossJoin(F.broadcast(other))  # a design: all of it is wanted
    return numbered(rows, ["_p", "ord", "level", "seed"], "row_index").select("row_index", "pipeline", "variant", "level", "seed")


def targeted_runs(cells: DataFrame, targets: DataFrame, seeds: Sequence[int] = SEEDS, levels: Sequence[float] = PARASITE_LEVELS, all_shapes: bool = True) -> DataFrame:
    """Foreign ink laid on what a variant damages and on the same place of the clean page: cells x seeds x levels x targets x sides.

    targets: variant, check, piece, zone. Level 0 has no shape.
    """
    spark = cells.sparkSession
    draws = spark.createDataFrame([(s, x) for s in seeds for x in levels], "seed int, parasite double")
    sides = spark.createDataFrame([("variant",), (CLEAN,)], "side string")
    out = cells.crossJoin(F.broadcast(draws)).crossJoin(small(targets)).crossJoin(F.broadcast(sides))  # a design: all of it is wanted
    return out.withColumn("shape", F.when(F.col("parasite") > 0, shape_for(F.col("seed"), F.col("cell_index"), all_shapes)))
