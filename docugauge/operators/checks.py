"""The nine checks: readings, declared dimensions and settings in, findings with continuous scores out.

A row of readings is a piece of a dossier: any key columns, identity, piece, and a ``reading`` struct.
Settings are columns beside it, so one pass scores any number of them. A score is higher the more there
is reason to reject; it fires strictly above its threshold; null means undecided, never compliant. With
abstention, checks that read text don't judge a piece below the resolution floor.

Dimensions are what forms and reference files declare; each is measured before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.functions import text as X
from docugauge.operators.broadcasts import small
from docugauge.operators.curves import fires
from docugauge.schema import CHECKS, KNOBS, READING_CHECKS, SETTING_DEFAULTS, SETTINGS, SWEPT

#: Pixels that a zone is widened by.
MARGIN = 8
_FINDING = ("check", "piece", "target", "score")


def combinations(check: str) -> list[dict]:
    """The settings that change something for a check; only ink reads by ink threshold, only words by confidence."""
    if check == "required_field":
        by_word = [{"text_sensor": s, "min_conf": c} for s in SWEPT["text_sensor"] for c in SWEPT["min_conf"]]
        chosen = by_word + [{"text_sensor": "ink", "ink_threshold": t} for t in SWEPT["ink_threshold"]]
    else:
        chosen = [dict(zip(KNOBS[check], v)) for v in product(*[SWEPT[k] for k in KNOBS[check]])]
    return [SETTING_DEFAULTS | c for c in chosen]


def settings_table(spark: SparkSession, chosen: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    names = [x.split()[0].strip("`") for x in SETTINGS.split(", ")]
    rows = [tuple({"setting_id": i, "check": check, **SETTING_DEFAULTS, **s}[n] for n in names) for check, all_ in chosen.items() for i, s in enumerate(all_)]
    return spark.createDataFrame(rows, SETTINGS)


def setting_name(check: Column, sensor: Column, conf: Column, ink: Column, disc: Column, signature: Column) -> Column:
    """What acts, in words."""
    by_ink = (check == "required_field") & (sensor == "ink")
    words = F.when(by_ink, F.concat(F.lit("ink@"), ink.cast("string"))).when(check.isin(*READING_CHECKS), F.concat_ws(" ", sensor, F.concat(F.lit("conf"), conf.cast("string"))))
    return words.when(check == "required_checkbox", F.concat(F.lit("disc "), disc.cast("string"), F.lit("@"), ink.cast("string"))).when(check == "signature", F.concat(signature, F.lit("@"), ink.cast("string"))).otherwise(F.lit("-"))


class Dimensions:
    """The declared tables, by name; see schema.DIMENSIONS."""

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.tables = {name: small(df) for name, df in tables.items()}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def fields(self, kind: str) -> DataFrame:
        return self.template_fields.where(F.col("kind") == kind).select("template", "role", "field_id", F.col("ord").alias("field_ord"), "required", "date_kind")

    def places(self) -> DataFrame:
        return self.zones.select("template", F.col("name").alias("field_id"), "x0", "y0", "x1", "y1")


def _r(name: str) -> Column:
    return F.col("reading")[name]


def _zone_texts() -> Column:
    page = X.within(F.coalesce(_r("words"), F.array().cast("array<struct<text:string,cx:int,cy:int,conf:int,added:boolean>>")), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), MARGIN)
    return X.zone_words(page, F.try_element_at(_r("zone_words_by_field"), F.col("field_id")), F.col("text_sensor"), F.col("min_conf"))


def _unreadable(floor: float, abstention: bool) -> Column:
    return (_r("source_dpi") < floor) if abstention else F.lit(False)


def _out(df: DataFrame, keys: Sequence[str], check: str, target: Column, score: Column, piece: Column | None = None) -> DataFrame:
    return df.select(*keys, F.lit(check).alias("check"), (F.col("piece") if piece is None else piece).alias("piece"), target.alias("target"), score.cast("double").alias("score"))


def required_field(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
    at = rows.join(dims.fields("field").where("required"), "template").join(dims.places(), ["template", "field_id"])
    ink = F.try_element_at(F.try_element_at(_r("field_ink"), F.col("field_id")), F.col("ink_threshold").cast("string"))
    by_ink = F.col("text_sensor") == "ink"
    at = at.where(~by_ink | ink.isNotNull())
    words = -X.alnum_count(F.transform(_zone_texts(), lambda w: w["text"])).cast("double")
    return _out(at, keys, "required_field", F.col("field_id"), F.when(by_ink, -ink).when(~_unreadable(floor, abstention), words))


def required_checkbox(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
    at = rows.join(dims.fields("box").where("required"), "template")
    name = F.concat(F.col("disc_ratio").cast("string"), F.lit("|"), F.col("ink_threshold").cast("string"))
    delta = F.try_element_at(F.try_element_at(_r("boxes"), F.col("field_id")), name)
    return _out(at.where(delta.isNotNull()), keys, "required_checkbox", F.col("field_id"), -delta)


def signature(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
    at = rows.join(dims.fields("signature").where("required"), "template")
    four = F.try_element_at(F.try_element_at(_r("signatures"), F.col("field_id")), F.col("ink_threshold").cast("string"))
    return _out(at.where(four.isNotNull()), keys, "signature", F.col("field_id"), F.when(F.col("signature_sensor") == "components", -F.get(four, F.lit(3))).otherwise(-F.get(four, F.lit(0))))


def expiry(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool, clock: str) -> DataFrame:
    fields = dims.template_fields.where("date_kind = 'expiration'").select("template", "field_id")
    at = rows.join(fields, "template").join(dims.places(), ["template", "field_id"], "left").join(dims.templates.select("template", "date_format"), "template")
    at = at.join(dims.ref_clocks.where(F.col("clock") == clock).select("identity", F.col("d").alias("_today")), "identity")
    days = F.date_diff(F.col("_today"), X.printed_date(_zone_texts(), F.col("date_format")))
    return _out(at, keys, "expiry", F.col("field_id"), F.when(~_unreadable(floor, abstention) & F.col("x0").isNotNull(), days))


def forbidden_value(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
    empty = F.array().cast("array<struct<text:string,cx:int,cy:int,conf:int,added:boolean>>")
    zones = F.flatten(F.map_values(F.coalesce(_r("zone_words_by_field"), F.create_map().cast("map<string,array<struct<text:string,cx:int,cy:int,conf:int,added:boolean>>>"))))
    every = X.first_of_place(X.confident(F.concat(F.coalesce(_r("words"), empty), zones), F.col("min_conf")))
    held = rows.withColumn("_words", F.when(~_unreadable(floor, abstention), every))
    at = held.join(dims.ref_forbidden, "identity")
    return _out(at, keys, "forbidden_value", F.col("value"), X.best_ngram("_words", "value"))


def _page(check: str, score):
    def run(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
        return _out(rows, keys, check, F.lit(""), score())

    return run


def consistency(rows: DataFrame, dims: Dimensions, keys: Sequence[str], floor: float, abstention: bool) -> DataFrame:
    """Pairs of readings of one declared datum; one undecided finding instead if any side can't be read."""
    sides = dims.ref_consistency.select("identity", "data", F.col("ord").alias("side"), "piece", F.col("field").alias("role"))
    fields = dims.template_fields.select("template", "role", "field_id", F.col("ord").alias("field_ord"))
    at = rows.join(sides, ["identity", "piece"]).join(fields, ["template", "role"]).join(dims.places(), ["template", "field_id"], "left")
    blurred = _unreadable(floor, abstention)
    at = at.where(F.col("x0").isNotNull() | blurred)
    at = at.withColumn("_tokens", X.tokens(F.transform(_zone_texts(), lambda w: w["text"])))
    held = at.groupBy(*keys, "data").agg(F.array_sort(F.collect_list(F.struct("side", "field_ord", F.col("piece"), F.col("_tokens").alias("t"), blurred.alias("bad")))).alias("s"))
    bad = F.array_distinct(F.transform(F.filter("s", lambda x: x["bad"]), lambda x: x["piece"]))
    none = held.where(F.size(bad) > 0).select(*keys, F.lit("consistency").alias("check"), F.array_join(bad, "+").alias("piece"), F.col("data").alias("target"), F.lit(None).cast("double").alias("score"))
    good = held.where(F.size(bad) == 0)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(F.concat(a["piece"], F.lit("+"), b["piece"]).alias("p"), a["t"].alias("x"), b["t"].alias("y")))))
    pairs = good.select(*keys, "data", F.explode(pairs).alias("q")).select(*keys, "data", "q.p", "q.x", "q.y")
    return none.unionByName(pairs.select(*keys, F.lit("consistency").alias("check"), F.col("p").alias("piece"), F.col("data").alias("target"), (1.0 - X.overlap("x", "y")).alias("score")))


RULES = {
    "required_field": required_field, "required_checkbox": required_checkbox, "signature": signature, "expiry": expiry, "consistency": consistency, "forbidden_value": forbidden_value,
    "resolution": _page("resolution", lambda: -_r("source_dpi")), "cropped_page": _page("cropped_page", lambda: 1.0 - _r("coverage")), "rotated_page": _page("rotated_page", lambda: _r("orientation_margin")),
}


#: What each check reads of a reading, besides its resolution; the rest isn't copied for its settings.
NEEDS = {
    "required_field": ("words", "zone_words_by_field", "field_ink"), "required_checkbox": ("boxes",), "signature": ("signatures",), "expiry": ("words", "zone_words_by_field"),
    "consistency": ("words", "zone_words_by_field"), "forbidden_value": ("words", "zone_words_by_field"), "resolution": (), "cropped_page": ("coverage",), "rotated_page": ("orientation_margin",),
}


def scored(readings: DataFrame, dims: Dimensions, settings: DataFrame, keys: Sequence[str], checks: Sequence[str] = CHECKS, *, clock: str = "filing", floor: float = 0.0, abstention: bool = True) -> DataFrame:
    """keys, setting_id, check, piece, target, score of every target under every setting of its check.

    readings need identity and piece; templates come from the identity's pieces. A missing piece has no rows.
    """
    rows = readings.join(dims.ref_pieces.select("identity", "piece", "template"), ["identity", "piece"])
    out = None
    for check in checks:
        own = settings.where(F.col("check") == check).drop("check")
        narrow = rows.withColumn("reading", F.struct(*[_r(name).alias(name) for name in ("source_dpi", *NEEDS[check])]))
        at = narrow.crossJoin(F.broadcast(own))  # at most a few dozen settings
        extra = (clock,) if check == "expiry" else ()
        found = RULES[check](at, dims, [*keys, "setting_id"], floor, abstention, *extra)
        out = found if out is None else out.unionByName(found)
    return out


def evaluate(readings: DataFrame, dims: Dimensions, settings: DataFrame, thresholds: Mapping[str, float], keys: Sequence[str], checks: Sequence[str] = CHECKS, *, clock: str = "filing", abstention: bool = True) -> DataFrame:
    """Findings at frozen thresholds, one setting per check. The floor is the resolution threshold's."""
    found = scored(readings, dims, settings, keys, checks, clock=clock, floor=-thresholds["resolution"], abstention=abstention)
    limit = F.create_map(*[F.lit(x) for c in checks for x in (c, float(thresholds[c]))])
    out = found.withColumn("threshold", F.try_element_at(limit, F.col("check")))
    return out.withColumn("fires", fires(F.col("score"), F.col("threshold")))


def verdict(findings: DataFrame, dossier: Sequence[str]) -> DataFrame:
    """Per dossier: defects, unreadable, silent findings, and the exit code: 1 with defects, else 2 with unreadable, else 0."""
    defect = F.col("fires") & (F.col("check") != "resolution")
    blurred = (F.col("fires") & (F.col("check") == "resolution")) | F.col("score").isNull()
    out = findings.groupBy(*dossier).agg(F.count_if(defect).alias("defects"), F.count_if(blurred).alias("unreadable"), F.count_if(~defect & ~blurred).alias("silent"))
    return out.withColumn("exit_code", F.when(F.col("defects") > 0, 1).when(F.col("unreadable") > 0, 2).otherwise(0))
