"""Declared data: reference and form files in YAML, thresholds in JSON, as dimension tables.

Files are small and read on the driver; what comes of them are DataFrames with the schemas of schema.DIMENSIONS.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.schema import DIMENSIONS, SETTING_DEFAULTS, THRESHOLDS

DATE_SHAPES = ("%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y")


def date(text) -> dt.date:
    """Day first, ISO, or month first, tried in that order."""
    if isinstance(text, dt.date):
        return text
    for shape in DATE_SHAPES:
        try:
            return dt.datetime.strptime(str(text), shape).date()
        except ValueError:
            continue
    raise ValueError(f"no date: {text!r}")


def _one_or_many(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def template_rows(name: str, declared: dict) -> dict[str, list[tuple]]:
    """Rows of templates and template_fields of one form; a role may have several fields."""
    required, boxes, signatures = (set(declared.get(k) or ()) for k in ("required", "required_boxes", "required_signatures"))
    dates, rows = declared.get("dates") or {}, []
    for kind, roles, need in (("field", declared.get("fields") or {}, required), ("box", declared.get("boxes") or {}, boxes), ("signature", declared.get("signatures") or {}, signatures)):
        rows += [(name, role, str(f), i, kind, role in need, dates.get(role)) for role, ids in roles.items() for i, f in enumerate(_one_or_many(ids))]
    return {"templates": [(name, declared.get("language", "eng"), declared.get("date_format", "us"), int(declared.get("page", 0)))], "template_fields": rows}


def reference_rows(identity: str, declared: dict) -> dict[str, list[tuple]]:
    """Rows of one reference file; dossier, clocks and pieces must be there."""
    if lacking := [k for k in ("dossier", "clocks", "pieces") if k not in declared]:
        raise ValueError(f"{identity}: {', '.join(lacking)} missing")
    pieces = [(p["id"], p["template"]) if isinstance(p, dict) else tuple(p) for p in declared["pieces"]]
    sides = [(identity, c["data"], i, s["piece"], s["field"]) for c in declared.get("consistencies") or () for i, s in enumerate(c["readings"])]
    return {
        "ref_pieces": [(identity, p, t, i) for i, (p, t) in enumerate(pieces)],
        "ref_clocks": [(identity, k, date(v)) for k, v in declared["clocks"].items()],
        "ref_forbidden": [(identity, str(v)) for v in declared.get("forbidden_values") or ()],
        "ref_consistency": sides,
    }


def load(spark: SparkSession, templates: Iterable[Path | str], references: Iterable[Path | str]) -> dict[str, DataFrame]:
    """All dimension tables of form and reference files; names and identities are file stems."""
    rows: dict[str, list] = {n: [] for n in DIMENSIONS}
    for paths, of in ((templates, template_rows), (references, reference_rows)):
        for path in sorted(map(Path, paths)):
            for name, some in of(path.stem, yaml.safe_load(path.read_text(encoding="utf-8"))).items():
                rows[name] += some
    return {n: spark.createDataFrame(r, DIMENSIONS[n]) for n, r in rows.items()}


def directory(path: Path | str) -> list[Path]:
    """The YAML files of a directory in order; an empty one is an error."""
    found = sorted(Path(path).glob("*.yaml"))
    if not found:
        raise ValueError(f"no YAML file in {path}")
    return found


def thresholds(spark: SparkSession, path: Path | str) -> DataFrame:
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = []
    for check, entry in held.items():
        if isinstance(entry, dict) and "value" in entry:
            chosen = entry.get("measured_settings") or {}
            rows.append((check, float(entry["value"]), entry.get("origin"), tuple((SETTING_DEFAULTS | chosen)[k] for k in ("min_conf", "text_sensor", "ink_threshold", "disc_ratio", "signature_sensor"))))
    return spark.createDataFrame(rows, THRESHOLDS)


def zones_from_rects(rects: DataFrame, dpi: int = 200) -> DataFrame:
    """Zones in pixels from rectangles in points (template, name, page, left, bottom, right, top, page_height, field_type, flags).

    Down from the top of the page, truncated towards zero; buttons are pushed (bit 16), chosen of several (bit 15), or ticked.
    """
    px = lambda c: (c * dpi / 72).cast("int")
    flag = lambda bit: F.col("flags").bitwiseAND(1 << bit) != 0
    kind = F.when((F.col("field_type") == "/Btn") & flag(16), "/Push").when((F.col("field_type") == "/Btn") & flag(15), "/Radio").otherwise(F.col("field_type"))
    return rects.select("template", "name", "page", px(F.col("left")).alias("x0"), px(F.col("page_height") - F.col("top")).alias("y0"), px(F.col("right")).alias("x1"), px(F.col("page_height") - F.col("bottom")).alias("y1"), kind.alias("kind"))


def page_size(points_wide, points_high, dpi: int = 200):
    """(width, height) in pixels of page sizes in points, as Columns."""
    return (points_wide * dpi / 72).cast("int"), (points_high * dpi / 72).cast("int")


def study(spark: SparkSession, path: str) -> DataFrame:
    """Per check: k of n, rate and interval of a study's JSON ({check: {k, n}})."""
    from docugauge.functions.stats import ratio, wilson

    held = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = spark.createDataFrame([(c, int(v["k"]), int(v["n"])) for c, v in held.items()], "`check` string, k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.withColumns({"rate": ratio(F.col("k"), F.col("n")), "low": low, "high": high})
