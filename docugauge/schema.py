"""Schemas of the tables: measurements with nested readings, declared dimensions, scores and findings."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the checks, their order, and the settings that act on each.
CHECKS = ("required_field", "required_checkbox", "signature", "expiry", "consistency", "forbidden_value", "resolution", "cropped_page", "rotated_page")
READING_CHECKS = ("required_field", "expiry", "consistency", "forbidden_value")
KNOBS = {
    "required_field": ("min_conf", "text_sensor", "ink_threshold"),
    "required_checkbox": ("disc_ratio", "ink_threshold"),
    "signature": ("ink_threshold", "signature_sensor"),
    "expiry": ("min_conf", "text_sensor"),
    "consistency": ("min_conf", "text_sensor"),
    "forbidden_value": ("min_conf", "text_sensor"),
    "resolution": (),
    "cropped_page": (),
    "rotated_page": (),
}
SWEPT = {"min_conf": (0.0, 10.0, 20.0, 40.0, 60.0, 80.0), "text_sensor": ("page", "zone", "union"), "disc_ratio": (0.30, 0.42, 0.55, 0.70), "ink_threshold": (128, 160, 190), "signature_sensor": ("components", "ink")}
SETTING_DEFAULTS = {"min_conf": 40.0, "disc_ratio": 0.42, "ink_threshold": 160, "signature_sensor": "components", "text_sensor": "union"}
# The factors of a cell, in their order.
AXES = ("angle", "dpi", "jpeg", "sigma", "parasite")
KEY_DDL = "angle DOUBLE, dpi INT, jpeg INT, sigma DOUBLE, seed INT, parasite DOUBLE, identity STRING, source STRING, jitter BOOLEAN, capture STRING, mark_step INT"
KEY = tuple(x.split()[0] for x in KEY_DDL.split(", "))
KEY_DEFAULTS = {"parasite": 0.0, "identity": "reference", "source": "g0", "jitter": False}

WORD_DDL = "STRUCT<text: STRING, cx: INT, cy: INT, conf: INT, added: BOOLEAN>"


def _reading(word: str) -> str:
    return (
        "STRUCT<piece: STRING, template: STRING, angle: DOUBLE, quarter_turns: INT, source_dpi: DOUBLE, peak: DOUBLE, coverage: DOUBLE, orientation_margin: DOUBLE, "
        f"words: ARRAY<{word}>, zone_words_by_field: MAP<STRING, ARRAY<{word}>>, boxes: MAP<STRING, MAP<STRING, DOUBLE>>, field_ink: MAP<STRING, MAP<STRING, DOUBLE>>, signatures: MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>>"
    )


READING_DDL = _reading(WORD_DDL)
#: On disk a word is an array of mixed types, which only loads as strings.
RAW_MEASUREMENTS = f"{KEY_DDL}, parasite_shape STRING, parasite_zone STRING, variant STRING, piece STRING, seconds DOUBLE, ts STRING, image_path STRING, instance STRING, field_ink_share DOUBLE, reading {_reading('ARRAY<STRING>')}"
MEASUREMENTS = RAW_MEASUREMENTS.replace(_reading("ARRAY<STRING>"), READING_DDL)

SETTINGS = "setting_id INT, `check` STRING, min_conf DOUBLE, text_sensor STRING, ink_threshold INT, disc_ratio DOUBLE, signature_sensor STRING"
THRESHOLDS = "`check` STRING, value DOUBLE, origin STRING, settings STRUCT<min_conf: DOUBLE, text_sensor: STRING, ink_threshold: INT, disc_ratio: DOUBLE, signature_sensor: STRING>"
DIMENSIONS = {
    "templates": "template STRING, language STRING, date_format STRING, page INT",
    "template_fields": "template STRING, role STRING, field_id STRING, ord INT, kind STRING, required BOOLEAN, date_kind STRING",
    "zones": "template STRING, name STRING, page INT, x0 INT, y0 INT, x1 INT, y1 INT, kind STRING",
    "ref_pieces": "identity STRING, piece STRING, template STRING, ord INT",
    "ref_clocks": "identity STRING, clock STRING, d DATE",
    "ref_forbidden": "identity STRING, value STRING",
    "ref_consistency": "identity STRING, data STRING, ord INT, piece STRING, field STRING",
    "variants": "identity STRING, variant STRING, `check` STRING, piece STRING, legacy BOOLEAN",
    "damaged_targets": "identity STRING, variant STRING, `check` STRING, piece STRING, target STRING",
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
