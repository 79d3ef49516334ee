"""A page's reading, assembled from its raster, its blank, the words on both and the declared zones.

Nothing is compared with a reference and nothing crosses a threshold. Words come with the page: text
recognition is an input. Words of the page and of zones are in the page's pixels, printed ones in the blank's.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docugauge.functions.text import NEAR, plain
from docugauge.operators import raster
from docugauge.operators.checks import MARGIN
from docugauge.schema import READING_DDL, SWEPT

INKS, DISCS = SWEPT["ink_threshold"], SWEPT["disc_ratio"]


def _words(found: list, frame: dict, printed: list) -> list[dict]:
    """Words in the blank's frame, and whether the page added them: no printed word of the same text is near."""
    at: dict[str, list] = {}
    for w in printed:
        at.setdefault(plain(w["text"]), []).append((w["cx"], w["cy"]))
    out = []
    for w in found:
        x, y = (frame[d] + w[c] * frame["scale"] for d, c in (("dx", "cx"), ("dy", "cy")))
        known = any(np.hypot(x - px, y - py) <= NEAR for px, py in at.get(plain(w["text"]), ()))
        out.append({"text": w["text"], "cx": x, "cy": y, "conf": w["conf"], "added": not known})
    return out


def _rounded(words: list[dict]) -> list[dict]:
    return [w | {k: round(w[k]) for k in ("cx", "cy", "conf")} for w in words]


def measured(page: np.ndarray, blank: np.ndarray, words: list, zone_words: dict, printed: list, zones: list, piece: str, template: str) -> dict:
    """The reading. zones: name, kind (field, box or signature), x0, y0, x1, y1 in the blank's pixels."""
    frame = raster.prepared(page, blank)
    axis, _, straight = raster.deskew(page)
    scan, under = raster.blank_in_frame(straight, blank, (frame["quarter_turns"] - axis) % 4, frame["scale"], frame["dx"], frame["dy"])
    scale = frame["scale"]
    inside = lambda w: any(z["x0"] - MARGIN <= w["cx"] <= z["x1"] + MARGIN and z["y0"] - MARGIN <= w["cy"] <= z["y1"] + MARGIN for z in zones)
    out = {"piece": piece, "template": template, "quarter_turns": frame["quarter_turns"]}
    out |= {name: round(frame[name], digits) for name, digits in (("angle", 3), ("source_dpi", 2), ("peak", 4), ("coverage", 4), ("orientation_margin", 4))}
    out["words"] = _rounded([w for w in _words(words, frame, printed) if inside(w)])
    out |= {"zone_words_by_field": {}, "field_ink": {}, "boxes": {}, "signatures": {}}
    for z in zones:
        there = [round((z[c] - frame[d]) / scale) for c, d in (("x0", "dx"), ("y0", "dy"), ("x1", "dx"), ("y1", "dy"))]
        gain = lambda f, *more: round(f(scan, there, *more) - f(under, there, *more), 3)  # noqa: E731, B023
        if z["kind"] == "field":
            out["zone_words_by_field"][z["name"]] = _rounded(_words(zone_words.get(z["name"], []), frame, printed))
            out["field_ink"][z["name"]] = {str(t): gain(raster.ink_ratio, t) for t in INKS}
        elif z["kind"] == "box":
            out["boxes"][z["name"]] = {f"{r}|{t}": gain(raster.disc_ink, r, t) for r in DISCS for t in INKS}
        else:
            marks = {t: raster.components(raster.added(scan, under, there, t)) for t in INKS}
            out["signatures"][z["name"]] = {str(t): [gain(raster.ink_ratio, t), n, round(area * scale * scale), round(diagonal * scale, 1)] for t, (n, area, diagonal) in marks.items()}
    return out


@F.pandas_udf(T.StringType())
def _measured(page: pd.DataFrame, blank: pd.DataFrame, given: pd.Series) -> pd.Series:
    out = []
    for p, b, text in zip(page.to_dict("records"), blank.to_dict("records"), given):
        g = json.loads(text)
        out.append(json.dumps(measured(raster._array(p), raster._array(b), *(g.get(k) or kind() for k, kind in (("words", list), ("zone_words", dict), ("printed", list), ("zones", list))), g.get("piece"), g.get("template"))))
    return pd.Series(out)


def reading(page: Column, blank: Column, *, words: Column, zone_words: Column, printed: Column, zones: Column, piece: Column, template: Column) -> Column:
    """The reading struct of a page. words, printed: arrays of text, cx, cy, conf; zone_words: a map of field to such; zones: an array. Null ones are empty."""
    given = F.to_json(F.struct(words.alias("words"), zone_words.alias("zone_words"), printed.alias("printed"), zones.alias("zones"), piece.alias("piece"), template.alias("template")))
    return F.from_json(_measured(page, blank, given), READING_DDL)
