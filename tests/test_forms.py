import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docugauge.__main__ import Parser, main
from docugauge.functions import forms
from docugauge.operators import design
from docugauge.operators import raster as R


def test_values_by_precedence(spark):
    rows = [("name", "Ann", None, False, None, False, None), ("name", "Ann", None, True, "Eve", False, None), ("name", "Ann", None, False, "Eve", False, None), ("until", None, "expiration", False, None, False, None), ("until", None, "expiration", False, None, True, None), ("until", None, "expiration", False, None, False, 365), ("signature_date", None, None, False, None, False, None)]
    df = spark.createDataFrame(rows, "role string, value string, kind string, emptied boolean, replacement string, expired boolean, expired_days int").coalesce(1)
    day = lambda *a: F.lit(dt.date(*a))
    variant = {k: F.col(k) for k in ("emptied", "replacement", "expired", "expired_days")}
    got = df.select(forms.printed_value(F.col("role"), F.col("value"), date_kind=F.col("kind"), date_format=F.lit("fr"), filing=day(2026, 8, 21), valid_until=day(2030, 1, 2), expired_until=day(2020, 1, 2), variant=variant)).collect()
    assert [r[0] for r in got] == ["Ann", None, "Eve", "02/01/2030", "02/01/2020", "21/08/2025", "21/08/2026"]


def test_places_and_lines(spark):
    df = spark.createDataFrame([("999-99-9999", ["a", "b", "c"]), ("02/01/2030", ["d"]), ("short", ["d"]), ("12 34", ["a", "b", "c"])], "v string, f array<string>").coalesce(1)
    got = [r[0] for r in df.select(forms.placed(F.col("v"), F.col("f"), F.create_map(F.lit("d"), F.lit(8)))).collect()]
    assert got == [{"a": "999", "b": "99", "c": "9999"}, {"d": "02012030"}, {"d": "short"}, {"a": "12", "b": "34"}]
    line = spark.createDataFrame([("one two three extraordinarily four",)], "t string").select(forms.wrapped(F.col("t"), 9)).first()[0]
    assert line == ["one two", "three", "extraordinarily", "four"]


def test_ink_and_degradation_are_neutral_at_zero_and_replay():
    page = np.full((60, 80), 250, np.uint8)
    page[20:30, 10:60] = 30
    assert (R.degraded(page) == page).all() and R.degraded(page, quarter_turns=1).shape == (80, 60) and R.degraded(page, crop=0.5).shape == (30, 80)
    a, b = (R.degraded(page, sigma=6.0, jitter=True, seed=s) for s in (11, 11))
    assert (a == b).all() and (a != R.degraded(page, sigma=6.0, jitter=True, seed=23)).any()
    zone = (10, 20, 70, 40)
    for shape in (R.speck, R.stroke):
        inks = [R.ink_ratio(shape(np.full((60, 80), 250, np.uint8), zone, f, np.random.default_rng(3)), zone, 160) for f in (0.002, 0.04)]
        assert 0 <= inks[0] < inks[1]


def test_targeted_design(spark):
    targets = spark.createDataFrame([("v", "expiry", "tax", "f1"), ("w", "signature", "tax", "f2")], "variant string, `check` string, piece string, zone string")
    cells = design.grid(spark, {"angle": (0.0, 1.0, 4.0), "dpi": (150, 200, 300), "jpeg": (30, 95, 75)})
    rows = design.targeted_runs(cells, targets)
    assert rows.count() == 27 * 3 * 4 * 2 * 2 and rows.where("parasite = 0 AND shape IS NOT NULL").count() == 0
    assert {r.shape for r in rows.where("parasite > 0").select("shape").distinct().collect()} == set(design.SHAPES)


def test_command_line(spark, tmp_path, capsys):
    for d in ("t", "r"):
        (tmp_path / d).mkdir()
    (tmp_path / "t" / "form.yaml").write_text("fields: {name: f1}\n")
    (tmp_path / "r" / "reference.yaml").write_text("dossier: d\nclocks: {filing: 2026-08-21}\npieces: [{id: tax, template: form}]\n")
    (tmp_path / "th.json").write_text(json.dumps({"resolution": {"value": -148.5}, "cropped_page": {"value": 0.0879}}))
    reading = {"piece": "tax", "source_dpi": 200.0, "coverage": 1.0}
    args = [str(tmp_path / x) for x in ("m.jsonl", "t", "r", "th.json")]

    def status(**changes):
        (tmp_path / "m.jsonl").write_text(json.dumps({"angle": 0.0, "dpi": 200, "variant": "clean", "piece": "tax", "reading": reading | changes}))
        return main([*args, "--clock", "filing", "--json"])

    assert status() == 0 and status(coverage=0.5) == 1 and status(source_dpi=72.0) == 2
    assert '"check":"resolution"' in capsys.readouterr().out
    with pytest.raises(SystemExit) as wrong:
        main(args)
    assert wrong.value.code == 64 and issubclass(Parser, object)
