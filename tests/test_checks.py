import datetime as dt

import pytest
from pyspark.sql import functions as F

from docugauge.operators import checks, design, dossiers
from docugauge.plans import protocol
from docugauge.schema import CHECKS, DIMENSIONS, READING_DDL, struct

FILING = dt.date(2026, 8, 21)
THRESHOLDS = {"required_field": -0.345, "required_checkbox": -14.375, "signature": -342.05, "expiry": 0.0, "consistency": 0.3939, "forbidden_value": 0.7214, "resolution": -148.5, "cropped_page": 0.0879, "rotated_page": 0.3585}


def dims(spark):
    rows = {
        "templates": [("form", "eng", "us", 0), ("card", "fra", "fr", 0)],
        "template_fields": [("form", "name", "f.name", 0, "field", True, None), ("form", "split", "f.s0", 0, "field", True, None), ("form", "split", "f.s1", 1, "field", True, None), ("form", "until", "f.until", 0, "field", False, "expiration"), ("form", "street", "f.street", 0, "field", False, None), ("form", "status", "f.box", 0, "box", True, None), ("form", "hand", "f.sign", 0, "signature", True, None), ("form", "ssn", "f.ssn", 0, "field", False, None), ("card", "street", "c.street", 0, "field", False, None)],
        "zones": [("form", n, 0, 0, y, 100, y + 10, "/Tx") for n, y in (("f.name", 0), ("f.s0", 40), ("f.s1", 80), ("f.until", 120), ("f.street", 160), ("f.ssn", 200))] + [("card", "c.street", 0, 0, 0, 100, 10, "/Tx")],
        "ref_pieces": [("a", "tax", "form", 0), ("a", "id", "card", 1)],
        "ref_clocks": [("a", "filing", FILING), ("a", "admissibility", dt.date(2026, 2, 10))],
        "ref_forbidden": [("a", "999-99-9999")],
        "ref_consistency": [("a", "address", 0, "tax", "street"), ("a", "address", 1, "id", "street")],
        "variants": [], "damaged_targets": [],
    }
    return checks.Dimensions({n: spark.createDataFrame(r, DIMENSIONS[n]) for n, r in rows.items()})


def reading(piece, dpi=200.0, words=(), ink=None, boxes=None, signs=None, coverage=1.0, margin=0.0):
    return (piece, "t", 0.0, 0, dpi, 0.9, coverage, margin, [(t, x, y, 90, True) for t, x, y in words], {}, boxes or {"f.box": {"0.42|160": 30.0}}, ink or {f: {"160": 4.0} for f in ("f.name", "f.s0", "f.s1")}, signs or {"f.sign": {"160": [9.0, 1.0, 50.0, 400.0]}})


GOOD = [("2026", 60, 125), ("10/", 40, 125), ("12/", 20, 125), ("rue", 10, 165), ("tilleuls", 50, 165)]
CARD = [("RUE", 10, 5), ("tilleuls", 50, 5)]


def findings(spark, tax, card, settings=None, clock="filing", abstention=True):
    rows = spark.createDataFrame([("d", "a", "tax", tax), ("d", "a", "id", card)], f"dossier string, identity string, piece string, reading {READING_DDL}")
    own = checks.settings_table(spark, {c: [(settings or {}).get(c, {"text_sensor": "ink"} if c == "required_field" else {})] for c in CHECKS})
    return {(r.check, r.piece, r.target): (r.score, r.fires) for r in checks.evaluate(rows, dims(spark), own, THRESHOLDS, ["dossier"], clock=clock, abstention=abstention).collect()}


def test_a_good_dossier_is_silent(spark):
    got = findings(spark, reading("tax", words=GOOD), reading("id", words=CARD))
    assert not any(fires for _, fires in got.values())
    assert got["required_field", "tax", "f.s1"][0] == -4.0 and got["required_checkbox", "tax", "f.box"][0] == -30.0 and got["signature", "tax", "f.sign"][0] == -400.0
    assert got["expiry", "tax", "f.until"][0] == (FILING - dt.date(2026, 12, 10)).days and got["consistency", "tax+id", "address"][0] == 0.0
    assert got["resolution", "id", ""][0] == -200.0 and got["forbidden_value", "id", "999-99-9999"][0] < 0.5 and len(got) == 3 + 1 + 1 + 1 + 1 + 2 + 6


def test_each_defect_fires_alone(spark):
    def fired(tax, card):
        return {k[0] for k, v in findings(spark, tax, card).items() if v[1]}

    good = reading("id", words=CARD)
    assert fired(reading("tax", words=GOOD, ink={"f.name": {"160": 0.1}, "f.s0": {"160": 4.0}}), good) == {"required_field"}
    assert fired(reading("tax", words=GOOD, boxes={"f.box": {"0.42|160": 2.0}}), good) == {"required_checkbox"}
    assert fired(reading("tax", words=GOOD, signs={"f.sign": {"160": [0.0, 0.0, 0.0, 0.0]}}), good) == {"signature"}
    assert fired(reading("tax", words=[("08", 20, 125), ("20", 40, 125), ("2026", 60, 125), *GOOD[3:]]), good) == {"expiry"}
    assert fired(reading("tax", words=GOOD), reading("id", words=[("RUE", 10, 5), ("acacias", 50, 5)])) == {"consistency"}
    assert fired(reading("tax", words=[*GOOD, ("999-99-9999", 10, 205)]), good) == {"forbidden_value"}
    assert fired(reading("tax", words=GOOD, coverage=0.8), good) == {"cropped_page"} and fired(reading("tax", words=GOOD, margin=0.5), good) == {"rotated_page"}


def test_below_the_floor_is_undecided_not_compliant(spark):
    got = findings(spark, reading("tax", dpi=72.0, words=GOOD), reading("id", words=CARD), settings={"required_field": {"text_sensor": "page"}})
    assert got["resolution", "tax", ""][1] and got["expiry", "tax", "f.until"] == (None, False) and got["consistency", "tax", "address"] == (None, False)
    assert got["required_field", "tax", "f.name"] == (None, False) and got["forbidden_value", "tax", "999-99-9999"] == (None, False)
    bare = findings(spark, reading("tax", dpi=72.0, words=GOOD), reading("id", words=CARD), abstention=False)
    assert bare["expiry", "tax", "f.until"][0] is not None


def test_two_clocks_and_an_unreadable_date(spark):
    at = lambda clock, words: findings(spark, reading("tax", words=words), reading("id", words=CARD), clock=clock)["expiry", "tax", "f.until"]
    june = [("06", 20, 125), ("15", 40, 125), ("2026", 60, 125)]
    assert at("filing", june) == (67.0, True) and at("admissibility", june) == (-125.0, False) and at("filing", [("soon", 20, 125)]) == (None, False)


def test_an_empty_reading_contradicts(spark):
    got = findings(spark, reading("tax", words=GOOD), reading("id", words=[]))
    assert got["consistency", "tax+id", "address"] == (1.0, True)


def test_settings_counts_and_verdict(spark):
    assert [len(checks.combinations(c)) for c in CHECKS] == [21, 12, 6, 18, 18, 18, 1, 1, 1]
    rows = spark.createDataFrame([("a", "expiry", 1.0, True), ("b", "resolution", 1.0, True), ("c", "expiry", None, False), ("d", "expiry", -1.0, False)], "dossier string, `check` string, score double, fires boolean")
    assert {r.dossier: r.exit_code for r in checks.verdict(rows, ["dossier"]).collect()} == {"a": 1, "b": 2, "c": 2, "d": 0}


def test_instances_and_what_they_damage(spark):
    d = dims(spark)
    found = design.enumerate_variants(d)
    names = {r.variant for r in found.collect()}
    assert names == {"empty_required_field@tax.name", "empty_required_field@tax.split", "unchecked_box@tax.status", "missing_signature@tax.hand", "expired_date@tax.until.1d", "expired_date@tax.until.365d", "forbidden_value@tax", "diverging_address@id", *[f"{p}@{x}" for p in design.PAGE_DEFECTS for x in ("tax", "id")]}
    hit = {(r.variant, r.piece, r.target) for r in design.damaged_targets(found, d).collect()}
    assert ("empty_required_field@tax.split", "tax", "f.s1") in hit and ("diverging_address@id", "tax+id", "address") in hit and ("forbidden_value@tax", "tax", "999-99-9999") in hit and ("cropped_page@id", "id", "") in hit
    assert design.readings_to_make(found, d).count() == 2 + len(names)


def test_complete_dossiers_overlay_and_sweep(spark):
    ddl = f"seed int, identity string, variant string, piece string, reading {READING_DDL}"
    good, card = reading("tax", words=GOOD), reading("id", words=CARD)
    empty = reading("tax", words=GOOD, ink={"f.name": {"128": 0.0, "160": 0.0, "190": 0.0}})
    rows = [(s, "a", "clean", p, r) for s in (1, 2, 3) for p, r in (("tax", good), ("id", card))] + [(s, "a", "v", "tax", empty) for s in (1, 2)]
    df = spark.createDataFrame(rows, ddl)
    expected = spark.createDataFrame([("clean",), ("v",)], "variant string")
    whole = dossiers.complete(df, ["seed", "identity"], expected, 2)
    assert whole.count() == 8 and {r.seed for r in whole.collect()} == {1, 2}
    damaged = spark.createDataFrame([("v", "required_field", "tax", "f.name")], "variant string, `check` string, piece string, target string")
    settings = checks.settings_table(spark, {"required_field": [{"text_sensor": "ink"}]})
    got = protocol.sweep(whole, dims(spark), settings, damaged, ["seed", "identity"], ["required_field"])
    counts = {r.positive: r.n for r in got.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    assert counts == {True: 2, False: 6}


def test_an_abstaining_instance_adds_no_positive_but_a_legacy_one_all(spark):
    rows = [("k", "v", "p", "t1", 0, None), ("k", "v", "p", "t2", 0, 1.0), ("k", "clean", "p", "t2", 0, 0.0)]
    df = spark.createDataFrame(rows, "key string, variant string, piece string, target string, setting_id int, score double")
    damaged = spark.createDataFrame([("v", "c", "p", "t1")], "variant string, `check` string, piece string, target string")
    decided = df.where("score IS NOT NULL")
    assert dossiers.labelled(decided, damaged, "c", ["key"]).where("positive").count() == 0
    assert dossiers.labelled(decided, damaged, "c", ["key"], legacy=["v"]).where("positive").count() == 1


def test_schema_parses(spark):
    from docugauge import schema

    assert len(struct(schema.MEASUREMENTS)) == len(struct(schema.RAW_MEASUREMENTS)) == 21
    assert pytest.approx(schema.SWEPT["disc_ratio"][1]) == 0.42
