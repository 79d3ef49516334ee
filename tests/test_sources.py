import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docugauge.sources import declarations, manifests, readings, sinks
from docugauge.streaming import ingest

READING = {"piece": "tax", "template": "form", "angle": 0.0, "quarter_turns": 0, "source_dpi": 200.0, "peak": 0.9, "coverage": 1.0, "orientation_margin": 0.0, "words": [["Ab", 1, 2.0, 90, True], ["x", -3, 4, 7, False]], "zone_words_by_field": {"f": [["z", 5, 6, 80, True]]}, "boxes": {"b": {"0.3|128": 4.5}}, "field_ink": {"f": {"128": 1.5}}, "signatures": {"s": {"128": [1, 2, 3, 4]}}}


def line(**more):
    return json.dumps({"angle": 0.0, "dpi": 200, "jpeg": 95, "sigma": 0.0, "seed": 11, "variant": "clean", "piece": "tax", "seconds": 1.0, "ts": "2026-08-21T10:00:00+00:00", "reading": READING} | more)


def test_measurements_defaults_words_and_last_wins(spark, tmp_path):
    late = dict(READING, coverage=0.5)
    (tmp_path / "m.jsonl").write_text("\n".join([line(), "", line(seed=23, parasite=0.01), line(reading=late), line(source="x2", mark_step=0)]))
    with gzip.open(tmp_path / "n.jsonl.gz", "wt") as f:
        f.write(line(seed=37) + "\n")
    got = readings.read(spark, str(tmp_path)).collect()
    assert len(got) == 4
    first = next(r for r in got if r.seed == 11 and r.source == "g0")
    assert (first.parasite, first.identity, first.jitter, first.mark_step, first.reading.coverage) == (0.0, "reference", False, None, 0.5)
    assert [tuple(w) for w in first.reading.words] == [("Ab", 1, 2, 90, True), ("x", -3, 4, 7, False)] and first.reading.zone_words_by_field["f"][0].cx == 5 and first.reading.signatures["s"]["128"] == [1.0, 2.0, 3.0, 4.0]
    digests = {r.sha256 for r in readings.dump_digest(spark, str(tmp_path)).collect()}
    assert hashlib.sha256((line(seed=37) + "\n").encode()).hexdigest() in digests


def test_declarations(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "t" / "form.yaml").write_text("language: fra\ndate_format: fr\nfields: {name: f1, split: [f2, f3], until: f4}\nboxes: {status: b1}\nsignatures: {hand: s1}\nrequired: [name]\nrequired_boxes: [status]\ndates: {until: expiration}\n")
    (tmp_path / "r" / "id01.yaml").write_text("dossier: d\nclocks: {filing: 2026-08-21, other: 10/02/2026}\npieces: [{id: tax, template: form}]\nforbidden_values: ['999']\nconsistencies: [{data: a, readings: [{piece: tax, field: name}]}]\n")
    tables = declarations.load(spark, declarations.directory(tmp_path / "t"), declarations.directory(tmp_path / "r"))
    fields = {(r.role, r.field_id, r.ord, r.kind, r.required, r.date_kind) for r in tables["template_fields"].collect()}
    assert ("split", "f3", 1, "field", False, None) in fields and ("until", "f4", 0, "field", False, "expiration") in fields and ("status", "b1", 0, "box", True, None) in fields
    assert {r.clock: r.d for r in tables["ref_clocks"].collect()} == {"filing": dt.date(2026, 8, 21), "other": dt.date(2026, 2, 10)}
    assert tables["ref_pieces"].first().identity == "id01" and tables["ref_forbidden"].first().value == "999"
    with pytest.raises(ValueError):
        declarations.directory(tmp_path)
    with pytest.raises(ValueError, match="clocks, pieces"):
        declarations.reference_rows("x", {"dossier": 1})


def test_zones_truncate_and_flip(spark):
    rects = spark.createDataFrame([("t", "a", 0, 10.0, 700.0, 50.5, 720.0, 792.0, "/Tx", 0), ("t", "b", 0, 0.0, 0.0, 1.0, 1.0, 792.0, "/Btn", 1 << 15)], "template string, name string, page int, left double, bottom double, right double, top double, page_height double, field_type string, flags int")
    got = {r.name: r for r in declarations.zones_from_rects(rects).collect()}
    assert (got["a"].x0, got["a"].y0, got["a"].x1, got["a"].y1, got["a"].kind) == (27, 200, 140, 255, "/Tx") and got["b"].kind == "/Radio"


def test_manifest_refuses_before_reading(spark, tmp_path):
    head = ",".join([*manifests.REQUIRED, "extra"])
    good = "p.png,g1,a,tax,clean,,11,200,,,t,e"
    path = tmp_path / "m.csv"
    path.write_text("\n".join([head, good, "p.png,zz,a,tax,clean,,12,200,,,t,e", "p.png,g1,b,tax,clean,,13,200,,,t,e", "p.png,g1,a,no,clean,,14,200,,,t,e", "p.png,g1,a,tax,odd,,15,200,,,t,e", "p.png,g1,a,tax,clean,,16,,,,t,e", good, "q.png,g1,a,tax,clean,,17,200,,,t,e"]))
    pieces, variants = spark.createDataFrame([("a", "tax")], "identity string, piece string"), spark.createDataFrame([("a", "v")], "identity string, variant string")
    there = spark.createDataFrame([("p.png",)], "path string")
    rows = manifests.read_manifest(spark, str(path))
    found = {(r.line, r.problem) for r in manifests.violations(rows, pieces, variants, there).collect()}
    assert found == {(3, "no such source: zz"), (4, "no reference for b"), (5, "the reference lacks the piece no"), (6, "not in the catalogue: odd"), (7, "resolution lacks"), (8, "repeats line 2"), (9, "nothing at q.png")}
    with pytest.raises(manifests.ManifestError, match="7 broken rules"):
        manifests.checked(rows, pieces, variants, there)
    path.write_text(f"{head}\n{good}\n")
    assert manifests.checked(manifests.read_manifest(spark, str(path)), pieces, variants, there).first().dpi == 200
    path.write_text("a,b\n1,2\n")
    with pytest.raises(manifests.ManifestError, match="missing column"):
        manifests.read_manifest(spark, str(path))


def test_capture_time_and_turns(spark):
    df = spark.createDataFrame([("D:20260821103000Z", None, None, "2020-01-01"), (None, "2026:08:21 10:30:00", None, "2020-01-01"), ("D:2026", None, "nonsense", "2020-01-01")], "p string, o string, e string, m string").coalesce(1)
    got = [str(r[0]) for r in df.select(manifests.capture_time(F.col("p"), F.col("o"), F.col("e"), F.to_timestamp("m"))).collect()]
    assert got == ["2026-08-21 10:30:00", "2026-08-21 10:30:00", "2020-01-01 00:00:00"]
    assert [r[0] for r in spark.range(4).select(manifests.expected_quarter_turns(F.col("id"))).collect()] == [0, 3, 2, 1]


def test_sinks(spark, tmp_path):
    merged = sinks.merged_thresholds({"expiry": {"value": 0, "origin": "definition", "note": 1}, "x": {"value": 1, "old": 2}}, {"expiry": {"value": 5.0, "recall": 0.123456}, "x": {"value": 2.34567, "origin": "grid"}})
    assert merged == {"expiry": {"value": 0, "origin": "definition", "note": 1, "recall": 0.1235}, "x": {"value": 2.3457, "origin": "grid"}}
    tagged = spark.createDataFrame([("a", None), ("b", "lost")], "file string, reason string")
    sinks.write_manifest(tagged, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1 and spark.read.json(f"{tmp_path / 'm'}.excluded").first().reason == "lost"
    rows = spark.createDataFrame([("expiry", 1.0, 2.0)], "`check` string, threshold double, recall double")
    held = sinks.publish_thresholds(rows, tmp_path / "t.json")
    assert held["expiry"]["value"] == 1.0 and declarations.thresholds(spark, tmp_path / "t.json").first().value == 1.0
    assert "67" not in sinks.markdown(rows) and "expiry" in sinks.markdown(rows)
    assert sinks.reading_sentence(rows.withColumn("text_sensor", F.lit("page"))).first().reading == "fires more than 1 days past the date"


def test_stream_reads_each_reading_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join([line(), line(), line(seed=23)]))
    flow = ingest.once(ingest.stream(spark, str(source)))
    ingest.append(flow, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    (source / "b.jsonl").write_text(line(seed=37))
    ingest.append(ingest.once(ingest.stream(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.seed for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [11, 23, 37]


def png(grey, kinds, colour=0):
    """A PNG file of lines with differences of the given kinds."""
    import struct
    import zlib

    import numpy as np

    step = {0: 1, 2: 3, 6: 4}[colour]
    lines, before, out = grey.reshape(len(grey), -1).astype(int), np.zeros(grey.reshape(len(grey), -1).shape[1], int), b""
    for kind, line in zip(kinds, lines):
        left, corner = (np.concatenate((np.zeros(step, int), x[:-step])) for x in (line, before))
        far = np.abs(np.stack((before - corner, left - corner, left + before - 2 * corner)))
        guess = [0, left, before, (left + before) // 2, np.choose(far.argmin(0), (left, before, corner))][kind]
        out += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    size = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size) + chunk(b"IDAT", zlib.compress(out)[:20]) + chunk(b"IDAT", zlib.compress(out)[20:]) + chunk(b"IEND", b"")


def test_png_files_become_rasters(spark):
    import numpy as np

    from docugauge.sources import images

    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (15, 11), dtype=np.uint8)
    assert np.array_equal(images.grey_png(png(grey, [i % 5 for i in range(15)])), grey)
    colours = rng.integers(0, 256, (10, 7, 3), dtype=np.uint8)
    found = images.grey_png(png(colours, [4, 3, 2, 1, 0] * 2, 2))
    assert np.abs(found.astype(float) - colours @ np.array([0.299, 0.587, 0.114])).max() <= 1
    clear = np.dstack((colours, np.zeros((10, 7), np.uint8)))
    assert (images.grey_png(png(clear, [1] * 10, 6)) == 255).all() and images.grey_png(b"GIF89a") is None
    df = spark.createDataFrame([(bytearray(png(grey, [4] * 15)),), (bytearray(b"no"),), (None,)], "content binary").coalesce(1)
    rows = [r.p for r in df.select(images.raster_of("content").alias("p")).collect()]
    assert (rows[0].h, rows[0].w, bytes(rows[0].px)) == (15, 11, grey.tobytes()) and rows[1].px is None and rows[2].px is None


def test_capture_times_of_files(spark):
    import struct

    from docugauge.sources import images

    def tags(order, original, changed):
        text = lambda s: s.encode().ljust(20, b"\0")
        entry = lambda tag, kind, n, v: struct.pack(order + "HHII", tag, kind, n, v)
        first = struct.pack(order + "H", 2) + entry(306, 2, 20, 100) + entry(34665, 4, 1, 50)
        sub = struct.pack(order + "H", 1) + entry(36867, 2, 20, 130)
        head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
        out = bytearray(200)
        for at, part in ((0, head), (8, first), (50, sub), (100, text(changed)), (130, text(original))):
            out[at : at + len(part)] = part
        return bytes(out)

    little, big = tags("<", "2026:08:21 10:30:00", ""), tags(">", "2026:08:21 10:30:00", "2026:08:22 11:00:00")
    assert images.tagged_times(little) == (None, "2026:08:21 10:30:00") and images.tagged_times(b"\xff\xd8\xff\xe1..Exif\0\0" + big)[1] == "2026:08:22 11:00:00"
    assert images.tagged_times(b"") == images.tagged_times(b"II*\0") == images.tagged_times(b"II*\0\xff\xff\xff\xff") == (None, None)
    rows = [b"%PDF-1.4 /CreationDate (D:20260821103000Z) x", little, b"\xff\xd8" + b"Exif\0\0" + big, b"nothing", None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(rows)], "i int, content binary").withColumn("modificationTime", F.lit("2020-01-01").cast("timestamp"))
    got = {r.i: str(r.captured) for r in images.with_times(df).collect()}
    assert got == {0: "2026-08-21 10:30:00", 1: "2026-08-21 10:30:00", 2: "2026-08-22 11:00:00", 3: "2020-01-01 00:00:00", 4: "2020-01-01 00:00:00"}
