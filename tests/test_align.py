from pyspark.sql import functions as F

from docugauge.operators import align


def pairs(spark, observed, expected, **options):
    o = spark.createDataFrame([("b", i, v) for i, v in enumerate(observed)], "batch string, place int, value string")
    e = spark.createDataFrame([("b", i, v) for i, v in enumerate(expected)], "batch string, place int, value string")
    rows = align.align(o, e, **options).collect()
    both = sorted((r.observed, r.expected) for r in rows if r.observed is not None and r.expected is not None)
    return both, sorted(r.observed for r in rows if r.expected is None), sorted(r.expected for r in rows if r.observed is None)


def test_straight_missing_duplicate_unreadable_ambiguous(spark):
    assert pairs(spark, ["a", "b", "c"], ["a", "b", "c"]) == ([(0, 0), (1, 1), (2, 2)], [], [])
    assert pairs(spark, ["a", "c", "d"], ["a", "b", "c", "d"]) == ([(0, 0), (1, 2), (2, 3)], [], [1])
    assert pairs(spark, ["a", "a", "b", "c"], ["a", "b", "c"]) == ([(0, 0), (2, 1), (3, 2)], [1], [])
    assert pairs(spark, ["a", None, "c"], ["a", "b", "c"]) == ([(0, 0), (2, 2)], [1], [1])
    assert pairs(spark, ["a", "b"], ["a", "b", "c"]) == ([(0, 0), (1, 1)], [], [2])
    assert pairs(spark, ["x", "y"], ["a", "b"]) == ([], [0, 1], [0, 1])
    assert pairs(spark, ["a", "b", "c", "d"], ["a", "c"]) == ([(0, 0)], [1, 2, 3], [1])


def test_own_matching_and_neighbours(spark):
    contains = lambda a, b: F.contains(a, b) | F.contains(b, a)
    assert pairs(spark, ["xa", "b"], ["a", "by"], matches=contains)[0] == [(0, 0), (1, 1)]
    rows = spark.createDataFrame([("b", 0, "ann", "ann"), ("b", 1, "cid", "bob"), ("b", 2, "bob", "cid"), ("b", 3, "eve", "dan")], "batch string, n int, seen string, want string")
    got = {r.n: r.fixed for r in align.neighbour_fix(rows, ["batch"], "n", "seen", "want", lambda a, b: a == b).collect()}
    assert got == {0: 0, 1: 1, 2: -1, 3: None}


def test_ingest_accounts_for_all(spark):
    shots = spark.createDataFrame([("b", f"f{i}", i, c, n) for i, (c, n) in enumerate([("S01", "ann"), ("S03", "cid"), ("S04", "nobody")])], "batch string, file string, ts int, code string, name string")
    lines = spark.createDataFrame([("b", i, f"S{i:02d}", "a", "tax", "clean", "", "0", 300, n) for i, n in ((1, "ann"), (2, "bob"), (3, "cid"), (4, "dan"))], "batch string, line int, sheet_code string, identity string, piece string, variant string, instance string, mark_step string, dpi int, name string")
    kept, lost = align.ingest(shots, lines, name_matches=lambda a, b: a == b)
    assert {(r.file, r.line) for r in kept.collect()} == {("f0", 1), ("f1", 3)}
    assert {(r.reason, r.file, r.line) for r in lost.collect()} == {("checklist line has no capture", None, 2), ("identity mismatch", "f2", 4)}


def test_baseline_is_the_last_step_zero_of_the_same_sheet(spark):
    rows = spark.createDataFrame([("s", 0, 1, 5.0), ("s", 0, 2, 7.0), ("s", 1, 3, 9.0), ("t", 1, 4, 1.0)], "sheet string, step int, n int, value double")
    got = {r.n: r.baseline for r in align.against_baseline(rows, ["sheet"], "step", "n", "value").collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 7.0, 4: None}
