import math
import random

import pytest
from pyspark.sql import functions as F

from docugauge.functions.stats import wilson
from docugauge.operators import curves, measures


def naive_wilson(k, n, z=1.96):
    if n == 0:
        return 0.0, 1.0
    p, d = k / n, 1 + z * z / n
    c, h = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (c - h) / d), min(1.0, (c + h) / d)


def naive_curve(rows):
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    seen = sorted({s for _, s in rows})
    cuts = [seen[0] - 1, *[(a + b) / 2 for a, b in zip(seen, seen[1:])], seen[-1] + 1]
    return [(t, sum(s > t for s in pos), sum(s > t for s in neg)) for t in cuts]


def table(spark, rows):
    return spark.createDataFrame([(f"k{i % 7}", p, float(s)) for i, (p, s) in enumerate(rows)], "key string, positive boolean, score double")


def test_wilson_values(spark):
    rows = spark.createDataFrame([(0, 81), (27, 81), (81, 81), (0, 0), (3, 3)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    got = {(r.k, r.n): (r.low, r.high) for r in rows.select("k", "n", low.alias("low"), high.alias("high")).collect()}
    assert got[0, 81] == pytest.approx((0.0, 0.04527967), abs=1e-8) and got[27, 81] == pytest.approx((0.24028620, 0.44147368), abs=1e-8)
    assert got[0, 0] == (0.0, 1.0)
    for (k, n), ends in got.items():
        assert ends == pytest.approx(naive_wilson(k, n), abs=1e-12)


@pytest.mark.parametrize("ranges", [1, 5, 32])
def test_curve_like_a_loop(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.random() < 0.4, rng.choice([rng.gauss(0, 3), round(rng.gauss(0, 2))])) for _ in range(400)]
    got = curves.curve(table(spark, rows), ranges=ranges).orderBy("threshold").collect()
    want = naive_curve(rows)
    assert [(r.threshold, r.tp, r.fp) for r in got] == want
    n_pos = sum(p for p, _ in rows)
    assert all(r.recall == r.tp / n_pos and r.n_neg == len(rows) - n_pos for r in got)


def test_ends_perfect_split_and_budget(spark):
    points = curves.curve(table(spark, [(True, 5), (True, 4), (False, 1), (False, 2)]))
    best = curves.chosen_point(points).first()
    assert (best.threshold, best.recall, best.fpr, best.grid_precision) == (3.0, 1.0, 0.0, 1.0)
    mixed = curves.curve(table(spark, [(True, 1), (False, 2)]))
    zero = curves.chosen_point(mixed, budget=0.0).first()
    assert zero.recall == 0.0 and zero.threshold == 3.0  # never firing is always affordable
    assert curves.curve(table(spark, []).where("false")).count() == 0
    assert curves.chosen_point(curves.curve(table(spark, []).where("false"))).count() == 0


def test_equal_to_the_threshold_does_not_fire_and_null_counts_nowhere(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("b", False, None), ("b", True, None)], "key string, positive boolean, score double")
    r = measures.measure(rows, 1.0, ["key"]).first()
    assert (r.tp, r.fp, r.n_pos, r.n_neg, r.n_dossiers, r.recall, r.dossier_fpr) == (0, 0, 1, 1, 2, 0.0, 0.0)


def test_plateau_takes_the_middle(spark):
    points = spark.createDataFrame([(float(t), 1.0, 0.0) for t in range(5)] + [(9.0, 0.5, 0.0)], "threshold double, recall double, fpr double")
    assert curves.chosen_point(points).first().threshold == 2.0


def test_two_level_counts_and_spine(spark):
    rows = spark.createDataFrame([("a", False, 5.0), ("a", False, 6.0), ("b", False, 1.0), ("b", True, 9.0)], "key string, positive boolean, score double")
    spine = spark.createDataFrame([("a",), ("b",), ("empty",)], "key string")
    r = measures.measure(rows, 4.0, ["key"], spine=spine).first()
    assert (r.fp, r.n_neg, r.n_dossiers) == (2, 3, 3) and r.dossier_fpr == pytest.approx(1 / 3)


def test_breakdowns_like_loops(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([1, 2, 3]), rng.choice([True, False]), f"k{rng.randrange(9)}", rng.random() < 0.5, float(rng.randrange(10))) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string, y int, z boolean, key string, positive boolean, score double")
    got = {(r.axis, r.value): r for r in measures.by_factor(df, 5.0, ["key"], ["x", "y", "z"]).collect()}
    for i, axis in enumerate(("x", "y", "z")):
        for value in {r[i] for r in rows}:
            part = [r for r in rows if r[i] == value]
            pos = [r for r in part if r[4]]
            r = got[axis, str(value).lower() if isinstance(value, bool) else str(value)]
            assert r.n == len(pos) and r.recall == sum(p[5] > 5 for p in pos) / max(1, len(pos))
    cells = measures.fallen_cells(df, 5.0, ["x", "y", "z"]).collect()
    assert len(cells) == len({r[:3] for r in rows}) and all(c.fallen == (c.tp / max(1, c.n) < 0.95) for c in cells)
    worst = measures.worst_conjunctions(df, 5.0, ["x", "y", "z"]).collect()
    assert {r.pair for r in worst} == {"x x y", "x x z", "y x z"} and all(r["rank"] <= 3 for r in worst)


def test_certifiability_rank_is_half_even(spark):
    rows = [("t", True, float(i)) for i in range(30)] + [("t", False, 100.0), ("u", False, -5.0)]
    df = spark.createDataFrame(rows, "target string, positive boolean, score double")
    assert measures.full_recall_threshold(df).first().full_recall == pytest.approx(2.0 - 1e-9, abs=0)  # round(1.5) is 2
    got = {r.target: r.certifiable for r in measures.certifiability(df, ["target"]).collect()}
    assert got == {"t": False, "u": True}


def test_empty_dossier_scores_and_stays_out_of_curves(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "key string, score double")
    got = {r.key: r.dossier_score for r in curves.dossier_score(rows, ["key"]).collect()}
    assert got == {"a": 3.0, "b": curves.NOTHING}
    assert curves.curve(spark.createDataFrame([(True, curves.NOTHING), (True, 2.0)], "positive boolean, score double")).count() == 2
