import math
import random

import pytest

from docugauge.llm import topk


def brute(rows, queries, k, scale):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in sorted((i, tuple(v)) for i, v in whole if i in queries):
        found = sorted(((-sum(a * b for a, b in zip(v, w)), -(2**63) if i is None else i) for i, w in whole if i != q and len(w) == len(v)))[:k]
        out[q] = out.get(q, []) + [(-s, None if i == -(2**63) else i) for s, i in found]
    return out


@pytest.mark.parametrize("block, bins", [(4096, 256), (3, 2)])
def test_like_brute_force(spark, block, bins):
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # one vector, very often
    rows += [(20, rows[20][1]), (20, [0.125, 0.25, 0.5, -1.0]), (30, rows[30][1])]  # repeated query rows, and one id of two vectors
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [1.0, 2.0]), (310, [2.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5]), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = {i for i, _ in rows if i is not None and i % 10 == 0}
    got: dict = {}
    for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5, scale=256, block=block, bins=bins).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    got = {q: sorted(v, key=repr) for q, v in got.items()}
    want = brute(rows, asked, 5, 256)
    assert got == {q: sorted(v, key=repr) for q, v in want.items() if v} and 300 not in got and got[310] == [(3 * 256 * 256 + 256 * 256, 304)]


def test_none_and_too_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(alone, alone).collect() == []
    huge = spark.createDataFrame([(0, [1e300]), (1, [1.0]), (2, [-1.0]), (3, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(huge, huge.where("vec_id = 1"), 1).collect()
    # a score that a long can't hold is no hindrance where it isn't among the highest
    assert [(r.vec_id, r.score) for r in topk.top_k(huge, huge.where("vec_id = 2"), 2, scale=1).orderBy("rank").collect()] == [(3, 0), (1, -1)]


def test_beyond_two_to_the_63(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, big, 3.0]), (1, [big, -big, 5.0]), (2, [-big, big, 7.0]), (-(2**63), [0.0, 0.0, 7.0]), (None, [0.0, 0.0, 7.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0"), 4, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(None, 21), (-(2**63), 21), (2, 21), (1, 15)]


def test_large_scores_are_exact(spark):
    df = spark.createDataFrame([(0, [float(2**28), 1.0]), (1, [float(2**28), 1.0]), (2, [float(2**28), 2.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0"), 2, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**56 + 2), (1, 2**56 + 1)]
