import pytest

from docugauge.operators.predicates import Holdout, Predicate, PredicateError, clean_pages, refuse_unknown

ROWS = [(0.5, 200, 37, 0.0, "reference", "g0", True, None), (0.0, 96, 11, 0.01, "id01", "x2", False, 2), (4.0, 300, None, None, "id02", "g1", None, 0)]
DDL = "angle double, dpi int, seed int, parasite double, identity string, source string, jitter boolean, mark_step int"


@pytest.mark.parametrize(
    "text, want",
    [
        ("seed == 37", [True, False, False]), ("seed != 37", [False, True, True]), ("not (mark_step >= 1)", [True, False, True]), ("mark_step == None", [True, False, False]), ("mark_step != None", [False, True, True]),
        ("seed in (11, 23)", [False, True, False]), ("seed not in [11, None]", [True, False, False]), ("identity in {'id01', 'id02'}", [False, True, True]), ("96 <= dpi < 300", [True, True, False]), ("dpi == 200.0", [True, False, False]),
        ("jitter == True", [True, False, False]), ("jitter == 1", [True, False, False]), ("seed == '37'", [False, False, False]), ("seed != '37'", [True, True, True]), ("angle > -1", [True, True, True]), ("True", [True, True, True]),
        ("source == 'x2' and mark_step > 0 or dpi >= 300", [False, True, True]), ("parasite > 0", [False, True, False]), ("None == mark_step", [True, False, False]), ("mark_step < None", [False, False, False]),
    ],
)
def test_truth(spark, text, want):
    df = spark.createDataFrame(ROWS, DDL).coalesce(1)
    assert [r[0] for r in df.select(Predicate(text).column()).collect()] == want


@pytest.mark.parametrize("text", ["seed", "f(seed)", "seed.x == 1", "seed[0] == 1", "seed + 1 == 2", "nothing == 1", "seed == (1, 2)", "seed in 3", "seed is None", "lambda: 1", "", "seed ==", "seed < 'a'", "identity < 3", "__import__('os')", "1", "seed in ((1,),)"])
def test_refused(text):
    with pytest.raises(PredicateError):
        Predicate(text)


def test_fields_sides_and_clean_pages(spark):
    df = spark.createDataFrame(ROWS, DDL)
    own = Holdout("seed == 11", "seed == 11 or dpi == 300")
    got = own.sides(df).orderBy("angle").collect()
    assert [(r.is_cal, r.is_rep) for r in got] == [(True, True), (False, True)]
    assert own.calibrate.fields == {"seed"} and own.report.fields == {"seed", "dpi"}
    assert clean_pages(df, own).count() == 2
    assert clean_pages(df, Holdout("parasite == 0", "parasite > 0")).count() == 3
    plan = df.where(Holdout().report.column())._jdf.queryExecution().optimizedPlan().toString()
    assert "seed" in plan


def test_unknown_names_are_named(spark):
    df, known = spark.createDataFrame([("a",), ("b",)], "v string"), spark.createDataFrame([("a",)], "w string")
    with pytest.raises(ValueError, match="unknown variant: b"):
        refuse_unknown(df, "v", known, "w", "variant")
    assert refuse_unknown(df.where("v = 'a'"), "v", known, "w", "variant").count() == 1
