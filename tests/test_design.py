from pyspark.sql import functions as F

from docugauge.operators import design, dossiers


def test_grids_and_numbers(spark):
    full = design.full_grid(spark)
    assert full.count() == 384 and design.parasite_grid(spark).count() == 108
    assert [r.cell_index for r in full.orderBy("angle", "dpi", "jpeg", "sigma").collect()] == list(range(384))
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "v int, w int")
    got = design.numbered(rows, ["v"], ranges=7).orderBy("v").collect()
    assert [r.n for r in got] == list(range(101))


def test_shapes_of_three_seeds_miss_one_unless_the_cell_moves_them(spark):
    rows = spark.createDataFrame([(s, c) for s in design.SEEDS for c in range(27)], "seed int, cell int")
    plain = {r[0] for r in rows.select(design.shape_for(F.col("seed"), F.col("cell"), False)).collect()}
    moved = {r[0] for r in rows.select(design.shape_for(F.col("seed"), F.col("cell"), True)).collect()}
    assert plain == {"speck", "stroke"} and moved == set(design.SHAPES)


def test_draws_replay_and_samples_are_even(spark):
    one = spark.range(1).select(design.draw(F.lit(11), F.lit(0.01), F.lit("tax"))).first()[0]
    assert one == spark.range(1).select(design.draw(F.lit(11), F.lit(0.01), F.lit("tax"))).first()[0] and one < 1 << 48
    assert [r.id for r in design.systematic_sample(spark.range(10), ["id"], 3).orderBy("id").collect()] == [0, 3, 6]
    assert design.systematic_sample(spark.range(2), ["id"], 5).count() == 2 and design.systematic_sample(spark.range(0), ["id"], 5).count() == 0


def test_resume_knows_nulls_and_regroups(spark):
    want = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, "c", "a")], "k int, capture string, part string")
    left = dossiers.not_done(want, want.where("part = 'b'"), ["k", "capture", "part"])
    got = {r.k: [m.part for m in r.missing] for r in dossiers.regrouped(left, ["k"], ["part"]).collect()}
    assert got == {1: ["a"], 2: ["a"]} and dossiers.not_done(want, want, ["k", "capture", "part"]).count() == 0


def test_captures(spark):
    rows = design.capture_rows(spark.createDataFrame([("S01",)], "sheet string"), {"flatbed": 1, "phone": 2}).collect()
    assert sorted((r.device, r.capture_index) for r in rows) == [("flatbed", 1), ("phone", 1), ("phone", 2)]
