import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docugauge.functions import text as X

WORD = "struct<text:string,cx:int,cy:int,conf:int,added:boolean>"


def words(spark, rows):
    return spark.createDataFrame([(rows,)], f"w array<{WORD}>")


def test_normalize_key_tokens(spark):
    df = spark.createDataFrame([("Élève n° 12",), (None,), ("",)], "t string").coalesce(1)
    got = df.select(X.normalize("t"), X.key("t"), X.tokens(F.array("t"))).collect()
    assert tuple(got[0]) == ("eleve n° 12", "eleven12", ["12", "eleve"]) and got[1][0] is None and got[2][1] == ""


def test_similarity_and_overlap_like_difflib(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcde", k=rng.randrange(9))), "".join(rng.choices("abcde", k=rng.randrange(9)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(X.similarity("a", "b")).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    df = spark.createDataFrame([(["des", "acacias"], ["ldes", "acacias"]), ([], ["a"]), (["rue", "x"], ["rue"])], "a array<string>, b array<string>").coalesce(1)
    assert [r[0] for r in df.select(X.overlap("a", "b")).collect()] == [SequenceMatcher(None, "des", "ldes").ratio(), 0.0, 1.0]


def test_best_run_joins_words_in_reading_order(spark):
    rows = [("99", 200, 5, 90, True), ("999", 100, 8, 90, True), ("9999", 300, 11, 90, True), ("noise", 0, 300, 90, True)]
    got = words(spark, rows).select(X.best_ngram("w", F.lit("999-99-9999")), X.best_ngram("w", F.lit("")), X.best_ngram(F.filter("w", lambda w: F.lit(False)), F.lit("9"))).first()
    assert tuple(got) == (1.0, 0.0, 0.0)


def test_zone_words_first_of_cell_and_sensors(spark):
    page = [("Ab", 10, 10, 90, True), ("ab", 15, 15, 90, True), ("ab", 17, 15, 90, True), ("low", 10, 10, 20, True), ("old", 10, 10, 90, False)]
    zone = [("AB", 12, 3, 95, True), ("new", -1, 0, 95, True)]
    df = spark.createDataFrame([(page, zone)], f"p array<{WORD}>, z array<{WORD}>")
    texts = lambda sensor: [w.text for w in df.select(X.zone_words(F.col("p"), F.col("z"), sensor, 40.0).alias("w")).first().w]
    assert texts("page") == ["Ab", "ab"] and texts("zone") == ["AB", "new"] and texts("union") == ["Ab", "ab", "new"]


def test_dates(spark):
    def date(parts, shape):
        rows = [(t, x, 0, 90, True) for x, t in parts]
        return words(spark, rows).select(X.printed_date(F.col("w"), F.lit(shape)).cast("string")).first()[0]

    assert date([(30, "2026"), (10, "02/"), (20, "10")], "us") == "2026-02-10" and date([(10, "10-02-2026")], "fr") == "2026-02-10"
    assert date([(1, "02302026")], "us") is None and date([(1, "1022026")], "us") is None and date([], "us") is None
    df = spark.createDataFrame([("21/08/2026",), ("2026-08-21",), ("08/21/2026",), ("soon",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.any_date(F.col("t")).cast("string")).collect()] == ["2026-08-21"] * 3 + [None]


def test_alnum_order_codes_names(spark):
    df = words(spark, [("|||", 1, 1, 97, True), ("O'Neil-2", 1, 39, 97, True), ("first", 0, 45, 97, True)])
    assert df.select(X.alnum_count(F.transform("w", lambda w: w["text"]))).first()[0] == 11
    assert [w.text for w in df.select(X.reading_order(F.col("w")).alias("w")).first().w] == ["|||", "O'Neil-2", "first"]
    row = spark.createDataFrame([("sheet S 7", "none")], "a string, b string").select(X.sheet_code(F.col("a")), X.sheet_code(F.col("b")), X.name_matches(F.lit("ann lee"), F.lit("lee")), X.name_matches(F.lit(""), F.lit("lee"))).first()
    assert tuple(row) == ("S07", None, True, False)
