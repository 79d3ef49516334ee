"""Queries of the evaluating side: checks, text, rasters, alignment, designs, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docugauge.functions import text as X
from docugauge.operators import align, checks, design, dossiers, raster
from docugauge.operators.broadcasts import small
from docugauge.operators.predicates import Holdout, Predicate
from docugauge.plans.bindings import B, scores, table
from docugauge.sources import manifests

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# ---- dossiers and designs -----------------------------------------------------------------------


@query("complete_dossiers", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_dossiers(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("variant"))
    return dossiers.divided(rows, ["user_id"], "variant", rows)


_OVERLAY = """r AS (SELECT l_suppkey AS k, CASE l_returnflag WHEN 'A' THEN 'clean' ELSE l_returnflag END AS variant, CAST(l_linenumber AS VARCHAR) AS piece, count(*) AS v FROM lineitem GROUP BY ALL),
ok AS (SELECT k FROM r GROUP BY k HAVING count(DISTINCT variant) = 3 AND count(DISTINCT piece) FILTER (variant = 'clean') >= 6)"""


@query("overlay_variant", f"WITH {_OVERLAY}, n AS (SELECT * FROM (VALUES ('clean'), ('N'), ('R')) x(variant)), pieces AS (SELECT k, piece, v FROM r SEMI JOIN ok USING (k) WHERE variant = 'clean') SELECT p.k, n.variant, p.piece, coalesce(e.v, p.v) AS v FROM pieces p CROSS JOIN n LEFT JOIN r e ON e.k = p.k AND e.piece = p.piece AND e.variant = n.variant UNION ALL SELECT e.k, e.variant, e.piece, e.v FROM r e SEMI JOIN ok USING (k) WHERE e.variant <> 'clean' AND NOT EXISTS (SELECT 1 FROM pieces p WHERE p.k = e.k AND p.piece = e.piece)")
def overlay_variant(spark, d):
    lines = table(spark, d, "lineitem")
    variant = F.when(F.col("l_returnflag") == "A", "clean").otherwise(F.col("l_returnflag"))
    rows = lines.groupBy(F.col("l_suppkey").alias("k"), variant.alias("variant"), F.col("l_linenumber").cast("string").alias("piece")).agg(F.count("*").alias("v"))
    expected = spark.createDataFrame([("clean",), ("N",), ("R",)], "variant string")
    return dossiers.complete(rows, ["k"], expected, 6)


@query("labelled_scores", "WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem) SELECT l_orderkey AS dossier, CASE l_returnflag WHEN 'A' THEN 'clean' ELSE l_returnflag END AS variant, CAST(l_linenumber AS VARCHAR) AS piece, l_quantity AS score, l_returnflag <> 'A' AS positive FROM t WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linenumber = 1)")
def labelled_scores(spark, d):
    variant = F.when(F.col("l_returnflag") == "A", "clean").otherwise(F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dossier"), variant.alias("variant"), F.col("l_linenumber").cast("string").alias("piece"), F.lit("").alias("target"), F.lit(0).alias("setting_id"), F.col("l_quantity").alias("score"))
    damaged = spark.createDataFrame([("R", "c", "1", "")], "variant string, `check` string, piece string, target string")
    return dossiers.labelled(rows, damaged, "c", ["dossier"]).select("dossier", "variant", "piece", "score", "positive")


@query("resume_antijoin", "SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 1) USING (o_orderkey)")
def resume_antijoin(spark, d):
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return dossiers.not_done(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("backfill_regroup", "WITH want AS (SELECT o_orderkey, CAST(n AS INTEGER) AS n FROM orders, range(1, 5) r(n)), missing AS (SELECT * FROM want ANTI JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber AS n FROM lineitem) USING (o_orderkey, n)) SELECT o_orderkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS parts FROM missing GROUP BY o_orderkey")
def backfill_regroup(spark, d):
    want = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("n"))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"))
    rows = dossiers.regrouped(dossiers.not_done(want, done, ["o_orderkey", "n"]), ["o_orderkey"], ["n"])
    return rows.select("o_orderkey", F.array_join(F.transform("missing", lambda m: m["n"].cast("string")), ",").alias("parts"))


@query("grid_crossjoin", "SELECT row_number() OVER (ORDER BY a, d, j, s) - 1 AS cell_index, CAST(a AS DOUBLE) AS angle, CAST(d AS INTEGER) AS dpi, CAST(j AS INTEGER) AS jpeg, CAST(s AS DOUBLE) AS sigma FROM (VALUES (0), (0.25), (0.5), (1), (2), (4)) x(a), (VALUES (96), (150), (200), (300)) y(d), (VALUES (30), (55), (75), (95)) z(j), (VALUES (0), (3), (6), (12)) w(s)")
def grid_crossjoin(spark, d):
    return design.full_grid(spark)


@query("holdout_predicate", "SELECT o_orderkey, l_linenumber IS NOT NULL AS has_line, NOT (coalesce(l_linenumber >= 2, false)) AS is_cal, coalesce(l_linenumber >= 2, false) AND coalesce(l_quantity < 20, false) OR l_linenumber IS NULL AND o_orderstatus IN ('F', 'O') AS is_rep FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE is_cal OR is_rep")
def holdout_predicate(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kinds = {"l_linenumber": "number", "l_quantity": "number", "o_orderstatus": "string"}
    protocol = Holdout("not (l_linenumber >= 2)", "l_linenumber >= 2 and l_quantity < 20 or l_linenumber == None and o_orderstatus in ('F', 'O')", kinds)
    return protocol.sides(rows).select("o_orderkey", F.col("l_linenumber").isNotNull().alias("has_line"), "is_cal", "is_rep")


@query("null_ordering", "SELECT o_orderkey, NOT coalesce(l_linenumber >= 1, false) AS below, l_linenumber IS NULL AS none, l_linenumber IS DISTINCT FROM 3 AS other, coalesce(2 <= l_linenumber, false) AND coalesce(l_linenumber < 5, false) AS chained FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def null_ordering(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    p = lambda text: Predicate(text, {"l_linenumber": "number"}).column()
    return rows.select("o_orderkey", p("not (l_linenumber >= 1)").alias("below"), p("l_linenumber == None").alias("none"), p("l_linenumber != 3").alias("other"), p("2 <= l_linenumber < 5").alias("chained"))


@query("systematic_sample", "WITH n AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS k FROM customer) SELECT c_custkey, c_name FROM n WHERE i % greatest(1, k // 40) = 0 AND i < 40 * greatest(1, k // 40)")
def systematic_sample(spark, d):
    return design.systematic_sample(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 40)


@query("numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders")
def numbered_rows(spark, d):
    return design.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("family_rotation", "SELECT p_partkey, (['expiry', 'required_checkbox', 'required_field', 'signature'])[p_partkey % 4 + 1] AS family, (['fold', 'speck', 'stroke'])[(p_partkey + p_size) % 3 + 1] AS shape, (['fold', 'speck', 'stroke'])[p_partkey % 3 + 1] AS plain_shape FROM part")
def family_rotation(spark, d):
    families = F.array(*[F.lit(x) for x in ("expiry", "required_checkbox", "required_field", "signature")])
    key, cell = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", design.rotated(families, key).alias("family"), design.shape_for(key, cell, True).alias("shape"), design.shape_for(key, cell, False).alias("plain_shape"))


@query("draw_seed", "SELECT n_nationkey, CAST('0x' || substr(sha1(concat_ws('|', '11', '0.01', n_name)), 1, 12) AS BIGINT) AS seed FROM nation")
def draw_seed(spark, d):
    return table(spark, d, "nation").select("n_nationkey", design.draw(F.lit(11), F.lit(0.01), F.col("n_name")).alias("seed"))


@query("capture_rows", "SELECT s_suppkey, device, CAST(i AS INTEGER) AS capture_index FROM supplier, (VALUES ('flatbed', 2), ('phone', 3)) v(device, n), range(1, 4) r(i) WHERE i <= n")
def capture_rows(spark, d):
    return design.capture_rows(table(spark, d, "supplier").select("s_suppkey"), {"flatbed": 2, "phone": 3})


@query("watched_zones", "SELECT n_name AS template, 'required_field' AS family, string_agg(c_name, ',' ORDER BY c_name) AS zones FROM (SELECT DISTINCT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) GROUP BY n_name")
def watched_zones(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    fields = rows.where("c_mktsegment = 'BUILDING'").select(F.col("n_name").alias("template"), F.lit("r").alias("role"), F.col("c_name").alias("field_id"), F.lit(0).alias("ord"), F.lit("field").alias("kind"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("date_kind"))
    zones = rows.where("c_acctbal > 0").select(F.col("n_name").alias("template"), F.col("c_name").alias("name"))
    return design.watched_zones(checks.Dimensions({"template_fields": fields, "zones": zones})).select("template", "family", F.array_join("zones", ",").alias("zones"))


_MANIFEST = """r AS (SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS line, ['g1', 'x2', 'naf', 'zz'][o_custkey % 4 + 1] AS source, 'i' || (o_orderkey % 3) AS identity, o_orderstatus AS piece, ['clean', 'v1', 'v2'][o_custkey % 3 + 1] AS variant,
  o_custkey % 100 AS instance, o_custkey % 7 AS seed, CASE WHEN o_totalprice >= 20000 THEN '200' END AS dpi, o_orderkey % 5 AS image FROM orders),
k AS (SELECT *, lag(line) OVER (PARTITION BY identity, source, seed, dpi, variant, piece, instance ORDER BY line) AS earlier FROM r WHERE identity IN ('i0', 'i1'))
SELECT line, 'no such source: ' || source AS problem FROM r WHERE source NOT IN ('g1', 'x2', 'naf') UNION ALL SELECT line, 'no reference for ' || identity FROM r WHERE identity NOT IN ('i0', 'i1')
UNION ALL SELECT line, 'the reference lacks the piece ' || piece FROM k WHERE (identity, piece) NOT IN (('i0', 'F'), ('i0', 'O'), ('i1', 'F')) UNION ALL SELECT line, 'not in the catalogue: ' || variant FROM k WHERE variant <> 'clean' AND (identity, variant) NOT IN (('i0', 'v1'), ('i1', 'v2'))
UNION ALL SELECT line, 'resolution lacks' FROM k WHERE dpi IS NULL UNION ALL SELECT line, 'nothing at ' || image FROM k WHERE image = 3 UNION ALL SELECT line, 'repeats line ' || earlier FROM k WHERE earlier IS NOT NULL"""


@query("manifest_violations", f"WITH {_MANIFEST}")
def manifest_violations(spark, d):
    """Every rule that a row breaks; a row of unknown identity is judged no further, and its key isn't taken."""
    orders, nth = table(spark, d, "orders"), lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    rows = orders.select(
        "o_orderkey", nth(("g1", "x2", "naf", "zz"), F.col("o_custkey") % 4).alias("source"), F.concat(F.lit("i"), F.col("o_orderkey") % 3).alias("identity"), F.col("o_orderstatus").alias("piece"), nth(("clean", "v1", "v2"), F.col("o_custkey") % 3).alias("variant"),
        (F.col("o_custkey") % 100).cast("string").alias("instance"), (F.col("o_custkey") % 7).cast("string").alias("seed"), F.when(F.col("o_totalprice") >= 20000, "200").alias("dpi"), F.lit(None).cast("string").alias("capture"), F.lit(None).cast("string").alias("mark_step"), (F.col("o_orderkey") % 5).cast("string").alias("image_path"),
    )
    lines = design.numbered(rows, ["o_orderkey"], "line").withColumn("line", F.col("line").cast("long") + 2)
    pieces = spark.createDataFrame([("i0", "F"), ("i0", "O"), ("i1", "F")], "identity string, piece string")
    variants = spark.createDataFrame([("i0", "v1"), ("i1", "v2")], "identity string, variant string")
    there = spark.createDataFrame([(x,) for x in "0124"], "path string")
    return manifests.violations(lines, pieces, variants, there).select("line", "problem")


@query("last_wins_dedup", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins_dedup(spark, d):
    return dossiers.last_wins(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


# ---- checks -------------------------------------------------------------------------------------


@query("printed_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS read FROM orders")
def printed_date(spark, d):
    shape = F.when(F.col("o_orderkey") % 2 == 0, "us").otherwise("fr")
    text = F.when(F.col("o_orderkey") % 7 == 0, "31/02/20").otherwise(X.format_date(F.col("o_orderdate").cast("date"), shape))
    parts = F.split(text, "/")
    word = lambda i, x: F.struct(F.get(parts, F.lit(i)).alias("text"), F.lit(x).alias("cx"), F.lit(0).alias("cy"), F.lit(90).alias("conf"), F.lit(True).alias("added"))
    words = F.array(word(2, 300), word(0, 100), word(1, 200))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(X.printed_date(words, shape).cast("string"), F.lit("none")).alias("read"))


@query("declared_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def declared_date(spark, d):
    date = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", X.any_date(text).cast("string").alias("d"))


@query("required_box", "SELECT event_id, -value AS score, -value > -14.375 AS fires FROM events")
def required_box(spark, d):
    return _reading_query(spark, d, "required_checkbox", F.lit(-14.375))


@query("signature_diagonal", "SELECT event_id, -value AS score, -value > -342.05 AS fires FROM events")
def signature_diagonal(spark, d):
    return _reading_query(spark, d, "signature", F.lit(-342.05))


@query("resolution_floor", "SELECT event_id, -value AS score, -value > -148.5 AS fires FROM events")
def resolution_floor(spark, d):
    return _reading_query(spark, d, "resolution", F.lit(-148.5))


@query("cropped_ratio", "SELECT event_id, 1.0::DOUBLE - value / 1000 AS score, 1.0::DOUBLE - value / 1000 > 0.9 AS fires FROM events")
def cropped_ratio(spark, d):
    return _reading_query(spark, d, "cropped_page", F.lit(0.9))


@query("rotated_margin", "SELECT event_id, value AS score, value > 50 AS fires FROM events")
def rotated_margin(spark, d):
    return _reading_query(spark, d, "rotated_page", F.lit(50.0))


def _reading_query(spark, d, check, threshold):
    """One check over readings that carry an event's value in every measured place."""
    from docugauge.schema import READING_DDL

    v = F.col("value")
    two = lambda a, b, c: F.create_map(F.lit(a), F.create_map(F.lit(b), c))
    fields = {"source_dpi": v, "coverage": v / 1000, "orientation_margin": v, "boxes": two("f", "0.42|160", v), "field_ink": two("f", "160", v), "signatures": two("f", "160", F.array(v, v, v, v))}
    names = [x.split(":")[0].strip() for x in ("piece", "template", "angle", "quarter_turns", "source_dpi", "peak", "coverage", "orientation_margin", "words", "zone_words_by_field", "boxes", "field_ink", "signatures")]
    reading = F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(READING_DDL)
    rows = table(spark, d, "events").select("event_id", F.lit("a").alias("identity"), F.lit("tax").alias("piece"), reading.alias("reading"))
    dims = checks.Dimensions({
        "ref_pieces": spark.createDataFrame([("a", "tax", "t", 0)], "identity string, piece string, template string, ord int"),
        "template_fields": spark.createDataFrame([("t", "r", "f", 0, k, True, None) for k in ("box", "signature")], "template string, role string, field_id string, ord int, kind string, required boolean, date_kind string"),
    })
    found = checks.scored(rows, dims, checks.settings_table(spark, {check: [{}]}), ["event_id"], [check], abstention=False)
    return found.select("event_id", "score", (F.col("score") > threshold).alias("fires"))


@query("verdict_three_state", f"WITH {B}, f AS (SELECT source, CASE WHEN size >= 200 THEN score END AS score, toxic = 1 AS blurred FROM b) SELECT source, count(*) FILTER (coalesce(score > 100, false) AND NOT blurred) AS defects, count(*) FILTER (coalesce(score > 100, false) AND blurred OR score IS NULL) AS unreadable, count(*) FILTER (NOT coalesce(score > 100, false) AND score IS NOT NULL) AS silent, CAST(CASE WHEN defects > 0 THEN 1 WHEN unreadable > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM f GROUP BY source")
def verdict_three_state(spark, d):
    rows = scores(spark, d).select("source", F.when(F.col("size") >= 200, F.col("score")).alias("score"), F.when(F.col("toxic") == 1, "resolution").otherwise("expiry").alias("check"))
    return checks.verdict(rows.withColumn("fires", F.coalesce(F.col("score") > 100, F.lit(False))), ["source"])


@query("settings_names", "SELECT s AS text_sensor, CAST(c AS DOUBLE) AS min_conf, s || ' conf' || CAST(CAST(c AS DOUBLE) AS VARCHAR) AS name FROM (VALUES ('page'), ('zone'), ('union')) a(s), (VALUES (0), (10), (20), (40), (60), (80)) b(c)")
def settings_names(spark, d):
    rows = checks.settings_table(spark, {"expiry": checks.combinations("expiry")})
    name = checks.setting_name(F.col("check"), F.col("text_sensor"), F.col("min_conf"), F.col("ink_threshold"), F.col("disc_ratio"), F.col("signature_sensor"))
    return rows.select("text_sensor", "min_conf", name.alias("name"))


# ---- text ---------------------------------------------------------------------------------------

_TOKENS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[0-9a-z]+'), lambda t: length(t) >= 2)))"


@query("alnum_count", "SELECT doc_id, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS n FROM documents")
def alnum_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.alnum_count(F.split("text", " ")).alias("n"))


@query("token_set", f"SELECT item_id, array_to_string({_TOKENS.format(c='text')}, ' ') AS tokens, len({_TOKENS.format(c='text')}) AS n FROM benchmark")
def token_set(spark, d):
    tokens = X.ascii_tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n"))


@query("key_strip", "SELECT page_id, regexp_replace(lower(url), '[^0-9a-z]', '', 'g') AS k FROM pages")
def key_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.ascii_key(F.col("url")).alias("k"))


@query("normalized_text", "SELECT item_id, strip_accents(lower(text)) AS t FROM benchmark")
def normalized_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.normalize("text").alias("t"))


@query("sheet_codes", "SELECT s_suppkey, 'S' || lpad(CAST(s_suppkey % 90 + 1 AS VARCHAR), 2, '0') AS code FROM supplier")
def sheet_codes(spark, d):
    seen = F.concat(F.lit("sheet S "), (F.col("s_suppkey") % 90 + 1).cast("string"), F.lit(" / 2"))
    return table(spark, d, "supplier").select("s_suppkey", X.sheet_code(seen).alias("code"))


@query("name_matches", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE contains(a.n_name, b.n_name) OR contains(b.n_name, a.n_name)")
def name_matches(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b"))
    return a.join(small(b), X.name_matches(F.col("a"), F.col("b")))


@query("word_dedup_grid", "WITH w AS (SELECT user_id, event_id, lower(event_type) AS t, CAST(floor(value) AS BIGINT) AS cx FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, t, CAST(floor(cx / 16) AS BIGINT) ORDER BY event_id) AS n FROM w) SELECT user_id, count(*) AS kept, CAST(sum(cx) AS BIGINT) AS places FROM r WHERE n = 1 GROUP BY user_id")
def word_dedup_grid(spark, d):
    word = F.struct("event_id", F.col("event_type").alias("text"), F.floor("value").cast("int").alias("cx"), F.lit(0).alias("cy"), F.lit(90).alias("conf"), F.lit(True).alias("added"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    kept = X.first_of_cell(X.confident(F.col("w"), 40.0))
    return rows.select("user_id", F.size(kept).cast("long").alias("kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, w: a + w["cx"]).alias("places"))


@query("reading_order", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(floor(value / 20) AS BIGINT), event_id % 97, event_id) AS ids FROM events GROUP BY user_id")
def reading_order(spark, d):
    word = F.struct("event_id", (F.col("event_id") % 97).cast("int").alias("cx"), F.col("value").alias("cy"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return rows.select("user_id", F.array_join(F.transform(X.reading_order(F.col("w")), lambda w: w["event_id"].cast("string")), ",").alias("ids"))


@query("zone_containment", "SELECT z, count(*) AS words FROM (VALUES (0, 0, 40), (1, 40, 60), (2, 55, 120)) v(z, x0, x1) JOIN events ON value BETWEEN x0 - 8 AND x1 + 8 GROUP BY z")
def zone_containment(spark, d):
    zones = spark.createDataFrame([(0, 0, 40), (1, 40, 60), (2, 55, 120)], "z int, x0 int, x1 int")
    word = F.array(F.struct(F.lit("w").alias("text"), F.col("value").alias("cx"), F.lit(0).alias("cy")))
    rows = table(spark, d, "events").select("event_id", word.alias("w")).crossJoin(F.broadcast(zones))
    inside = X.within(F.col("w"), F.col("x0"), F.lit(0), F.col("x1"), F.lit(0), checks.MARGIN)
    return rows.where(F.size(inside) > 0).groupBy("z").agg(F.count("*").alias("words"))


# ---- rasters: embeddings as pages of 8 x 8 ------------------------------------------------------

_PIXELS = "px AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(greatest(0, least(255, 128 + floor(400 * CAST(embedding[i] AS DOUBLE)))) AS INTEGER) AS v FROM embeddings, range(1, 65) r(i))"


def _pixels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), 128 + F.floor(400 * F.col("e").cast("double")))).cast("int")
    return rows.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


@query("otsu_hist", f"WITH {_PIXELS}, h AS (SELECT vec_id, v, count(*) AS k FROM px GROUP BY vec_id, v), c AS (SELECT vec_id, v, CAST(sum(k) OVER w AS BIGINT) AS w0, CAST(sum(k * v) OVER w AS BIGINT) AS m, CAST(sum(k) OVER (PARTITION BY vec_id) AS BIGINT) AS n, CAST(sum(k * v) OVER (PARTITION BY vec_id) AS BIGINT) AS t FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY v)), s AS (SELECT vec_id, v, CASE WHEN n > w0 THEN (t * CAST(w0 AS DOUBLE) / n - m) * (t * CAST(w0 AS DOUBLE) / n - m) / (CAST(w0 AS DOUBLE) * (n - w0)) END AS q FROM c) SELECT vec_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC NULLS LAST, v) AS r FROM s) WHERE r = 1")
def otsu_hist(spark, d):
    return raster.otsu_table(_pixels(spark, d), ["vec_id"])


@query("profile_variance", f"WITH {_PIXELS}, l AS (SELECT vec_id, y, count(*) FILTER (v < 128) AS k FROM px GROUP BY vec_id, y), s AS (SELECT vec_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS s, CAST(sum(k * k) AS BIGINT) AS q FROM l GROUP BY vec_id) SELECT vec_id, CAST(n * q - s * s AS DOUBLE) / (n * n) AS variance FROM s")
def profile_variance(spark, d):
    return raster.profile_variance_table(_pixels(spark, d), ["vec_id"], 128)


@query("ink_ratio_window", f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (v < 128) AS dark, count(*) AS area, CAST(count(*) FILTER (v < 128) AS DOUBLE) / count(*) * 100 AS ink FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6 GROUP BY vec_id")
def ink_ratio_window(spark, d):
    return raster.dark_share(_pixels(spark, d), ["vec_id"], F.col("y").between(2, 5) & F.col("x").between(1, 6), 128)


@query("disc_ink", f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (v < 128) AS dark, count(*) AS area, CAST(count(*) FILTER (v < 128) AS DOUBLE) / count(*) * 100 AS ink FROM px WHERE (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= 8.6436 GROUP BY vec_id")
def disc_ink(spark, d):
    return raster.dark_share(_pixels(spark, d), ["vec_id"], raster.in_disc(F.col("x"), F.col("y"), 0, 0, 7, 7, 0.42), 128)


@query("added_pixels", f"WITH {_PIXELS}, a AS (SELECT vec_id // 2 AS page, y, x FROM px WHERE vec_id % 2 = 0 AND v < 128), b AS (SELECT vec_id // 2 AS page, y, x FROM px WHERE vec_id % 2 = 1 AND v < 128) SELECT page, count(*) AS added FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY page")
def added_pixels(spark, d):
    px = _pixels(spark, d).withColumn("page", F.floor(F.col("vec_id") / 2))
    return raster.added_table(px.where("vec_id % 2 = 0"), px.where("vec_id % 2 = 1"), ["page"], 128).groupBy("page").agg(F.count("*").alias("added"))


_SHIFTS = """a AS (SELECT vec_id // 2 AS page, y, x FROM px WHERE vec_id % 2 = 0 AND v < 100), b AS (SELECT vec_id // 2 AS page, y, x FROM px WHERE vec_id % 2 = 1 AND v < 100),
s AS (SELECT a.page, (a.y - b.y + 8) % 8 AS dy, (a.x - b.x + 8) % 8 AS dx, count(*) AS hits FROM a JOIN b USING (page) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hits DESC, dy, dx) AS r FROM s),
n AS (SELECT p.page, (SELECT count(*) FROM a WHERE a.page = p.page) AS na, (SELECT count(*) FROM b WHERE b.page = p.page) AS nb FROM (SELECT vec_id // 2 AS page FROM embeddings GROUP BY 1 HAVING count(*) = 2) p)"""


@query("xcorr_shift", f"WITH {_PIXELS}, {_SHIFTS} SELECT n.page, CAST(coalesce(CASE WHEN dy > 4 THEN dy - 8 ELSE dy END, 0) AS INTEGER) AS dy, CAST(coalesce(CASE WHEN dx > 4 THEN dx - 8 ELSE dx END, 0) AS INTEGER) AS dx, round(coalesce(hits / sqrt(CAST(na AS DOUBLE) * nb), 0.0), 9) AS peak FROM n LEFT JOIN t ON t.page = n.page AND r = 1")
def xcorr_shift(spark, d):
    """Neighbouring pages laid on each other by correlation, which is what registration rests on."""
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), 128 + F.floor(400 * e.cast("double"))))
    px = F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(level(e)), 2, "0")), ""))
    pages = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("page"), (F.col("vec_id") % 2).alias("side"), F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), px.alias("px")).alias("p"))
    both = pages.where("side = 0").select("page", F.col("p").alias("a")).join(pages.where("side = 1").select("page", F.col("p").alias("b")), "page")
    return both.select("page", raster.shift_of("a", "b", F.lit(100)).alias("s")).select("page", "s.dy", "s.dx", F.round("s.peak", 9).alias("peak"))


@query("components_bbox", f"WITH RECURSIVE {_PIXELS}, dark AS (SELECT vec_id, y, x, y * 8 + x AS id FROM px WHERE v < 100), near AS (SELECT a.vec_id, a.id AS a, b.id AS b FROM dark a JOIN dark b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), reach AS (SELECT vec_id, id, id AS root FROM dark UNION SELECT r.vec_id, n.b, r.root FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.a = r.id), least AS (SELECT vec_id, id, min(root) AS root FROM reach GROUP BY vec_id, id), parts AS (SELECT vec_id, root, count(*) AS area, max(id // 8) - min(id // 8) + 1 AS h, max(id % 8) - min(id % 8) + 1 AS w FROM least GROUP BY vec_id, root HAVING count(*) >= 3), best AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, root) AS r FROM parts) SELECT e.vec_id, CAST(coalesce(n, 0) AS INTEGER) AS n, CAST(coalesce(area, 0) AS INTEGER) AS area, round(coalesce(sqrt(CAST(h * h + w * w AS DOUBLE)), 0.0), 9) AS diagonal FROM embeddings e LEFT JOIN best b ON b.vec_id = e.vec_id AND r = 1")
def components_bbox(spark, d):
    dark = F.transform(F.col("embedding"), lambda e: F.greatest(F.lit(0), F.least(F.lit(255), 128 + F.floor(400 * e.cast("double")))) < 100)
    rows = table(spark, d, "embeddings").select("vec_id", raster.mask_components(dark, F.lit(8), F.lit(3)).alias("c"))
    return rows.select("vec_id", "c.n", "c.area", F.round("c.diagonal", 9).alias("diagonal"))


# ---- alignment ----------------------------------------------------------------------------------


_ALIGNED = """t AS (SELECT conv_id AS batch, turn, sha1(text) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations),
n AS (SELECT *, lead(v) OVER (PARTITION BY batch ORDER BY e) AS w, lead(e) OVER (PARTITION BY batch ORDER BY e) IS NULL AS last FROM t), p AS (SELECT batch, e AS p FROM t WHERE turn = batch % 4),
f AS (SELECT n.batch, min(e) AS f FROM n JOIN p ON p.batch = n.batch AND e >= p WHERE last OR v IS DISTINCT FROM w GROUP BY n.batch)"""


@query("align_sequences", f"WITH {_ALIGNED} SELECT t.batch, CAST(CASE WHEN f IS NULL OR e < f THEN e WHEN e = f THEN -1 ELSE e - 1 END AS INTEGER) AS observed, CAST(e AS INTEGER) AS expected FROM t LEFT JOIN f USING (batch)")
def align_sequences(spark, d):
    """Turns of each conversation against the same turns with one taken out: the gap is found, whatever it is."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("batch"), "turn", F.sha1("text").alias("value"))
    number = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("turn")) - 1)
    seen = number(turns.where(F.col("turn") != F.pmod(F.col("batch"), F.lit(4))))
    return align.align(seen, number(turns)).select("batch", F.coalesce("observed", F.lit(-1)).alias("observed"), F.coalesce("expected", F.lit(-1)).alias("expected"))


@query("neighbour_fix", "WITH e AS (SELECT user_id, event_id, event_type AS seen, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE event_type END AS want FROM events), n AS (SELECT *, lag(want) OVER w AS b, lead(want) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CASE WHEN seen = want THEN 'own' WHEN seen = b THEN 'previous' WHEN seen = a THEN 'next' ELSE 'none' END AS fixed FROM n")
def neighbour_fix(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("seen"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_type")).alias("want"))
    out = align.neighbour_fix(rows, ["user_id"], "event_id", "seen", "want", lambda a, b: a == b)
    word = F.when(F.col("fixed") == 0, "own").when(F.col("fixed") == -1, "previous").when(F.col("fixed") == 1, "next").otherwise("none")
    return out.select("user_id", "event_id", word.alias("fixed"))


@query("step0_baseline", "WITH b AS (SELECT user_id, event_type, arg_max(value, event_id) AS baseline FROM events WHERE event_id % 4 = 0 GROUP BY ALL) SELECT event_id, round(greatest(0.0, value - baseline) / 100, 5) AS share FROM events JOIN b USING (user_id, event_type) WHERE event_id % 4 <> 0")
def step0_baseline(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 4).alias("step"), "value")
    out = align.against_baseline(rows, ["user_id", "event_type"], "step", "event_id", "value").where("step <> 0 AND baseline IS NOT NULL")
    return out.select("event_id", raster.ink_gained(F.col("baseline"), F.col("value")).alias("share"))
