"""Queries that run the checks, the sweep, the designs and the sources as a user does, over readings built from whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docugauge.functions import forms
from docugauge.functions import text as X
from docugauge.operators import align, checks, design, predicates, raster
from docugauge.plans import protocol
from docugauge.plans.bindings import table, wilson
from docugauge.schema import READING_DDL, WORD_DDL
from docugauge.sources import declarations, manifests, readings, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


_FIELDS = [x.split(":")[0].strip() for x in ("piece", "template", "angle", "quarter_turns", "source_dpi", "peak", "coverage", "orientation_margin", "words", "zone_words_by_field", "boxes", "field_ink", "signatures")]


def reading(**fields):
    """A reading with some fields, the others null."""
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in _FIELDS]).cast(READING_DDL)


# ---- turns of conversations as pieces -----------------------------------------------------------
# A word is a token's first letter, as often as the token is long: so two words are alike by their
# lengths if their letters are the same, else not at all, which SQL can say. Longer words are read
# with more confidence; every word has a cell of its own.

_TURNS = """t AS (SELECT conv_id, turn, list_transform(coalesce(regexp_extract_all(lower(text), '[0-9a-z]+'), []), lambda w: {{'c': {c}, 'n': length(w)}}) AS w, conv_id % 5 = 0 AND turn = 1 AS bad FROM conversations),
u AS (SELECT *, list_filter(w, lambda x: x.n >= 4) AS k, list_distinct(list_filter(w, lambda x: x.n >= 4)) AS d FROM t)"""
_SIDES, _PLAIN = _TURNS.format(c="w[1]"), _TURNS.format(c="'a'")
_PIECES, _SEP = 64, ["a", "aaaaaaaaa", "aaaaaaaaaaaaaa"]


def _turns(spark, d, letter=None):
    """conv_id, turn, identity, piece and reading; the second piece of every fifth dossier is blurred."""
    tokens = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0)), F.array().cast("array<string>"))
    first = (lambda w: F.substring(w, 1, 1)) if letter is None else (lambda w: F.lit(letter))
    words = F.transform(tokens, lambda w, i: F.struct(F.repeat(first(w), F.length(w)).alias("text"), (i * 20).alias("cx"), F.lit(10).alias("cy"), (F.length(w) * 10).alias("conf"), F.lit(True).alias("added")).cast(WORD_DDL))
    dpi = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), 100.0).otherwise(200.0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.lit("a").alias("identity"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("piece"), reading(words=words, source_dpi=dpi).alias("reading"))


def _dims(spark, **more):
    pieces = [f"t{i}" for i in range(_PIECES)]
    tables = {
        "templates": spark.createDataFrame([("f", "eng", "us", 0)], "template string, language string, date_format string, page int"),
        "template_fields": spark.createDataFrame([("f", "begin", "begin", 0, "field", True, None), ("f", "all", "all", 0, "field", False, None)], "template string, role string, field_id string, ord int, kind string, required boolean, date_kind string"),
        "zones": spark.createDataFrame([("f", "begin", 0, 0, 0, 200, 20, ""), ("f", "all", 0, 0, 0, 1 << 30, 20, "")], "template string, name string, page int, x0 int, y0 int, x1 int, y1 int, kind string"),
        "ref_pieces": spark.createDataFrame([("a", p, "f", i) for i, p in enumerate(pieces)], "identity string, piece string, template string, ord int"),
        "ref_consistency": spark.createDataFrame([("a", "said", i, p, "all") for i, p in enumerate(pieces)], "identity string, data string, ord int, piece string, field string"),
        "ref_forbidden": spark.createDataFrame([("a", "a" * n) for n in (5, 9, 14)], "identity string, value string"),
    }
    return checks.Dimensions(tables | more)


def _scored(spark, d, check, letter=None):
    settings = checks.settings_table(spark, {check: [{"text_sensor": "page"}]})
    return checks.scored(_turns(spark, d, letter), _dims(spark), settings, ["conv_id"], [check], floor=150.0).select("conv_id", "piece", "target", "score")


_REQUIRED = "SELECT conv_id, 't' || turn AS piece, 'begin' AS target, CASE WHEN NOT bad THEN -CAST(coalesce(list_sum(list_transform(list_filter(w[1:11], lambda x: x.n >= 4), lambda x: x.n)), 0) AS DOUBLE) END AS score FROM {t}"


@query("check_required_field", f"WITH {_SIDES} {_REQUIRED.format(t='t')}")
def check_required_field(spark, d):
    return _scored(spark, d, "required_field")


_LIKE = "list_min(list_transform({few}, lambda x: list_max(list_transform({many}, lambda y: CASE WHEN x.c = y.c THEN 2.0::DOUBLE * least(x.n, y.n) / (x.n + y.n) ELSE 0.0::DOUBLE END))))"
_CONSISTENCY = f"""SELECT conv_id, string_agg('t' || turn, '+' ORDER BY turn) FILTER (bad) AS piece, 'said' AS target, CAST(NULL AS DOUBLE) AS score FROM u GROUP BY conv_id HAVING bool_or(bad)
UNION ALL SELECT a.conv_id, 't' || a.turn || '+t' || b.turn, 'said', round(1.0::DOUBLE - CASE WHEN len(a.d) = 0 OR len(b.d) = 0 THEN 0.0::DOUBLE WHEN len(a.d) <= len(b.d) THEN {_LIKE.format(few='a.d', many='b.d')} ELSE {_LIKE.format(few='b.d', many='a.d')} END, 9)
FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.conv_id NOT IN (SELECT conv_id FROM u WHERE bad)"""


@query("check_consistency", f"WITH {_SIDES} {_CONSISTENCY}")
def check_consistency(spark, d):
    return _scored(spark, d, "consistency").withColumn("score", F.round("score", 9))


_FORBIDDEN = "SELECT conv_id, 't' || turn AS piece, repeat('a', g) AS target, CASE WHEN NOT bad THEN round(coalesce(list_max(list_transform(list_filter(r, lambda x: 2 * x >= g AND x <= 2 * g), lambda x: 2.0::DOUBLE * least(x, g) / (x + g))), 0.0::DOUBLE), 9) END AS score FROM (SELECT conv_id, turn, bad, flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, greatest(len(k) - n + 2, 1)), lambda i: list_sum(list_transform(k[i:i + n - 1], lambda x: x.n))))) AS r FROM u), (VALUES (5), (9), (14)) v(g)"


@query("check_forbidden_value", f"WITH {_PLAIN} {_FORBIDDEN}")
def check_forbidden_value(spark, d):
    return _scored(spark, d, "forbidden_value", "a").withColumn("score", F.round("score", 9))


_DATES = "SELECT o_orderkey, clock, 'date' AS target, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), d) AS DOUBLE) END AS score FROM orders, (VALUES ('filing', DATE '1998-08-21'), ('admissibility', DATE '1996-02-10')) c(clock, d)"


@query("check_expiry", _DATES)
def check_expiry(spark, d):
    """Every order's date, printed as three words from right to left, against two clocks; every seventh isn't a date."""
    shape = F.when(F.col("o_orderkey") % 2 == 0, "us").otherwise("fr")
    parts = F.split(F.when(F.col("o_orderkey") % 7 == 0, "31/02/20").otherwise(X.format_date(F.col("o_orderdate").cast("date"), shape)), "/")
    words = F.array(*[F.struct(F.get(parts, F.lit(i)).alias("text"), F.lit(100 * (i + 1)).alias("cx"), F.lit(10).alias("cy"), F.lit(90).alias("conf"), F.lit(True).alias("added")).cast(WORD_DDL) for i in (2, 0, 1)])
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("a").alias("identity"), shape.alias("piece"), reading(words=words, source_dpi=F.lit(200.0)).alias("reading"))
    dims = _dims(
        spark,
        templates=spark.createDataFrame([("us", "eng", "us", 0), ("fr", "fra", "fr", 0)], "template string, language string, date_format string, page int"),
        template_fields=spark.createDataFrame([(t, "until", "date", 0, "field", True, "expiration") for t in ("us", "fr")], "template string, role string, field_id string, ord int, kind string, required boolean, date_kind string"),
        zones=spark.createDataFrame([(t, "date", 0, 0, 0, 400, 20, "") for t in ("us", "fr")], "template string, name string, page int, x0 int, y0 int, x1 int, y1 int, kind string"),
        ref_pieces=spark.createDataFrame([("a", t, t, 0) for t in ("us", "fr")], "identity string, piece string, template string, ord int"),
        ref_clocks=spark.sql("SELECT * FROM VALUES ('a', 'filing', DATE '1998-08-21'), ('a', 'admissibility', DATE '1996-02-10') AS t(identity, clock, d)"),
    )
    settings, out = checks.settings_table(spark, {"expiry": [{"text_sensor": "page"}]}), None
    for clock in ("filing", "admissibility"):
        one = checks.scored(rows, dims, settings, ["o_orderkey"], ["expiry"], clock=clock).select("o_orderkey", F.lit(clock).alias("clock"), "target", "score")
        out = one if out is None else out.unionByName(one)
    return out


_LIMITS = {"required_field": -20.0, "forbidden_value": 0.85, "resolution": -150.0}


@query("frozen_verdicts", f"WITH {_PLAIN}, f AS (SELECT conv_id, 'required_field' AS ch, score, -20.0 AS t FROM ({_REQUIRED.format(t='t')}) UNION ALL SELECT conv_id, 'forbidden_value', score, 0.85 FROM ({_FORBIDDEN}) UNION ALL SELECT conv_id, 'resolution', CASE WHEN bad THEN -100.0::DOUBLE ELSE -200.0::DOUBLE END, -150.0 FROM t), g AS (SELECT conv_id, ch, score, coalesce(score > t, false) AS fires FROM f) SELECT conv_id, count(*) FILTER (fires AND ch <> 'resolution') AS defects, count(*) FILTER (fires AND ch = 'resolution' OR score IS NULL) AS unreadable, count(*) FILTER (NOT fires AND score IS NOT NULL) AS silent, CAST(CASE WHEN defects > 0 THEN 1 WHEN unreadable > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM g GROUP BY conv_id")
def frozen_verdicts(spark, d):
    """Whole dossiers judged at frozen thresholds, to an exit code each."""
    names = [c for c in _LIMITS]
    settings = checks.settings_table(spark, {c: [{"text_sensor": "page"}] for c in names})
    return checks.verdict(checks.evaluate(_turns(spark, d, "a"), _dims(spark), settings, _LIMITS, ["conv_id"], names), ["conv_id"])


# ---- events as pages that were measured ---------------------------------------------------------


def _pages(spark, d):
    variant = F.when(F.col("event_type") == "view", "clean").otherwise(F.col("event_type"))
    boxes = F.create_map(F.lit("begin"), F.create_map(*[x for r in ("0.42", "0.55") for t in ("128", "160") for x in (F.lit(f"{r}|{t}"), F.col("value") + float(r) + int(t))]))
    rows = table(spark, d, "events").select("event_id", F.lit("a").alias("identity"), F.lit("t0").alias("piece"), variant.alias("variant"), reading(source_dpi=F.when(F.col("event_id") % 11 > 0, F.col("value") * 4), coverage=F.col("value") / 100, boxes=boxes).alias("reading"))
    fields = spark.createDataFrame([("f", "begin", "begin", 0, "box", True, None)], "template string, role string, field_id string, ord int, kind string, required boolean, date_kind string")
    damaged = spark.createDataFrame([("click", "resolution", "t0", ""), ("purchase", "cropped_page", "t0", ""), ("error", "required_checkbox", "t0", "begin")], "variant string, `check` string, piece string, target string")
    return rows, _dims(spark, template_fields=fields), damaged


_EVENTS = """e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'clean' ELSE event_type END AS variant, CASE WHEN event_id % 11 > 0 THEN -(value * 4) END AS res, 1.0::DOUBLE - value / 100 AS crop, value FROM events)"""


@query("sweep_settings", f"WITH {_EVENTS}, s AS (SELECT event_id, variant, 'resolution' AS \"check\", CAST(0 AS INTEGER) AS setting_id, res AS score FROM e UNION ALL SELECT event_id, variant, 'cropped_page', 0, crop FROM e UNION ALL SELECT event_id, variant, 'required_checkbox', k, -(value + r + t) FROM e, (VALUES (0, 0.42::DOUBLE, 128), (1, 0.42::DOUBLE, 160), (2, 0.55::DOUBLE, 128), (3, 0.55::DOUBLE, 160)) v(k, r, t)) SELECT event_id, variant, \"check\", CAST(setting_id AS INTEGER) AS setting_id, score, variant <> 'clean' AS positive FROM s WHERE score IS NOT NULL AND (variant = 'clean' OR (variant, \"check\") IN (('click', 'resolution'), ('purchase', 'cropped_page'), ('error', 'required_checkbox')))")
def sweep_settings(spark, d):
    """Every target under every setting of three checks, labelled; what is undecided is left out."""
    rows, dims, damaged = _pages(spark, d)
    settings = checks.settings_table(spark, {"resolution": [{}], "cropped_page": [{}], "required_checkbox": [{"disc_ratio": r, "ink_threshold": t} for r in (0.42, 0.55) for t in (128, 160)]})
    out = protocol.sweep(rows, dims, settings, damaged, ["event_id"], ["resolution", "cropped_page", "required_checkbox"])
    return out.select("event_id", "variant", "check", "setting_id", "score", "positive")


@query("frozen_scoring", f"WITH {_EVENTS}, s AS (SELECT event_id, variant, 'resolution' AS \"check\", res AS score, -150.0::DOUBLE AS threshold FROM e UNION ALL SELECT event_id, variant, 'cropped_page', crop, 0.4::DOUBLE FROM e) SELECT *, variant <> 'clean' AS positive, coalesce(score > threshold, false) AS fires, score IS NULL AS abstained FROM s WHERE variant = 'clean' OR (variant, \"check\") IN (('click', 'resolution'), ('purchase', 'cropped_page'))")
def frozen_scoring(spark, d):
    rows, dims, damaged = _pages(spark, d)
    settings = checks.settings_table(spark, {"resolution": [{}], "cropped_page": [{}]})
    out = protocol.frozen_rows(rows, dims, settings, {"resolution": -150.0, "cropped_page": 0.4}, damaged, ["event_id"], ["resolution", "cropped_page"])
    return out.select("event_id", "variant", "check", "score", "threshold", "positive", "fires", "abstained")


@query("corner_follow_up", f"WITH l AS (SELECT *, CASE l_linestatus WHEN 'F' THEN 'original' ELSE 'corner' END AS s FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT *, 'control' FROM lineitem WHERE l_returnflag = 'A'), m AS (SELECT s AS \"set\", l_linenumber, l_quantity > 25 AS hit FROM l UNION ALL SELECT 'combined', l_linenumber, l_quantity > 25 FROM l WHERE s <> 'control'), g AS (SELECT \"set\", count(*) FILTER (hit) AS tp, count(*) AS n, count(*) FILTER (hit AND l_linenumber < 4) AS tp_below, count(*) FILTER (l_linenumber < 4) AS n_below, count(*) FILTER (hit AND l_linenumber >= 4) AS tp_from, count(*) FILTER (l_linenumber >= 4) AS n_from FROM m GROUP BY 1) SELECT *, CAST(tp AS DOUBLE) / n AS recall, {wilson('tp', 'n', 'low', 'high')} FROM g")
def corner_follow_up(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").alias("score"), F.lit(True).alias("positive"))
    sets = {"original": lines.where("l_returnflag <> 'A' AND l_linestatus = 'F'"), "corner": lines.where("l_returnflag <> 'A' AND l_linestatus <> 'F'"), "control": lines.where("l_returnflag = 'A'")}
    out = protocol.follow_up(sets, 25.0, "l_linenumber", 4, ["original", "corner"])
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query("dump_summary", "SELECT count(*) AS rows, count(DISTINCT user_id) AS cells, (SELECT string_agg(event_type || ':' || k, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS k FROM events WHERE event_type <> 'view' GROUP BY 1)) AS shapes, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT event_id % 4 AS x FROM events)) AS levels, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT event_id % 3 AS x FROM events)) AS seeds FROM events")
def dump_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("cell"), (F.col("event_id") % 4).alias("parasite"), (F.col("event_id") % 3).alias("seed"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("shape"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    shapes = F.array_join(F.transform(F.map_entries("shapes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return readings.dump_summary(rows).select("rows", "cells", shapes.alias("shapes"), listed("levels").alias("levels"), listed("seeds").alias("seeds"))


@query("verdict_objects", f"WITH {_EVENTS} SELECT event_id, '{{\"event_id\":' || event_id || ',\"verdict\":\"' || CASE WHEN crop > 0.4 THEN 'defect' WHEN res IS NULL OR res > -150 THEN 'unreadable' ELSE 'no_finding' END || '\",\"findings\":[{{\"check\":\"cropped_page\",\"piece\":\"t0\",\"target\":\"\",\"fires\":' || (crop > 0.4) || ',\"undecidable\":false}},{{\"check\":\"resolution\",\"piece\":\"t0\",\"target\":\"\",\"fires\":' || coalesce(res > -150, false) || ',\"undecidable\":' || (res IS NULL) || '}}]}}' AS value FROM e")
def verdict_objects(spark, d):
    """Each page's verdict as the JSON that users get, here without the scores."""
    rows, dims, _ = _pages(spark, d)
    settings = checks.settings_table(spark, {"resolution": [{}], "cropped_page": [{}]})
    found = checks.evaluate(rows, dims, settings, {"resolution": -150.0, "cropped_page": 0.4}, ["event_id"], ["resolution", "cropped_page"])
    return sinks.verdict_json(found, ["event_id"]).select("event_id", F.regexp_replace("value", r'"score":[^,]*,', "").alias("value"))


# ---- words on pages -----------------------------------------------------------------------------


@query("added_words", "WITH w AS (SELECT event_id, user_id % 50 AS page, event_type AS text, value AS cx, event_id % 100 AS cy FROM events), p AS (SELECT * FROM w WHERE event_id % 10 = 0), s AS (SELECT * FROM w WHERE event_id % 10 <> 0) SELECT event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = s.page AND p.text = s.text AND (p.cx - s.cx) * (p.cx - s.cx) + (p.cy - s.cy) * (p.cy - s.cy) <= 484)")
def added_words(spark, d):
    w = table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("page"), F.col("event_type").alias("text"), F.col("value").alias("cx"), (F.col("event_id") % 100).alias("cy"))
    return align.added_words(w.where("event_id % 10 <> 0"), w.where("event_id % 10 = 0"), ["page"]).select("event_id")


@query("first_of_place", "SELECT user_id, count(DISTINCT (event_type, CAST(floor(value / 5) AS BIGINT), event_id % 3)) AS kept, CAST(sum(event_id) FILTER (n = 1) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value / 5) AS BIGINT), event_id % 3 ORDER BY event_id) AS n FROM events) GROUP BY user_id")
def first_of_place(spark, d):
    word = F.struct("event_id", F.col("event_type").alias("text"), F.floor(F.col("value") / 5).alias("cx"), (F.col("event_id") % 3).alias("cy"))
    kept = X.first_of_place(F.array_sort(F.collect_list(word)))
    rows = table(spark, d, "events").groupBy("user_id").agg(kept.alias("w"))
    return rows.select("user_id", F.size("w").cast("long").alias("kept"), F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["event_id"]).alias("ids"))


# ---- designs ------------------------------------------------------------------------------------


@query("parasite_grid", "SELECT row_number() OVER (ORDER BY a, d, j, s) - 1 AS cell_index, CAST(a AS DOUBLE) AS angle, CAST(d AS INTEGER) AS dpi, CAST(j AS INTEGER) AS jpeg, CAST(s AS DOUBLE) AS sigma FROM (VALUES (0), (0.5), (1), (4)) x(a), (VALUES (150), (200), (300)) y(d), (VALUES (30), (75), (95)) z(j), (VALUES (0), (6), (12)) w(s)")
def parasite_grid(spark, d):
    return design.parasite_grid(spark)


_FORMS = """fields AS (SELECT 'i' || n_regionkey AS identity, n_name AS piece, p_brand AS role, CASE p_size % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'box' ELSE 'signature' END AS kind, p_size % 2 = 0 AS required, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN 'expiration' END AS date_kind, 'F' || p_partkey AS field_id FROM nation JOIN part ON p_partkey % 25 = n_nationkey),
roles AS (SELECT DISTINCT identity, piece, role, kind, required, date_kind FROM fields), pieces AS (SELECT 'i' || n_regionkey AS identity, n_name AS piece, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation),
v AS (SELECT identity, 'empty_required_field@' || piece || '.' || role AS variant, 'required_field' AS ch, piece, role, CAST(NULL AS VARCHAR) AS detail FROM roles WHERE kind = 'field' AND required
UNION ALL SELECT identity, 'unchecked_box@' || piece || '.' || role, 'required_checkbox', piece, role, NULL FROM roles WHERE kind = 'box' AND required
UNION ALL SELECT identity, 'missing_signature@' || piece || '.' || role, 'signature', piece, role, NULL FROM roles WHERE kind = 'signature' AND required
UNION ALL SELECT identity, 'expired_date@' || piece || '.' || role || '.' || n || 'd', 'expiry', piece, role, CAST(n AS VARCHAR) FROM roles, (VALUES (1), (365)) x(n) WHERE date_kind = 'expiration'
UNION ALL SELECT identity, 'forbidden_value@' || piece, 'forbidden_value', piece, role, '123' FROM (SELECT identity, piece, min(role) AS role FROM roles WHERE role IN ('ssn', 'tax_id') GROUP BY ALL)
UNION ALL SELECT identity, n || '@' || piece, c, piece, NULL, NULL FROM pieces, (VALUES ('low_resolution', 'resolution'), ('cropped_page', 'cropped_page'), ('rotated_page', 'rotated_page')) x(n, c)
UNION ALL SELECT identity, 'diverging_name@' || arg_max(piece, ord), 'consistency', arg_max(piece, ord), 'Brand#11', 'name' FROM pieces GROUP BY identity)"""


def _forms(spark, d):
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "field").when(size % 3 == 1, "box").otherwise("signature")
    fields = part.join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("template"), F.col("p_brand").alias("role"), F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("field_id"), F.lit(0).alias("ord"), kind.alias("kind"), (size % 2 == 0).alias("required"), F.when((size % 5 == 0) & (size % 3 == 0), "expiration").alias("date_kind"))
    identity = F.concat(F.lit("i"), F.col("n_regionkey").cast("string"))
    pieces = nation.select(identity.alias("identity"), F.col("n_name").alias("piece"), F.col("n_name").alias("template"), F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1").alias("ord"))
    sides = pieces.select("identity", F.lit("name").alias("data"), "ord", "piece", F.lit("Brand#11").alias("field"))
    forbidden = pieces.select("identity").distinct().withColumn("value", F.lit("123"))
    return checks.Dimensions({"template_fields": fields, "ref_pieces": pieces, "ref_consistency": sides, "ref_forbidden": forbidden})


@query("enumerated_variants", f"WITH {_FORMS} SELECT identity, variant, ch AS \"check\", piece, role, detail FROM v")
def enumerated_variants(spark, d):
    return design.enumerate_variants(_forms(spark, d)).select("identity", "variant", "check", "piece", "role", "detail")


@query("damaged_targets", f"WITH {_FORMS} SELECT DISTINCT identity, variant, ch AS \"check\", piece, field_id AS target FROM v JOIN fields USING (identity, piece, role) WHERE ch IN ('required_field', 'required_checkbox') UNION SELECT identity, variant, ch, piece, field_id FROM v JOIN fields f USING (identity, piece) WHERE ch = 'signature' AND f.kind = 'signature' UNION SELECT identity, variant, ch, piece, field_id FROM v JOIN fields f USING (identity, piece) WHERE ch = 'expiry' AND f.date_kind = 'expiration' UNION SELECT identity, variant, ch, piece, '123' FROM v WHERE ch = 'forbidden_value' UNION SELECT v.identity, variant, ch, a.piece || '+' || b.piece, 'name' FROM v JOIN pieces a ON a.identity = v.identity JOIN pieces b ON b.identity = v.identity AND a.ord < b.ord WHERE ch = 'consistency' UNION SELECT identity, variant, ch, piece, '' FROM v WHERE ch IN ('resolution', 'cropped_page', 'rotated_page')")
def damaged_targets(spark, d):
    dims = _forms(spark, d)
    return design.damaged_targets(design.enumerate_variants(dims), dims).select("identity", "variant", "check", "piece", "target")


@query("readings_to_make", f"WITH {_FORMS} SELECT identity, 'clean' AS variant, piece FROM pieces UNION ALL SELECT identity, variant, piece FROM v")
def readings_to_make(spark, d):
    dims = _forms(spark, d)
    return design.readings_to_make(design.enumerate_variants(dims), dims).select("identity", "variant", "piece")


@query("targeted_runs", "WITH c AS (SELECT n_nationkey AS cell_index FROM nation), r AS (SELECT cell_index, CAST(s AS INTEGER) AS seed, CAST(x AS DOUBLE) AS parasite, r_name AS target, side FROM c, (VALUES (11), (23), (37)) a(s), (VALUES (0.0), (0.002), (0.01), (0.04)) b(x), region, (VALUES ('variant'), ('clean')) d(side)) SELECT *, CASE WHEN parasite > 0 THEN (['fold', 'speck', 'stroke'])[(seed + cell_index) % 3 + 1] END AS shape FROM r")
def targeted_runs(spark, d):
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_index"))
    return design.targeted_runs(cells, table(spark, d, "region").select(F.col("r_name").alias("target"))).select("cell_index", "seed", "parasite", "target", "side", "shape")


@query("renderer_rows", "SELECT row_number() OVER (ORDER BY p, n_nationkey, l, s) - 1 AS row_index, CAST(p AS VARCHAR) AS pipeline, n_name AS variant, CAST(l AS INTEGER) AS level, CAST(s AS INTEGER) AS seed FROM (VALUES ('p1'), ('p2'), ('p3'), ('p4'), ('p5'), ('p6')) a(p), nation, (VALUES (0), (1), (2)) b(l), (VALUES (11), (23), (37)) c(s)")
def renderer_rows(spark, d):
    """The rows of the arm that a third-party renderer would make: pipelines x variants x levels x seeds."""
    variants = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("variant"))
    return design.renderer_rows(variants, [f"p{i}" for i in range(1, 7)], [0, 1, 2])


# ---- sources, sinks and small functions ---------------------------------------------------------


@query("zones_from_rects", "SELECT p_partkey, CAST(trunc(x0 * 200 / 72) AS INTEGER) AS x0, CAST(trunc((792 - y1) * 200 / 72) AS INTEGER) AS y0, CAST(trunc(x1 * 200 / 72) AS INTEGER) AS x1, CAST(trunc((792 - y0) * 200 / 72) AS INTEGER) AS y1, kind FROM (SELECT p_partkey, p_size * 3.7::DOUBLE AS x0, p_size * 5.1::DOUBLE AS y0, p_size * 3.7::DOUBLE + 20.3::DOUBLE AS x1, p_size * 5.1::DOUBLE + 9.9::DOUBLE AS y1, CASE p_size % 4 WHEN 0 THEN '/Push' WHEN 1 THEN '/Radio' WHEN 2 THEN '/Btn' ELSE '/Tx' END AS kind FROM part)")
def zones_from_rects(spark, d):
    s = F.col("p_size")
    flags = F.when(s % 4 == 0, 1 << 16).when(s % 4 == 1, 1 << 15).otherwise(0)
    rects = table(spark, d, "part").select(F.lit("t").alias("template"), F.col("p_partkey").alias("name"), F.lit(0).alias("page"), (s * 3.7).alias("left"), (s * 5.1).alias("bottom"), (s * 3.7 + 20.3).alias("right"), (s * 5.1 + 9.9).alias("top"), F.lit(792.0).alias("page_height"), F.when(s % 4 == 3, "/Tx").otherwise("/Btn").alias("field_type"), flags.alias("flags"))
    return declarations.zones_from_rects(rects).select(F.col("name").alias("p_partkey"), "x0", "y0", "x1", "y1", "kind")


@query("page_sizes", "SELECT p_partkey, CAST(trunc(p_size * 12.3::DOUBLE * 200 / 72) AS INTEGER) AS wide, CAST(trunc(p_retailprice * 200 / 72) AS INTEGER) AS high FROM part")
def page_sizes(spark, d):
    wide, high = declarations.page_size(F.col("p_size") * 12.3, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", wide.alias("wide"), high.alias("high"))


@query("blank_to_null", "SELECT doc_id, nullif(trim(substr(text, 1 + length(text) // 2, doc_id % 3)), '') AS t FROM documents")
def blank_to_null(spark, d):
    return table(spark, d, "documents").select("doc_id", X.blank_to_null(F.expr("substr(text, cast(1 + length(text) div 2 as int), cast(doc_id % 3 as int))")).alias("t"))


@query("content_tags", "SELECT n_nationkey, substr(sha1('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}'), 1, 10) AS tag FROM nation")
def content_tags(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.content_tag(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).alias("tag"))


@query("orientations", "SELECT event_id, CAST(user_id % 4 AS INTEGER) AS quarter_turns, CAST((4 - event_id % 4) % 4 AS INTEGER) AS expected_quarter_turns, user_id % 4 <> (4 - event_id % 4) % 4 AS wrong_quarter_turn FROM events")
def orientations(spark, d):
    turns = lambda c: (F.col(c) % 4).cast("int")
    return table(spark, d, "events").select("event_id", manifests.orientation(turns("user_id"), manifests.expected_quarter_turns(turns("event_id"))).alias("o")).select("event_id", "o.*")


@query("page_frames", "SELECT event_id, event_id % 37 + value * 0.4::DOUBLE AS there, CAST(round_even((value - event_id % 37) / 0.4::DOUBLE, 0) AS INTEGER) AS here FROM events")
def page_frames(spark, d):
    offset, scale = F.col("event_id") % 37, F.lit(0.4)
    return table(spark, d, "events").select("event_id", raster.canonical(F.col("value"), offset, scale).alias("there"), raster.in_scan(F.col("value"), offset, scale).alias("here"))


@query("degradation_keys", "SELECT event_id, concat_ws('_', 'a' || (event_id % 5), 'd' || (event_id % 7), event_type) AS k FROM events")
def degradation_keys(spark, d):
    return table(spark, d, "events").select("event_id", X.joined_key(F.concat(F.lit("a"), F.col("event_id") % 5), F.concat(F.lit("d"), F.col("event_id") % 7), F.col("event_type")).alias("k"))


@query("printed_values", "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 5 = 1 THEN c_mktsegment WHEN c_mktsegment = 'BUILDING' THEN strftime(DATE '2026-01-31' - CAST(c_custkey % 9 AS INTEGER), '%d/%m/%Y') ELSE c_name END AS v FROM customer")
def printed_values(spark, d):
    """Texts of a role: emptied, replaced, or an expiration date some days before the clock."""
    n = F.col("c_nationkey") % 5
    variant = {"emptied": n == 0, "replacement": F.when(n == 1, F.col("c_mktsegment")), "expired": F.lit(True), "expired_days": (F.col("c_custkey") % 9).cast("int")}
    day = F.lit("2026-01-31").cast("date")
    value = forms.printed_value(F.lit("r"), F.col("c_name"), date_kind=F.when(F.col("c_mktsegment") == "BUILDING", "expiration"), date_format=F.lit("fr"), filing=day, valid_until=day, expired_until=day, variant=variant)
    return table(spark, d, "customer").select("c_custkey", value.alias("v"))


@query("placed_values", "SELECT c_custkey, p[1] AS a, p[2] AS b, CASE WHEN length(v) > 6 + c_nationkey THEN substr(regexp_replace(v, '[^0-9A-Za-z]', '', 'g'), 1, 6 + c_nationkey) ELSE v END AS one FROM (SELECT *, c_custkey || '-' || c_mktsegment || ' / ' || c_name AS v, regexp_split_to_array(v, '[^0-9A-Za-z]+') AS p FROM customer)")
def placed_values(spark, d):
    most = F.create_map(F.lit("x"), (F.col("c_nationkey") + 6).cast("int"))
    value = F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_mktsegment"), F.lit(" / "), F.col("c_name"))
    both = forms.placed(value, F.array(F.lit("x"), F.lit("y")), most)
    return table(spark, d, "customer").select("c_custkey", both["x"].alias("a"), both["y"].alias("b"), forms.placed(value, F.array(F.lit("x")), most)["x"].alias("one"))


@query("clean_pages", "SELECT event_id, 'as is' AS protocol FROM events WHERE event_id % 4 = 0 AND user_id >= 75 UNION ALL SELECT event_id, 'on ink' FROM events WHERE user_id >= 75")
def clean_pages(spark, d):
    """Rows without foreign ink from a resolution on, unless the protocol itself speaks of ink."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 8 > 0, (F.col("event_id") % 4).cast("double")).alias("parasite"), F.col("user_id").alias("dpi"))
    out = None
    for name, report in (("as is", "seed == 37"), ("on ink", "parasite > 0.0")):
        one = predicates.from_dpi(predicates.clean_pages(rows, predicates.Holdout(report=report)), 75).select("event_id", F.lit(name).alias("protocol"))
        out = one if out is None else out.unionByName(one)
    return out


@query("reading_sentences", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN printf('fires more than %.0f days past the date', value) WHEN 1 THEN printf('fires below %.2f dpi', value) WHEN 2 THEN printf('fires at a similarity above %.4f', value) ELSE printf('fires if a zone gained less than %.3f %% ink', value) END AS reading FROM (SELECT event_id, CAST(floor(value) AS DOUBLE) AS value FROM events)")
def reading_sentences(spark, d):
    k = F.col("event_id") % 4
    check = F.when(k == 0, "expiry").when(k == 1, "resolution").when(k == 2, "forbidden_value").otherwise("required_field")
    value = F.floor("value").cast("double")
    rows = table(spark, d, "events").select("event_id", check.alias("check"), F.when((k == 0) | (k == 2), value).otherwise(-value).alias("threshold"), F.lit("ink").alias("text_sensor"))
    return sinks.reading_sentence(rows).select("event_id", "reading")


@query("raw_words", "SELECT event_id, event_type AS text, CAST(round_even(value, 0) AS INTEGER) AS cx, CAST(user_id AS INTEGER) AS cy, event_id % 2 = 0 AS added FROM events")
def raw_words(spark, d):
    """Words as measurement files hold them, arrays of mixed types that load as strings."""
    raw = F.array("event_type", F.col("value").cast("string"), F.col("user_id").cast("string"), F.lit("90"), F.when(F.col("event_id") % 2 == 0, "true"))
    return table(spark, d, "events").select("event_id", readings.word(raw).alias("w")).select("event_id", "w.text", "w.cx", "w.cy", "w.added")
