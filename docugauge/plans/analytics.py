"""Queries of the measuring side: curves, points, measures, breakdowns, duels, domains, frozen scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from docugauge.operators import curves, measures
from docugauge.plans import protocol
from docugauge.plans.bindings import MEASURED, SUMS, B, S, chosen, keyed, points, rate, scores, settings, table, wilson

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS, T = 9, 100.0
AXES = ("lang", "bucket", "toxic")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


RATES = "threshold, recall, fpr, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS grid_precision, CASE WHEN 0.1::DOUBLE * recall + 0.9::DOUBLE * fpr = 0 THEN 1.0 ELSE (0.1::DOUBLE * recall) / (0.1::DOUBLE * recall + 0.9::DOUBLE * fpr) END AS prevalence_precision, tp, fp, n_pos, n_neg"


@query("pr_curve", f"WITH {B}, c AS ({points('b')}) SELECT {RATES} FROM c")
def pr_curve(spark, d):
    return curves.curve(scores(spark, d))


@query("operating_point", f"WITH {B}, c AS ({points('b')}) SELECT {RATES} FROM ({chosen('c')})")
def operating_point(spark, d):
    return curves.operating_point(scores(spark, d))


@query("precisions_at_prevalence", f"WITH {B}, c AS ({points('b', 'lang')}) SELECT lang, threshold, CASE WHEN recall + fpr = 0 THEN 1.0 ELSE recall / (recall + fpr) END AS balanced_precision FROM c")
def precisions_at_prevalence(spark, d):
    return curves.balanced(curves.curve(scores(spark, d), ["lang"])).select("lang", "threshold", "balanced_precision")


@query("wilson_by_group", f"SELECT event_type, fired, n, {rate('fired', 'n', 'rate')}, {wilson('fired', 'n', 'low', 'high')} FROM (SELECT event_type, count(*) FILTER (value > 50) AS fired, count(*) AS n FROM events GROUP BY event_type)")
def wilson_by_group(spark, d):
    return measures.grouped_rates(table(spark, d, "events"), F.col("value") > 50, [["event_type"]], DIGITS).drop("grouping")


@query("measure_two_level", f"WITH {B}, k AS ({keyed('b', '100', 'source')}), m AS (SELECT {SUMS} FROM k) SELECT {MEASURED} FROM m")
def measure_two_level(spark, d):
    return measures.measure(scores(spark, d), T, ["source"], digits=DIGITS)


@query("measure_cal_vs_report", f"WITH {B}, c AS ({points('(SELECT * FROM b WHERE seed <> 2) x')}), p AS ({chosen('c')}), z AS (SELECT b.*, seed = 2 AS report, p.threshold AS t FROM b, p), k AS (SELECT report, source, t, count(*) FILTER (positive) AS n_pos, count(*) FILTER (positive AND score > t) AS tp, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (NOT positive AND score > t) AS fp FROM z GROUP BY ALL), m AS (SELECT report, t AS threshold, {SUMS} FROM k GROUP BY report, t) SELECT report, threshold, {MEASURED} FROM m")
def measure_cal_vs_report(spark, d):
    rows = scores(spark, d).withColumn("report", F.col("seed") == 2)
    point = curves.operating_point(rows.where("NOT report")).select("threshold")
    return measures.measure(rows.crossJoin(F.broadcast(point)), F.col("threshold"), ["source"], ["report", "threshold"], digits=DIGITS)


_FACTOR = "SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS value, tp, fp, n_pos, n_neg, hit, n_dossiers FROM (SELECT {a}, " + SUMS + " FROM k GROUP BY {a})"


@query("by_factor_grouping_sets", f"WITH {B}, k AS ({keyed('b', '100', 'source, lang, bucket, toxic')}), m AS (" + " UNION ALL ".join(_FACTOR.format(a=a) for a in AXES) + f") SELECT axis, value, {rate('tp', 'n_pos', 'recall')}, n_pos AS n, {rate('fp', 'n_neg', 'fpr')}, {rate('hit', 'n_dossiers', 'dossier_fpr')}, {wilson('tp', 'n_pos', 'low', 'high')} FROM m")
def by_factor_grouping_sets(spark, d):
    return measures.by_factor(scores(spark, d), T, ["source"], AXES, DIGITS)


_CELLS = "cells AS (SELECT lang, bucket, toxic, count(*) FILTER (positive AND score > 100) AS tp, count(*) FILTER (positive) AS n FROM b GROUP BY ALL)"


@query("floor_cells", f"WITH {B}, {_CELLS} SELECT *, CAST(tp AS DOUBLE) / greatest(n, 1) AS recall, CAST(tp AS DOUBLE) / greatest(n, 1) < 0.95 AS fallen FROM cells")
def floor_cells(spark, d):
    return measures.fallen_cells(scores(spark, d), T, AXES)


@query("frontier", f"WITH {B}, {_CELLS} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS value, count(*) FILTER (CAST(tp AS DOUBLE) / greatest(n, 1) < 0.95) AS fallen, count(*) AS cells FROM cells GROUP BY {a}" for a in AXES))
def frontier(spark, d):
    return measures.frontier(measures.fallen_cells(scores(spark, d), T, AXES), AXES)


_PAIR = "SELECT '{a} x {b}' AS pair, CAST({a} AS VARCHAR) AS left_value, CAST({b} AS VARCHAR) AS right_value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY {a}, {b}"


@query("worst_conjunctions", f"WITH {B}, {_CELLS}, p AS (" + " UNION ALL ".join(_PAIR.format(a=a, b=b) for i, a in enumerate(AXES) for b in AXES[i + 1 :]) + f"), r AS (SELECT pair, left_value, right_value, CAST(tp AS DOUBLE) / greatest(n, 1) AS recall, tp, n, CAST(row_number() OVER (PARTITION BY pair ORDER BY CAST(tp AS DOUBLE) / greatest(n, 1), left_value, right_value) AS INTEGER) AS rank FROM p) SELECT pair, left_value, right_value, recall, n, rank, {wilson('tp', 'n', 'low', 'high')} FROM r WHERE rank <= 3")
def worst_conjunctions(spark, d):
    return measures.worst_conjunctions(scores(spark, d), T, AXES, digits=DIGITS)


@query("noisy_targets_topk", f"WITH {B} SELECT lang, source, count(*) FILTER (score > 25) AS fired, count(*) AS seen FROM b WHERE NOT positive GROUP BY lang, source HAVING fired > 0 ORDER BY fired DESC, lang, source LIMIT 8")
def noisy_targets_topk(spark, d):
    return measures.noisy_targets(scores(spark, d), 25.0, ["lang", "source"])


_LEAST = "SELECT score - 1e-9::DOUBLE AS full_recall FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM {rel} WHERE positive) WHERE i = least(n - 1, CAST(round_even(0.05::DOUBLE * n, 0) AS BIGINT))"


@query("certifiability", f"WITH {B}, t AS ({_LEAST.format(rel='b')}), c AS (SELECT lang, source, count(*) FILTER (score > full_recall) AS fired, count(*) AS seen FROM b, t WHERE NOT positive GROUP BY lang, source) SELECT *, CAST(fired AS DOUBLE) / seen AS rate, CAST(fired AS DOUBLE) / seen <= 0.002 AS certifiable FROM c")
def certifiability(spark, d):
    return measures.certifiability(scores(spark, d), ["lang", "source"])


@query("restricted_point", f"WITH {B.replace('b AS (', 'b0 AS (', 1)}, b AS (SELECT * REPLACE (score + CASE WHEN positive THEN 500 WHEN bucket = 0 THEN 600 ELSE 0 END AS score) FROM b0), cal AS (SELECT * FROM b WHERE seed <> 2), t AS ({_LEAST.format(rel='cal')}), r AS (SELECT lang, source, CAST(count(*) FILTER (score > full_recall) AS DOUBLE) / count(*) <= 0.002 AS ok FROM cal, t WHERE NOT positive GROUP BY lang, source), held AS (SELECT * FROM b WHERE positive UNION ALL SELECT b.* FROM b SEMI JOIN (SELECT * FROM r WHERE ok) o USING (lang, source) WHERE NOT positive), c AS ({points('(SELECT * FROM held WHERE seed <> 2) x')}), p AS ({chosen('c')}), z AS (SELECT held.*, threshold AS t FROM held, p WHERE seed = 2), k AS (SELECT source, t, count(*) FILTER (positive) AS n_pos, count(*) FILTER (positive AND score > t) AS tp, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (NOT positive AND score > t) AS fp FROM z GROUP BY ALL), m AS (SELECT t AS threshold, {SUMS} FROM k GROUP BY t), n AS (SELECT count(*) FILTER (ok) AS kept_targets, count(*) AS total_targets FROM r) SELECT threshold, {MEASURED}, kept_targets, total_targets FROM m, n WHERE kept_targets > 0 AND kept_targets < total_targets")
def restricted_point(spark, d):
    """A quarter of the targets have scores above every positive and can't be certified."""
    rows = scores(spark, d).withColumn("score", F.col("score") + F.when(F.col("positive"), 500).when(F.col("bucket") == 0, 600).otherwise(0))
    return measures.restricted_to_certifiable(rows, ["lang", "source"], ["source"], F.col("seed") != 2, F.col("seed") == 2, digits=DIGITS)


_DUEL = f"WITH {S}, c AS ({points('s', 'setting_id')}), p AS ({chosen('c', 'setting_id')}), z AS (SELECT s.*, threshold AS t, recall AS gr, fpr AS gf FROM s JOIN (SELECT setting_id, threshold, recall, fpr FROM p) USING (setting_id)), k AS (SELECT setting_id, lang, t, gr, gf, source, count(*) FILTER (positive) AS n_pos, count(*) FILTER (positive AND score > t) AS tp, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (NOT positive AND score > t) AS fp FROM z GROUP BY ALL), m AS (SELECT setting_id, lang, t AS threshold, gr AS global_recall, gf AS global_fpr, {SUMS} FROM k GROUP BY ALL)"


@query("duel_by_axis", _DUEL + f", r AS (SELECT setting_id, CAST(row_number() OVER (ORDER BY recall DESC, fpr, setting_id) AS INTEGER) AS place FROM p) SELECT setting_id, lang, threshold, global_recall, global_fpr, {MEASURED}, place FROM m JOIN r USING (setting_id)")
def duel_by_axis(spark, d):
    return measures.duel(settings(spark, d), "setting_id", "lang", ["source"], digits=DIGITS)


@query("duel_ties", _DUEL + ", v AS (SELECT setting_id, lang, CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pos END AS recall FROM m), top AS (SELECT lang, max(recall) AS recall FROM v GROUP BY lang), best AS (SELECT recall, min(fpr) AS fpr FROM p WHERE recall = (SELECT max(recall) FROM p) GROUP BY recall) SELECT lang, string_agg(CAST(setting_id AS VARCHAR), '+' ORDER BY CAST(setting_id AS VARCHAR)) AS winners, recall, (SELECT count(*) > 1 FROM p JOIN best USING (recall, fpr)) AS tie FROM v JOIN top USING (lang, recall) GROUP BY lang, recall")
def duel_ties(spark, d):
    rows = settings(spark, d).withColumn("setting_id", F.col("setting_id").cast("string"))
    return measures.duel_verdicts(rows, "setting_id", "lang", ["source"])


@query("duel_drops", _DUEL + ", v AS (SELECT setting_id, lang, CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pos END AS recall FROM m) SELECT setting_id, max(recall) FILTER (lang = 'en') AS clean_recall, max(recall) FILTER (lang = 'de') AS dirty_recall, clean_recall - dirty_recall AS drop FROM v GROUP BY setting_id")
def duel_drops(spark, d):
    return measures.drops(measures.duel(settings(spark, d), "setting_id", "lang", ["source"]), "setting_id", "lang", "en", "de")


@query("best_setting", f"WITH {S}, cal AS (SELECT * FROM s WHERE seed <> 2), c AS ({points('cal', 'setting_id')}), p AS ({chosen('c', 'setting_id')}) SELECT setting_id, {RATES} FROM p ORDER BY recall DESC, fpr, setting_id LIMIT 1")
def best_setting(spark, d):
    return protocol.best_setting(settings(spark, d).withColumn("is_cal", F.col("seed") != 2))


@query("setting_ranking", f"WITH {S}, cal AS (SELECT * FROM s WHERE seed <> 2), c AS ({points('cal', 'setting_id')}), p AS ({chosen('c', 'setting_id')}) SELECT setting_id, {RATES}, CAST(row_number() OVER (ORDER BY recall DESC, fpr, setting_id) AS INTEGER) AS rank FROM p")
def setting_ranking(spark, d):
    return protocol.ranking(settings(spark, d).withColumn("is_cal", F.col("seed") != 2))


_K4 = "k AS (SELECT setting_id, source, count(*) FILTER (positive) AS n_pos, count(*) FILTER (positive AND score > 100) AS tp, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (NOT positive AND score > 100) AS fp FROM s WHERE seed <> 2 GROUP BY ALL)"


@query("best_setting_at_definition", f"WITH {S}, {_K4}, m AS (SELECT setting_id, {SUMS} FROM k GROUP BY setting_id), r AS (SELECT setting_id, tp, fp, n_pos, n_neg, n_dossiers, {rate('tp', 'n_pos', 'recall')}, {rate('fp', 'n_neg', 'fpr')}, {rate('hit', 'n_dossiers', 'dossier_fpr')}, 100.0::DOUBLE AS threshold FROM m) SELECT * FROM r ORDER BY recall DESC, fpr, setting_id LIMIT 1")
def best_setting_at_definition(spark, d):
    out = protocol.best_setting_at(settings(spark, d).withColumn("is_cal", F.col("seed") != 2), T, ["source"])
    return out.drop(*[c for c in out.columns if c.endswith(("_low", "_high"))])


_LINES = "trial AS (SELECT l_orderkey, l_linenumber, l_returnflag AS defect, unnest([{'c': 'A', 's': l_discount, 't': 0.05}, {'c': 'N', 's': l_tax, 't': 0.04}, {'c': 'R', 's': l_quantity, 't': 40.0}]) AS x FROM lineitem)"


@query("crosstalk_pivot", f"WITH {_LINES}, one AS (SELECT x.c AS ch, defect, l_orderkey, l_linenumber, max(CAST(x.s > x.t AS INTEGER)) AS fired FROM trial WHERE x.c <> defect GROUP BY ALL), g AS (SELECT ch, defect, CAST(sum(fired) AS BIGINT) AS fired, count(*) AS n FROM one GROUP BY ch, defect) SELECT ch AS \"check\", max(CAST(fired AS DOUBLE) / n) FILTER (defect = 'A') AS \"A\", max(CAST(fired AS DOUBLE) / n) FILTER (defect = 'N') AS \"N\", max(CAST(fired AS DOUBLE) / n) FILTER (defect = 'R') AS \"R\" FROM g GROUP BY ch")
def crosstalk_pivot(spark, d):
    lines = table(spark, d, "lineitem")
    rules = F.array(*[F.struct(F.lit(c).alias("check"), F.col(s).alias("score"), F.lit(t).alias("threshold")) for c, s, t in (("A", "l_discount", 0.05), ("N", "l_tax", 0.04), ("R", "l_quantity", 40.0))])
    trials = lines.select(F.col("l_returnflag").alias("defect"), F.col("l_orderkey").alias("dossier"), F.col("l_linenumber").alias("instance"), F.explode(rules).alias("r")).select("defect", "dossier", "instance", "r.*")
    return measures.crosstalk(trials).groupBy("check").pivot("defect", ["A", "N", "R"]).agg(F.max("rate"))


_DOMAIN = "l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 300 WHEN l_quantity >= 25 THEN 200 WHEN l_quantity >= 10 THEN 150 ELSE 96 END AS dpi, l_returnflag = 'R' AS positive, l_orderkey % 3 <> 2 AS is_cal, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem), x AS (SELECT dpi, positive, is_cal, unnest([{'c': 'expiry', 's': l_discount * 100 + CASE WHEN positive THEN l_quantity ELSE 0 END}, {'c': 'consistency', 's': CASE WHEN positive THEN l_quantity * 10 ELSE l_tax END}]) AS r FROM l), y AS (SELECT dm.d AS domain, r.c AS ch, positive, r.s AS score FROM x, (VALUES (96), (150), (200), (300)) dm(d) WHERE dpi >= dm.d AND is_cal)"


def _lines(spark, d):
    q = F.col("l_quantity")
    dpi = F.when(q >= 40, 300).when(q >= 25, 200).when(q >= 10, 150).otherwise(96)
    lines = table(spark, d, "lineitem").select(dpi.alias("dpi"), (F.col("l_returnflag") == "R").alias("positive"), (F.col("l_orderkey") % 3 != 2).alias("is_cal"), "l_quantity", "l_discount", "l_tax")
    two = F.array(F.struct(F.lit("expiry").alias("check"), (F.col("l_discount") * 100 + F.when(F.col("positive"), q).otherwise(0)).alias("score")), F.struct(F.lit("consistency").alias("check"), F.when(F.col("positive"), q * 10).otherwise(F.col("l_tax")).alias("score")))
    return lines.select("dpi", "positive", "is_cal", F.explode(two).alias("r")).select("dpi", "positive", "is_cal", "r.*").withColumn("setting_id", F.lit(0))


@query("domain_choice", f"WITH {_DOMAIN}, c AS ({points('y', 'domain', 'ch')}), p AS ({chosen('c', 'domain', 'ch')}), w AS (SELECT domain, min(recall) AS worst_recall FROM p GROUP BY domain) SELECT domain, worst_recall, row_number() OVER (ORDER BY worst_recall >= 0.95 DESC, CASE WHEN worst_recall >= 0.95 THEN 0.0 ELSE -worst_recall END, domain) = 1 AS chosen FROM w")
def domain_choice(spark, d):
    return protocol.choose_domain(_lines(spark, d), ["expiry", "consistency"])


@query("estimator_error", "SELECT max(abs(l_extendedprice - l_quantity * 1000) / (l_quantity * 1000)) AS max_error FROM lineitem")
def estimator_error(spark, d):
    return protocol.estimator_error(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000)


@query("operational_floor", "WITH e AS (SELECT max(abs(l_quantity * 1.001::DOUBLE - l_quantity) / l_quantity) AS max_error FROM lineitem) SELECT 150 AS domain, max_error, greatest(0.01, 10 * max_error) AS margin, -(150 * (1 - greatest(0.01, 10 * max_error))) AS threshold FROM e")
def operational_floor(spark, d):
    error = protocol.estimator_error(table(spark, d, "lineitem"), F.col("l_quantity") * 1.001, F.col("l_quantity"))
    return protocol.operational_floor(spark.createDataFrame([(150,)], "domain int"), error)


_FROZEN = f"WITH {B}, f AS (SELECT doc_id, lang, source, positive, CASE WHEN size >= 200 THEN score END AS score, 100.0::DOUBLE AS threshold FROM b)"


def _frozen(spark, d):
    rows = scores(spark, d).withColumn("score", F.when(F.col("size") >= 200, F.col("score"))).withColumn("threshold", F.lit(T))
    return rows.withColumns({"fires": curves.fires(F.col("score"), F.col("threshold")), "abstained": F.col("score").isNull()})


@query("frozen_report_abstention", _FROZEN + f", a AS (SELECT lang, threshold, count(*) FILTER (positive AND score IS NULL) AS abstained_pos, count(*) FILTER (NOT positive AND score IS NULL) AS abstained_neg FROM f GROUP BY ALL), k AS ({keyed('f', 'threshold', 'lang, threshold, source')} HAVING count(score) > 0), m AS (SELECT lang, threshold, {SUMS} FROM k GROUP BY lang, threshold), r AS (SELECT lang, threshold, {MEASURED} FROM m) SELECT a.lang, a.threshold, abstained_pos, abstained_neg, r.* EXCLUDE (lang, threshold), {rate('coalesce(tp, 0)', '(coalesce(n_pos, 0) + abstained_pos)', 'recall_abstention_as_miss')} FROM a LEFT JOIN r ON a.lang = r.lang AND a.threshold = r.threshold")
def frozen_report_abstention(spark, d):
    return measures.frozen_report(_frozen(spark, d), ["source"], ["lang"], DIGITS)


@query("dossier_score", _FROZEN + " SELECT source, lang, coalesce(max(score), -1e18) AS dossier_score FROM f GROUP BY source, lang")
def dossier_score(spark, d):
    return curves.dossier_score(_frozen(spark, d), ["source", "lang"])


@query("felt_rate", _FROZEN + " SELECT CAST(sum(fired) AS BIGINT) AS fired, count(*) AS n, CAST(sum(fired) AS DOUBLE) / greatest(count(*), 1) AS rate FROM (SELECT source, lang, max(CAST(coalesce(score > threshold, false) AS INTEGER)) AS fired FROM f WHERE NOT positive GROUP BY source, lang)")
def felt_rate(spark, d):
    return protocol.felt_rate(_frozen(spark, d).where("NOT positive"), ["source", "lang"])


@query("shape_split_grouping", f"WITH r AS (SELECT l_returnflag AS level, CASE WHEN l_returnflag <> 'N' THEN l_linestatus || l_linenumber % 2 END AS shape, l_discount FROM lineitem), g AS (SELECT 'level' AS grouping, level, NULL AS shape, count(*) FILTER (l_discount > 0.05) AS fired, count(*) AS n FROM r GROUP BY level UNION ALL SELECT 'level+shape', level, shape, count(*) FILTER (l_discount > 0.05), count(*) FROM r WHERE shape IS NOT NULL GROUP BY level, shape) SELECT grouping, level, shape, fired, n, {rate('fired', 'n', 'rate')}, {wilson('fired', 'n', 'low', 'high')} FROM g")
def shape_split_grouping(spark, d):
    """Rates pooled over shapes and split by them; rows of one level have none and are in the pooled part only."""
    shape = F.when(F.col("l_returnflag") != "N", F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")))
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("level"), shape.alias("shape"), "l_discount")
    return measures.shape_split(rows, F.col("l_discount") > 0.05, digits=DIGITS)


@query("angle_step_split", "WITH p AS (SELECT CAST(l_linenumber AS VARCHAR) AS angle, CASE WHEN l_linenumber < 4 THEN 'below' ELSE 'from' END AS side, l_quantity AS score FROM lineitem WHERE l_returnflag = 'R') SELECT angle, side, count(*) FILTER (score > 25) AS tp, count(*) AS n, CAST(count(*) FILTER (score > 25) AS DOUBLE) / count(*) AS recall FROM p GROUP BY GROUPING SETS ((angle), (side))")
def angle_step_split(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("angle"), (F.col("l_returnflag") == "R").alias("positive"), F.col("l_quantity").alias("score"))
    return protocol.step_split(rows, 25.0, "angle", 4).withColumn("angle", F.col("angle").cast("string"))


_INKY = f"WITH {B}, i AS (SELECT *, CASE WHEN toxic = 1 THEN 0.01 ELSE 0.0 END AS parasite FROM b)"


@query("by_parasite", _INKY + f", k AS ({keyed('i', '100', 'parasite, source')}), m AS (SELECT CAST(parasite AS DOUBLE) AS parasite, {SUMS} FROM k GROUP BY 1) SELECT parasite, {MEASURED} FROM m")
def by_parasite(spark, d):
    rows = scores(spark, d).withColumn("parasite", F.when(F.col("toxic") == 1, 0.01).otherwise(0.0))
    return measures.measure(rows, T, ["source"], ["parasite"], digits=DIGITS)


_INKS = f"WITH {S}, i AS (SELECT *, CAST(CASE WHEN toxic = 1 THEN 0.01 ELSE 0.0 END AS DOUBLE) AS parasite FROM s), c AS ({points('(SELECT * FROM i WHERE parasite = 0 AND seed <> 2) x', 'setting_id')}), p AS ({chosen('c', 'setting_id')}), z AS (SELECT i.*, threshold AS t FROM i JOIN (SELECT setting_id, threshold FROM p) USING (setting_id)), k AS (SELECT setting_id, parasite, t, source, count(*) FILTER (positive) AS n_pos, count(*) FILTER (positive AND score > t) AS tp, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (NOT positive AND score > t) AS fp FROM z GROUP BY ALL), m AS (SELECT setting_id, parasite, t AS threshold, {SUMS} FROM k GROUP BY ALL)"


@query("parasite_ranking", _INKS + f" SELECT setting_id, parasite, threshold, tp, fp, n_pos, n_neg, n_dossiers, {rate('tp', 'n_pos', 'recall')}, {rate('fp', 'n_neg', 'fpr')}, {rate('hit', 'n_dossiers', 'dossier_fpr')} FROM m")
def parasite_ranking(spark, d):
    rows = settings(spark, d).withColumns({"parasite": F.when(F.col("toxic") == 1, 0.01).otherwise(0.0), "is_cal": F.col("seed") != 2})
    out = protocol.clean_points_on_all(rows, ["source"])
    return out.drop(*[c for c in out.columns if c.endswith(("_low", "_high"))])


@query("ink_bins", f"SELECT bin, fired, n, {rate('fired', 'n', 'rate')}, {wilson('fired', 'n', 'low', 'high')} FROM (SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(*) FILTER (event_type = 'purchase') AS fired, count(*) AS n FROM events GROUP BY 1)")
def ink_bins(spark, d):
    rows = table(spark, d, "events").withColumn("bin", F.floor(F.col("value") / 20))
    return measures.grouped_rates(rows, F.col("event_type") == "purchase", [["bin"]], DIGITS).drop("grouping")


@query("published_evidence", f"WITH {B}, p AS (SELECT lang AS \"check\", count(*) FILTER (positive AND score > 100) AS tp FROM b GROUP BY lang), e AS (SELECT lang AS \"check\", count(*) AS documents FROM documents WHERE lang <> 'es' GROUP BY lang) SELECT \"check\", tp, coalesce(documents, 0) AS documents FROM p LEFT JOIN e USING (\"check\")")
def published_evidence(spark, d):
    results = scores(spark, d).groupBy(F.col("lang").alias("check")).agg(F.count_if(F.col("positive") & (F.col("score") > T)).alias("tp"))
    more = table(spark, d, "documents").where("lang <> 'es'").groupBy(F.col("lang").alias("check")).agg(F.count("*").alias("documents"))
    return protocol.published(results, [more]).fillna(0, ["documents"])
