"""Where results go: JSON lines, curves, frozen rows, summaries, manifests with what was left out, verdicts."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docugauge.schema import KEY


def append_readings(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_curves(points: DataFrame, path: str) -> None:
    """CSV by check."""
    points.write.mode("overwrite").partitionBy("check").option("header", True).csv(path)


def write_frozen(rows: DataFrame, path: str) -> None:
    columns = [*[k for k in KEY if k in rows.columns], "check", "variant", "piece", "target", "positive", "score", "threshold", "fires", "abstained"]
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_summary(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def merged_thresholds(old: Mapping[str, dict], new: Mapping[str, dict], digits: int = 4) -> dict:
    """Thresholds by check: entries that are fixed by definition are updated, others replaced; numbers are rounded."""
    show = lambda v: round(v, digits) if isinstance(v, float) else v
    out = dict(old)
    for check, entry in new.items():
        fresh = {k: show(v) for k, v in entry.items()}
        kept = old.get(check) or {}
        out[check] = {**kept, **fresh, "value": kept["value"], "origin": "definition"} if kept.get("origin") == "definition" else fresh
    return out


def publish_thresholds(results: DataFrame, path: str | Path, digits: int = 4) -> dict:
    """Merges results (one row per check, at most nine) into a thresholds file."""
    path = Path(path)
    old = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    new = {r["check"]: {"value": float(r["threshold"]), "origin": "grid", **{c: r[c] for c in results.columns if c not in ("check", "threshold") and isinstance(r[c], (int, float, str))}} for r in results.collect()}
    out = merged_thresholds(old, new, digits)
    path.write_text(json.dumps(out, indent=2, sort_keys=True), encoding="utf-8")
    return out


def write_manifest(tagged: DataFrame, path: str) -> None:
    """Rows without a reason are the manifest; the others go beside it, each with its reason."""
    tagged.where("reason IS NULL").drop("reason").write.mode("overwrite").option("header", True).csv(path)
    tagged.where("reason IS NOT NULL").write.mode("overwrite").json(f"{path}.excluded")


def split_errors(rows: DataFrame, column: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """Of rows with a struct<ok, error>: the good ones, and the others."""
    ok = F.col(column)["error"].isNull()
    return rows.where(ok), rows.where(~ok)


def verdict_text(findings: DataFrame) -> DataFrame:
    """One line per finding, defects first, then unreadable ones."""
    pile = F.when(F.col("score").isNull() | (F.col("fires") & (F.col("check") == "resolution")), "unreadable").when(F.col("fires"), "defect").otherwise("silent")
    order = F.when(pile == "defect", 0).when(pile == "unreadable", 1).otherwise(2)
    return findings.select(order.alias("o"), F.format_string("%-10s %-18s %s %s", pile, F.col("check"), F.col("piece"), F.col("target")).alias("line")).orderBy("o", "line").select("line")


def verdict_json(findings: DataFrame, dossier: list[str]) -> DataFrame:
    """Per dossier its verdict and findings as one JSON object."""
    rank = F.max(F.when(F.col("fires") & (F.col("check") != "resolution"), 2).when(F.col("score").isNull() | F.col("fires"), 1).otherwise(0))
    one = F.struct("check", "piece", "target", "score", "fires", F.col("score").isNull().alias("undecidable"))
    held = findings.groupBy(*dossier).agg(F.element_at(F.array(*[F.lit(x) for x in ("no_finding", "unreadable", "defect")]), rank + 1).alias("verdict"), F.array_sort(F.collect_list(one)).alias("findings"))
    return held.select(*dossier, F.to_json(F.struct(*dossier, "verdict", "findings"), {"ignoreNullFields": "false"}).alias("value"))


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small report table; only for results of bounded size."""
    held = df.limit(rows).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in held]])


def reading_sentence(results: DataFrame) -> DataFrame:
    """What a threshold means, in a sentence, for each check."""
    t, c = F.col("threshold"), F.col("check")
    text = F.when(c == "required_field", F.when(F.col("text_sensor") == "ink", F.format_string("fires if a zone gained less than %.3f %% ink", -t)).otherwise(F.format_string("fires if a zone holds fewer than %.1f letters and digits", -t)))
    for name, pattern, value in (
        ("required_checkbox", "fires if the middle of a box gained less than %.3f %% ink", -t), ("signature", "fires if the largest mark is smaller than %.3f", -t), ("expiry", "fires more than %.0f days past the date", t), ("consistency", "fires if the worst token is less than %.4f similar", 1 - t),
        ("forbidden_value", "fires at a similarity above %.4f", t), ("resolution", "fires below %.2f dpi", -t), ("cropped_page", "fires if less than %.4f of the form is there", 1 - t), ("rotated_page", "fires if another turn fits better by more than %.4f", t),
    ):
        text = text.when(c == name, F.format_string(pattern, value))
    return results.withColumn("reading", text)
