"""Judges dossiers from the command line: measurements and declarations in, verdicts out.

Exit status: 1 if any dossier has a defect, else 2 if any can't be read, else 0; 64 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.operators import checks
from docugauge.schema import CHECKS, KEY
from docugauge.sources import declarations, readings, sinks


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(64, f"{self.prog}: {message}\n")


def judge(spark: SparkSession, measurements: str, templates: str, references: str, thresholds: str, zones: DataFrame | None, clock: str) -> DataFrame:
    """Findings of the clean variant's dossiers at a file's thresholds and settings."""
    dims = declarations.load(spark, declarations.directory(templates), declarations.directory(references))
    if zones is not None:
        dims["zones"] = zones
    held = declarations.thresholds(spark, thresholds).collect()
    limits = {r["check"]: r["value"] for r in held}
    settings = checks.settings_table(spark, {r["check"]: [r["settings"].asDict()] for r in held})
    rows = readings.read(spark, measurements)
    return checks.evaluate(rows, checks.Dimensions(dims), settings, limits, [*KEY, "variant"], [c for c in CHECKS if c in limits], clock=clock)


def main(argv: list[str] | None = None) -> int:
    parser = Parser(prog="docugauge")
    for name in ("measurements", "templates", "references", "thresholds"):
        parser.add_argument(name)
    parser.add_argument("--zones", help="Parquet of template, name, page, x0, y0, x1, y1, kind")
    parser.add_argument("--clock", required=True)
    parser.add_argument("--json", action="store_true")
    own = parser.parse_args(argv)
    spark = SparkSession.builder.appName("docugauge").getOrCreate()
    found = judge(spark, own.measurements, own.templates, own.references, own.thresholds, spark.read.parquet(own.zones) if own.zones else None, own.clock).persist()
    verdicts = checks.verdict(found, [*KEY, "variant"]).agg(F.max((F.col("exit_code") == 1).cast("int")), F.max((F.col("exit_code") == 2).cast("int"))).first()
    for row in (sinks.as_json(found) if own.json else sinks.verdict_text(found)).toLocalIterator():
        print(row[0])
    return 1 if verdicts[0] else 2 if verdicts[1] else 0


if __name__ == "__main__":
    sys.exit(main())
