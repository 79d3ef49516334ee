"""Names, keys, stored tables and checked broadcasts that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docugauge-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset: a folder of this machine if Spark has no other, else one below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    return _own_dir() if master.startswith("local") and not master.startswith("local-cluster") else spark.conf.get("spark.sql.warehouse.dir")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docugauge/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage and outlives executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Frees what stored() wrote, once nothing reads it any more: a table without rows takes its place."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/docugauge/" in path:
            df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def row_order(id_column: str) -> Column:
    """A long that orders rows by id; null comes first, before every id but the smallest long, which it equals."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions have no variables but those of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def some(df: DataFrame, columns: list[str], n: int, within: str | None = None) -> DataFrame:
    """At most n different rows, those whose columns have the least hashes; with ``within``, at most n of each of its values.

    Only rows whose hash is among the least few of all come to be sorted, so that a task has few of them,
    however large the table; the share is the larger, the fewer rows there are, and one of all rows at the end.
    Not empty unless the table is, whatever repeats. Its last column, ``_rank``, begins with 1.
    """
    group = [F.col(within)] if within else [F.lit(0).alias("_all")]
    rows = df.select(*columns, *([] if within else group), F.xxhash64(F.lit(3), *columns).alias("_h"))
    by = within or "_all"
    totals = F.broadcast(rows.groupBy(by).agg(F.count("*").alias("_n"), F.min("_h").alias("_least")))  # a row for each value
    share = F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(4.0 * n) / F.col("_n"))
    near = rows.join(totals, by).where((F.abs(F.col("_h").cast("double")) <= share) | (F.col("_h") == F.col("_least"))).select(*dict.fromkeys([*columns, by]), "_h")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", *columns))
    return near.distinct().withColumn("_rank", rank).where(F.col("_rank") <= n).select(*columns, "_rank")
