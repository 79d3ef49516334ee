"""The corpus pipeline: documents in, token ids of what is worth keeping out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps, with
the columns of documents, and the last one token ids. Each stage works on all that its predecessor kept,
and is written as Parquet and read again before the next. ``run`` applies them to the documents table.

1. language_id: the text and the source's smoothed prior are fused; documents whose language can't be told
   go. The column lang only teaches the model, on a bounded sample; it has no say on its own row.
2. near_duplicates: of documents linked at a similarity of 0.8 or more of their 5-word shingles, directly
   or through others, the one with the smallest id stays.
3. repeated_spans: words of 20-word windows that start earlier elsewhere go; documents that lose all go.
4. decontamination: documents of which a twentieth or more is in windows of benchmark items go.
5. byte_bpe: the texts that are left, as ids, with what they decode to compared.

Nulls are handled as each operator says; other columns stay, whatever their names, up to the last stage,
which returns doc_id, lang, source, n_tokens, ids and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.llm import bpe, debruijn, decontaminate, langid, neardup
from docugauge.llm.frames import stored, table

#: No SQL expresses the fused language evidence or the tokens; tests/llm/test_pipeline.py has a brute-force version of every stage.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fitted(docs)
    nothing = F.lit(None).cast("string")
    out, names = langid.identified(docs, model, text="text", declared=nothing, address=nothing, host=F.col("source"))
    return out.where(F.col(names[2])).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.unique_documents(docs, k=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, (n_words, n_removed, _) = debruijn.deduplicated(docs)
    left = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    shorter = F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", shorter).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.round_trips(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
