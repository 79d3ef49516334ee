"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.llm import decontaminate
from docugauge.llm.frames import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words in windows of benchmark items, the items, and whether it is contaminated."""
    out, (n_words, _, items, n_hit, bad) = decontaminate.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", n_words, n_hit, F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), bad)


QUERIES["op4_decontaminate"] = op4_decontaminate

ORACLE_SQL["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, and digests of the ids and of what they decode to."""
    from docugauge.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES["op7_byte_bpe"] = op7_byte_bpe


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as binary records with their index, and returns per document what the files hold."""
    from docugauge.llm import records
    from docugauge.llm.frames import shared_path

    path = shared_path(spark, "records")
    records.write(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{path}/data")
    records.write_index(records.read(spark, f"{path}/data"), f"{path}/index")
    return spark.read.parquet(f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES["op5_token_records"] = op5_token_records


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, writes them anew with revisits for equal payloads, and returns what those hold."""
    from docugauge.llm import warc
    from docugauge.llm.frames import shared_path

    path = shared_path(spark, "warc")
    warc.write_responses(table(spark, sf_dir, "pages"), f"{path}/crawl")
    warc.deduplicate(spark, f"{path}/crawl", f"{path}/unique", min_bytes=0)
    return warc.read(spark, f"{path}/unique").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op1_warc_revisits"] = op1_warc_revisits

ORACLE_SQL["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50, against all others."""
    from docugauge.llm import topk

    vecs = table(spark, sf_dir, "embeddings")
    return topk.top_k(vecs, vecs.where("vec_id % 50 = 0"), 5, scale=256)


QUERIES["op6_exact_topk"] = op6_exact_topk

ORACLE_SQL["op6_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its set's size, the smallest id that links reach, and whether it is that."""
    from docugauge.llm import neardup

    found = neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
    known = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return found.select(known("o").alias("doc_id"), F.col("n").alias("n_shingles"), known("root").alias("component_id"), (F.col("o") == F.col("root")).alias("kept"))


QUERIES["op10_near_duplicates"] = op10_near_duplicates

ORACLE_SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words that go because a 20-word window covers them that starts earlier, and a digest of the others."""
    from docugauge.llm import debruijn

    out, (n_words, n_removed, left) = debruijn.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", n_words, n_removed, left)


QUERIES["op3_substring_dedup"] = op3_substring_dedup

ORACLE_SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM e),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, tokens that training documents hold, the base score and the lattice score."""
    from docugauge.llm import lm_score

    return lm_score.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op8_lattice_score"] = op8_lattice_score


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: language, probability, what the markup declares, and whether the page is accepted."""
    from docugauge.llm import langid

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", langid.declared_language(F.col("html")).alias("declared"))
    model = langid.fitted(table(spark, sf_dir, "documents"))
    out, names = langid.identified(pages, model, text="html", declared=F.col("declared"), address=langid.address_language(F.col("url")), host=langid.host(F.col("url")), html=True, keep_text=False)
    return out.select("page_id", "declared", *names)


QUERIES["op9_language_id"] = op9_language_id


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: paragraphs, those predicted to be licences, those that a template confirms, and the confirmed families."""
    from docugauge.llm import license_scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scanned(docs, license_scan.fitted(docs))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return out.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_paragraphs"), F.size("licences").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.coalesce(F.array_max(F.transform("licences", lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )


QUERIES["op2_license_scan"] = op2_license_scan
