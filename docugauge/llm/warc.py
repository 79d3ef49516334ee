"""WARC archives: writing, reading, and resolving equal payloads into revisit records.

Archives are gzip files of WARC/1.1 records, written by Spark's text sink (the two line ends after a
record are its separator) and read as binary files, so they live in any store that Spark reaches.

``deduplicate`` reads the headers of all records, shuffles them by payload digest, and finds for each
digest the record that stays: the one with the largest id, which every other record of that digest
then refers to. Only headers meet by digest, and only the pre-aggregated one of each digest is joined
back, so a digest that a third of all records share is no more work for a task than another. What each
archive's revisits refer to is brought to the archive as it is, compressed; then each record is written
anew with fresh headers: responses with their payload, revisits without. Archives are inflated in pieces,
so a worker holds a compressed archive and its longest record, and an archive is no more than FILE_RECORDS
records of what one task has read.

Null payloads are empty. A null id sorts below all others and is written as ``null``. Repeated rows and
ids are records of their own; of equal ones, the one that is last in the archives stays. A null address
leaves out its header; white space and control characters in it are percent-encoded. An empty table
makes no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docugauge.llm import scan
from docugauge.llm.frames import discard, row_order, stored

# Fixed values of the formats.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, URN = "\r\n\r\n", "urn:x-page:"
#: Records of a file, and the date of records that have none of their own.
FILE_RECORDS, DATE = 5_000, "1970-01-01T00:00:00Z"

_FIELDS = (("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()))
HEADERS = "file string, offset long, record_type string, page_id long, uri string, payload_digest string, payload_bytes long, refers_to long"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 160 bits in hexadecimal: 8 times 4 letters of 5 bits."""

    def letters(i: int) -> list[Column]:
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def _record(kind: Column, page_id: Column, uri: Column, digest: Column, size: Column, payload: Column, refers_to: Column, date: str) -> Column:
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = kind == "revisit"
    coded = uri
    for c in [*range(0x21), 0x7F]:
        coded = F.replace(coded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    safe = F.when(uri.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(uri)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn(page_id)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", safe), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(refers_to)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body,
    )


def write_responses(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, file_records: int = FILE_RECORDS) -> None:
    """A response record per row."""
    held = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    held = held.withColumn("hex", F.sha1(F.col("p").cast("binary"))).withColumn("digest", base32(F.col("hex")))
    _write(held.select(_record(F.lit("response"), F.col("i"), F.col("u"), F.col("digest"), F.octet_length("p"), F.col("p"), F.lit(None), date)), path, file_records)


def _write(records: DataFrame, path: str, file_records: int) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record, with its payload as a string if asked for. Lengths and digests of payloads must hold; a damaged archive fails the read."""
    fields = [*_FIELDS, ("payload", pa.binary())] if payload else [*_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from _batches(walk(name.as_py(), inflated(content.as_buffer())), fields)

    found = _archives(spark, path).mapInArrow(scan.tidy(run), HEADERS + (", payload binary" if payload else ""))
    return found.withColumn("payload", F.col("payload").cast("string")) if payload else found


def _batches(records: Iterator[tuple], fields: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of some MB; a record's last column is its payload."""
    rows, held = [], 0
    for row in records:
        rows.append(row[: len(fields)])
        held += len(row[-1] or b"") if len(fields) == len(row) else 0
        if held > 4 << 20 or len(rows) >= 2048:
            yield _batch(rows, fields)
            rows, held = [], 0
    if rows:
        yield _batch(rows, fields)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    data, stream, fed = memoryview(data), zlib.decompressobj(31), False
    for at in range(0, len(data), 1 << 16):
        part = data[at : at + (1 << 16)]
        while len(part):
            fed = True
            yield stream.decompress(part, piece)
            part = stream.unconsumed_tail
            if stream.eof:
                part, stream, fed = stream.unused_data, zlib.decompressobj(31), False
    while fed and not stream.eof and (left := stream.decompress(b"", piece)):
        yield left
    if fed and not stream.eof:
        raise ValueError("a gzip file that ends too early")


class _Stream:
    """Bytes that come in pieces, taken from the front; ``place`` is how many were taken."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at, self.place = iter(pieces), bytearray(), 0, 0

    def _more(self) -> bool:
        for piece in self.pieces:
            if piece:
                del self.held[: self.at]
                self.at = 0
                self.held += piece
                return True
        return False

    def ended(self) -> bool:
        return self.at == len(self.held) and not self._more()

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError("ends within a record")
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at += n
        self.place += n
        return out

    def take_until(self, end: bytes) -> bytes:
        """What comes before an end, which is taken too."""
        seen = 0
        while (found := self.held.find(end, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(end))
            if not self._more():
                raise ValueError("ends within a header")
        return self.take(found - self.at + len(end))[: -len(end)]


def walk(name: str, pieces: Iterator[bytes], compare: bool = True) -> Iterator[tuple]:
    """The records of one archive's bytes. compare: payloads with their digests."""
    stream, end = _Stream(pieces), END.encode()
    while not stream.ended():
        at = stream.place
        head = dict(x.split(": ", 1) for x in stream.take_until(end).decode().split("\r\n")[1:])
        length, begin = int(head["Content-Length"]), stream.place
        size = int(stream.take_until(end).decode().rpartition("Content-Length: ")[2])
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        rest = stream.take(length - (stream.place - begin))
        body = rest if kind != "revisit" else None
        if stream.take(len(end)) != end or body is not None and (len(body) != size or compare and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
            raise ValueError(f"damaged record at {at} of {name}")
        yield name, at, kind, _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), digest, size, _id(head["WARC-Refers-To"]) if kind == "revisit" else None, body


def _id(urn: str) -> int | None:
    found = urn[len(URN) + 1 : -1]
    return None if found == "null" else int(found)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers with record_type and refers_to as they must become."""
    place = F.struct(row_order("page_id").alias("o"), "file", "offset")
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(place).alias("stays"), F.max_by("page_id", place).alias("stays_id"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").drop("n"), "digests")  # a table, so that Spark may split a large digest in the join
    joined = headers.drop("record_type", "refers_to").join(groups, "payload_digest", "left")
    revisits = F.col("stays").isNotNull() & (F.col("payload_bytes") >= min_bytes) & (place != F.col("stays"))
    return joined.select("file", "offset", "page_id", "uri", "payload_digest", "payload_bytes", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("stays_id")).alias("refers_to"))


def deduplicate(spark: SparkSession, source: str, target: str, *, min_bytes: int = 0, date: str = DATE, file_records: int = FILE_RECORDS) -> None:
    """Writes the archives of source anew to target, equal payloads once."""
    headers = stored(read(spark, source), "headers")
    revisits = resolve(headers, min_bytes).where("record_type = 'revisit'").groupBy("file").agg(F.collect_list(F.struct("offset", "refers_to")).alias("revisits"))
    fields = [*_FIELDS, ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, found in zip(*batch.columns):
                to = {r["offset"]: r["refers_to"] for r in found.as_py() or ()}
                # digests were compared when the headers were read
                anew = ((f, at, *(("revisit", i, u, d, n, to[at], None) if at in to else ("response", i, u, d, n, None, body))) for f, at, _, i, u, d, n, _, body in walk(name.as_py(), inflated(content.as_buffer()), compare=False))
                yield from _batches(anew, fields)

    rows = _archives(spark, source).join(revisits, "file", "left").mapInArrow(scan.tidy(run), HEADERS + ", payload binary").withColumn("payload", F.col("payload").cast("string"))
    _write(rows.select(_record(F.col("record_type"), F.col("page_id"), F.col("uri"), F.col("payload_digest"), F.col("payload_bytes"), F.col("payload"), F.col("refers_to"), date)), target, file_records)
    discard(headers)
