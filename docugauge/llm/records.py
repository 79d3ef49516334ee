"""Token ids as length-delimited binary records, with an offset index for reads in any order.

A file is a run of records in ascending document order, FILE_BYTES of them or one longer record. Files
follow each other by the two numbers in their names: that of the task, and that of the file in the task
after ``-c``. A record:

    8 bytes   length of the body, little-endian
    4 bytes   masked checksum of those 8 bytes
    body      1 byte: bit 0 set if the id is null, bit 1 set if ids take 4 bytes and not 2; 8 bytes: the id;
              then the ids, little-endian
    4 bytes   masked checksum of the body
    1 byte    0x0A

A masked checksum is the CRC-32 of the bytes, rotated right by 15 bits, plus 0xA282EAD8, modulo 2**32.
The index has a row per record, made by walking the files: file, offset and bytes of the record, id,
ids before it in all files, number of ids and their CRC-32 as 4-byte integers.

Files are written and read by Spark's own sinks and sources, so they live in any store that Spark
reaches. Documents are sorted by range, so that no task holds more than its share.

Null texts are empty; an empty text is a record of the end id alone. Null ids come first. Repeated rows
and ids are records of their own, in the order of the hashes of their texts. No rows: no records. Texts
may be of any length that a row of the table has. Texts that hold an added token of the tokenizer, such
as ``<|endoftext|>``, get its id there, as the library gives it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docugauge.llm import scan
from docugauge.llm.frames import discard, row_order, stored
from docugauge.llm.parts import PartEncoder

TOKENIZER, END = "byte_bpe_50k.json", 0
#: Bytes of a file, unless one record is longer.
FILE_BYTES = 16 << 20


def masked(data: bytes) -> bytes:
    c = zlib.crc32(data)
    return ((((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def record(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """A record; ids in 4 or 2 bytes each."""
    body = bytes([(doc_id is None) | wide << 1]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids
    head = len(body).to_bytes(8, "little")
    return b"".join((head, masked(head), body, masked(body), b"\n"))


def parse(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """The id and the token ids of the record at an offset, and the next offset. ValueError if it is damaged."""
    head = bytes(data[at : at + 8])
    size = int.from_bytes(head, "little")
    end = at + 12 + size
    if data[at + 8 : at + 12] != masked(head) or end + 5 > len(data):
        raise ValueError(f"damaged length at {at}")
    body = data[at + 12 : end]
    if data[end : end + 4] != masked(body) or data[end + 4] != 0x0A:
        raise ValueError(f"damaged record at {at}")
    ids = np.frombuffer(body[9:], dtype="<u4" if body[0] & 2 else "<u2").astype("<u4")
    return None if body[0] & 1 else int.from_bytes(body[1:9], "little", signed=True), ids, end + 5


class Encoder(PartEncoder):
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.wide = library.get_vocab_size() > 1 << 16
        added = list(library.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized and library.normalizer is not None for t in added):
            raise ValueError("added tokens that look at their neighbours can't be cut out of a text")
        super().__init__("<u4" if self.wide else "<u2", lambda new: [x.ids for x in library.encode_batch_fast(new, add_special_tokens=False)], whole=[t.content for t in added])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Encodes and writes all documents, in ascending order, the end id after each."""
    where = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(where)
        last = end.to_bytes(4 if own.wide else 2, "little")
        held: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["frame"])  # the sink ends the row

        for batch in batches:
            for part in scan.slices(batch.column(1)):
                ids, ends = own.encode(part)
                data, ends = ids.tobytes(), (ends * own.kind.itemsize).tolist()
                names = batch.column(0).slice(part.first, part.rows).to_pylist()
                for i, a, b in zip(names, ends, ends[1:]):
                    frame = record(i, data[a:b] + last, own.wide)
                    if held and size + len(frame) > file_bytes:
                        yield file()
                        held, size = [], 0
                    held.append(frame)
                    size += len(frame)
        if held:
            yield file()

    order, digest = row_order(doc_id).alias("o"), F.xxhash64(text).alias("h")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), order, digest)
    rows = rows.repartitionByRange("o", "h").sortWithinPartitions("o", "h").select("id", "text")
    # A row is a file. The text sink writes the bytes of a string as they are, and the separator after each.
    rows.mapInArrow(scan.tidy(run), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row per record: file, offset, bytes, doc_id, ids before it in the file, n_tokens, the ids' CRC-32, and the ids if asked for.

    Every checksum is compared; a damaged file fails the read.
    """
    schema = "file string, offset long, bytes long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that has encoded before needs its parts no more
        scan.release()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data, at, before, rows = memoryview(content.as_buffer()).cast("B"), 0, 0, []
                while at < len(data):
                    doc, found, to = parse(data, at)
                    rows.append((name.as_py(), at, to - at, doc, before, len(found), zlib.crc32(found.tobytes())) + ((found.astype(np.int32),) if ids else ()))
                    at, before = to, before + len(found)
                    if len(rows) >= 4096 or at >= len(data):
                        types = [pa.string(), *[pa.int64()] * 6] + [pa.list_(pa.int32())] * ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])
                        rows = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0), "content").mapInArrow(scan.tidy(run), schema)


def with_starts(records: DataFrame) -> DataFrame:
    """records with start: ids of all records before, in this file and those before it by both numbers of the names.

    Sums run over the files of each task, and over the tasks: neither is more than the tasks' share of the files.
    """
    part, c = (F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"part-(\d+)", r"-c(\d+)"))
    files = records.groupBy("file").agg(F.sum("n_tokens").alias("in_file")).withColumns({"part": part, "c": c})
    before = lambda window: F.coalesce(F.sum("in_file").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("part").agg(F.sum("in_file").alias("in_file")).withColumn("base", before(Window.orderBy("part"))).drop("in_file")
    base = files.withColumn("own", before(Window.partitionBy("part").orderBy("c"))).join(tasks, "part").select("file", (F.col("own") + F.col("base")).alias("base"))
    return records.join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def write_index(records: DataFrame, path: str) -> None:
    """The offset index, apart from the files, which are read once."""
    held = stored(records, "index")
    with_starts(held).select("doc_id", "file", "offset", "bytes", "start", "n_tokens", "ids_crc32").write.parquet(path)
    discard(held)


def at_offset(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of a file on a local or mounted disk, by its index row: what a training loop reads in its own order."""
    with open(path, "rb") as f:
        f.seek(offset)
        head = f.read(12)
        data = memoryview(head + f.read(int.from_bytes(head[:8], "little") + 5))
    return parse(data, 0)[:2]
