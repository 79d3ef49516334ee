"""Image files as rasters and capture times, from their bytes alone: grey pages of PNG files, dates of PDF, TIFF and JPEG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docugauge.sources.manifests import capture_time

# Fixed values of the formats: the begin of a PNG file, samples of a pixel by colour type, tags of times, and bytes of a value by type.
PNG, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TIME, SUB, ORIGINAL = 306, 34665, 36867
#: Weights of red, green and blue in 65536ths.
GREY = np.array([19595, 38470, 7471], dtype=np.int64)


def _chunks(data: bytes):
    at = len(PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines without the differences that a PNG file stores; raw has the kind of difference first in each line."""
    kinds, lines = raw[:, 0], raw[:, 1:].astype(np.int64)
    before = np.zeros(lines.shape[1], dtype=np.int64)
    for kind, line in zip(kinds.tolist(), lines):
        if kind == 1:
            pixels = line.reshape(-1, step)
            line[:] = np.cumsum(pixels, axis=0).ravel()
        elif kind == 2:
            line += before
        elif kind in (3, 4):
            for at in range(0, len(line), step):
                here, up = slice(at, at + step), before[at : at + step]
                left = line[at - step : at] if at else np.zeros(step, dtype=np.int64)
                if kind == 3:
                    line[here] += (left + up) // 2
                else:
                    corner = before[at - step : at] if at else np.zeros(step, dtype=np.int64)
                    far = np.abs(np.stack((up - corner, left - corner, left + up - 2 * corner)))
                    line[here] += np.choose(far.argmin(axis=0), (left, up, corner))
                line[here] &= 255
        elif kind:
            raise ValueError("not a PNG file's line")
        line &= 255
        before = line
    return lines.astype(np.uint8)


def grey_png(data: bytes) -> np.ndarray | None:
    """The grey page of a PNG file of 8 bits a sample, transparent parts on paper; null if it isn't one, or is interlaced."""
    if not data.startswith(PNG):
        return None
    held = {b"IDAT": []}
    for kind, content in _chunks(data):
        held[b"IDAT"].append(content) if kind == b"IDAT" else held.setdefault(kind, content)
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", held[b"IHDR"])
    if depth != 8 or laced or colour not in SAMPLES:
        return None
    step = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(held[b"IDAT"])), dtype=np.uint8)[: height * (1 + width * step)]
    pixels = _unfiltered(raw.reshape(height, 1 + width * step), step).reshape(height, width, step).astype(np.int64)
    if colour == 3:
        pixels = np.frombuffer(held[b"PLTE"], dtype=np.uint8).reshape(-1, 3)[pixels[:, :, 0]].astype(np.int64)
    opaque = pixels[:, :, -1] if colour in (4, 6) else None
    grey = (pixels[:, :, :3] @ GREY + 0x8000) >> 16 if pixels.shape[2] >= 3 else pixels[:, :, 0]
    return (grey if opaque is None else (grey * opaque + 255 * (255 - opaque) + 127) // 255).astype(np.uint8)


def tagged_times(data: bytes) -> tuple[str | None, str | None]:
    """When a picture was taken, and what else its tags say: those of a TIFF file, or in a JPEG or PNG file.

    The former is the first table's original time; the latter its time of change, or failing that the sub-table's original time.
    """
    begin = 0 if data[:4] in (b"II*\0", b"MM\0*") else data.find(b"Exif\0\0") + 6 if b"Exif\0\0" in data[: 1 << 16] else -1
    if begin < 0 and data.startswith(PNG):
        data, begin = next(((c, 0) for k, c in _chunks(data) if k == b"eXIf"), (b"", -1))
    if begin < 0:
        return None, None
    tags = data[begin:]
    order = "<" if tags[:2] == b"II" else ">"

    def entries(at: int) -> dict[int, int]:
        if not 0 < at <= len(tags) - 2:
            return {}
        (n,) = struct.unpack_from(order + "H", tags, at)
        fields = [tags[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)]
        return {struct.unpack(order + "H", f[:2])[0]: struct.unpack(order + "I", f[8:])[0] for f in fields if len(f) == 12}

    def text(at: int | None) -> str | None:
        found = tags[at : at + 19].split(b"\0")[0].decode("ascii", "replace") if at else ""
        return found or None

    first = entries(struct.unpack_from(order + "I", tags, 4)[0]) if len(tags) >= 8 else {}
    return text(first.get(ORIGINAL)), text(first.get(TIME)) or text(entries(first.get(SUB, 0)).get(ORIGINAL))


@F.pandas_udf(T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("px", T.BinaryType())]))
def raster_of(content: pd.Series) -> pd.DataFrame:
    """The raster of a PNG file's bytes; its fields are null if there is none."""
    pages = [grey_png(c) if c is not None else None for c in content]
    return pd.DataFrame([(None, None, None) if p is None else (*p.shape, p.tobytes()) for p in pages], columns=["h", "w", "px"]).astype({"h": "Int32", "w": "Int32"})


@F.pandas_udf(T.StructType([T.StructField("original", T.StringType()), T.StructField("changed", T.StringType())]))
def times_of(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tagged_times(c) if c is not None else (None, None) for c in content], columns=["original", "changed"])


def pdf_date(content: Column) -> Column:
    """The creation date in a PDF file's bytes, as it is written; null if there is none."""
    found = F.regexp_extract(F.decode(content, "ISO-8859-1"), r"/CreationDate\s*\((D:[^)]*)\)", 1)
    return F.when((F.substring(content, 1, 4) == F.lit(b"%PDF")) & (found != ""), found)


def with_times(files: DataFrame) -> DataFrame:
    """Files (content, modificationTime, ...) with ``captured``: when each page was captured, by its own bytes or else the file's time."""
    tagged = files.withColumn("_tagged", times_of("content"))
    return tagged.withColumn("captured", capture_time(pdf_date(F.col("content")), F.col("_tagged.original"), F.col("_tagged.changed"), F.col("modificationTime"))).drop("_tagged")
