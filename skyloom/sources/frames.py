"""FITS and XISF frames as DataFrames, read through Spark's binaryFile source so that any file system works.

``read_frames`` gives a row per band of rows (``BAND_ROWS``) and channel with the pixels packed as
little-endian float32; ``read_headers`` gives a row per file. ``write_fits`` makes one FITS file.
"""

from __future__ import annotations

import math
import os
import re
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARD, BLOCK, BAND_ROWS = 80, 2880, 256
PATTERN = "*.{fit,fits,fts,xisf,FIT,FITS,FTS,XISF}"
#: FITS cards that describe the array itself, and comment cards.
STRUCTURAL = ("SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "EXTEND", "BSCALE", "BZERO", "END", "COMMENT", "HISTORY", "XTENSION", "PCOUNT", "GCOUNT")
#: XISF sample formats as numpy types.
SAMPLES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}


def parse_cards(raw: bytes) -> tuple[dict[str, str], int]:
    """Header values as text, and the bytes that the header fills."""
    header, at = {}, 0
    while at + CARD <= len(raw):
        card = raw[at : at + CARD].decode("latin-1")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            break
        if card[8:10] == "= " and key not in header:
            value = card[10:]
            text = re.match(r"\s*'((?:[^']|'')*)'", value)
            header[key] = text.group(1).replace("''", "'").rstrip() if text else value.split("/")[0].strip()
    return header, -(-at // BLOCK) * BLOCK


def parse_fits(raw: bytes) -> tuple[np.ndarray | None, dict[str, str]]:
    """The first array of two or more axes and its header."""
    at, first = 0, {}
    while at < len(raw):
        header, size = parse_cards(raw[at:])
        first = first or header
        axes = [int(header.get(f"NAXIS{k + 1}", 0)) for k in range(int(header.get("NAXIS", 0)))]
        bits = int(header.get("BITPIX", 8))
        count = math.prod(axes) if axes else 0
        start = at + size
        if len(axes) >= 2 and count:
            kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bits]
            data = np.frombuffer(raw, kind, count, start).reshape(axes[::-1]).astype(np.float64 if abs(bits) == 64 else np.float32)
            return data * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0)), first | header
        at = start + -(-count * abs(bits) // 8 // BLOCK) * BLOCK
    return None, first


def parse_xisf(raw: bytes) -> tuple[np.ndarray | None, dict[str, str]]:
    """Image 0 and the first value of each FITS keyword."""
    if raw[:8] != b"XISF0100":
        return None, {}
    size = int.from_bytes(raw[8:12], "little")
    root = ET.fromstring(raw[16 : 16 + size].rstrip(b"\0"))
    image = next((e for e in root.iter() if e.tag.endswith("Image")), None)
    if image is None:
        return None, {}
    header: dict[str, str] = {}
    for e in image.iter():
        if e.tag.endswith("FITSKeyword"):
            header.setdefault(e.get("name", ""), e.get("value", "").strip().strip("'").strip())
    where = image.get("location", "").split(":")
    if where[0] != "attachment":
        return None, header
    part = raw[int(where[1]) : int(where[1]) + int(where[2])]
    packed = image.get("compression", "").split(":")
    if packed[0].startswith("zlib"):
        part = zlib.decompress(part)
    elif packed[0]:
        raise ValueError(f"compression {packed[0]} is not supported")
    width, height, channels = (*map(int, image.get("geometry", "0:0:1").split(":")), 1)[:3]
    return np.frombuffer(part, SAMPLES[image.get("sampleFormat", "UInt16")], width * height * channels).reshape(channels, height, width).astype(np.float32), header


def layout(data: np.ndarray) -> np.ndarray:
    """Any two or three axes as (channels, height, width) float32 with one or three channels; what is not
    finite becomes 0."""
    data = np.asarray(data)
    while data.ndim > 3:
        data = data[0]
    if data.ndim == 2:
        data = data[None]
    elif data.shape[0] not in (1, 3) and data.shape[2] in (1, 3, 4):
        data = np.moveaxis(data, 2, 0)
    if data.shape[0] not in (1, 3):
        data = data[:3] if data.shape[0] > 3 else data[:1]
    data = data.astype(np.float32)
    return np.where(np.isfinite(data), data, 0).astype(np.float32)


def parse(path: str, raw: bytes) -> tuple[np.ndarray | None, dict[str, str]]:
    data, header = parse_xisf(raw) if path.lower().endswith(".xisf") else parse_fits(raw)
    return None if data is None else layout(data), header


def files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Files of our formats under a folder, or those listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", str(recursive).lower()).load(path)


def listing(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, size, changed) of the files, contents unread."""
    return files(spark, path, recursive).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def read_headers(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, header map, channels, height, width), a row a file, in the order of their names."""

    def run(frames):
        for pdf in frames:
            out = [(p, *_summary(p, raw)) for p, raw in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(out, columns=["path", "header", "channels", "height", "width"])

    return files(spark, path, recursive).select("path", "content").mapInPandas(run, "path string, header map<string,string>, channels int, height int, width int").orderBy("path")


def _summary(path: str, raw: bytes) -> tuple:
    header, shape = (xisf_header if path.lower().endswith(".xisf") else fits_header)(raw)
    return (header, *laid_out(shape))


def fits_header(raw: bytes) -> tuple[dict[str, str], tuple[int, ...]]:
    """Header and axes of the first array, from the cards alone."""
    at, first = 0, {}
    while at < len(raw):
        header, size = parse_cards(raw[at:])
        first = first or header
        axes = [int(header.get(f"NAXIS{k + 1}", 0)) for k in range(int(header.get("NAXIS", 0)))]
        if len(axes) >= 2 and math.prod(axes):
            return first | header, tuple(axes[::-1])
        at += size + -(-(math.prod(axes) if axes else 0) * abs(int(header.get("BITPIX", 8))) // 8 // BLOCK) * BLOCK
    return first, ()


def xisf_header(raw: bytes) -> tuple[dict[str, str], tuple[int, ...]]:
    if raw[:8] != b"XISF0100":
        return {}, ()
    root = ET.fromstring(raw[16 : 16 + int.from_bytes(raw[8:12], "little")].rstrip(b"\0"))
    image = next((e for e in root.iter() if e.tag.endswith("Image")), None)
    if image is None:
        return {}, ()
    header: dict[str, str] = {}
    for e in image.iter():
        if e.tag.endswith("FITSKeyword"):
            header.setdefault(e.get("name", ""), e.get("value", "").strip().strip("'").strip())
    width, height, channels = (*map(int, image.get("geometry", "0:0:1").split(":")), 1)[:3]
    return header, (channels, height, width)


def laid_out(shape: tuple[int, ...]) -> tuple[int, int, int]:
    """Channels, height and width that ``layout`` gives an array of this shape."""
    if len(shape) < 2:
        return 0, 0, 0
    c, h, w = shape[-3:] if len(shape) > 2 else (1, *shape)
    if c not in (1, 3) and w in (1, 3, 4):
        c, h, w = w, c, h
    return c if c in (1, 3) else 3 if c > 3 else 1, h, w


def read_frames(spark: SparkSession, path: str, recursive: bool = False, band_rows: int = BAND_ROWS) -> DataFrame:
    """(path, c, band, row_start, n_rows, width, data binary)."""

    def run(frames):
        for pdf in frames:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                data, _ = parse(p, raw)
                if data is None:
                    continue
                rows = [(p, c, y // band_rows, y, min(band_rows, data.shape[1] - y), data.shape[2], data[c, y : y + band_rows].astype("<f4").tobytes()) for c in range(data.shape[0]) for y in range(0, data.shape[1], band_rows)]
                yield pd.DataFrame(rows, columns=["path", "c", "band", "row_start", "n_rows", "width", "data"])

    return files(spark, path, recursive).select("path", "content").mapInPandas(run, "path string, c int, band int, row_start int, n_rows int, width int, data binary")


def pixels(bands: DataFrame) -> DataFrame:
    """Bands as (path, c, y, x, v): for small images; real ones stay in bands."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, "<f4").astype(np.float64)
                yield pd.DataFrame({"path": r.path, "c": r.c, "y": r.row_start + np.arange(len(v)) // r.width, "x": np.arange(len(v)) % r.width, "v": v})

    return bands.mapInPandas(run, "path string, c int, y int, x int, v double")


def own_output(header: str = "header", software: str = "skyloom") -> F.Column:
    """Whether a header says that this engine wrote the file, or that it holds a map."""
    by_us = F.coalesce(F.lower(F.try_element_at(header, F.lit("SOFTWARE"))).startswith(software), F.lit(False))
    return by_us | F.map_contains_key(header, "MAPTYPE")


def light_frames(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Headers (see ``read_headers``) of the frames under ``path`` that are no results of ours."""
    return read_headers(spark, path, recursive).filter(~own_output())


def card(key: str, value, comment: str = "") -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value!r:>20}"
    else:
        text = "'" + str(value).replace("'", "''")[:66].ljust(8) + "'"
    return f"{key[:8]:<8}= {text}{f' / {comment}' if comment else ''}"[:CARD].ljust(CARD).encode("latin-1", "replace")


def fits_bytes(data: np.ndarray, header: dict | None = None, mark: bool = True) -> bytes:
    """A FITS file of float32, without the structural cards of ``header``; with ``mark`` a result of ours."""
    data = np.asarray(data, np.float32)
    data = data[0] if data.ndim == 3 and data.shape[0] == 1 else data
    cards = [card("SIMPLE", True), card("BITPIX", -32), card("NAXIS", data.ndim)]
    cards += [card(f"NAXIS{k + 1}", n) for k, n in enumerate(data.shape[::-1])]
    cards += [card(k, v) for k, v in (header or {}).items() if k not in STRUCTURAL] + [card("SOFTWARE", "skyloom")] * mark + [b"END".ljust(CARD)]
    head, body = b"".join(cards), data.astype(">f4").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK, b" ") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def write_fits(path: str, data: np.ndarray, header: dict | None = None, mark: bool = True) -> str:
    """Written under another name, flushed and renamed."""
    own = f"{path}.part"
    with open(own, "wb") as f:
        f.write(fits_bytes(data, header, mark))
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)
    return path
