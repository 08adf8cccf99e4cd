"""Decode jobs: binary raster files to image lines.

Files are read by the ``binaryFile`` source and decoded inside tasks, one file
at a time; every line becomes a row, so nothing downstream holds a whole image.
A file that cannot be decoded yields one row with ``error`` set, and the job
goes on.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.paths import local_path
from scanmill.session import ship_package

LINES_SCHEMA = "path string, ch int, y int, h int, w int, vals array<double>, error string"
_CHUNK = 256  # lines handed to Arrow at a time

Decoder = Callable[[bytes], np.ndarray]  # bytes -> (height, width, channels)


def decode_pfm(data: bytes) -> np.ndarray:
    """Portable float map. The sign of the scale gives the byte order; rows run bottom up."""
    magic, size, scale, rest = _header_lines(data)
    channels = {b"PF": 3, b"Pf": 1}.get(magic.rstrip())
    if channels is None:
        raise ValueError("not a PFM file")
    match = re.fullmatch(rb"(\d+)\s(\d+)\s", size)
    if not match:
        raise ValueError("malformed PFM header")
    width, height = int(match[1]), int(match[2])
    order = "<" if float(scale) < 0 else ">"
    values = np.frombuffer(rest, dtype=order + "f4")
    return values.reshape(height, width, channels)[::-1]


def _header_lines(data: bytes) -> tuple[bytes, bytes, bytes, bytes]:
    ends, start = [], 0
    for _ in range(3):
        stop = data.find(b"\n", start)
        if stop < 0:
            # a first line that is not a header at all is reported by its magic
            return data[:2], b"", b"0", b""
        ends.append(data[start : stop + 1])
        start = stop + 1
    return ends[0], ends[1], ends[2], data[start:]


def decode_npy(data: bytes) -> np.ndarray:
    """Numpy array file with two axes, or three with channels last."""
    values = np.load(io.BytesIO(data), allow_pickle=False)
    if values.ndim not in (2, 3):
        raise ValueError(f"expected an image, got {values.ndim} axes")
    return values if values.ndim == 3 else values[:, :, None]


def decode_png(data: bytes) -> np.ndarray:
    """Gray or colour PNG of 8 or 16 bits, keeping both bytes of a sample."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, header = 8, [], None
    while at < len(data):
        (length,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    width, height, bits, color, _, _, interlaced = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if channels is None or bits not in (8, 16) or interlaced:
        raise ValueError(f"unsupported PNG: colour type {color}, {bits} bits, interlace {interlaced}")
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    rows = _unfilter(raw[:, 0], raw[:, 1:].reshape(height, width, step))
    samples = rows.view(">u2") if bits == 16 else rows
    return samples.reshape(height, width, channels)


def _unfilter(kinds: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Undo the PNG row filters of ``pixels`` (height, width, bytes of a pixel); bytes wrap around.

    Filters 3 and 4 need the left neighbour, so a line cannot be undone at once. A pixel needs its left, upper and corner neighbour
    only, all of earlier anti-diagonals: each anti-diagonal is one step for all its lines, height + width steps in all.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown PNG filter {kinds.max()}")
    height, width, step = pixels.shape
    if not (kinds > 2).any():
        out = np.zeros((height, width * step), np.uint8)
        above = np.zeros(width * step, np.uint8)
        for y, kind in enumerate(kinds.tolist()):
            line = pixels[y]
            if kind == 1:
                line = np.cumsum(line, axis=0, dtype=np.uint8)
            above = out[y] = line.reshape(-1) + above if kind == 2 else line.reshape(-1)
        return out
    # one line above and one column on the left are zero; walking down a line and back a column is a fixed stride
    grid = np.zeros((height + 1, width + 1, step), np.int16)
    grid[1:, 1:] = pixels
    flat, row = grid.reshape(-1, step), width + 1
    kinds = np.concatenate([[0], kinds])[:, None]
    of = [kinds == k for k in range(5)]
    for d in range(2, height + width + 1):
        low, high = max(1, d - width), min(height, d - 1)

        def at(shift: int) -> np.ndarray:
            first = d + low * width - shift
            return flat[first : first + (high - low) * width + 1 : width]

        left, up, corner = at(1), at(row), at(row + 1)
        to_left, to_up = np.abs(up - corner), np.abs(left - corner)
        to_corner = np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        lines = slice(low, high + 1)
        guess = of[1][lines] * left + of[2][lines] * up + of[3][lines] * ((left + up) >> 1) + of[4][lines] * nearest
        here = at(0)
        here += guess
        here &= 255
    return grid[1:, 1:].astype(np.uint8).reshape(height, width * step)


def _failed(path: str, error: str) -> pd.DataFrame:
    none = {c: [None] for c in ("ch", "y", "h", "w", "vals")}
    return pd.DataFrame({"path": [path], **none, "error": [error]}).astype({c: "Int32" for c in ("ch", "y", "h", "w")})


def _decode_files(decoder: Decoder) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(path: str, image: np.ndarray) -> Iterator[pd.DataFrame]:
        height, width, channels = image.shape
        for ch in range(channels):
            for start in range(0, height, _CHUNK):
                part = image[start : start + _CHUNK, :, ch].astype(np.float64)
                yield pd.DataFrame(
                    {
                        "path": path, "ch": ch, "y": range(start, start + len(part)),
                        "h": height, "w": width, "vals": list(part), "error": None,
                    }
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    image = decoder(content)
                except Exception as exc:  # one bad file must not end the job
                    yield _failed(path, str(exc) or type(exc).__name__)
                    continue
                yield from rows(path, image)

    return run


def read_lines(spark: SparkSession, paths: str | list[str], decoder: Decoder, pattern: str | None = None) -> DataFrame:
    """Decode the files under ``paths`` (globs allowed) to lines keyed by path."""
    ship_package(spark)
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths).select(local_path(F.col("path")).alias("path"), "content")
    return files.mapInPandas(_decode_files(decoder), LINES_SCHEMA)


def read_pfm(spark: SparkSession, paths) -> DataFrame:
    return read_lines(spark, paths, decode_pfm)


def read_npy(spark: SparkSession, paths) -> DataFrame:
    return read_lines(spark, paths, decode_npy)


def read_png16(spark: SparkSession, paths) -> DataFrame:
    """16-bit PNG; the built-in image source would keep only one byte of a sample."""
    return read_lines(spark, paths, decode_png)


def read_images(spark: SparkSession, paths, rgb: bool = True) -> DataFrame:
    """8-bit images by the built-in source, channels in RGB order or as stored (BGR)."""
    ship_package(spark)
    image = F.col("image")
    files = spark.read.format("image").load(paths).select(
        local_path(image["origin"]).alias("path"),
        image["height"].alias("h"), image["width"].alias("w"), image["nChannels"].alias("n"),
        image["data"].alias("data"),
    )

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, h, w, n, data in batch.itertuples(index=False):
                if h < 1 or w < 1 or n < 1:  # what the source gives for a file it cannot decode
                    yield _failed(path, "not an image")
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                # blue, green, red, then alpha if there is one
                order = [2, 1, 0, 3][:n] if rgb and n >= 3 else list(range(n))
                for out_ch, ch in enumerate(order):
                    for start in range(0, h, _CHUNK):
                        part = pixels[start : start + _CHUNK, :, ch].astype(np.float64)
                        yield pd.DataFrame(
                            {
                                "path": path, "ch": out_ch, "y": range(start, start + len(part)),
                                "h": h, "w": w, "vals": list(part), "error": None,
                            }
                        )

    return files.mapInPandas(unpack, LINES_SCHEMA)


def decode_errors(lines: DataFrame) -> DataFrame:
    return lines.filter("error IS NOT NULL").select("path", "error")


def decoded(lines: DataFrame) -> DataFrame:
    return lines.filter("error IS NULL").drop("error")
