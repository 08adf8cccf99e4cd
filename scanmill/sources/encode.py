"""Raster files from image lines: PFM, NPY, and PNG of 8 or 16 bits."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.session import pin, ship_package
from scanmill.sources.files import open_filesystem

Encoder = Callable[[np.ndarray], bytes]  # (height, width, channels) -> bytes


def encode_pfm(image: np.ndarray) -> bytes:
    """Portable float map in little-endian order; one or three channels."""
    height, width, channels = image.shape
    if channels not in (1, 3):
        raise ValueError(f"a PFM has one or three channels, not {channels}")
    head = f"{'PF' if channels == 3 else 'Pf'}\n{width} {height}\n-1.0\n".encode()
    return head + np.ascontiguousarray(image[::-1], dtype="<f4").tobytes()


def encode_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image[:, :, 0] if image.shape[2] == 1 else image))
    return out.getvalue()


def encode_png(image: np.ndarray, bits: int = 8, filters: Sequence[int] = (4,)) -> bytes:
    """PNG of whole numbers; the row filters are taken in turn."""
    height, width, channels = image.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}.get(channels)
    if color is None or bits not in (8, 16):
        raise ValueError(f"a PNG has one to four channels of 8 or 16 bits, not {channels} of {bits}")
    if image.min(initial=0) < 0 or image.max(initial=0) >= 1 << bits:
        raise ValueError(f"values do not fit {bits} bits")
    step = channels * bits // 8
    grid = np.zeros((height + 1, width + 1, step), np.int16)
    stored = np.ascontiguousarray(image, dtype=">u2" if bits == 16 else "u1")
    grid[1:, 1:] = stored.view("u1").reshape(height, width, step)
    here, left, up, corner = grid[1:, 1:], grid[1:, :-1], grid[:-1, 1:], grid[:-1, :-1]
    to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    guesses = (np.zeros_like(here), left, up, (left + up) >> 1, nearest)
    kinds = np.resize(np.array(filters, np.uint8), height)
    lines = np.zeros((height, 1 + width * step), np.uint8)
    lines[:, 0] = kinds
    for kind in set(kinds.tolist()):
        picked = kinds == kind
        lines[picked, 1:] = ((here - guesses[kind])[picked] & 255).reshape(int(picked.sum()), width * step)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_files(lines: DataFrame, folder: str, encoder: Encoder, name: str = "name", col: str = "vals") -> DataFrame:
    """One file per image below ``folder``; returns ``path, bytes``.

    ``lines`` has the column ``name`` (path below the folder) beside ``ch, y, h, w`` and the values; its images are told apart by it. A
    task holds one image. A file gets its name when it is whole, so a task that runs twice leaves one whole file.
    """
    ship_package(lines.sparkSession)

    def write(image: pd.DataFrame) -> pd.DataFrame:
        filesystem, base = open_filesystem(folder)
        pixels = np.full((image["h"].max(), image["w"].max(), image["ch"].max() + 1), np.nan)
        for ch, y, vals in zip(image["ch"], image["y"], image["vals"]):
            pixels[y, :, ch] = vals
        if np.isnan(pixels).any() and len(image) != pixels.shape[0] * pixels.shape[2]:
            raise ValueError(f"{image['name'].iloc[0]}: lines are missing")
        data = encoder(pixels)
        target = f"{base}/{image['name'].iloc[0]}"
        filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
        draft = f"{target}.{uuid.uuid4().hex}.part"
        with filesystem.open_output_stream(draft) as out:
            out.write(data)
        filesystem.move(draft, target)
        return pd.DataFrame({"path": [target], "bytes": [len(data)]})

    slim = lines.select(F.col(name).alias("name"), "ch", "y", "h", "w", F.col(col).alias("vals"))
    return pin(slim.groupBy("name").applyInPandas(write, "path string, bytes long"))
