"""``spark.read.format("raster")``: PFM, NPY and PNG files as image lines, and the same decoding for paths in a column.

Files are packed into partitions by their size, so a million small ones do not become a million tasks and a large one has a task of its own.
Filters on ``path`` are applied to the listing, before any file is opened. A schema without ``vals`` reads headers only. A file that
cannot be decoded is one row with ``error``; the others go on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from scanmill.session import ship_package
from scanmill.sources.files import list_sizes, open_filesystem, read_file
from scanmill.sources.rasters import LINES_SCHEMA, decode_npy, decode_pfm, decode_png

DECODERS = {"pfm": decode_pfm, "npy": decode_npy, "png": decode_png}
PARTITION_BYTES = 32 << 20
_HEAD = 4096
_LINES = 256  # lines of one Arrow batch
_TYPES = {
    "path": pa.string(), "ch": pa.int32(), "y": pa.int32(), "h": pa.int32(), "w": pa.int32(),
    "vals": pa.list_(pa.float64()), "error": pa.string(),
}


def decoder_of(path: str):
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in DECODERS:
        raise ValueError(f"no decoder for .{kind} files")
    return DECODERS[kind]


def head_shape(path: str, head: bytes) -> tuple[int, int, int]:
    """Height, width and channels from the first bytes of a file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "png":
        if head[:8] != b"\x89PNG\r\n\x1a\n" or len(head) < 26:
            raise ValueError("not a PNG file")
        width, height, _, color = struct.unpack(">IIBB", head[16:26])
        return height, width, {0: 1, 2: 3, 4: 2, 6: 4}[color]
    if kind == "pfm":
        magic, size = head.split(b"\n", 2)[:2]
        if magic.rstrip() not in (b"PF", b"Pf"):
            raise ValueError("not a PFM file")
        width, height = map(int, size.split())
        return height, width, 3 if magic.rstrip() == b"PF" else 1
    if kind == "npy":
        import io

        stream = io.BytesIO(head)
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape = read(stream)[0]
        if len(shape) not in (2, 3):
            raise ValueError(f"expected an image, got {len(shape)} axes")
        return shape[0], shape[1], shape[2] if len(shape) == 3 else 1
    raise ValueError(f"no decoder for .{kind} files")


def line_batches(path: str, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The lines of one file, with the columns asked for only."""
    schema = pa.schema([(c, _TYPES[c]) for c in columns])
    try:
        if "vals" in columns:
            image = decoder_of(path)(read_file(path))
            shape = image.shape
        else:
            filesystem, found = open_filesystem(path)
            with filesystem.open_input_stream(found) as stream:
                shape = head_shape(path, stream.read(_HEAD))
    except Exception as exc:  # one bad file must not end the job
        row = {"path": path, "error": str(exc) or type(exc).__name__}
        yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in columns}], schema=schema)
        return
    height, width, channels = shape
    for ch in range(channels):
        for start in range(0, height, _LINES):
            n = min(_LINES, height - start)
            made = {
                "path": lambda: pa.array([path] * n, pa.string()),
                "ch": lambda: pa.array(np.full(n, ch, np.int32)),
                "y": lambda: pa.array(np.arange(start, start + n, dtype=np.int32)),
                "h": lambda: pa.array(np.full(n, height, np.int32)),
                "w": lambda: pa.array(np.full(n, width, np.int32)),
                "vals": lambda: pa.ListArray.from_arrays(
                    np.arange(n + 1, dtype=np.int32) * width, image[start : start + n, :, ch].astype(np.float64).reshape(-1)),
                "error": lambda: pa.nulls(n, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in columns], schema=schema)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class RasterReader(DataSourceReader):
    def __init__(self, columns: Sequence[str], options):
        unknown = [c for c in columns if c not in _TYPES]
        if unknown:
            raise ValueError(f"a raster has no columns {unknown}")
        self.columns = list(columns)
        self.glob = options["path"]
        self.room = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, path: str) -> bool:
        tests = {
            EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value),
            StringEndsWith: lambda f: path.endswith(f.value), StringContains: lambda f: f.value in path,
        }
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        out, paths, held = [], [], 0
        for path, size in list_sizes(self.glob):
            if not self._keeps(path):
                continue
            if paths and held + size > self.room:
                out.append(_Files(paths))
                paths, held = [], 0
            paths.append(path)
            held += size
        # a source without partitions would be read once with none
        return out + [_Files(paths)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            yield from line_batches(path, self.columns)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(schema.fieldNames(), self.options)


def read_rasters(spark: SparkSession, path: str, columns: Sequence[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Lines of the files a glob matches or a folder holds; with ``columns`` nothing else is decoded."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    kinds = dict(part.split(" ") for part in LINES_SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (columns or kinds))
    return spark.read.format("raster").schema(schema).option("partitionBytes", str(partition_bytes)).load(path)


def decode_paths(listing: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Lines of the files named in a column, each with the keys of its row: ``*keys, ch, y, h, w, vals, error``.

    Samples thus come to lines without a join, and no path passes through the driver. A null path is an error row.
    """
    ship_package(listing.sparkSession)
    columns = ["ch", "y", "h", "w", "vals", "error"]
    slim = listing.select(*keys, listing[path].alias("__path"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, file in enumerate(batch.column("__path").to_pylist()):
                if file is None:
                    rows = [{"error": "no path"}]
                    found = [pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, _TYPES[c]) for c in columns]))]
                else:
                    found = line_batches(file, columns)
                for part in found:
                    own = [batch.column(k).take(pa.array([at] * part.num_rows)) for k in keys]
                    yield pa.RecordBatch.from_arrays(own + part.columns, names=[*keys, *columns])

    kinds = dict(part.split(" ") for part in LINES_SCHEMA.split(", "))
    schema = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(decode, schema + ", " + ", ".join(f"{c} {kinds[c]}" for c in columns))
