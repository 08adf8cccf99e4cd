"""Token ids as files of independent zstandard frames with a trailing seek table.

File: one frame a document (ids as little-endian unsigned integers, content size and checksum in the frame), then a skippable
frame with the documents' ids (64-bit) and flags of null ids, then the seek table: a skippable frame of (compressed size, size,
checksum) per frame and the footer of the seekable format. A reader fetches the tail, then only the frames it wants.

Rows and ties: a null text is empty and has the end id alone. Documents are written in ascending id (nulls first); repeated ids
keep all their rows, in the order of their texts. An empty table writes no file and reads back no row. Other columns are ignored.
A task that runs twice writes the same name again through a temporary one, so lost executors leave whole files only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, shared_folder, slices, stored
from .tokens import encoder, tokenizer_path

# fixed values of the zstandard seekable format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
INDEX_MAGIC = 0x184D2A50

STAT_SCHEMA = "shard int, path string, docs long, tokens long, bytes long"
ROW_SCHEMA = "shard int, position long, doc_id long, n_tokens long, ids binary"


def _filesystem(path: str):
    """File system of a folder all executors share, by its URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class FrameWriter:
    """Writes one file; knows its seek table at the end."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.stream, self.entries, self.ids, self.size = stream, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self._packer.compress(ids)
        self.stream.write(frame)
        self.size += len(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64(ids).intdigest() & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        flags = bytes(i is None for i in self.ids)
        index = np.array([0 if i is None else i for i in self.ids], dtype="<i8").tobytes() + flags
        table = np.array(self.entries, dtype="<u4").tobytes()
        foot = struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        tail = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        tail += struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot
        self.stream.write(tail)
        self.size += len(tail)
        self.stream.close()


class FrameReader:
    """Random access to one file: the tail is read once, a frame only when asked for."""

    def __init__(self, path: str):
        import zstandard

        files, place = _filesystem(path)
        self._file = files.open_input_file(place)
        size = self._file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"no seek table in {path}")
        table_at = size - 9 - 12 * count
        self.entries = np.frombuffer(self._at(table_at, 12 * count), dtype="<u4").reshape(count, 3)
        index_at = table_at - 8 - 9 * count
        self.ids = np.frombuffer(self._at(index_at, 8 * count), dtype="<i8")
        self.null = np.frombuffer(self._at(index_at + 8 * count, count), dtype=np.uint8).astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])
        self._unpacker = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self._file.seek(int(place))
        return self._file.read(int(size))

    def frame(self, k: int) -> bytes:
        """Ids of document ``k`` of this file; both checksums are compared."""
        import xxhash

        packed, size, check = (int(x) for x in self.entries[k])
        ids = self._unpacker.decompress(self._at(self.offsets[k], packed), max_output_size=size)
        if len(ids) != size or xxhash.xxh64(ids).intdigest() & 0xFFFFFFFF != check:
            raise ValueError("damaged frame")
        return ids

    def close(self) -> None:
        self._file.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    level: int = 3,
) -> DataFrame:
    """Encode and write all documents; returns one row per file, already stored: ``shard, path, docs, tokens, bytes``.

    The ids are range-partitioned by sampled splitters, so files follow each other in ascending id and no task holds
    more than its range; rows stream through a task and only a slice of them is in memory.
    """
    ready(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, base = _filesystem(folder)
        name = f"{base}/shard-{shard:06d}.zst"
        words, out, tokens, part = None, None, 0, f"{name}.{uuid.uuid4().hex}.part"
        for rows in slices(batches):
            if not rows.num_rows:
                continue
            if out is None:
                files.create_dir(base, recursive=True)
                words = encoder(tokenizer)
                out = FrameWriter(files.open_output_stream(part, compression=None), level)
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), words.encode(rows.column("text").to_pylist(), end_id)):
                out.add(doc_id, ids)
                tokens += len(ids) // words.dtype.itemsize
        if out is not None:
            out.close()
            files.move(part, name)
            row = (shard, f"{folder}/shard-{shard:06d}.zst", len(out.entries), tokens, out.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["shard", "path", "docs", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    return stored(placed.mapInArrow(write, STAT_SCHEMA), "token-shards")


def read_tokens(spark: SparkSession, shards: DataFrame, item_bytes: int, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of the written files: ``shard, position, doc_id, n_tokens, ids`` (bytes as written).

    ``wanted`` (one column of ids) names the documents to fetch; the tails of all files are read, and of the frames
    only those named. Without it all frames are read, one at a time.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("wanted").to_pylist() if "wanted" in batch.schema.names else [None] * batch.num_rows
            for shard, path, some in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), keys):
                reader = FrameReader(path)
                picks = range(len(reader.ids))
                if some is not None:
                    picks = np.flatnonzero(np.isin(reader.ids, np.array(some, dtype=np.int64)) & ~reader.null)
                rows, held = [], 0
                for k in picks:
                    ids = reader.frame(k)
                    rows.append((shard, int(k), None if reader.null[k] else int(reader.ids[k]), len(ids) // item_bytes, ids))
                    held += len(ids)
                    if held > 1 << 22:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)
                reader.close()

    ready(spark)
    source = shards.select("shard", "path")
    if wanted is not None:
        # a file gets the wanted ids of its range only; the lists are cut so that none grows with the request
        key = wanted.select(F.col(wanted.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
        spans = read_spans(spark, shards)
        source = key.join(F.broadcast(spans), (F.col("id") >= F.col("low")) & (F.col("id") <= F.col("high")))
        source = source.groupBy("shard", "path", F.pmod(F.xxhash64("id"), F.lit(16))).agg(F.collect_list("id").alias("wanted"))
        return source.select("shard", "path", "wanted").repartitionByRange(max(shards.count(), 1), "shard").mapInArrow(fetch, ROW_SCHEMA)
    # a row is a path, but its task reads a file: one task a file, however small the rows are
    return source.repartitionByRange(max(shards.count(), 1), "shard").mapInArrow(fetch, ROW_SCHEMA)


def read_spans(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Smallest and largest id of each file, from the files' tails (one row a file)."""

    def spans(batches):
        for batch in batches:
            rows = []
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                reader = FrameReader(path)
                ids = reader.ids[~reader.null]
                if len(ids):
                    rows.append((shard, path, int(ids.min()), int(ids.max())))
                reader.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "low", "high"), r)) for r in rows], schema=pa.schema(
                [("shard", pa.int32()), ("path", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))

    return shards.select("shard", "path").mapInArrow(spans, "shard int, path string, low long, high long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shard", "position", "doc_id", "n_tokens", "ids"])


def with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before each row.

    Files follow each other by number, so a running sum over the files' totals (one row a file) and one inside each
    file give it; a file is one task's range and has no hot key.
    """
    before = shards.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def crc_of_ids(ids: bytes, dtype: str = "<u2") -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype=dtype).astype("<u4").tobytes())


def token_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode, write, read back: ``doc_id, start, n_tokens, ids_crc32`` per document, from the files."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    dtype = encoder(tokenizer).dtype
    folder = shared_folder(spark, "token-frames")
    shards = write_tokens(docs, folder, tokenizer, end_id)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [crc_of_ids(x, dtype.str) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("shard", "position", "doc_id", "n_tokens")] + [pa.array(crc, pa.int64())],
                names=["shard", "position", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, shards, dtype.itemsize).mapInArrow(
        digest, "shard int, position long, doc_id long, n_tokens long, ids_crc32 long")
    return with_starts(rows, shards).select("doc_id", "start", "n_tokens", "ids_crc32")
