"""Packs documents into windows by lexical neighbours from a sharded BM25 inverted index.

Shards: documents are range-partitioned by their rarest token id (then doc_id, so a token shared by a third of all rows
is still cut into even ranges) and each shard indexes up to ``shard_docs`` documents of its range. Document frequencies and
the mean length are counted over all documents. A seed document opens a window; the shard's index returns its best unused
neighbours, which fill the window greedily; the last one is cut where the window ends, and its rest stays in the index.
What is left at the end of a shard goes on as candidates of the next one; the last rest of a task is cut into windows whose
lengths are powers of two, which need no padding.

Rows and ties: a null text is empty and has the end id alone. Equal scores go to the smaller (key, doc_id, text order). Rows that
repeat an id are packed each on its own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, stored
from .tokens import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
QUERY_TERMS = 24
#: words a worker remembers while it encodes, about 210 MB; its rows are small, so there is room
WORDS = 1_000_000
K1, B = 1.2, 0.75


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, key, ids`` per document; key is its largest token id, which is the one merged last and so rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, WORDS)
        for rows in slices(batches):
            ids = words.encode(rows.column("text").to_pylist(), end_id)
            arrays = [np.frombuffer(x, dtype=words.dtype) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64()),
                 pa.array([int(a.max()) for a in arrays], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n", "key", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, key long, ids binary")


def document_frequency(tokens: DataFrame, vocab: int, dtype: np.dtype) -> tuple[np.ndarray, float, int]:
    """Documents holding each token id, mean length and number of documents: one array of the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last, place = np.zeros(vocab, dtype=np.int64), np.zeros(vocab, dtype=np.int64), np.arange(1 << 12)
        docs = total = 0
        for b in batches:
            for ids in b.column("ids").to_pylist():
                got = np.frombuffer(ids, dtype=dtype)
                if len(got) > len(place):
                    place = np.arange(2 * len(got))
                at = place[: len(got)]
                last[got] = at  # one place of each id stays, so each is counted once, without a sort
                df[got[last[got] == at]] += 1
                total += len(got)
                docs += 1
        seen = np.flatnonzero(df)
        terms = np.concatenate([seen, [-1, -2]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.int64()), pa.array(np.concatenate([df[seen], [docs, total]]), pa.int64())], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(vocab, dtype=np.int64)
    docs = total = 0
    for r in rows:  # at most one row per token id
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
        elif r["term"] == -1:
            docs = r["n"]
        else:
            total = r["n"]
    return df, (total / docs if docs else 1.0), docs


class Shard:
    """BM25 inverted index over up to ``shard_docs`` documents, as postings sorted by term."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, weights = [], [], []
        for k, ids in enumerate(texts):
            term, tf = np.unique(ids, return_counts=True)
            norm = K1 * (1 - B + B * len(ids) / mean)
            terms.append(term.astype(np.int64))
            owners.append(np.full(len(term), k))
            weights.append(idf[term] * tf * (K1 + 1) / (tf + norm))
        self.query = [t[np.argsort(-w, kind="stable")[:QUERY_TERMS]] for t, w in zip(terms, weights)]
        term, owner, weight = np.concatenate(terms), np.concatenate(owners), np.concatenate(weights)
        order = np.argsort(term, kind="stable")
        self.term, self.owner, self.weight = term[order], owner[order], weight[order]
        self.size = len(texts)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents of the shard that share a query term with ``seed``, best first, ties by position."""
        low = np.searchsorted(self.term, self.query[seed], side="left")
        high = np.searchsorted(self.term, self.query[seed], side="right")
        spans = [slice(a, b) for a, b in zip(low, high)]
        owner = np.concatenate([self.owner[s] for s in spans])
        score = np.bincount(owner, weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.size)
        score[seed] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(texts: list[np.ndarray], lengths: np.ndarray, starts: np.ndarray, idf: np.ndarray, mean: float, window: int):
    """Windows of one shard as lists of (document, start, length), and the rests as (document, start, length)."""
    left, at = lengths.astype(np.int64).copy(), starts.astype(np.int64).copy()
    done: list[list[tuple[int, int, int]]] = []
    for k in np.flatnonzero(left >= window):  # whole windows of one document need no neighbour
        whole = int(left[k] // window)
        done += [[(int(k), int(at[k] + j * window), window)] for j in range(whole)]
        at[k] += whole * window
        left[k] -= whole * window
    if int(left.sum()) < window:
        return done, [(int(k), int(at[k]), int(left[k])) for k in np.flatnonzero(left)]
    index, order, next_seed, total = Shard(texts, idf, mean), np.arange(len(texts)), 0, int(left.sum())
    while total >= window:
        while left[order[next_seed]] == 0:
            next_seed += 1
        seed = int(order[next_seed])
        parts, room = [(seed, int(at[seed]), int(left[seed]))], window - int(left[seed])
        total -= int(left[seed])
        left[seed] = 0
        near = index.neighbours(seed)
        near = np.concatenate([near, np.setdiff1d(np.flatnonzero(left), near, assume_unique=True)])
        near = near[left[near] > 0]
        sizes = left[near]
        fill = np.cumsum(sizes)
        for k in near[: int(np.searchsorted(fill, room, side="left")) + 1]:
            take = min(int(left[k]), room)
            if take == 0:
                break
            parts.append((int(k), int(at[k]), take))
            at[k] += take
            left[k] -= take
            room -= take
            total -= take
        done.append(parts)
    return done, [(int(k), int(at[k]), int(left[k])) for k in np.flatnonzero(left)]


def powers(total: int) -> list[int]:
    """``total`` as a sum of falling powers of two."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def pack(
    docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, shard_docs: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    ready(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    words = encoder(path)
    vocab, dtype = words.tokenizer.get_vocab_size(), words.dtype
    tokens = stored(encoded(docs, path, end_id, id_col, text_col), "packing-tokens")
    df, mean, count = document_frequency(tokens, vocab, dtype)
    idf = np.log1p((count - df + 0.5) / (df + 0.5))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (doc_id, ids, start, length) of the shard that is being gathered
        fresh = 0

        def emit(windows, rows):
            nonlocal sequence
            out = []
            for parts in windows:
                offset = 0
                for k, start, length in parts:
                    doc_id, ids = rows[k][0], rows[k][1]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    out.append((doc_id, start, length, crc, len(ids), (part << 40) | sequence, offset))
                    offset += length
                sequence += 1
            return _pieces(out) if out else None

        def shard(rows, last):
            windows, rest = pack_shard(
                [r[1][r[2] :] for r in rows], np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), idf, mean, window)
            if last and rest:
                for size in powers(sum(r[2] for r in rest)):
                    parts = []
                    while size:
                        k, start, length = rest.pop(0)
                        take = min(size, length)
                        parts.append((k, start, take))
                        size -= take
                        if take < length:
                            rest.insert(0, (k, start + take, length - take))
                    windows.append(parts)
            return emit(windows, rows), [(rows[k][0], rows[k][1], start, length) for k, start, length in rest]

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, dtype=dtype)
                held.append((doc_id, ids, 0, len(ids)))
                fresh += len(ids)
                if len(held) >= shard_docs or fresh > 2048 * shard_docs:
                    out, held = shard(held, last=False)
                    fresh = 0
                    if out is not None:
                        yield out
        if held:
            out, _ = shard(held, last=True)
            if out is not None:
                yield out

    placed = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return placed.select("doc_id", "ids").mapInArrow(fill, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
