"""Alignment of two tokenizers over a corpus: groups that end at the same byte, links between overlapping tokens, counts of linked ids.

Texts are shuffled whole, so that every distinct one is tokenised and aligned once, with the number of its copies as its weight. A
task writes its texts' links as packed id pairs, and for every chunk of texts the distinct pairs with their weights. Totals are summed
over chunks; a chunk then gets the totals of its own pairs back, never the whole table, and measures its texts by them. The measures
return to the documents by a SHA-256 of the text.

A is a byte-level BPE file of `tokenizers` and sees a space and the text; B is a BPE model of `sentencepiece`, which adds that space
itself. Neither merges across a space that follows a visible character, so what stands between two such spaces is encoded and aligned
once while a worker remembers it, and a text's result is put together from its parts. The tests compare with whole texts.

Rows and ties: texts that are null, empty, or not given back byte for byte by A or B have no tokens, count zero everywhere and have '' for
their digest. Pairs that tie for the highest count of a B id are all best. Rows that repeat, ids too, keep a row each; a null id is
passed on. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, stored
from .memory import remembered
from .tokens import tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of text of one chunk, about; one longer text is a chunk of its own
CHUNK_BYTES = 8 << 20
#: parts a worker remembers, and the longest it does, in characters
_MEMORY, _PART = 250_000, 40
#: a space behind a visible character; the last four are in doubt as white space or stand for a space in B
_CUT = re.compile(r" (?<=[^\s\u180e\u200b\ufeff\u2581] )")
_SPACE = "\u2581"
_MEASURES = "n_a long, n_b long, n_groups long, n_links long"
_ENCODED = f"chunk string, digest binary, {_MEASURES}, groups_sha256 string, groups string, links binary, pairs array<long>, counts array<long>"


def byte_letters() -> dict[str, int]:
    """The letters byte-level files write bytes with: printable ones stand for themselves, the rest for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Tokens of A and B of a text, their common groups and links, part by part."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(c in letters for c in entry):
                self.bytes_a[number] = bytes(letters[c] for c in entry)
        self.bytes_b = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            self.bytes_b.append(
                bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(_SPACE, " ").encode())
        self.space_b = [self.b.piece_to_id(_SPACE)]
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.shift = pair_bits(len(self.bytes_b))
        self.packed = "I" if pair_bits(len(self.bytes_a)) + self.shift <= 32 else "Q"
        self.known: dict[str, tuple | None] = {}

    def align(self, a: list[int], b: list[int], want: bytes) -> tuple | None:
        """(tokens of A, tokens of B, groups, packed links, groups as text), or None if the tokens don't give ``want``."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != want or b"".join(parts_b) != want:
            return None
        # both cut the same bytes, so every stretch between two cuts of either is one link
        sizes_a, sizes_b, names, shift = self.sizes_a, self.sizes_b, self.names, self.shift
        links, groups = [], []
        i, j, from_a, from_b = 0, 0, 0, 0
        end_a, end_b, last = sizes_a[a[0]], sizes_b[b[0]], len(a)
        while True:
            links.append(a[i] << shift | b[j])
            if end_a < end_b:
                i += 1
                end_a += sizes_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += sizes_b[b[j]]
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join([names[k] for k in a[from_a:i]])}|{','.join([names[k] for k in b[from_b:j]])}")
                if i == last:
                    break
                from_a, from_b = i, j
                end_a += sizes_a[a[i]]
                end_b += sizes_b[b[j]]
        return last, len(b), len(groups), array(self.packed, links).tobytes(), ";".join(groups)

    def _ask(self, parts: Iterable[str]) -> dict[str, tuple | None]:
        parts = list(parts)
        got_a = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        got_b = self.b.encode(parts, num_threads=1)
        return {p: self.align(a.ids, b if p else self.space_b, b" " + p.encode()) for p, a, b in zip(parts, got_a, got_b)}

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """What :meth:`align` says of each whole text."""
        cut = [_CUT.split(t) for t in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        missing = {p for parts, got in zip(cut, found) if None in got for p, g in zip(parts, got) if g is None}
        fresh = self._ask(missing) if missing else {}
        out = []
        for text, parts, got in zip(texts, cut, found):
            if missing and None in got:
                got = [fresh[p] if g is None else g for p, g in zip(parts, got)]
            if not text or None in got:
                out.append(None)
                continue
            out.append((
                sum([g[0] for g in got]), sum([g[1] for g in got]), sum([g[2] for g in got]),
                b"".join([g[3] for g in got]), ";".join([g[4] for g in got])))
        # the parts met first are the frequent ones: once the memory is full it stays as it is
        if len(self.known) < _MEMORY:
            self.known.update((p, g) for p, g in fresh.items() if len(p) <= _PART)
        return out


def pair_bits(pieces: int) -> int:
    """Bits that an id below ``pieces`` takes; a packed pair holds the id of B in its lowest ones."""
    return max(1, (pieces - 1).bit_length())


def _aligner(path_a: str, path_b: str) -> Aligner:
    known = remembered("aligners")
    if (path_a, path_b) not in known:
        known[path_a, path_b] = Aligner(path_a, path_b)
    return known[path_a, path_b]


def _weighed(links: list[bytes], copies: list[int], packed: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a chunk and how many links have them, copies counted."""
    keys = np.frombuffer(b"".join(links), dtype=packed)
    if all(c == 1 for c in copies):
        return np.unique(keys, return_counts=True)
    weights = np.repeat(np.array(copies, dtype=np.int64), [len(b) // array(packed).itemsize for b in links])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _encoder(path_a: str, path_b: str, chunk_bytes: int, keep_groups: bool, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        task = TaskContext.get().partitionId()
        chunk, held, links, copies = 0, 0, [], []
        size = array(aligner.packed).itemsize

        def emit(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def totals() -> pa.RecordBatch:
            pairs, counts = _weighed(links, copies, aligner.packed)
            return emit([{"chunk": f"{task}-{chunk}", "pairs": pairs.astype(np.int64), "counts": counts.astype(np.int64)}])

        for part in slices(batches):
            texts = part.column("text").to_pylist()
            rows = []
            for text, digest, n, got in zip(
                    texts, part.column("digest").to_pylist(), part.column("copies").to_pylist(), aligner.texts(texts)):
                if got is None:
                    rows.append({"chunk": "", "digest": digest, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0,
                                 "groups_sha256": "", "groups": "", "links": b""})
                    continue
                rows.append({
                    "chunk": f"{task}-{chunk}", "digest": digest, "n_a": got[0], "n_b": got[1], "n_groups": got[2],
                    "n_links": len(got[3]) // size, "groups_sha256": hashlib.sha256(got[4].encode()).hexdigest(),
                    "groups": got[4] if keep_groups else None, "links": got[3]})
                links.append(got[3])
                copies.append(n)
                held += len(text)
            yield emit(rows)
            if held >= chunk_bytes:
                yield totals()
                chunk, held = chunk + 1, 0
                links.clear()
                copies.clear()
        if links:
            yield totals()

    return encode


def _measurer(schema: pa.Schema):
    def measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = answers.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs = pairs[order]
        counts, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n_best, count_sum = [], []
        for links, n in zip(texts.column("links"), texts.column("n_links").to_pylist()):
            packed = links.as_buffer()
            at = np.searchsorted(pairs, np.frombuffer(packed, dtype=f"<u{packed.size // n}").astype(np.int64))
            n_best.append(int(best[at].sum()))
            count_sum.append(int(counts[at].sum()))
        kept = texts.drop_columns(["chunk", "links"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).cast(schema)

    return measure


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def encoded(docs: DataFrame, text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
            chunk_bytes: int = CHUNK_BYTES, keep_groups: bool = False) -> DataFrame:
    """One row per distinct text, stored: its measures, packed links and, if asked for, the groups as text; and one row per chunk
    with its distinct pairs and their weights (there ``digest`` is null)."""
    ready(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text <> ''")
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select("text", "copies", text_digest(F.col("text")).alias("digest"))
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in _ENCODED.split(", "))])
    encode = _encoder(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B), chunk_bytes, keep_groups, schema)
    return stored(distinct.mapInArrow(encode, _ENCODED), "align-encoded")


def pair_counts(rows: DataFrame, pieces: int) -> DataFrame:
    """``pair, count, best`` of all links of :func:`encoded` rows: how many hold the pair, and if no pair of its B id has more."""
    each = rows.where("digest IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = stored(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count")), "align-totals")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << pair_bits(pieces)) - 1))
    most = totals.groupBy(id_b.alias("id_b")).agg(F.max("count").alias("most"))
    found = totals.withColumn("id_b", id_b).join(most, "id_b")
    return stored(found.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-pairs")


def pieces_of(path_b: str | None = None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b or tokenizer_path(TOKENIZER_B)).get_piece_size()


def measures(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct texts of :func:`encoded` with ``n_best`` and ``count_sum``."""
    asked = rows.where("digest IS NULL").select(F.col("chunk").alias("part"), F.explode("pairs").alias("pair"))
    answers = asked.join(pairs, "pair").select("part", "pair", "count", "best")
    columns = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    texts = rows.where("n_links > 0").select("chunk", *columns, "links")
    out = f"digest binary, {_MEASURES}, groups_sha256 string, n_best long, count_sum long"
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in out.split(", "))])
    return stored(texts.groupBy("chunk").cogroup(answers.groupBy("part")).applyInArrow(_measurer(schema), out), "align-measures")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = encoded(docs, text_col, path_a, path_b, chunk_bytes)
    found = measures(rows, pair_counts(rows, pieces_of(path_b)))
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(text != "", text_digest(text)).alias("digest"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    zeros = [F.lit(0).cast("long").alias(c) for c in numbers]
    without = slim.where("digest IS NULL").select("doc_id", *zeros, F.lit("").alias("groups_sha256"))
    joined = slim.where("digest IS NOT NULL").join(found, "digest", "left")
    return joined.select(
        "doc_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")).unionByName(without)
