"""Benchmark passages in documents, also paraphrased: latent semantic retrieval, then subsequence and answer checks.

1. Words (letters only, lower case) are hashed to ``2**BITS`` terms. Document frequencies are counted over all blocks of 32 words of all
   documents and summed per term, a table of fixed size. Every term has a positive weight.
2. The benchmark is dealt into blocks of about ``rank`` items, and the TF-IDF matrix of each gets a distributed randomised SVD: each
   task multiplies its rows with a random block, partial sums are added per term, and a second round sharpens the basis. A block's
   rank is the number of its different texts, so the basis spans all of them and no item loses weight in it.
3. Every document is read whole, as windows of two blocks that overlap by one. A window and an item are candidates if their cosine
   reaches ``least_cosine``, or if their product is half of what it is when one holds the other: copies of items that are far
   shorter or far longer than a window have a small cosine.
4. The words around a candidate are aligned with the item by longest common subsequence. It is a leak if the share of the item's
   words found in order reaches ``sure``, or reaches ``likely`` and the item's answer (column ``answer``, else its last
   sentence) is found in order too.

A pass over the documents searches the blocks of up to ``block_items`` items and about ``PASS_BYTES`` of bases, so what is sent to
the tasks has a bound that grows with neither table. Documents are not shuffled at all.

Rows and ties: null and empty texts match nothing, nor do items without a word. An item shorter than a window needs all its
words in it or beside it. Rows that repeat an id are searched each on its own; of several places of an item in a document the best
alignment counts, the first on ties. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import LETTER, Bytes
from .common import ready, slices, stored

BITS = 18
BLOCK = 32
#: bytes of latent places that one pass over the documents takes along; one larger block is a pass of its own
PASS_BYTES = 64 << 20
#: blocks of words whose terms' places are gathered at once
GATHERED = 64
LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, word_start int, word_stop int"
_SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")


def word_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, term and text number of all words."""
    b = Bytes(texts, lower=True)
    start, end, doc = b.words(LETTER)
    hashed = b.hash(start, end)
    return hashed, (hashed >> np.uint64(64 - BITS)).astype(np.int64), doc


def blocks_of(doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block number of every word, first block of every text, and the blocks' number."""
    words = np.bincount(doc, minlength=docs)
    blocks = -(-words // BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(len(doc)) - np.repeat(np.cumsum(words) - words, words)
    return first[doc] + within // BLOCK, first, blocks


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """log((blocks + 1) / (blocks with the term + 1)) + 0.05 for every term, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(1 << BITS, dtype=np.int64)
        for rows in slices(batches):
            _, term, doc = word_terms(rows.column("text"))
            block, _, blocks = blocks_of(doc, rows.num_rows)
            total += int(blocks.sum())
            df += np.bincount(np.unique((block << BITS) | term) & ((1 << BITS) - 1), minlength=1 << BITS)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], total), pa.int64())], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term int, n long")
    table = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most one row per term
    df, total = np.zeros(1 << BITS), 0
    for term, n in zip(table["term"], table["n"]):
        if term < 0:
            total = n
        else:
            df[term] = n
    return np.log((total + 1) / (df + 1)) + 0.05


def _tfidf(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the matrix's cells."""
    _, term, doc = word_terms(texts)
    cell, tf = np.unique((doc << BITS) | term, return_counts=True)
    term = cell & ((1 << BITS) - 1)
    return cell >> BITS, term, tf * idf[term]


def randomised_bases(
    items: DataFrame, idf: np.ndarray, ranks: dict[int, int], rounds: int = 2, seed: int = 7
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per block: terms in use and an orthonormal basis (terms x rank) of the leading right singular vectors of its items' matrix.

    Each round is one job for all blocks: tasks add up A'(A B) over their rows, by block and term; only sums reach the driver.
    """
    spark = items.sparkSession
    bases: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def start_of(term: np.ndarray, rank: int) -> np.ndarray:
        """Random rows that depend on the term alone, so every task draws the same ones."""
        column = np.arange(rank, dtype=np.uint64)
        x = term.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (column + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        return x.astype(np.float64) / 2.0**63 - 1.0

    for _ in range(rounds):
        known = spark.sparkContext.broadcast(bases)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in slices(batches):
                blocks = rows.column("block").to_numpy()
                for at in np.unique(blocks).tolist():
                    row, term, weight = _tfidf(rows.column("text").filter(pa.array(blocks == at)), idf)
                    if not len(row):
                        continue
                    if at in known.value:
                        right = known.value[at][1][np.searchsorted(known.value[at][0], term)]
                    else:
                        right = start_of(term, ranks[at])
                    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    product = np.add.reduceat(right * weight[:, None], edge, axis=0)
                    back = product[np.cumsum(np.append(False, row[1:] != row[:-1]))] * weight[:, None]
                    order = np.argsort(term, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
                    sums = np.add.reduceat(back[order], first, axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), at), pa.int32()), pa.array(term[order][first], pa.int32()),
                         pa.array([s.tobytes() for s in sums], pa.binary())], names=["block", "term", "sums"])

        def add(groups: pa.Table) -> pa.Table:
            term = groups.column("term").to_numpy()
            value = np.array([np.frombuffer(x) for x in groups.column("sums").to_pylist()])
            order = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
            sums = np.add.reduceat(value[order], first, axis=0)
            return pa.table({
                "block": groups.column("block").slice(0, len(first)), "term": pa.array(term[order][first], pa.int32()),
                "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

        parts = items.select("block", "text").mapInArrow(multiply, "block int, term int, sums binary")
        got = parts.groupBy("block", F.pmod("term", F.lit(64))).applyInArrow(add, "block int, term int, sums binary").collect()
        sums: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["block"], r["term"])):
            sums.setdefault(r["block"], []).append(r)
        bases = {
            at: (np.array([r["term"] for r in rows], dtype=np.int64), np.linalg.qr(np.array([np.frombuffer(r["sums"]) for r in rows]))[0])
            for at, rows in sums.items()}
    return bases


def randomised_basis(items: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms in use and basis of items that are one block."""
    bases = randomised_bases(items.withColumn("block", F.lit(0)), idf, {0: rank})
    return bases.get(0, (np.zeros(0, np.int64), np.zeros((0, 1))))


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list, idf: np.ndarray, terms: np.ndarray, basis: np.ndarray):
        texts = [r["text"] or "" for r in rows]
        self.ids = [r["item_id"] for r in rows]
        hashed, _, doc = word_terms(pa.array(texts, pa.string()))
        self.words = [hashed[doc == k] for k in range(len(rows))]
        self.vocabulary, number = np.unique(hashed, return_inverse=True)
        self.numbers = [number[doc == k] for k in range(len(rows))]  # the items' words, numbered
        self.answers = [self._answer(r) for r in rows]
        self.slot = np.full(1 << BITS, -1, dtype=np.int32)
        self.slot[terms] = np.arange(len(terms))
        self.idf = idf.astype(np.float32)
        self.latent = (basis * idf[terms][:, None]).astype(np.float32)  # one word's share of a window's place
        row, term, weight = _tfidf(pa.array(texts, pa.string()), idf)
        place = np.zeros((len(rows), basis.shape[1]))
        np.add.at(place, row, basis[np.searchsorted(terms, term)] * weight[:, None])
        length = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(rows)))
        self.length = length.astype(np.float32)
        self.place = (place / np.maximum(length, 1e-9)[:, None]).astype(np.float32)

    def places(self, term: np.ndarray, block: np.ndarray, total: int) -> np.ndarray:
        """Latent place of every block of words."""
        slot = self.slot[term]
        used = np.flatnonzero(slot >= 0)
        place = np.zeros((total, self.latent.shape[1]), dtype=np.float32)
        slot, block = slot[used], block[used]
        edges = np.flatnonzero(np.append(True, np.diff(block) != 0)) if len(used) else used
        for a in range(0, len(edges), GATHERED):  # the rows gathered at once stay in the processor's cache
            edge = edges[a : a + GATHERED]
            stop = edges[a + GATHERED] if a + GATHERED < len(edges) else len(used)
            place[block[edge]] = np.add.reduceat(self.latent[slot[edge[0] : stop]], edge - edge[0], axis=0)
        return place

    def number(self, hashed: np.ndarray) -> np.ndarray:
        """The words' numbers in the items' vocabulary; all others have the number behind the last."""
        at = np.searchsorted(self.vocabulary, hashed).clip(max=max(len(self.vocabulary) - 1, 0))
        met = self.vocabulary[at] == hashed if len(self.vocabulary) else np.zeros(len(hashed), dtype=bool)
        return np.where(met, at, len(self.vocabulary))

    @staticmethod
    def _answer(row) -> np.ndarray:
        text = row["answer"] if "answer" in row and row["answer"] else None
        if text is None:
            sentences = [s for s in _SENTENCE.findall(row["text"] or "") if len(s.split()) >= 3]
            text = sentences[-1] if sentences else (row["text"] or "")
        return word_terms(pa.array([text], pa.string()))[0]


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b`` (matches sorted, longest rising run)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    at: list[tuple] = []  # per length: (position in a, link to the shorter one)
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, at[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                at.append(node)
            else:
                tails[k] = j
                at[k] = node
    out, node = [], at[-1] if at else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _share(want: np.ndarray, have: np.ndarray) -> tuple[float, int, int]:
    """Share of ``want`` found in order in ``have``, and where the match begins and ends there."""
    at = common_subsequence(have.tolist(), want.tolist())
    return (len(at) / len(want), at[0], at[-1] + 1) if at else (0.0, 0, 0)


def search(docs: DataFrame, items: list[Items], least_cosine: float, likely: float, sure: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            hashed, term, doc = word_terms(rows.column("text"))
            if not len(doc):
                continue
            block, first, blocks = blocks_of(doc, rows.num_rows)
            total = int(blocks.sum())
            last = np.zeros(total, dtype=bool)
            last[(first + blocks - 1)[blocks > 0]] = True
            pair = np.where(last, np.arange(total), np.arange(total) + 1).clip(max=total - 1)
            length = np.bincount(block, weights=shared.value[0].idf[term] ** 2, minlength=total)
            length += np.where(last, 0, length[pair])
            length = np.sqrt(np.maximum(length, 1e-9))[:, None]
            starts = np.searchsorted(block, np.arange(total + 1))
            ends = np.append(np.searchsorted(doc, np.arange(rows.num_rows)), len(doc))
            best: dict[tuple[int, int, int], tuple] = {}
            for part, it in enumerate(shared.value):
                place = it.places(term, block, total)
                place += np.where(last[:, None], 0, place[pair])
                product = place @ it.place.T  # with the item's direction
                held = (product >= 0.5 * it.length) & (it.length > 0)
                holds = (product * it.length >= 0.5 * length**2) & ~last[:, None]
                window, item = np.nonzero((product >= least_cosine * length) | held | holds)
                owner = np.searchsorted(first + blocks, window, side="right")
                number = it.number(hashed) if len(window) else hashed
                there = np.zeros(len(it.vocabulary) + 1, dtype=bool)
                for w, k, d in zip(window.tolist(), item.tolist(), owner.tolist()):
                    want = it.words[k]
                    if not len(want):
                        continue
                    low = max(int(ends[d]), int(starts[w]) - len(want))
                    high = min(int(ends[d + 1]), int(starts[w]) + 2 * BLOCK + len(want))
                    there[number[low:high]] = True
                    met = np.count_nonzero(there[it.numbers[k]])
                    there[number[low:high]] = False
                    if met / len(want) < likely:  # no common subsequence is longer
                        continue
                    share, a, z = _share(want, hashed[low:high])
                    if share < likely:
                        continue
                    answer = len(it.answers[k]) > 0 and _share(it.answers[k], hashed[low:high])[0] >= 0.8
                    if share >= sure or answer:
                        cosine = float(product[w, k] / length[w, 0])
                        row = (share, -(low + a), cosine, answer, low + a - int(ends[d]), low + z - int(ends[d]))
                        best[d, part, k] = max(best.get((d, part, k), row), row)
            ids = rows.column("doc_id").to_pylist()
            out = [(ids[d], shared.value[part].ids[k], r[2], r[0], bool(r[3]), r[4], r[5]) for (d, part, k), r in sorted(best.items())]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer_found", "word_start", "word_stop"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, LEAKS)


def passes(sizes: list, block_items: int) -> Iterator[dict[int, int]]:
    """Blocks with their ranks, as many at a time as one pass over the documents takes along."""
    group, items, held = {}, 0, 0
    for r in sizes:
        rank = r["texts"] + 8  # a few more random directions than texts, so that all of them are met
        size = min(1 << BITS, r["chars"] // 6 + 1) * rank * 4
        if group and (items + r["items"] > block_items or held + size > PASS_BYTES):
            yield group
            group, items, held = {}, 0, 0
        group[r["block"]] = rank
        items, held = items + r["items"], held + size
    if group:
        yield group


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 192, least_cosine: float = 0.1, likely: float = 0.55, sure: float = 0.7,
    block_items: int = 2000,
) -> DataFrame:
    """One row per document and benchmark item found in it."""
    spark = docs.sparkSession
    ready(spark)
    columns = [F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    if "answer" in benchmark.columns:
        columns.append(F.col("answer").cast("string").alias("answer"))
    items = stored(benchmark.select(*columns).withColumn("block", F.lit(0)), "benchmark")
    count = items.count()
    full = min(rank, block_items)
    if count > full:  # blocks are three quarters full on average; one that gets more has a higher rank
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-4 * count // (3 * full)))).cast("int")
        items = stored(items.withColumn("block", block), "benchmark")
    found = spark.createDataFrame([], LEAKS)
    if not count:
        return found
    idf = inverse_frequency(docs)
    sizes = items.groupBy("block").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("text").alias("texts"), F.sum(F.length("text")).alias("chars"))
    for group in passes(sizes.orderBy("block").collect(), block_items):  # one row per block
        some = items.where(F.col("block").isin(list(group)))
        bases = randomised_bases(some, idf, group)
        rows: dict[int, list] = {}
        for r in sorted(some.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])):
            rows.setdefault(r["block"], []).append(r)
        if bases:
            found = found.unionByName(
                search(docs, [Items(rows[at], idf, *basis) for at, basis in sorted(bases.items())], least_cosine, likely, sure))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    found = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("__leak")), "left_anti")
