"""Repeated byte strings by a sparse distributed suffix array.

Every string of ``length`` bytes that occurs twice is found, wherever it starts. Not every suffix is shipped: of the ``length``
bytes behind a position, the ``chunk`` bytes with the smallest hash (the leftmost on ties) are the position's anchor. The anchor
depends on those bytes only, so equal strings have it at the same place. Positions that follow each other share an anchor; such a
run is one suffix to sort, led by its anchor's tokens, and holds all strings of the run.

1. Anchors whose bytes occur once in all documents are dropped: counted by hash, summed in every task before the shuffle.
2. Runs with equal bytes fall together by their digest. If all runs of an anchor are equal, they are repeated as a whole.
3. The others are range-partitioned by sampled splitters on their leading token (the anchor's hash). A bucket sorts the strings of
   its runs by a multikey quicksort over (anchor, place, fingerprint words) and compares neighbours. An anchor with more than
   ``hot_runs`` different runs is cut into even buckets by its runs' digests. Of those runs only the blocks of ``block`` places stay
   whose common bytes another run has too; each distinct string of such a block is then compared across the buckets' boundaries
   by a grouping over the fingerprints, to which a bucket gives it once.

A fingerprint is two 64-bit polynomials of the 400 bytes; neighbours that agree are compared byte by byte inside a bucket.

What repeats in fewer than ``length`` bytes is not removed but counted: :func:`passages` finds the strings of ``words`` words that
another document holds too, by anchors of a few words in the same way. Words are those between white space, compared as they are.

Rows and ties: null and empty texts, and texts shorter than ``length``, lose nothing. Rows that repeat an id are documents of their
own, and identical rows are copies of each other. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Bytes, mix
from .common import ready, slices, stored

ANCHORS = "id long, sha binary, anchor long, first int, last int, at int"
RUNS = "id long, sha binary, anchor long, digest binary, first int, last int, at int, run binary"
PASSAGES = "id long, sha binary, anchor long, strings int"
STRINGS = "sha binary, string long"
FOUND = "anchor long, digest binary, low int, high int, open boolean, h1 long, h2 long"
NO_ID = -(1 << 63)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the position of its smallest one, the leftmost on ties (block-wise prefix minima)."""
    n = len(values)
    bits = np.uint64(max(n - 1, 1).bit_length())
    packed = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = packed
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchor_runs(b: Bytes, length: int, chunk: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, first and last position and anchor position of every run, positions within the text."""
    total = len(b.data)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if total < length:
        return none
    at = np.arange(total - chunk + 1)
    hashed = b.hash(at, at + chunk)
    best = sliding_argmin(hashed, length - chunk + 1)
    room = b.sizes - length + 1  # number of strings of each text
    owner = np.repeat(np.arange(len(b.sizes)), np.maximum(room, 0))
    start = b.starts[owner] + _count_up(np.maximum(room, 0))
    if not len(start):
        return none
    place = best[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    text = owner[new]
    base = b.starts[text]
    return text, hashed[place[new]].view(np.int64), start[new] - base, start[last] - base, place[new] - base


def _count_up(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def word_strings(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, those across texts included."""
    step = np.uint64(0xA24BAED4963EE407)
    out = np.zeros(max(len(word_hash) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = out * step + word_hash[k : k + len(out)]
    return mix(out)


def word_anchors(b: Bytes, words: int, chunk: int) -> tuple[np.ndarray, ...]:
    """Text number, first word (counted over all texts) and anchor hash of every string of ``words`` words; and the words' hashes."""
    start, end, doc = b.words()
    hashed = b.hash(start, end)
    if len(start) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), hashed
    parts = word_strings(hashed, chunk)
    best = sliding_argmin(parts, words - chunk + 1)
    at = np.flatnonzero(doc[: len(best)] == doc[words - 1 :])
    return doc[at], at, parts[best[at]].view(np.int64), hashed


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first word, then each run of ties by the next one, and so on; and the ends of the runs tied in all words."""
    order = np.argsort(words[0], kind="stable")
    tied = np.zeros(len(order), dtype=bool)  # equal to the one before it so far
    tied[1:] = words[0][order][1:] == words[0][order][:-1]
    for word in words[1:]:
        part = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(part):
            break
        run = np.cumsum(~tied[part])
        sub = order[part]
        again = np.lexsort((word[sub], run))
        order[part] = sub = sub[again]
        value = word[sub]
        tied[part] &= np.concatenate([[False], value[1:] == value[:-1]])
    return order, tied


def compare_bucket(anchors: np.ndarray, digests: list[bytes], places: np.ndarray, runs: list[bytes], live: list, length: int, block: int):
    """Strings of a bucket that occur in more than one of its runs, as intervals of places; and of the runs with ``live`` blocks
    each distinct string of those blocks, with its run's digest if the bucket has it only there."""
    b = Bytes(pa.array(runs, pa.binary()))
    counts = b.sizes - length + 1
    owner = np.repeat(np.arange(len(runs)), counts)
    start = b.starts[owner] + _count_up(counts)
    h1, h2 = b.hash(start, start + length, 0), b.hash(start, start + length, 1)
    place = (start - b.starts[owner] - places[owner]).astype(np.int64)  # start of the string relative to its anchor
    order, tied = multikey_order([anchors[owner].view(np.uint64), place.view(np.uint64), h1, h2])
    for k in np.flatnonzero(tied):  # fingerprints agree: so must the bytes
        a, z = int(start[order[k - 1]]), int(start[order[k]])
        if b.data[a : a + length].tobytes() != b.data[z : z + length].tobytes():
            raise ArithmeticError("two strings share a 128-bit fingerprint")
    follows = np.append(tied[1:], False)
    hit = np.sort(order[tied | follows])
    rows = []
    if len(hit):
        edge = np.flatnonzero(np.append(True, (owner[hit][1:] != owner[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)))
        stop = np.append(edge[1:], len(hit)) - 1
        rows = [(int(anchors[owner[i]]), digests[owner[i]], int(place[i]), int(place[j]), False, 0, 0) for i, j in zip(hit[edge], hit[stop])]
    blocks = [k * (1 << 20) + x + (1 << 19) for k, some in enumerate(live) for x in some or ()]
    if blocks:
        first = ~tied
        alone = first & ~follows
        wanted = np.isin(owner[order] * (1 << 20) + place[order] // block + (1 << 19), blocks)
        # strings equal to a wanted one lie in the same block, which is live for them too
        rows += [
            (int(anchors[owner[i]]), digests[owner[i]] if lone else None, int(place[i]), int(place[i]), True, int(h1[i].view(np.int64)), int(h2[i].view(np.int64)))
            for i, lone in zip(order[first & wanted], alone[first & wanted])]
    return rows


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def covered(
    docs: DataFrame, length: int = 400, chunk: int = 128, bucket_runs: int = 4000, hot_runs: int = 1000, block: int = 32,
) -> DataFrame:
    """Byte spans of repeated strings: ``id, sha, start, stop``, one row per run, not merged."""
    ready(docs.sparkSession)

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            text, anchor, first, last, at = anchor_runs(Bytes(rows.column("text")), length, chunk)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id").take(pa.array(text)), rows.column("sha").take(pa.array(text)), pa.array(anchor, pa.int64()),
                 *(pa.array(x.astype(np.int32), pa.int32()) for x in (first, last, at))],
                names=["id", "sha", "anchor", "first", "last", "at"])

    anchors = stored(docs.mapInArrow(find_anchors, ANCHORS), "anchors")
    # stored, so that both sides of the join are plain shuffles, which AQE splits where an anchor is hot
    twice = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    wanted = anchors.join(twice, "anchor").groupBy("id", "sha").agg(
        F.collect_set(F.struct("anchor", "first", "last", "at")).alias("runs"))

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "sha", "anchor", "digest", "first", "last", "at", "run"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for part in slices(batches):
            out, held = [], 0
            for doc_id, sha, text, runs in zip(*(part.column(c).to_pylist() for c in ("id", "sha", "text", "runs"))):
                data = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    run = data[r["first"] : r["last"] + length]
                    out.append((doc_id, sha, r["anchor"], hashlib.blake2b(run, digest_size=16).digest(), r["first"], r["last"], r["at"], run))
                    held += len(run)
                    if held > 1 << 23:
                        yield _batch(out, names, kinds)
                        out, held = [], 0
            if out:
                yield _batch(out, names, kinds)

    runs = stored(docs.join(wanted, ["id", "sha"]).select("id", "sha", "text", "runs").mapInArrow(cut_runs, RUNS), "runs")
    kinds_of = stored(runs.groupBy("anchor").agg(F.min("digest").alias("least"), F.max("digest").alias("most")), "anchor-kinds")
    alike = kinds_of.where("least = most").select("anchor")
    mixed = kinds_of.where("least <> most").select("anchor")
    whole = runs.join(alike, "anchor").select("id", "sha", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    some = runs.select("anchor", "digest", "first", "at", "run").join(mixed, "anchor", "left_semi")
    place = (F.col("at") - F.col("first")).alias("place")
    some = some.select("anchor", "digest", place, "run").groupBy("anchor", "digest", "place", "run").agg(F.count(F.lit(1)).alias("n"))
    some = stored(some, "different-runs")
    most = F.octet_length("run") - length - F.col("place")  # last place of a run; the first is -place
    # a run that occurs twice is repeated as a whole
    inside = some.where("n > 1").select("anchor", "digest", (-F.col("place")).alias("low"), most.cast("int").alias("high"))

    hot = stored(some.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > hot_runs).select("anchor"), "hot-anchors")
    blocks = F.sequence(F.floor(-F.col("place") / F.lit(float(block))).cast("int"), F.floor(most / F.lit(float(block))).cast("int"))
    cores = some.join(hot, "anchor", "left_semi").select("anchor", "digest", "place", "run", F.explode(blocks).alias("block"))
    # the bytes that all strings of a block have in common
    core = F.md5(F.substring(F.col("run"), F.col("place") + block * F.col("block") + block, F.lit(length - block + 1)))
    cores = cores.select("anchor", "digest", "block", core.alias("core"))
    key = ["anchor", "block", "core"]
    shared = cores.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    live = cores.join(shared, key).groupBy("anchor", "digest").agg(F.collect_set("block").alias("live"))
    none = F.lit(None).cast("array<int>")
    few = some.join(hot, "anchor", "left_anti").select("anchor", "digest", "place", "run", none.alias("live"), F.lit(0).cast("long").alias("part"))
    many = some.join(live, ["anchor", "digest"]).select("anchor", "digest", "place", "run", "live", F.xxhash64("digest").alias("part"))

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "low", "high", "open", "h1", "h2"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        held: list[pa.RecordBatch] = []

        def bucket(last: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            anchor = t.column("anchor").to_numpy()
            cut = t.num_rows
            if not last and not t.column("live")[cut - 1].is_valid:
                # an anchor that isn't hot stays in one bucket
                cut = int(np.searchsorted(anchor, anchor[-1]))
                held.extend(t.slice(cut).to_batches())
            if cut:
                part = t.slice(0, cut)
                yield _batch(compare_bucket(
                    anchor[:cut], part.column("digest").to_pylist(), part.column("place").to_numpy(), part.column("run").to_pylist(),
                    part.column("live").to_pylist(), length, block), names, kinds)

        for part in slices(batches, "run"):
            at = 0
            while at < part.num_rows:
                room = max(bucket_runs - sum(x.num_rows for x in held), 1)
                held.append(part.slice(at, room))
                at += held[-1].num_rows
                if sum(x.num_rows for x in held) >= bucket_runs:
                    yield from bucket(last=False)
        if held:
            yield from bucket(last=True)

    placed = few.unionByName(many).repartitionByRange("anchor", "part").sortWithinPartitions("anchor", "part")
    found = stored(placed.mapInArrow(sort_buckets, FOUND), "repeated-strings")
    inside = inside.unionByName(found.where("not open").select("anchor", "digest", "low", "high"))
    string = ["anchor", "low", "h1", "h2"]
    loose = found.where("open").select(*string, "digest")
    across = loose.groupBy(string).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(string)
    alone = loose.where("digest is not null").join(across, string)
    inside = inside.unionByName(alone.select("anchor", "digest", "low", F.col("low").alias("high")))
    spans = inside.groupBy("anchor", "digest").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    # stored, so that the join is one of plain shuffles, which AQE splits where an anchor is hot
    spans = stored(spans, "string-spans")
    parts = runs.select("id", "sha", "anchor", "digest", "at").join(spans, ["anchor", "digest"])
    parts = parts.select("id", "sha", "at", F.explode("spans").alias("s")).select(
        "id", "sha", (F.col("at") + F.col("s.low")).alias("start"), (F.col("at") + F.col("s.high") + length).alias("stop"))
    return whole.unionByName(parts)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.md5(text)).alias("sha"), text.alias("text"))


def passages(docs: DataFrame, words: int = 51, chunk: int = 16) -> DataFrame:
    """How many places a document has where a string of ``words`` words starts that another document holds too: ``id, sha, n``,
    only where there are any. Of equal texts one is compared with the other texts; all strings of a text with a copy are shared."""
    ready(docs.sparkSession)

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            text, _, anchor, _ = word_anchors(Bytes(rows.column("text")), words, chunk)
            if not len(text):
                continue
            counts = np.bincount(text, minlength=rows.num_rows)
            some = np.flatnonzero(counts)
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
            owner = pa.array(np.concatenate([some, text[new]]))
            # a row without an anchor stands for the document
            yield pa.RecordBatch.from_arrays(
                [rows.column("id").take(owner), rows.column("sha").take(owner),
                 pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(anchor[new], pa.int64())]),
                 pa.concat_arrays([pa.array(counts[some].astype(np.int32)), pa.nulls(int(new.sum()), pa.int32())])],
                names=["id", "sha", "anchor", "strings"])

    rows = stored(docs.mapInArrow(find_anchors, PASSAGES), "passage-anchors")
    whole = rows.where("anchor is null").select("id", "sha", "strings")
    anchors = rows.where("anchor is not null").select("sha", "anchor")
    text = F.xxhash64("sha")
    differ = F.min(text).alias("least"), F.max(text).alias("most")
    # stored, so that both sides of the joins are plain shuffles, which AQE splits where an anchor, a string or a text is hot
    twice = stored(anchors.groupBy("anchor").agg(*differ).where("least <> most").select("anchor"), "passage-shared")
    texts = stored(whole.groupBy("sha").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("strings").alias("strings")), "passage-texts")
    single = texts.where("copies = 1").select("sha")
    wanted = anchors.join(twice, "anchor").groupBy("sha").agg(F.collect_set("anchor").alias("anchors"))
    wanted = wanted.join(texts.select("sha", "id"), "sha")

    def cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            b = Bytes(part.column("text"))
            owner, at, anchor, hashed = word_anchors(b, words, chunk)
            anchors = part.column("anchors")
            shared = anchors.flatten().to_numpy(zero_copy_only=False)
            lists = np.repeat(np.arange(part.num_rows), anchors.value_lengths().to_numpy(zero_copy_only=False))
            # an anchor and its text in one number; a clash only lets a string through that is compared below
            mine = np.isin(mix(anchor.view(np.uint64)) + owner.astype(np.uint64), mix(shared.view(np.uint64)) + lists.astype(np.uint64))
            if not mine.any():
                continue
            string = word_strings(hashed, words)[at[mine]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("sha").take(pa.array(owner[mine])), pa.array(string, pa.int64())], names=["sha", "string"])

    strings = stored(docs.join(wanted, ["id", "sha"]).select("sha", "text", "anchors").mapInArrow(cut_strings, STRINGS), "passage-strings")
    common = stored(strings.groupBy("string").agg(*differ).where("least <> most").select("string"), "passage-common")
    # texts that have copies share all strings, whatever others hold
    shared = strings.join(common, "string").groupBy("sha").agg(F.count(F.lit(1)).alias("n")).join(single, "sha").select("sha", "n")
    found = stored(shared.unionByName(texts.where("copies > 1").select("sha", F.col("strings").cast("long").alias("n"))), "passage-counts")
    return whole.select("id", "sha").join(found, "sha")


def dedup(docs: DataFrame, length: int = 400, chunk: int = 128, words: int = 51, **sizes) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, spans, kept``: ``n_repeated`` as in
    :func:`passages`, maximal spans, remaining bytes."""
    rows = _keyed(docs)
    nothing = F.lit(None).cast("int")
    counts = passages(rows, words).select("id", "sha", nothing.alias("start"), nothing.alias("stop"), "n")
    spans = covered(rows, length, chunk, **sizes).withColumn("n", F.lit(None).cast("long")).unionByName(counts)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "stop"))
    spans = spans.groupBy("id", "sha").agg(F.collect_set(span).alias("spans"), F.max("n").alias("repeated"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for part in slices(batches):
            out = []
            for doc_id, text, parts, repeated in zip(*(part.column(c).to_pylist() for c in ("id", "text", "spans", "repeated"))):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in parts or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                at, left = 0, []
                for start, stop in merged:
                    left.append(data[at:start])
                    at = stop
                kept = b"".join([*left, data[at:]])
                out.append((None if doc_id == NO_ID else doc_id, len(data), len(data) - len(kept), len(merged),
                            hashlib.sha256(kept).hexdigest(), repeated or 0, [x for s in merged for x in s], kept))
            yield _batch(out, names, kinds)

    joined = rows.join(spans, ["id", "sha"], "left").select("id", "text", "spans", "repeated")
    return joined.mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans array<long>, kept binary")


def report(docs: DataFrame, length: int = 400) -> DataFrame:
    """The contract's columns, ``n_repeated``, the spans, and what remains as ``kept``, with cut characters replaced."""
    kept = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept")
    return dedup(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans", kept)
