"""Jaccard join over word shingles by a token-group matrix, and the classes its links form.

A document's set is its distinct shingles (hashed to 64 bits). Two sets can only reach the threshold if they share a token of
their prefixes: the first ``n - ceil(threshold * n) + 1`` tokens in one order for all documents. The order puts frequent tokens
(from a tenth of the documents; any order is right, this one is fast) last, so passages that many documents share hardly count.

1. Equal sets are one node, the smallest id of theirs. Only nodes that share a prefix token with another go on.
2. Similar nodes are partitioned into groups: nodes with the same least prefix token under a hash compare with one leader
   of theirs. Linked ones are a group; a group of thousands is cut into leaves of about ``leaf_size`` members.
3. The matrix holds (prefix token, leaf). A node queries the leaves of other groups with which it shares as many prefix tokens as
   their sizes ask for; the smaller group asks. Each leaf is opened only if the node's overlap with the union of the leaf's
   tokens reaches the needed part of the node's set; then its members' overlaps are counted exactly.
4. Links give classes by min-label spreading with pointer jumping, as joins in the shared folder.

Nothing is lost by leaving out the pairs inside a group: its members are in one class already.

Rows and ties: null and empty texts, and texts without a word, have an empty set and are a class of their own. A text with fewer words
than a shingle has its whole sequence as one. Rows that repeat an id are one document with several texts and so in one class. A
row without an id has no links and no class. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import NOT_SPACE, Bytes, shingles
from .common import ready, slices, stored

SIGNATURES = "doc_id long, n long, sid binary, prefix array<long>"
SETS = "node long, n long, tokens binary"
LINKS = "a long, b long"
SLOT_BITS = 25


def token_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    b = Bytes(texts, lower=True)
    start, end, doc = b.words(NOT_SPACE)
    value, owner = shingles(b.hash(start, end), doc, len(texts), size)
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(value[a:z]) for a, z in zip(edge[:-1], edge[1:])]


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` tokens with a partner: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def prefix(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The set's first tokens: rare ones by hash, then those of the ``hot`` list from rarer to more frequent."""
    take = len(tokens) - needed(len(tokens), percent) + 1
    at = np.searchsorted(hot, tokens).clip(max=max(len(hot) - 1, 0))
    common = hot[at] == tokens if len(hot) else np.zeros(len(tokens), dtype=bool)
    rare = tokens[~common]
    if len(rare) >= take:
        return rare[:take]
    frequent = tokens[common]
    frequent = frequent[np.argsort(rank[at[common]], kind="stable")]
    return np.concatenate([rare, frequent[: take - len(rare)]])


def frequent_tokens(docs: DataFrame, size: int, sample_docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least three documents of a sample, sorted, and their rank by frequency.

    The sample is a tenth of the documents, ``sample_docs`` at least: with a fixed number of them, the documents that share a
    token which is just too rare to be met thrice grow with the table, and their pairs with its square.
    """
    count = docs.count()
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = token_sets(rows.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "tokens"])

    sample = docs.where(draw < min(1.0, max(sample_docs / count, 0.1))).mapInArrow(emit, "sid binary, tokens array<long>").dropDuplicates(["sid"])
    counts = sample.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = stored(counts.orderBy(F.desc("n"), "token").limit(most), "frequent-tokens").toArrow()  # bounded by ``most``, as arrays
    token = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(token), 0, -1)
    order = np.argsort(token)
    return token[order], rank[order]


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, comp``: the smallest node reachable by links. Each round is stored in the shared folder."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(nodes.select("node", F.col("node").alias("comp")), "labels")
    linked = stored(both.select(F.col("a").alias("node")).distinct(), "linked")
    moving = linked.select("node", F.col("node").alias("comp"))
    for _ in range(rounds):
        heard = both.join(moving.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = moving.join(heard, "node").select("node", F.least("comp", "least").alias("comp"), F.col("comp").alias("old"))
        step = stored(step, "labels")
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = stored(step.join(up, "comp").select("node", F.col("top").alias("comp"), "old"), "labels")
        moving = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            break
    else:
        raise RuntimeError("labels still change; allow more rounds")
    return labels.select("node").join(moving, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Fewest tokens that the prefixes of linked sets of n and m tokens share.

    The overlap is at least ``percent * (n + m) / (100 + percent)``. All of it that lies in the prefix which ends first in the
    order is in both prefixes, and behind that prefix stand fewer than ``percent * max(n, m) / 100`` tokens of its set.
    """
    overlap = F.lit(float(percent)) * (n + m) / F.lit(100.0 + percent)
    return F.greatest(F.lit(1.0), overlap - F.greatest(n, m) * percent / F.lit(100.0) - F.lit(1e-6))


def maybe_among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is a ``node``, and few others: a filter before a join, so that not all texts are shuffled.

    Hashed ids are bits of bitmaps that together have a fixed size, 4 MB at most.
    """
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << SLOT_BITS)) + 1
    maps = nodes.groupBy(F.bitmap_bucket_number(slot("node")).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot("node"))).alias("__bits"))
    place = F.bitmap_bit_position(slot("doc_id"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(slot("doc_id"))).join(F.broadcast(maps), "__bucket")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("__bucket", "__bits")


def _pack(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def compare(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between the queries and the members of the same leaf. Both: ``leaf, salt, node, tokens``.

    Members and queries of a leaf meet in one task, members first; queries stream by, so a task holds one leaf.
    """

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, ids, union, flat, owner = None, [], [], None, None, None
        for batch in slices(batches, "tokens"):
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("leaf", "salt", "asks", "node", "tokens")]
            for leaf, salt, asks, node, tokens in zip(*columns):
                tokens = np.frombuffer(tokens, dtype=np.uint64)
                if (leaf, salt) != at:
                    at, sets, ids, union = (leaf, salt), [], [], None
                if not asks:
                    sets.append(tokens)
                    ids.append(node)
                    continue
                if not sets or not len(tokens):
                    continue
                if union is None:
                    flat = np.concatenate(sets)
                    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], owner[order]
                    union = flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat
                    sizes = np.array([len(s) for s in sets])
                if not len(union):
                    continue
                place = np.searchsorted(union, tokens).clip(max=len(union) - 1)
                shared = tokens[union[place] == tokens]
                if len(shared) < needed(len(tokens), percent):
                    continue  # the union bounds every member's overlap
                low, high = np.searchsorted(flat, shared, "left"), np.searchsorted(flat, shared, "right")
                picks = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(int((high - low).sum()))
                overlap = np.bincount(owner[picks], minlength=len(sets))
                for k in np.flatnonzero(100 * overlap >= percent * (sizes + len(tokens) - overlap)):
                    a.append(node)
                    b.append(ids[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=LINK_NAMES)

    rows = members.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    rows = rows.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "asks")
    return rows.mapInArrow(open_leaves, LINKS)


LINK_NAMES = ["a", "b"]


def jaccard_classes(
    docs: DataFrame, size: int = 5, percent: int = 80, leaf_size: int = 128, queries_per_task: int = 512, seeds: int = 2,
    sample_docs: int = 5000, hot_tokens: int = 100_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot, rank = frequent_tokens(rows, size, sample_docs, hot_tokens)
    order = spark.sparkContext.broadcast((hot, rank))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        for part in slices(batches):
            sets = token_sets(part.column("text"), size)
            heads = [prefix(s, hot, rank, percent).view(np.int64) if len(s) else None for s in sets]
            sids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "n", "sid", "prefix"])

    signed = stored(rows.mapInArrow(sign, SIGNATURES), "signatures")
    # equal sets are one node
    nodes = stored(
        signed.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "nodes")
    heads = signed.select("doc_id", "sid", "prefix").join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "sid"]).select(
        F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).drop("pos")
    counted = heads.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    # a token of two sets whose sizes can't link tells nothing
    counted = counted.where((F.col("c") > 2) | ((F.col("c") == 2) & (100 * F.col("low") >= percent * F.col("high")))).select("token")
    # stored, so that both sides of the join are plain shuffles, which AQE splits where a token is hot
    counted = stored(counted, "shared-tokens")
    postings = stored(heads.join(counted, "token"), "postings")
    asked = postings.select("node").distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = token_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array([len(s) for s in sets], pa.int64()), _pack(sets)], names=["node", "n", "tokens"])

    def fetch(nodes: DataFrame) -> DataFrame:
        """Token sets of the nodes, from their whole texts."""
        nodes = stored(nodes, "wanted")
        texts = maybe_among(rows, nodes).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("node"), "text")
        return stored(texts.mapInArrow(gather, SETS), "token-sets")

    # groups: one leader for the nodes with the same least token under each hash
    keys = [F.min(F.xxhash64("token", F.lit(k))).alias(f"key{k}") for k in range(seeds)]
    keyed = postings.groupBy("node").agg(F.first("n").alias("n"), *keys)
    keyed = keyed.select("node", "n", F.posexplode(F.array(*[f"key{k}" for k in range(seeds)])).alias("seed", "key"))
    leader = keyed.groupBy("seed", "key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = keyed.join(leader.drop("size"), ["seed", "key"]).where(
        (F.col("node") != F.col("lead.node")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    pairs = pairs.select("node", F.col("lead.node").alias("leaf")).distinct()
    other = postings.select(F.col("node").alias("leaf"), "token", F.col("n").alias("m"))
    met = pairs.join(postings.select("node", "token", "n"), "node").join(other, ["leaf", "token"])
    met = met.groupBy("node", "leaf", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    pairs = met.where(F.col("shared") >= _least_shared(F.col("n"), F.col("m"), percent)).select("node", "leaf")
    pairs = stored(pairs.distinct(), "leader-pairs")
    sets = fetch(pairs.select("node").union(pairs.select("leaf")).distinct())
    zero = F.lit(0).alias("salt")
    ask = pairs.join(sets, "node").select("leaf", F.pmod("node", F.lit(64)).cast("int").alias("salt"), "node", "tokens")
    salts = pairs.select("leaf", F.pmod("node", F.lit(64)).cast("int").alias("salt")).distinct()
    hold = salts.join(sets.withColumnRenamed("node", "leaf"), "leaf").select("leaf", "salt", F.col("leaf").alias("node"), "tokens")
    stars = stored(compare(ask, hold, percent), "star-links")
    first = stored(components(asked, stars), "groups")

    # the matrix of tokens and leaves
    sizes = first.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    placed = first.join(sizes, "comp")
    chunks = F.ceil(F.col("members") / F.lit(float(leaf_size)))
    placed = stored(placed.withColumn("leaf", F.xxhash64("comp", F.pmod(F.xxhash64("node"), chunks))), "leaves")
    marked = postings.join(placed, "node")
    matrix = marked.groupBy("token", "leaf", "comp", "members").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # tokens of one group only ask nothing
    cells = matrix.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    cells = stored(cells, "cells")
    matrix = stored(matrix.join(cells, "token"), "matrix")
    asks = marked.join(cells, "token").select(
        "token", "node", F.col("comp").alias("own"), F.col("members").alias("own_members"), F.col("n").alias("own_n"))
    smaller = (F.col("own_members") < F.col("members")) | ((F.col("own_members") == F.col("members")) & (F.col("own") < F.col("comp")))
    fits = (100 * F.col("own_n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("own_n"))
    met = asks.join(matrix, "token").where((F.col("own") != F.col("comp")) & smaller & fits)
    met = met.groupBy("node", "leaf", F.col("own_n").alias("n")).agg(
        F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    # of the leaf's sizes, the most lopsided ones ask for the fewest shared tokens
    least = F.least(
        _least_shared(F.col("n"), F.greatest(F.col("low"), F.col("n") * percent / 100.0), percent),
        _least_shared(F.col("n"), F.least(F.col("high"), F.col("n") * 100.0 / percent), percent))
    candidates = stored(met.where(F.col("shared") >= least).select("node", "leaf").distinct(), "candidates")
    per_leaf = candidates.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(queries_per_task))).alias("salts"))
    salted = candidates.join(per_leaf, "leaf").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    opened = placed.select("node", "leaf").join(candidates.select("leaf").distinct(), "leaf", "left_semi").select("node")
    sets = fetch(candidates.select("node").union(opened).distinct())
    ask = salted.join(sets, "node").select("leaf", "salt", "node", "tokens")
    leaves = placed.select("node", "leaf").join(per_leaf, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    hold = leaves.join(sets, "node").select("leaf", "salt", "node", "tokens")
    across = stored(compare(ask, hold, percent), "leaf-links")
    final = components(asked, stars.unionByName(across))

    classes = nodes.join(final, "node", "left").select("sid", F.coalesce("comp", "node").alias("comp"))
    found = signed.select("doc_id", "n", "sid").join(classes, "sid", "left")
    # documents that repeat an id stand in one class, through any of their texts
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns: of each class the one with the smallest id."""
    classes = jaccard_classes(docs, id_col=id_col, text_col=text_col, **how)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
