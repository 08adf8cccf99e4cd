"""Exact duplicates by 128-bit digest, with the bytes of a group compared. DataFrame functions only.

Rows and ties: a null text counts as empty, so empty and null texts form one group. Texts are equal when identical after
lower-casing A-Z. Rows that repeat an id stay separate rows of their group, and all carry ``kept`` if their id is the one kept.
A row whose id is null never wins against one with an id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, stored, text_or_empty


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Grouping by (digest, text) compares the bytes inside each digest and is summed in every task before the shuffle, so
    a group that holds a third of all rows leaves each task as one row. Only the digest travels on the way back; the
    side with the copies is split by AQE when one digest is hot. Digests shared by different texts are told apart by
    joining on the text as well.
    """
    pick = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(text_or_empty(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))
    variants = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
    groups = variants.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.first("group_size").alias("group_size"), F.first("keep_id").alias("keep_id"),
    )
    groups = stored(groups, "exact-groups")
    shared = groups.where("texts > 1").select("digest")
    one = groups.where("texts = 1").select("digest", "group_size", "keep_id")
    slim = rows.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"))
    found = slim.join(one, "digest")
    if not shared.isEmpty():
        # different texts with one digest: the text itself decides
        apart = variants.join(shared, "digest", "left_semi")
        clash = rows.join(shared, "digest", "left_semi").join(apart, ["digest", "norm"])
        found = found.unionByName(clash.select(
            "doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id"))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat both the kept id and its text, one stays."""
    groups = exact_groups(docs, keep, id_col, text_col).where("kept")
    groups = groups.select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumns({
        "__id": F.coalesce(F.col(id_col), F.lit(-1)), "__sha": F.sha2(fold_ascii(text_or_empty(text_col)), 256)})
    return marked.join(groups.distinct(), ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(docs.columns)
