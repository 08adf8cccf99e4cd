"""Sample manifests: one sample per line, paths separated by single spaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.paths import join_path
from scanmill.operators.ordinal import with_ordinal
from scanmill.session import pin

# What each column of a manifest holds.
COLUMNS = ("left_path", "right_path", "disp_path", "conf_path", "mask_nocc_path", "mask_inpaint_path")


def _place() -> Column:
    return F.struct("__block", "__row")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in their file and the place of its first blank line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    placed = pin(
        raw.select(
            F.col("_metadata.file_path").alias("manifest"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__row"),
            "value",
        )
    )
    # one row per manifest file
    stops = placed.groupBy("manifest").agg(F.min(F.when(F.col("value") == "", _place())).alias("__stop"))
    return placed.join(stops, "manifest")


def read_manifest(
    spark: SparkSession, path: str, root: str, cols: Sequence[int] = (0, 1, 2, 3, 4, 5)
) -> DataFrame:
    """samples(manifest, sample_id, ...) up to the first blank line of each file; :func:`left_out` names what lies behind it.

    Line order is the file offset of the split a line was read from, then its
    place in the split, so a large manifest is read by many tasks.
    """
    kept = _placed(spark, path).filter(F.col("__stop").isNull() | (_place() < F.col("__stop")))
    lines = with_ordinal(kept, ["__block", "__row"], ["manifest"], name="sample_id")
    parts = F.split("value", " ")
    need = max(cols) + 1
    checked = F.when(F.size(parts) >= need, parts).otherwise(
        F.raise_error(F.concat(F.lit("manifest line with too few paths: "), F.col("value"))).cast("array<string>")
    )
    return lines.withColumn("__parts", checked).select(
        "manifest", "sample_id", *[join_path(root, F.get("__parts", F.lit(c))).alias(COLUMNS[c]) for c in cols]
    )


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, lines) of the files that have lines with paths behind their first blank line, which no sample is made of."""
    behind = _placed(spark, path).filter((_place() > F.col("__stop")) & (F.col("value") != ""))
    return behind.groupBy("manifest").agg(F.count(F.lit(1)).alias("lines"))
