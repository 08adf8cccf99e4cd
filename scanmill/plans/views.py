"""Rasters, feature lines and listings derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64  # vectors per image and values per vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores a task per core.

    Only inputs too small to fill the cluster are shuffled; a large scan already
    has enough splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lines from ``embeddings``: 64 consecutive vectors make an image, the last may be short."""
    emb = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    last = emb.agg(F.max("vec_id")).first()[0]
    image = F.expr(f"vec_id div {SIDE}")
    return emb.select(
        image.alias("image_id"),
        F.lit(0).alias("ch"),
        F.pmod("vec_id", F.lit(SIDE)).cast("int").alias("y"),
        F.least(F.lit(SIDE), F.lit(last) + 1 - image * SIDE).cast("int").alias("h"),
        F.size("embedding").alias("w"),
        F.col("embedding").cast("array<double>").alias("vals"),
    )


def stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image k as left view and image k+1 as right view, on the lines both have."""
    left = raster(spark, sf_dir)
    right = left.select(
        (F.col("image_id") - 1).alias("image_id"), "y", F.col("h").alias("hr"), F.col("vals").alias("right")
    )
    return left.withColumnRenamed("vals", "left").join(right, ["image_id", "y"]).select(
        "image_id", "ch", "y", F.least("h", "hr").alias("h"), "w", "left", "right"
    )


def quarter_disparity(vals: str = "vals") -> Column:
    """Disparities in steps of a quarter pixel, so that ties and whole shifts occur."""
    return F.transform(vals, lambda v: F.floor((v + 0.6) * 40) / 4)


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of 64 values read as 8 pixels with 8 channels, for both views."""
    split = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    pairs = stereo_pairs(spark, sf_dir)
    return pairs.select("image_id", "y", split("left").alias("left"), split("right").alias("right"))


# The same views in SQL.
PX = """px AS (
  SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INTEGER) AS y,
         CAST(unnest(range(64)) AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""
HT = "ht AS (SELECT vec_id // 64 AS image_id, CAST(count(*) AS INTEGER) AS h FROM embeddings GROUP BY 1)"
PAIR = """pr AS (
  SELECT l.image_id, l.y, l.x, l.v AS l, r.v AS r
  FROM px l JOIN px r ON r.image_id = l.image_id + 1 AND r.y = l.y AND r.x = l.x)"""
FEAT = """ft AS (
  SELECT image_id, y, CAST(c // 8 AS INTEGER) AS x, list(l ORDER BY c) AS l, list(r ORDER BY c) AS r
  FROM (SELECT image_id, y, x AS c, l, r FROM pr) GROUP BY image_id, y, c // 8)"""
SHIFT = "sh AS (SELECT image_id, y, x, v, floor((v + 0.6) * 40) / 4 AS d, x - floor((v + 0.6) * 40) / 4 AS s FROM px)"
