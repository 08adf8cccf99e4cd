"""Raster files written below the checkpoint folder and read back: decoders, headers, bad files, listings to lines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.operators import grid
from scanmill.plans.registry import query, r6, r6_sql
from scanmill.plans.views import HT, PX, quarter_disparity, raster
from scanmill.session import shared_path
from scanmill.sources import listings, rasters, readers
from scanmill.sources.encode import encode_npy, encode_pfm, encode_png, write_files
from scanmill.sources.raster_source import decode_paths, read_rasters

FILTERS = (0, 1, 2, 3, 4)
ID = r"(\d+)\.\w+$"


def _named(lines: DataFrame, ext: str, folder: str = "", digits: int = 6) -> DataFrame:
    stem = F.lpad(F.col("image_id").cast("string"), digits, "0")
    return lines.withColumn("name", F.concat(F.lit(folder), stem, F.lit(ext)))


def _written(spark, lines: DataFrame, ext: str, encoder) -> str:
    folder = shared_path(spark, "rasters")
    write_files(_named(lines, ext), folder, encoder)
    return folder


def _pixels(lines: DataFrame) -> DataFrame:
    """Decoded lines by the number in their path, one row a pixel."""
    good = rasters.decoded(lines).withColumn("image_id", F.regexp_extract("path", ID, 1).cast("long"))
    return grid.to_pixels(good).select("image_id", "y", "x", r6(F.col("v")).alias("v"))


def _bytes(lines: DataFrame) -> DataFrame:
    level = lambda v: F.least(F.greatest(F.floor((v + 0.6) * 200), F.lit(0)), F.lit(255)).cast("double")
    return lines.withColumn("vals", F.transform("vals", level))


def _steps(lines: DataFrame) -> DataFrame:
    """Quarter pixels as 16-bit ground truth holds them: 256 a pixel."""
    return lines.withColumn("vals", F.transform(quarter_disparity(), lambda d: F.greatest(d * 256, F.lit(0.0))))


LEVEL = "least(greatest(floor((v + 0.6) * 200), 0), 255)"
STEP = "greatest(floor((v + 0.6) * 40) / 4 * 256, 0)"


@query("raster_pfm", f"WITH {PX} SELECT image_id, y, x, {r6_sql('v')} AS v FROM px")
def raster_pfm(spark, sf_dir):
    return _pixels(read_rasters(spark, _written(spark, raster(spark, sf_dir), ".pfm", encode_pfm)))


@query("raster_npy", f"WITH {PX} SELECT image_id, y, x, {r6_sql('v')} AS v FROM px")
def raster_npy(spark, sf_dir):
    folder = _written(spark, raster(spark, sf_dir), ".npy", encode_npy)
    return _pixels(rasters.read_npy(spark, f"{folder}/*.npy"))


@query("raster_png16", f"WITH {PX} SELECT image_id, y, x, {r6_sql(STEP)} AS v FROM px")
def raster_png16(spark, sf_dir):
    folder = _written(spark, _steps(raster(spark, sf_dir)), ".png", partial(encode_png, bits=16, filters=FILTERS))
    return _pixels(read_rasters(spark, f"{folder}/*.png"))


@query("raster_images", f"WITH {PX} SELECT image_id, y, x, {r6_sql(LEVEL)} AS v FROM px")
def raster_images(spark, sf_dir):
    folder = _written(spark, _bytes(raster(spark, sf_dir)), ".png", partial(encode_png, filters=FILTERS))
    return _pixels(rasters.read_images(spark, folder))


@query("raster_headers", f"""
WITH {HT} SELECT image_id, h, 64 AS w, CAST(h AS BIGINT) AS n_lines FROM ht WHERE image_id % 10 = 3
""")
def raster_headers(spark, sf_dir):
    """Sizes of the files a path filter leaves, from their headers."""
    folder = _written(spark, raster(spark, sf_dir), ".npy", encode_npy)
    heads = read_rasters(spark, folder, columns=("path", "h", "w")).where(F.col("path").endswith("3.npy"))
    number = F.regexp_extract("path", ID, 1).cast("long").alias("image_id")
    return heads.groupBy(number, "h", "w").agg(F.count(F.lit(1)).alias("n_lines"))


@query("raster_errors", f"""
WITH {HT} SELECT image_id, CAST(CASE WHEN image_id % 3 = 1 THEN 0 ELSE h END AS BIGINT) AS n_lines,
  CAST(CASE WHEN image_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_errors FROM ht
""")
def raster_errors(spark, sf_dir):
    """Every third file is cut short; the rest is read all the same."""
    folder = shared_path(spark, "broken")
    lines = _named(_bytes(raster(spark, sf_dir)), ".png")
    cut = F.col("image_id") % 3 == 1
    write_files(lines.where(~cut), folder, encode_png)
    write_files(lines.where(cut), folder, lambda image: encode_png(image)[:60])
    found = read_rasters(spark, folder)
    number = F.regexp_extract("path", ID, 1).cast("long").alias("image_id")
    return found.groupBy(number).agg(F.count("vals").alias("n_lines"), F.count("error").alias("n_errors"))


@query("dataset_lines", f"""
WITH {PX},
nx AS (SELECT image_id, lead(image_id, 1, 0) OVER (ORDER BY image_id) AS other FROM (SELECT DISTINCT image_id FROM px))
SELECT l.image_id, l.y, l.x, {r6_sql(LEVEL.replace('v', 'l.v'))} AS left_level, CASE WHEN r.v IS NOT NULL THEN {r6_sql(LEVEL.replace('v', 'r.v'))} END AS right_level,
       {r6_sql('greatest(floor((l.v + 0.6) * 40) / 4, 0)')} AS disp, floor((l.v + 0.6) * 40) / 4 > 0 AS valid
FROM px l JOIN nx USING (image_id) LEFT JOIN px r ON r.image_id = nx.other AND r.y = l.y AND r.x = l.x
""")
def dataset_lines(spark, sf_dir):
    """A dataset written in its layout, listed, paired and decoded: from paths to aligned lines of left, right and disparity."""
    root, lines = shared_path(spark, "kitti"), raster(spark, sf_dir)
    top = "2015/training"
    views = _bytes(lines)
    write_files(_named(views, "_10.png", f"{top}/image_2/"), root, encode_png)
    # the right view of an image is the next one, that of the last one the first
    count = lines.agg(F.max("image_id")).first()[0] + 1
    moved = views.withColumn("image_id", F.pmod(F.col("image_id") - 1, F.lit(count)))
    write_files(_named(moved, "_10.png", f"{top}/image_3/"), root, encode_png)
    write_files(_named(_steps(lines), "_10.png", f"{top}/disp_occ_0/"), root, partial(encode_png, bits=16))
    samples = listings.list_dataset(spark, "kitti", root).withColumnRenamed("ordinal", "image_id")
    disp = readers.disparity_lines(rasters.decoded(decode_paths(samples, "disp_path", ["image_id"])), "kitti")
    role = lambda name: rasters.decoded(decode_paths(samples, f"{name}_path", ["image_id"])).select("image_id", "y", F.col("vals").alias(name))
    both = disp.join(role("left"), ["image_id", "y"], "left").join(role("right"), ["image_id", "y"], "left")
    # a view without this line has no values there; it must not take the line from the others
    line = lambda name: F.coalesce(name, F.array().cast("array<double>")).alias(name)
    cells = F.arrays_zip(line("left"), line("right"), "disp", "valid")
    return both.select("image_id", "y", F.posexplode(cells).alias("x", "c")).select(
        "image_id", "y", "x", r6(F.col("c.left")).alias("left_level"), r6(F.col("c.right")).alias("right_level"),
        r6(F.col("c.disp")).alias("disp"), F.col("c.valid").alias("valid"))
