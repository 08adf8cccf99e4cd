"""Listings of image folders and of the public stereo datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.paths import local_path, swap_path
from scanmill.operators.ordinal import append_listings, even_sample, pair_by_position, with_ordinal


def list_files(spark: SparkSession, *globs: str, must_exist: bool = False) -> DataFrame:
    """Paths that match any of the globs. Only names are read, never contents."""
    found = None
    for glob in globs:
        try:
            part = spark.read.format("binaryFile").load(glob).select(local_path(F.col("path")).alias("path"))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            if must_exist:
                raise FileNotFoundError(f"no such input: {glob}") from exc
            continue
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "path string")


def list_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Images of one folder."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such folder: {folder}") from exc
        raise
    return files.select(local_path(F.col("path")).alias("path"))


def require_nonempty(listing: DataFrame, what: str) -> DataFrame:
    """Fail early and clearly when there is nothing to work on."""
    if listing.isEmpty():
        raise FileNotFoundError(f"no files found: {what}")
    return listing


@dataclass(frozen=True)
class Layout:
    """Where a dataset keeps each role's files, below its root.

    A role may have several globs; their listings are appended in order.
    ``strict`` demands equally long listings, otherwise the longer ones are cut.
    """

    left: tuple[str, ...]
    right: tuple[str, ...]
    disp: tuple[str, ...]
    strict: bool


# File layouts of the public datasets.
KITTI = Layout(
    left=("2015/training/image_2/*_10.png",),
    right=("2015/training/image_3/*_10.png",),
    disp=("2015/training/disp_occ_0/*_10.png",),
    strict=True,
)
MIDDLEBURY = Layout(
    left=("MiddEval3/training{resolution}/*/im0.png",),
    right=("MiddEval3/training{resolution}/*/im1.png",),
    disp=("MiddEval3/training{resolution}/*/disp0GT.pfm",),
    strict=True,
)
ETH3D = Layout(
    left=("two_view_training/*/im0.png",),
    right=("two_view_training/*/im1.png",),
    disp=("two_view_training_gt/*/disp0GT.pfm",),
    strict=True,
)
TARTANAIR = Layout(
    left=("*/*/*/*/image_left/*.png",),
    right=("*/*/*/*/image_right/*.png",),
    disp=("*/*/*/*/depth_left/*.npy",),
    strict=False,
)
CRESTEREO = Layout(
    left=("*/*_left.jpg",),
    right=("*/*_right.jpg",),
    disp=("*/*_left.disp.png",),
    strict=False,
)
FALLING_THINGS = Layout(
    left=("*/*/*left.jpg", "*/*/*/*left.jpg"),
    right=("*/*/*right.jpg", "*/*/*/*right.jpg"),
    disp=("*/*/*left.depth.png", "*/*/*/*left.depth.png"),
    strict=False,
)
VKITTI2 = Layout(
    left=("Scene*/*/frames/rgb/Camera_0/rgb*.jpg",),
    right=("Scene*/*/frames/rgb/Camera_1/rgb*.jpg",),
    disp=("Scene*/*/frames/depth/Camera_0/depth*.png",),
    strict=True,
)
LAYOUTS = {
    "kitti": KITTI,
    "middlebury": MIDDLEBURY,
    "eth3d": ETH3D,
    "tartanair": TARTANAIR,
    "crestereo": CRESTEREO,
    "falling_things": FALLING_THINGS,
    "vkitti2": VKITTI2,
}
ROLES = ("left", "right", "disp")


def list_assets(spark: SparkSession, dataset: str, root: str, resolution: str = "H") -> DataFrame:
    """assets(dataset, role, part, path) of a dataset."""
    layout = LAYOUTS[dataset]
    parts = []
    for role in ROLES:
        globs = [f"{root}/{g.format(resolution=resolution)}" for g in getattr(layout, role)]
        listing = append_listings(*[list_files(spark, g) for g in globs])
        parts.append(listing.select(F.lit(dataset).alias("dataset"), F.lit(role).alias("role"), "part", "path"))
    assets = parts[0]
    for p in parts[1:]:
        assets = assets.unionByName(p)
    return assets


def list_dataset(spark: SparkSession, dataset: str, root: str, resolution: str = "H") -> DataFrame:
    """samples(dataset, ordinal, left_path, right_path, disp_path), paired by position."""
    list_files(spark, root, must_exist=True)
    assets = list_assets(spark, dataset, root, resolution)
    return pair_by_position(assets, ROLES, strict=LAYOUTS[dataset].strict, order_by=("part", "path"))


# Depth of the left folders below the split, per sub-collection.
SCENEFLOW_LEFT = ("*/*/left/*.png", "*/left/*.png", "*/*/*/left/*.png")
SCENEFLOW_TEST_SIZE = 500


def list_sceneflow(
    spark: SparkSession, root: str, dstype: str = "frames_finalpass", test: bool = False, augmented: bool = True
) -> DataFrame:
    """Only left images are listed; the other paths follow from them.

    The test split, which is also what unaugmented readers get, is an evenly
    spaced sample of the first sub-collection.
    """
    list_files(spark, root, must_exist=True)
    if test or not augmented:
        left = list_files(spark, f"{root}/{dstype}/TEST/{SCENEFLOW_LEFT[0]}")
        kept = even_sample(left, ["path"], SCENEFLOW_TEST_SIZE).drop("ordinal")
    else:
        kept = append_listings(*[list_files(spark, f"{root}/{dstype}/TRAIN/{g}") for g in SCENEFLOW_LEFT])
    by = [c for c in ("part", "path") if c in kept.columns]
    path = F.col("path")
    return with_ordinal(kept, by).select(
        F.lit("sceneflow").alias("dataset"),
        "ordinal",
        path.alias("left_path"),
        swap_path(path, "left", "right").alias("right_path"),
        swap_path(swap_path(path, dstype, "disparity"), ".png", ".pfm").alias("disp_path"),
    )


def pair_folder(spark: SparkSession, left_globs: Sequence[str], right_globs: Sequence[str]) -> DataFrame:
    """Left and right listings of one job zipped by position, cut to the shorter."""
    tag = lambda df, role: df.select(F.lit("job").alias("dataset"), F.lit(role).alias("role"), "path")
    both = tag(list_files(spark, *left_globs), "left").unionByName(tag(list_files(spark, *right_globs), "right"))
    return pair_by_position(both, ("left", "right"))
