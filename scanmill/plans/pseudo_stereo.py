"""From depth predictions to a synthetic stereo pair, and the sample tables training reads.

Depth networks and hole fillers are the user's: their outputs come in as line
tables, or as a function from a line table to a line table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.scalar import default_valid, downscale_factor, mask_is_set, training_valid
from scanmill.operators.augment import AugmentParams, augment
from scanmill.operators.depth import adaptive_disparity, confidence, cut_edges, nearest_fill
from scanmill.operators.grid import align, resize
from scanmill.operators.lookup import lookup_join
from scanmill.operators.warp import forward_warp

Predictor = Callable[[DataFrame], DataFrame]


def disparity_maps(
    depth: DataFrame,
    u1: Column | None = None,
    u2: Column | None = None,
    seed: int = 0,
    dilate_iterations: int = 1,
) -> DataFrame:
    """Disparity and confidence from ``depth`` and ``depth_flipped`` lines.

    The confidence rides along while edges are cut and filled, so the two maps
    of a line stay in one row.
    """
    scored = confidence(depth)
    scaled = adaptive_disparity(scored, "depth", "vals", u1, u2, seed).drop("depth", "depth_flipped")
    filled = nearest_fill(cut_edges(scaled, dilate_iterations))
    return filled.select("image_id", "y", "h", "w", F.col("vals").alias("disp"), "conf")


def warp_view(image: DataFrame, maps: DataFrame, compat: str = "reference") -> DataFrame:
    """Warp every channel of ``image`` by the disparity of its line."""
    pairs = image.join(maps.select("image_id", "y", "disp"), ["image_id", "y"])
    return forward_warp(pairs, compat)


def fill_holes(warped: DataFrame, predict: Predictor | None = None, keys=("image_id", "ch", "y")) -> DataFrame:
    """Take predicted values where no source pixel landed, warped ones elsewhere.

    ``predict`` takes the warped lines (holes are zero, ``mask_inpaint`` tells
    where) and adds a ``pred`` array to them, so nothing is computed twice. One that
    gives only keys and ``pred`` is joined, and a line without a prediction fails the job.
    """
    if predict is None:
        return warped
    both = predict(warped)
    if not set(warped.columns) <= set(both.columns):
        lacking = F.raise_error(F.lit("a line has no prediction")).cast("array<double>")
        both = warped.join(both.select(*keys, "pred"), list(keys), "left").withColumn("pred", F.coalesce("pred", lacking))
    cells = F.arrays_zip(F.col("vals").alias("v"), F.col("pred").alias("p"), F.col("mask_inpaint").alias("m"))
    return both.withColumn(
        "vals", F.transform(cells, lambda c: F.when(c["m"], c["p"]).otherwise(c["v"]))
    ).drop("pred")


def pseudo_stereo(
    image: DataFrame,
    depth: DataFrame,
    u1: Column | None = None,
    u2: Column | None = None,
    seed: int = 0,
    compat: str = "reference",
    predict: Predictor | None = None,
) -> DataFrame:
    """Right view with both masks, disparity and confidence, one row per line and channel."""
    maps = disparity_maps(depth, u1, u2, seed)
    pairs = image.join(maps.select("image_id", "y", "disp", "conf"), ["image_id", "y"])
    return fill_holes(forward_warp(pairs, compat), predict)


# --- sample tables ----------------------------------------------------------------------------


def eval_samples(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """Left, right, disparity and validity of a line side by side, per channel.

    ``truth(image_id, y, disp, valid)`` comes from a dataset's reader.
    """
    views = left.select("image_id", "ch", "y", "h", "w", F.col("vals").alias("left")).join(
        right.select("image_id", "ch", "y", F.col("vals").alias("right")), ["image_id", "ch", "y"]
    )
    return views.join(truth.select("image_id", "y", "disp", "valid"), ["image_id", "y"])


def fill_samples(
    left: DataFrame,
    right: DataFrame,
    truth: DataFrame,
    images: DataFrame | None = None,
    params: AugmentParams | None = None,
    seed: int = 0,
    epoch: int = 0,
    compat: str = "reference",
) -> DataFrame:
    """Right view, left view warped into it, and the holes left open: input of a fill model.

    Only the first three channels count. Without ``params`` nothing is augmented.
    """
    left, right = left.filter("ch < 3"), right.filter("ch < 3")
    checked = truth.withColumn(
        "valid",
        F.zip_with("valid", "disp", lambda v, d: default_valid(v, d)) if "valid" in truth.columns
        else F.transform("disp", lambda d: default_valid(F.lit(None).cast("boolean"), d)),
    )
    if params is not None:
        as_lines = lambda c: checked.select("image_id", F.lit(0).alias("ch"), "y", "h", "w", F.transform(c, lambda v: v.cast("double")).alias("vals"))
        done = augment(
            {"left": left, "right": right, "disp": as_lines("disp"), "valid": as_lines("valid")},
            images, params, seed, epoch,
        )
        left, right = done["left"], done["right"]
        checked = align({"disp": done["disp"], "valid": done["valid"]}, missing="fail")
    warped = warp_view(left, checked, compat).select(
        "image_id", "ch", "y", "h", "w", F.col("vals").alias("warped_right"), "mask_inpaint"
    )
    return right.select("image_id", "ch", "y", F.col("vals").alias("right")).join(warped, ["image_id", "ch", "y"])


def stereo_samples(
    left: DataFrame,
    right: DataFrame,
    disp: DataFrame,
    conf: DataFrame,
    mask_nocc: DataFrame,
    mask_inpaint: DataFrame,
    images: DataFrame | None = None,
    params: AugmentParams | None = None,
    seed: int = 0,
    epoch: int = 0,
) -> dict[str, DataFrame]:
    """The nine aligned rasters of a training sample as line tables.

    Masks are set where the stored value is 255; a disparity is valid above zero.
    """
    as_mask = lambda df: df.withColumn("vals", F.transform("vals", lambda v: mask_is_set(v).cast("double")))
    rasters = {
        "left": left, "right": right, "left_clean": left, "right_clean": right,
        "disp": disp, "conf": conf,
        "mask_nocc": as_mask(mask_nocc), "mask_inpaint": as_mask(mask_inpaint),
        "valid": disp.withColumn("vals", F.transform("vals", lambda d: training_valid(d).cast("double"))),
    }
    return augment(rasters, images, params, seed, epoch) if params is not None else rasters


def warp_samples(image: DataFrame, disp: DataFrame, limit: int | None = None, compat: str = "reference") -> DataFrame:
    """Warp large images at a reduced size; ``scale`` and the full size allow enlarging back. Without ``limit`` none is reduced.

    ``scale`` is how often ``limit`` fits in the short side. Only images with a
    scale above one are resampled.
    """
    scale = F.lit(1)
    if limit is not None:
        scale = downscale_factor(F.floor(F.col("h") * 1000 / limit), F.floor(F.col("w") * 1000 / limit))
    sized = lambda df: df.withColumns({"scale": scale, "full_h": F.col("h"), "full_w": F.col("w")})
    img, dsp = sized(image), sized(disp)
    out_h, out_w = F.floor(F.col("h") / F.col("scale")).cast("int"), F.floor(F.col("w") / F.col("scale")).cast("int")

    def reduced(df: DataFrame, mode: str, change) -> DataFrame:
        large = resize(df.filter("scale > 1"), out_h, out_w, mode=mode, rule="centers")
        return change(large)

    clipped = lambda df: df.withColumn(
        "vals", F.transform("vals", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)))
    )
    heads = img.filter("scale > 1").groupBy("image_id").agg(
        F.max("scale").alias("scale"), F.max("full_h").alias("full_h"), F.max("full_w").alias("full_w")
    )
    small_img = lookup_join(reduced(img, "bicubic", clipped), heads, ["image_id"])
    small_dsp = lookup_join(reduced(dsp, "bilinear", lambda df: df), heads, ["image_id"]).withColumn(
        "vals", F.transform("vals", lambda v: v / F.col("scale"))
    )
    cols = ["image_id", "ch", "y", "h", "w", "vals", "scale", "full_h", "full_w"]
    img_all = img.filter("scale <= 1").select(cols).unionByName(small_img.select(cols))
    dsp_all = dsp.filter("scale <= 1").select(cols).unionByName(small_dsp.select(cols))
    pairs = img_all.join(dsp_all.select("image_id", "y", F.col("vals").alias("disp")), ["image_id", "y"])
    return forward_warp(pairs, compat)


def enlarge(warped: DataFrame) -> dict[str, DataFrame]:
    """Bring a reduced right view and its masks back to full size."""
    back = lambda df, mode: resize(df, F.col("full_h"), F.col("full_w"), mode=mode)
    mask = lambda c: warped.withColumn("vals", F.transform(c, lambda m: m.cast("double")))
    bounded = back(warped, "bicubic").withColumn(
        "vals", F.transform("vals", lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)))
    )
    return {
        "right": bounded,
        "mask_nocc": back(mask("mask_nocc"), "nearest"),
        "mask_inpaint": back(mask("mask_inpaint"), "nearest"),
    }
