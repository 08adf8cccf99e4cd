"""Scalar column rules: rounding, losses, raw depth to disparity, target sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmill.functions.arrays import clip
from scanmill.functions.paths import swap_path

# Calibration and encoding constants of the public datasets.
TARTANAIR_FOCAL_TIMES_BASELINE = 80.0
CRESTEREO_UNITS_PER_PIXEL = 32.0
KITTI_UNITS_PER_PIXEL = 256.0
FALLING_THINGS_BASELINE = 6.0
FALLING_THINGS_UNITS = 100.0
VKITTI2_UNITS_PER_METRE = 100.0
VKITTI2_FAR_LIMIT = 655.0
VKITTI2_BASELINE = 0.532725
VKITTI2_FOCAL = 725.0087
FULL_MASK = 255
DEFAULT_DISPARITY_LIMIT = 1024.0
# Channel means and deviations of the common image normalisation.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

_INF = float("inf")


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def smooth_l1(error: Column) -> Column:
    size = F.abs(error)
    return F.when(size < 1, 0.5 * error * error).otherwise(size - 0.5)


def _positive(value: Column) -> Column:
    """``value > 0`` where NaN does not count as large."""
    return F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))


def _over(numerator: Column, depth: Column) -> Column:
    # IEEE division without tripping the engine's divide-by-zero check
    return (
        F.when(numerator.isNull() | depth.isNull(), F.lit(None).cast("double"))
        .when((depth == 0) & (numerator == 0), F.lit(float("nan")))
        .when(depth == 0, F.signum(numerator) * F.lit(_INF))
        .otherwise(F.try_divide(numerator, depth))
    )


def tartanair(depth: Column) -> tuple[Column, Column]:
    disp = _over(F.lit(TARTANAIR_FOCAL_TIMES_BASELINE), depth.cast("double"))
    return disp, _positive(disp)


def crestereo(raw: Column) -> tuple[Column, Column]:
    raw = raw.cast("double")
    return raw / CRESTEREO_UNITS_PER_PIXEL, _positive(raw)


def falling_things(depth: Column, fx: Column) -> tuple[Column, Column]:
    disp = _over(fx * FALLING_THINGS_BASELINE * FALLING_THINGS_UNITS, depth.cast("double"))
    return disp, _positive(disp)


def vkitti2(raw: Column) -> tuple[Column, Column]:
    # metres are stored as 32-bit floats before the range test
    depth = (raw.cast("double") / VKITTI2_UNITS_PER_METRE).cast("float").cast("double")
    valid = F.coalesce((depth > 0) & (depth < VKITTI2_FAR_LIMIT), F.lit(False))
    disp = F.when(valid, F.try_divide(F.lit(VKITTI2_BASELINE * VKITTI2_FOCAL), depth)).otherwise(0.0)
    return disp, valid


def kitti(raw: Column) -> tuple[Column, Column]:
    disp = raw.cast("double") / KITTI_UNITS_PER_PIXEL
    return disp, _positive(disp)


def kitti_file(path: Column, mask_mode: str) -> Column:
    """Which ground-truth file a mask mode reads."""
    if mask_mode == "all":
        return path
    if mask_mode == "noc":
        return swap_path(path, "disp_occ", "disp_noc")
    raise ValueError(f"unknown mask mode: {mask_mode}")


def occlusion_mask_file(path: Column) -> Column:
    """The mask image that lies beside a two-view ground-truth file."""
    return swap_path(path, "disp0GT.pfm", "mask0nocc.png")


def masked_ground_truth(disp: Column, nocc: Column, mask_mode: Column) -> tuple[Column, Column]:
    """Two-view ground truth whose validity comes from a mask image."""
    valid = (
        F.when(mask_mode == "all", nocc > 0)
        .when(mask_mode == "noc", nocc == FULL_MASK)
        .otherwise(F.raise_error(F.concat(F.lit("unknown mask mode: "), mask_mode)).cast("boolean"))
    )
    return disp.cast("double"), valid


def default_valid(valid: Column, disp: Column) -> Column:
    """Validity of readers that return none."""
    return F.coalesce(valid, (disp < DEFAULT_DISPARITY_LIMIT) & ~F.isnan(disp))


def training_valid(disp: Column) -> Column:
    return _positive(disp)


def mask_is_set(mask: Column) -> Column:
    return mask == FULL_MASK


def loss_valid(valid: Column, disp_gt: Column, max_disp: float = 700.0) -> Column:
    return F.coalesce((valid >= 0.5) & (disp_gt < max_disp) & ~F.isnan(disp_gt), F.lit(False))


def unit_scale(value: Column) -> Column:
    return value / 255.0


def signed_scale(value: Column) -> Column:
    return value / 127.5 - 1


def signed_unscale(value: Column) -> Column:
    """Back to 0..255, rounded half to even."""
    return F.rint((value + 1) * 127.5)


def standardise(value: Column, channel: Column) -> Column:
    pick = lambda table: F.get(F.array(*[F.lit(t) for t in table]), channel)
    return (value / 255.0 - pick(CHANNEL_MEAN)) / pick(CHANNEL_STD)


def hide_masked(value: Column, mask: Column) -> Column:
    return F.when(mask < 0.5, value).otherwise(0.0)


def composite(predicted: Column, original: Column, mask: Column) -> Column:
    return F.when(mask >= 0.5, predicted).otherwise(original)


def downscale_factor(height: Column, width: Column) -> Column:
    """Whole factor that brings the short side near 1000; 1 means leave it."""
    return F.greatest(F.floor(F.least(height, width) / 1000).cast("int"), F.lit(1))


def pad_amounts(width: Column, height: Column, k: int, mode: str = "even") -> dict[str, Column]:
    """Left, right, top, bottom padding that makes both sides multiples of ``k``.

    ``even`` splits the vertical padding (rest at the end), ``top0`` puts all of
    it at the bottom. The horizontal padding is always split.
    """
    need = lambda size: F.pmod(F.lit(k) - F.pmod(size, F.lit(k)), F.lit(k)).cast("int")
    pad_w, pad_h = need(width), need(height)
    half = lambda n: F.floor(n / 2).cast("int")
    top = half(pad_h) if mode == "even" else F.lit(0)
    return {"left": half(pad_w), "right": pad_w - half(pad_w), "top": top, "bottom": pad_h - top}


def target_size(
    width: Column,
    height: Column,
    target_w: float,
    target_h: float,
    method: str = "lower_bound",
    multiple: int = 1,
    keep_aspect: bool = False,
) -> tuple[Column, Column]:
    """Output (width, height) of an aspect-aware resize, rounded to a multiple."""
    scale_w = F.lit(float(target_w)) / width
    scale_h = F.lit(float(target_h)) / height
    prefer_width = {
        "lower_bound": scale_w > scale_h,
        "upper_bound": scale_w < scale_h,
        "minimal": F.abs(1 - scale_w) < F.abs(1 - scale_h),
    }
    if method not in prefer_width:
        raise ValueError(f"unknown resize method: {method}")
    if keep_aspect:
        common = F.when(prefer_width[method], scale_w).otherwise(scale_h)
        scale_w = scale_h = common

    def fit(size: Column, bound: float) -> Column:
        units = size / multiple
        nearest = F.rint(units) * multiple
        if method == "lower_bound":
            fitted = F.when(nearest < bound, F.ceil(units) * multiple).otherwise(nearest)
        elif method == "upper_bound":
            # never below zero, so only the upper bound can bite
            fitted = F.when(nearest > bound, F.floor(units) * multiple).otherwise(nearest)
        else:
            fitted = nearest
        return fitted.cast("int")

    return fit(scale_w * width, target_w), fit(scale_h * height, target_h)


def iteration_weight(i: Column, n: Column, gamma: float = 0.9) -> Column:
    """Weight of prediction ``i`` of ``n``: later ones count more; a single one counts fully."""
    decay = F.pow(F.lit(gamma), F.lit(15.0) / F.greatest(n - 1, F.lit(1)))
    return F.when(n == 1, 1.0).otherwise(F.pow(decay, (n - i - 1).cast("double")))


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def uniform(salt: str, seed: int, *keys: Column) -> Column:
    """A draw in [0,1) that depends only on the seed and the keys, not on partitioning."""
    bits = F.xxhash64(F.lit(salt), F.lit(seed), *keys)
    return F.shiftrightunsigned(bits, 11) / float(2**53)


def normal(salt: str, seed: int, *keys: Column) -> Column:
    """A standard normal draw from two hash draws (Box-Muller)."""
    u1 = uniform(salt + "/r", seed, *keys)
    u2 = uniform(salt + "/a", seed, *keys)
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)


__all__ = [name for name in dir() if not name.startswith("_")] + ["clip"]
