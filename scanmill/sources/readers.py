"""Which rule turns a dataset's raw file values into disparity and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions import scalar
from scanmill.sources.rasters import decode_npy, decode_pfm, decode_png

# dataset -> how its ground-truth files are decoded
DECODERS = {
    "tartanair": decode_npy,
    "crestereo": decode_png,
    "falling_things": decode_png,
    "vkitti2": decode_png,
    "kitti": decode_png,
    "middlebury": decode_pfm,
    "eth3d": decode_pfm,
    "sceneflow": decode_pfm,
    "generated": decode_npy,
}


def _plain(raw: Column) -> tuple[Column, Column]:
    # the reader states no validity: the default limit applies
    disp = raw.cast("double")
    return disp, scalar.default_valid(F.lit(None).cast("boolean"), disp)


def _generated(raw: Column) -> tuple[Column, Column]:
    disp = raw.cast("double")
    return disp, scalar.training_valid(disp)


RULES = {
    "tartanair": scalar.tartanair,
    "crestereo": scalar.crestereo,
    "vkitti2": scalar.vkitti2,
    "kitti": scalar.kitti,
    "sceneflow": _plain,
    "generated": _generated,
}


def disparity_lines(lines: DataFrame, dataset: str, mask_mode: str = "all") -> DataFrame:
    """Adds array columns ``disp`` and ``valid`` to decoded ground-truth lines.

    ``falling_things`` needs an ``fx`` column, the two-view sets a ``nocc`` array
    of the aligned mask image.
    """
    if dataset == "falling_things":
        pair = F.transform("vals", lambda v: _packed(scalar.falling_things(v, F.col("fx"))))
    elif dataset in ("middlebury", "eth3d"):
        if mask_mode not in ("all", "noc"):
            raise ValueError(f"unknown mask mode: {mask_mode}")
        pair = F.zip_with(
            "vals", "nocc", lambda v, m: _packed(scalar.masked_ground_truth(v, m, F.lit(mask_mode)))
        )
    else:
        rule = RULES[dataset]
        pair = F.transform("vals", lambda v: _packed(rule(v)))
    return (
        lines.withColumn("__p", pair)
        .withColumns({"disp": F.col("__p.disp"), "valid": F.col("__p.valid")})
        .drop("__p")
    )


def _packed(pair: tuple[Column, Column]) -> Column:
    disp, valid = pair
    return F.struct(disp.alias("disp"), valid.alias("valid"))
