"""Reproducible augmentation of stereo samples.

Draws are hashes of (seed, epoch, sample, purpose), so a sample is augmented the
same way wherever and however often its rows are computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import clip, indices, let, run_firsts
from scanmill.functions.scalar import normal, uniform
from scanmill.operators.grid import channels_to_columns, columns_to_channels, crop, resize
from scanmill.operators.lookup import lookup_join
from scanmill.operators.stencil import gauss_blur
from scanmill.session import pin


@dataclass(frozen=True)
class AugmentParams:
    """Ranges and probabilities of the augmentation chain."""

    crop_height: int = 384
    crop_width: int = 512
    noise_std: float = 0.02
    blur_prob: float = 0.5
    brightness: tuple[float, float] = (0.6, 1.4)
    contrast: tuple[float, float] = (0.6, 1.4)
    saturation: tuple[float, float] = (0.0, 1.4)
    hue: float = 0.5 / 3.14
    asymmetric_prob: float = 0.2
    erase_prob: float = 0.5
    erase_max: int = 2
    erase_bound: tuple[int, int] = (50, 100)
    min_scale: float = -0.2
    max_scale: float = 0.4
    max_stretch: float = 0.2
    stretch_prob: float = 0.8
    scale_prob: float = 1.0
    y_jitter: bool = True
    sparse: bool = False
    steps: frozenset[str] = field(default_factory=lambda: frozenset({"noise", "color", "erase", "scale"}))


def _draw(salt: str, seed: int, epoch: int, key: Column = None) -> Column:
    key = key if key is not None else F.col("image_id")
    return uniform(salt, seed, F.lit(epoch), key)


def _between(u: Column, low: Column | int | float, high: Column | int | float) -> Column:
    """Whole number in [low, high) from a unit draw."""
    return (low + F.floor(u * (high - low))).cast("int")


def add_noise(lines: DataFrame, std: float, seed: int, epoch: int = 0) -> DataFrame:
    """Gaussian noise on 0..255 values, clipped to the range."""
    noisy = lambda v, x: 255.0 * clip(
        v / 255.0
        + std * normal("noise", seed, F.lit(epoch), F.col("image_id"), F.col("ch"), F.col("y"), x),
        0.0,
        1.0,
    )
    return lines.withColumn("vals", F.transform("vals", noisy))


def random_blur(lines: DataFrame, prob: float, seed: int, epoch: int = 0) -> DataFrame:
    """Blur some images with a drawn width below one pixel, borders repeated."""
    hit = _draw("blur?", seed, epoch) < prob
    sigma = F.when(hit, _draw("blur", seed, epoch)).otherwise(0.0)
    # four standard deviations of a width below one fit in nine taps
    return gauss_blur(lines, n=9, std=sigma, border="edge")


# --- colour -----------------------------------------------------------------------------------

# Luma weights used for gray conversion.
LUMA = (0.299, 0.587, 0.114)


def color_factors(seed: int, epoch: int, params: AugmentParams) -> dict[str, Column]:
    """Per image and view: drawn factors; a shared draw unless the image is asymmetric."""
    apart = _draw("asym", seed, epoch) < params.asymmetric_prob
    owner = F.when(apart, F.col("view")).otherwise(F.lit("both"))
    u = lambda salt: uniform(salt, seed, F.lit(epoch), F.col("image_id"), owner)
    span = lambda salt, lo, hi: lo + u(salt) * (hi - lo)
    return {
        "brightness": span("brightness", *params.brightness),
        "contrast": span("contrast", *params.contrast),
        "saturation": span("saturation", *params.saturation),
        "hue": span("hue", -params.hue, params.hue),
        "stacked": ~apart,
    }


def _gray(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def _mix255(v: Column, base: Column, factor: Column) -> Column:
    return clip(factor * v + (1 - factor) * base, 0.0, 255.0)


def _hue_shift(p: Column, shift: Column) -> Column:
    """Rotate the hue of an (r, g, b) struct by a share of the full circle."""
    r, g, b = p["r"], p["g"], p["b"]

    def rotated(ends: Column) -> Column:
        top, span = ends["top"], ends["span"]
        part = lambda q: F.try_divide(q, span)
        sector = (
            F.when(span == 0, 0.0)
            .when(top == r, part(g - b))
            .when(top == g, part(b - r) + 2)
            .otherwise(part(r - g) + 4)
        )

        def channels(turn: Column) -> Column:
            def channel(offset: int) -> Column:
                # distance of the hue from the sector where the channel is full
                fall = lambda k: top - span * F.least(F.greatest(F.least(k, 4 - k), F.lit(0.0)), F.lit(1.0))
                return let(F.pmod(turn + float(offset), F.lit(6.0)), fall)

            return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))

        return let(sector + shift * 6, channels)

    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return let(F.struct(high.alias("top"), (high - low).alias("span")), rotated)


def color_jitter(colors: DataFrame, factors: dict[str, Column], whole: bool = True) -> DataFrame:
    """Brightness, contrast, saturation, hue, in that order, on 0..255 values.

    ``colors(image_id, view, y, h, w, r, g, b)`` with one array per channel. The
    contrast step pulls towards the mean gray of the brightened image, or of both
    views together when they share one draw. The order is fixed here so that
    results can be reproduced. ``whole`` rounds the result to whole values.
    """
    named = colors.withColumns({f"__{k}": v for k, v in factors.items()})
    lit = named.withColumns(
        {
            c: let(F.col("__brightness"), lambda f, c=c: F.transform(c, lambda v: clip(v * f, 0.0, 255.0)))
            for c in ("r", "g", "b")
        }
    )
    pixels = F.arrays_zip("r", "g", "b")
    owner = F.when(F.col("__stacked"), F.lit("both")).otherwise(F.col("view"))
    keyed = lit.withColumn("__owner", owner)
    sums = keyed.select(
        "image_id", "__owner",
        F.aggregate(pixels, F.lit(0.0), lambda a, p: a + _gray(p["r"], p["g"], p["b"])).alias("s"),
        F.size("r").cast("long").alias("n"),
    )
    means = sums.groupBy("image_id", "__owner").agg(F.rint(F.sum("s") / F.sum("n")).alias("__mean"))
    with_mean = lookup_join(keyed, means, ["image_id", "__owner"])

    def recolor(p: Column) -> Column:
        f = lambda n: F.col(f"__{n}")
        con = F.struct(*[_mix255(p[c], f("mean"), f("contrast")).alias(c) for c in ("r", "g", "b")])

        def saturate(q: Column) -> Column:
            gray = _gray(q["r"], q["g"], q["b"])
            return F.struct(*[_mix255(q[c], gray, f("saturation")).alias(c) for c in ("r", "g", "b")])

        return let(let(con, saturate), lambda q: _hue_shift(q, f("hue")))

    done = with_mean.withColumn("__p", F.transform(pixels, recolor))
    return done.withColumns(
        {
            c: F.transform(F.col("__p").getField(c), lambda v: F.rint(v) if whole else v)
            for c in ("r", "g", "b")
        }
    ).drop("__p", "__mean", "__owner", *[f"__{k}" for k in factors])


# --- erase ------------------------------------------------------------------------------------


def mean_color(lines: DataFrame) -> DataFrame:
    """Mean of each channel of each image."""
    per_line = lines.select(
        "image_id", "ch",
        F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.size("vals").cast("long").alias("n"),
    )
    return per_line.groupBy("image_id", "ch").agg((F.sum("s") / F.sum("n")).alias("mean_color"))


def draw_rects(images: DataFrame, seed: int, epoch: int, params: AugmentParams) -> DataFrame:
    """Rectangles to erase, zero to ``erase_max`` per image header (image_id, h, w)."""
    key = F.col("image_id")
    n = F.when(
        _draw("erase?", seed, epoch) < params.erase_prob,
        _between(_draw("erase#", seed, epoch), 1, params.erase_max + 1),
    ).otherwise(0)
    u = lambda salt: uniform(salt, seed, F.lit(epoch), key, F.col("rect"))
    low, high = params.erase_bound
    rects = images.select("image_id", "h", "w", F.explode_outer(indices(n)).alias("rect")).filter("rect IS NOT NULL")
    return rects.select(
        "image_id",
        _between(u("x0"), 0, F.col("w")).alias("x0"),
        _between(u("y0"), 0, F.col("h")).alias("y0"),
        _between(u("dx"), low, high).alias("dx"),
        _between(u("dy"), low, high).alias("dy"),
    )


def erase(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Fill each rectangle with the mean colour the image had before erasing."""
    # few rectangles per image, so a list per image stays short
    per_image = rects.groupBy("image_id").agg(F.collect_list(F.struct("x0", "y0", "dx", "dy")).alias("__rects"))
    with_mean = lookup_join(lines, mean_color(lines), ["image_id", "ch"])
    with_rects = lookup_join(with_mean, per_image, ["image_id"], how="left")
    y = F.col("y")
    hits = F.filter("__rects", lambda r: (y >= r["y0"]) & (y < r["y0"] + r["dy"]))

    def blank(vals: Column, rs: Column) -> Column:
        inside = lambda x: F.exists(rs, lambda r: (x >= r["x0"]) & (x < r["x0"] + r["dx"]))
        return F.transform(vals, lambda v, x: F.when(inside(x), F.col("mean_color")).otherwise(v))

    erased = F.when(
        F.col("__rects").isNull(), F.col("vals")
    ).otherwise(let(hits, lambda rs: blank(F.col("vals"), rs)))
    return with_rects.withColumn("vals", erased).drop("mean_color", "__rects")


# --- space ------------------------------------------------------------------------------------


def scale_params(images: DataFrame, params: AugmentParams, seed: int, epoch: int = 0) -> DataFrame:
    """Adds ``sx, sy, scaled`` to image headers: drawn scales, never below what the crop needs."""
    need = F.greatest(
        F.lit(params.crop_height + 1.0) / F.col("h"), F.lit(params.crop_width + 1.0) / F.col("w")
    )
    u = lambda salt: _draw(salt, seed, epoch)
    if "scale" in params.steps:
        span = lambda salt, lo, hi: F.pow(F.lit(2.0), lo + u(salt) * (hi - lo))
        both = span("scale", params.min_scale, params.max_scale)
        stretch = F.lit(not params.sparse) & (u("stretch?") < params.stretch_prob)
        one = lambda salt: F.when(stretch, span(salt, -params.max_stretch, params.max_stretch)).otherwise(1.0)
        sx, sy = F.greatest(both * one("sx"), need), F.greatest(both * one("sy"), need)
        chosen = u("scale?") < params.scale_prob
    else:
        sx, sy, chosen = need, need, F.lit(False)
    scaled = chosen | (need > 1)
    return images.withColumns(
        {
            "sx": F.when(scaled, sx).otherwise(1.0),
            "sy": F.when(scaled, sy).otherwise(1.0),
            "scaled": scaled,
        }
    )


def rescale_dense(lines: DataFrame, sx: Column, sy: Column, kind: str = "image") -> DataFrame:
    """Scale images and confidence linearly, disparity with its values, masks by nearest pixel."""
    sized = lines.withColumns(
        {"__sx": sx, "__sy": sy}
    )
    out_h = F.rint(F.col("h") * F.col("__sy")).cast("int")
    out_w = F.rint(F.col("w") * F.col("__sx")).cast("int")
    if kind == "disp":
        sized = sized.withColumn(
            "vals", let(F.col("__sx"), lambda k: F.transform("vals", lambda v: v * k))
        )
    return resize(
        sized, out_h, out_w,
        mode="nearest" if kind == "mask" else "bilinear",
        rule="centers", ratio_y=F.col("__sy"), ratio_x=F.col("__sx"),
    )


def scatter_last(points: DataFrame, keys: Sequence[str], order: Column, value: str = "v") -> DataFrame:
    """Integer targets hit by several sources keep the last one."""
    return points.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def rescale_sparse_points(lines: DataFrame, fx: Column, fy: Column, disp: str = "disp", valid: str = "valid") -> DataFrame:
    """Valid disparities moved to rounded targets: one row per hit pixel (image_id, y, x, v).

    Targets in row or column 0 or beyond the new size are dropped; of several
    sources the last in reading order wins.
    """
    cells = F.filter(
        F.transform(
            F.arrays_zip(F.col(disp).alias("d"), F.col(valid).alias("m")),
            lambda c, x: F.struct(x.alias("x"), c["d"].alias("d"), c["m"].alias("m")),
        ),
        lambda c: F.coalesce(c["m"].cast("double") >= 0.5, F.lit(False)),
    )
    px = lines.select(
        "image_id", "y", "h", "w", fx.alias("fx"), fy.alias("fy"), F.explode_outer(cells).alias("c")
    ).filter("c IS NOT NULL")
    placed = px.select(
        "image_id",
        F.rint(F.col("y") * F.col("fy")).cast("int").alias("ty"),
        F.rint(F.col("c.x") * F.col("fx")).cast("int").alias("tx"),
        F.rint(F.col("h") * F.col("fy")).cast("int").alias("h"),
        F.rint(F.col("w") * F.col("fx")).cast("int").alias("w"),
        (F.col("c.d") * F.col("fx")).alias("v"),
        (F.col("y").cast("long") * F.col("w") + F.col("c.x")).alias("order"),
    ).filter("tx > 0 AND tx < w AND ty > 0 AND ty < h")
    hit = scatter_last(placed, ["image_id", "ty", "tx"], F.col("order"))
    return hit.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def rescale_sparse(lines: DataFrame, fx: Column, fy: Column, disp: str = "disp", valid: str = "valid") -> DataFrame:
    """:func:`rescale_sparse_points` as full lines: zero and invalid where nothing landed."""
    points = rescale_sparse_points(lines, fx, fy, disp, valid)
    per_line = points.groupBy("image_id", "y").agg(F.collect_list(F.struct("x", "v")).alias("__hits"))
    new_h = F.rint(F.col("h") * F.col("fy")).cast("int")
    new_w = F.rint(F.col("w") * F.col("fx")).cast("int")
    # each source line emits the target lines between its own and the next one's start
    rows = lines.select("image_id", "y", "h", "w", fx.alias("fx"), fy.alias("fy")).select(
        "image_id", F.col("y").alias("y0"), new_h.alias("h"), new_w.alias("w"),
        F.floor(F.col("y") * new_h / F.col("h")).cast("int").alias("lo"),
        F.floor((F.col("y") + 1) * new_h / F.col("h")).cast("int").alias("hi"),
    )
    grid = rows.filter("hi > lo").select(
        "image_id", F.explode_outer(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("y"), "h", "w"
    )
    joined = grid.join(per_line, ["image_id", "y"], "left")
    hits = F.transform(
        F.coalesce("__hits", F.array().cast("array<struct<x:int,v:double>>")),
        lambda p: F.struct(p["x"].alias("x"), F.lit(0).alias("miss"), p["v"].alias("v")),
    )
    blanks = F.transform(
        indices(F.col("w")), lambda x: F.struct(x.alias("x"), F.lit(1).alias("miss"), F.lit(0.0).alias("v"))
    )
    dense = joined.withColumn("__d", run_firsts(F.sort_array(F.concat(hits, blanks)), "x"))
    return dense.select(
        "image_id", "y", "h", "w",
        F.transform("__d", lambda p: p["v"]).alias("disp"),
        F.transform("__d", lambda p: p["miss"] == 0).alias("valid"),
    )


def crop_params(images: DataFrame, params: AugmentParams, seed: int, epoch: int = 0) -> DataFrame:
    """Adds the crop corner ``x0, y0`` and the right view's row ``y1`` to image headers."""
    h, w = F.col("h"), F.col("w")
    ch, cw = params.crop_height, params.crop_width
    if params.y_jitter and not params.sparse:
        jitter = F.least(F.lit(2), F.floor((h - ch) / 2).cast("int"))
    else:
        jitter = F.lit(0)
    y0 = _between(_draw("y0", seed, epoch), jitter, h - ch - jitter + 1)
    x0 = _between(_draw("x0", seed, epoch), 0, w - cw + 1)
    shift = _between(_draw("y1", seed, epoch), -jitter, jitter + 1)
    return images.withColumns({"x0": x0, "y0": y0}).withColumn("y1", (F.col("y0") + shift).cast("int"))


def random_crop(lines: DataFrame, corners: DataFrame, params: AugmentParams, right: bool = False) -> DataFrame:
    """Cut the drawn window; the right view starts at its jittered row."""
    row = "y1" if right else "y0"
    placed = lookup_join(lines, corners.select("image_id", "x0", F.col(row).alias("__y0")), ["image_id"])
    return crop(placed, F.col("__y0"), F.col("x0"), params.crop_height, params.crop_width)


def augment(
    rasters: dict[str, DataFrame], images: DataFrame, params: AugmentParams, seed: int, epoch: int = 0
) -> dict[str, DataFrame]:
    """Noise and blur, colour, erase, then scale and crop, on the rasters of a sample.

    Keys: ``left, right`` and optionally ``left_clean, right_clean, disp, conf,
    mask_nocc, mask_inpaint, valid``. Clean views skip everything but space.
    ``images(image_id, h, w)`` are the sample headers.
    """
    out = dict(rasters)
    right = out["right"]
    if "noise" in params.steps:
        noisy = add_noise(right, params.noise_std, seed, epoch)
        # read again for every image statistic below: storing it is cheaper than drawing it again
        right = pin(random_blur(noisy, params.blur_prob, seed, epoch))
    left = out["left"]
    if "color" in params.steps:
        truncated = lambda df: df.withColumn("vals", F.transform("vals", lambda v: F.floor(v).cast("double")))
        view = lambda df, name: channels_to_columns(truncated(df)).withColumn("view", F.lit(name))
        both = view(left, "left").unionByName(view(right, "right"))
        colored = pin(color_jitter(both, color_factors(seed, epoch, params)))
        left = columns_to_channels(colored.filter("view = 'left'"))
        right = columns_to_channels(colored.filter("view = 'right'"))
    if "erase" in params.steps:
        right = erase(right, draw_rects(images, seed, epoch, params))
    out["left"], out["right"] = left, right

    scales = scale_params(images, params, seed, epoch)
    kinds = {"disp": "disp", "valid": "mask", "mask_nocc": "mask", "mask_inpaint": "mask"}
    attach = lambda df: lookup_join(df, scales.select("image_id", "sx", "sy"), ["image_id"])
    if params.sparse:
        sparse = attach(
            out["disp"].withColumnRenamed("vals", "disp").join(
                out["valid"].select("image_id", "y", F.col("vals").alias("valid")), ["image_id", "y"]
            )
        )
        moved = rescale_sparse(sparse, F.col("sx"), F.col("sy"))
        out["disp"] = moved.select("image_id", F.lit(0).alias("ch"), "y", "h", "w", F.col("disp").alias("vals"))
        out["valid"] = moved.select(
            "image_id", F.lit(0).alias("ch"), "y", "h", "w",
            F.transform("valid", lambda m: m.cast("double")).alias("vals"),
        )
    for name, df in list(out.items()):
        if params.sparse and name in ("disp", "valid"):
            continue
        out[name] = rescale_dense(attach(df), F.col("sx"), F.col("sy"), kinds.get(name, "image"))

    sized = scales.select(
        "image_id",
        F.rint(F.col("h") * F.col("sy")).cast("int").alias("h"),
        F.rint(F.col("w") * F.col("sx")).cast("int").alias("w"),
    )
    corners = crop_params(sized, params, seed, epoch)
    return {name: random_crop(df, corners, params, right=name == "right") for name, df in out.items()}
