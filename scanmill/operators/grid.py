"""Rasters as tables: pixel rows, image lines, tiles, padding, cropping and resizing.

The working grain is one row per image line,
``lines(image_id, ch, y, h, w, vals array<double>)``. Operators that look along
a line are plain array expressions and need no shuffle; operators that change
rows re-key whole lines, so what is shuffled is arrays, not pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import indices, let
from scanmill.functions.scalar import pad_amounts

LINE_KEY = ["image_id", "ch", "y"]


def to_pixels(lines: DataFrame, cols: Sequence[str] = ("vals",), names: Sequence[str] = ("v",)) -> DataFrame:
    """One row per pixel; several line arrays become several pixel columns."""
    keys = [c for c in LINE_KEY if c in lines.columns]
    if len(cols) == 1:
        return lines.select(*keys, F.posexplode_outer(cols[0]).alias("x", names[0]))
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(cols, names)])
    out = lines.select(*keys, F.posexplode_outer(zipped).alias("x", "__p"))
    return out.select(*keys, "x", *[F.col("__p").getField(n).alias(n) for n in names])


def to_lines(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Collect pixels to lines; a line is bounded by the image width."""
    ordered = F.sort_array(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    lines = pixels.groupBy(*LINE_KEY).agg(F.transform(ordered, lambda p: p["v"]).alias("vals"))
    return lines.withColumn("w", F.size("vals"))


def heights(lines: DataFrame) -> DataFrame:
    """Image headers (height) where the source did not state them."""
    return lines.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("h"))


def coords_grid(images: DataFrame) -> DataFrame:
    """All (y, x) of each image header row (image_id, h, w)."""
    rows = images.select("image_id", "w", F.explode_outer(indices(F.col("h"))).alias("y"))
    return rows.select("image_id", "y", F.explode_outer(indices(F.col("w"))).alias("x"))


def flip_x(lines: DataFrame, col: str = "vals") -> DataFrame:
    return lines.withColumn(col, F.reverse(col))


def flip_y(lines: DataFrame) -> DataFrame:
    return lines.withColumn("y", F.col("h") - 1 - F.col("y"))


def first_channels(df: DataFrame, n: int = 3) -> DataFrame:
    """Drop what lies beyond the colour channels, such as alpha."""
    return df.filter(F.col("ch") < n)


def reverse_channels(df: DataFrame, n: int = 3) -> DataFrame:
    return df.withColumn("ch", (F.lit(n - 1) - F.col("ch")).cast("int"))


def channels_to_columns(lines: DataFrame, names: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Channel-first rows to one row per line with an array column per channel."""
    return lines.groupBy("image_id", "y").agg(
        F.first("h").alias("h"),
        F.first("w").alias("w"),
        *[F.max(F.when(F.col("ch") == i, F.col("vals"))).alias(n) for i, n in enumerate(names)],
    )


def columns_to_channels(df: DataFrame, names: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(i).alias("ch"), F.col(n).alias("vals")) for i, n in enumerate(names)])
    return df.select("image_id", "y", "h", "w", F.explode_outer(packed).alias("c")).select(
        "image_id", F.col("c.ch").alias("ch"), "y", "h", "w", F.col("c.vals").alias("vals")
    )


def align(rasters: dict[str, DataFrame], missing: str = "drop") -> DataFrame:
    """Bring the single-channel rasters of a sample side by side, one array column each.

    One shuffle on (image_id, y) for all of them: the rasters are stacked and
    grouped rather than joined pairwise. A line that one raster has twice fails the job. One that
    a raster lacks is left out, and :func:`misaligned` names it; with ``missing="fail"``, as the
    composed jobs ask, it fails the job too.
    """
    if missing not in ("fail", "drop"):
        raise ValueError(f"missing must be fail or drop, not {missing}")
    stacked = None
    for name, lines in rasters.items():
        part = lines.select("image_id", "y", "h", "w", F.lit(name).alias("__role"), "vals")
        stacked = part if stacked is None else stacked.unionByName(part)
    def only(name: str) -> Column:
        line = F.when(F.col("__role") == name, F.col("vals"))
        place = F.concat_ws(" ", F.first("image_id").cast("string"), F.first("y").cast("string"))
        stop = lambda what: F.raise_error(F.concat(F.lit(f"{name} {what} line of image, y: "), place)).cast("array<double>")
        once = F.when(F.count(line) > 1, stop("has more than one")).otherwise(F.max(line))
        return (F.coalesce(once, stop("lacks a")) if missing == "fail" else once).alias(name)

    out = stacked.groupBy("image_id", "y").agg(F.max("h").alias("h"), F.max("w").alias("w"), *[only(n) for n in rasters])
    return out if missing == "fail" else out.dropna(subset=list(rasters))


def misaligned(rasters: dict[str, DataFrame]) -> DataFrame:
    """Lines that not every raster has once: image_id, y and the number of lines of each raster."""
    stacked = None
    for name, lines in rasters.items():
        part = lines.select("image_id", "y", F.lit(name).alias("__role"))
        stacked = part if stacked is None else stacked.unionByName(part)
    counts = [F.count(F.when(F.col("__role") == n, 1)).alias(f"n_{n}") for n in rasters]
    off = F.lit(False)
    for n in rasters:
        off = off | (F.col(f"n_{n}") != 1)
    return stacked.groupBy("image_id", "y").agg(*counts).filter(off)


# --- padding and cropping ---------------------------------------------------------------------


def pad(lines: DataFrame, k: int, mode: str = "even") -> DataFrame:
    """Replicate-pad to multiples of ``k``.

    Border lines emit their own copies, so no join against a padded grid is needed.
    """
    p = pad_amounts(F.col("w"), F.col("h"), k, mode)
    wide = F.concat(
        F.array_repeat(F.get("vals", F.lit(0)), p["left"]),
        F.col("vals"),
        F.array_repeat(F.get("vals", F.col("w") - 1), p["right"]),
    )
    top, bottom = p["top"], p["bottom"]
    first = F.when(F.col("y") == 0, F.lit(0)).otherwise(F.col("y") + top)
    last = F.when(F.col("y") == F.col("h") - 1, F.col("h") - 1 + top + bottom).otherwise(F.col("y") + top)
    return lines.select(
        "image_id",
        "ch",
        F.explode_outer(F.sequence(first.cast("int"), last.cast("int"))).alias("y"),
        (F.col("h") + top + bottom).cast("int").alias("h"),
        (F.col("w") + p["left"] + p["right"]).cast("int").alias("w"),
        wide.alias("vals"),
    )


def unpad(lines: DataFrame, height: Column, width: Column, k: int, mode: str = "even") -> DataFrame:
    """Undo :func:`pad`, given the size before padding."""
    p = pad_amounts(width, height, k, mode)
    kept = lines.filter((F.col("y") >= p["top"]) & (F.col("y") < p["top"] + height))
    return kept.select(
        "image_id",
        "ch",
        (F.col("y") - p["top"]).cast("int").alias("y"),
        height.cast("int").alias("h"),
        width.cast("int").alias("w"),
        F.slice("vals", p["left"] + 1, width.cast("int")).alias("vals"),
    )


def crop(lines: DataFrame, y0: Column, x0: Column, height: int, width: int) -> DataFrame:
    """Rectangle starting at (y0, x0); the offsets may differ per image."""
    kept = lines.filter((F.col("y") >= y0) & (F.col("y") < y0 + height))
    return kept.select(
        "image_id",
        "ch",
        (F.col("y") - y0).cast("int").alias("y"),
        F.least(F.lit(height), F.col("h") - y0).cast("int").alias("h"),
        F.least(F.lit(width), F.col("w") - x0).cast("int").alias("w"),
        F.slice("vals", (x0 + 1).cast("int"), F.lit(width)).alias("vals"),
    )


# --- tiles ------------------------------------------------------------------------------------


def split_tiles(lines: DataFrame, p: int, border: str = "fail") -> DataFrame:
    """Non-overlapping p x p tiles. ``token`` is the row-major tile number.

    Sizes must divide, as a network's patches ask; with ``border="keep"`` they need not, and the last
    tiles of a line or column hold what is there.
    """
    if border not in ("fail", "keep"):
        raise ValueError(f"border must be fail or keep, not {border}")
    checked = F.col("vals")
    if border == "fail":
        divides = (F.pmod(F.col("h"), F.lit(p)) == 0) & (F.pmod(F.col("w"), F.lit(p)) == 0)
        checked = F.when(divides, checked).otherwise(
            F.raise_error(F.lit(f"image size is not a multiple of {p}")).cast("array<double>")
        )
    across = F.ceil(F.col("w") / p).cast("int")
    pieces = F.transform(
        indices(across),
        lambda t: F.struct(t.alias("tile_x"), F.slice(checked, t * p + 1, F.lit(p)).alias("part")),
    )
    parts = lines.select(
        "image_id",
        "ch",
        F.floor(F.col("y") / p).cast("int").alias("tile_y"),
        F.pmod(F.col("y"), F.lit(p)).alias("__row"),
        across.alias("__across"),
        "h",
        "w",
        F.explode_outer(pieces).alias("__t"),
    )
    rows = F.sort_array(F.collect_list(F.struct("__row", F.col("__t.part").alias("part"))))
    return (
        parts.groupBy("image_id", "ch", "tile_y", F.col("__t.tile_x").alias("tile_x"), "__across", "h", "w")
        .agg(F.flatten(F.transform(rows, lambda r: r["part"])).alias("vals"))
        .withColumn("token", F.col("tile_y") * F.col("__across") + F.col("tile_x"))
        .drop("__across")
    )


def join_tiles(tiles: DataFrame, p: int) -> DataFrame:
    """Put tiles back together into lines; tiles at the border may be smaller."""
    high = F.least(F.lit(p), F.col("h") - F.col("tile_y") * p)
    wide = F.least(F.lit(p), F.col("w") - F.col("tile_x") * p)
    rows = F.transform(
        indices(high),
        lambda r: F.struct(r.alias("row"), F.slice("vals", r * wide + 1, wide).alias("part")),
    )
    parts = tiles.select("image_id", "ch", "tile_y", "tile_x", "h", "w", F.explode_outer(rows).alias("__r"))
    across = F.sort_array(F.collect_list(F.struct("tile_x", F.col("__r.part").alias("part"))))
    y = (F.col("tile_y") * p + F.col("__r.row")).cast("int").alias("y")
    return parts.groupBy("image_id", "ch", y, "h", "w").agg(
        F.flatten(F.transform(across, lambda r: r["part"])).alias("vals")
    )


# --- resizing ---------------------------------------------------------------------------------

_CUBIC = -0.75  # fixed value: sharpness of the cubic kernel used by the common image libraries


def _source(t: Column, size_in: Column, size_out: Column, ratio: Column, rule: str) -> Column:
    t = t.cast("double")
    if rule == "corners":
        return F.when(size_out > 1, t * (size_in - 1) / F.greatest(size_out - 1, F.lit(1))).otherwise(0.0)
    return (t + 0.5) / ratio - 0.5


def _target(s: Column, size_in: Column, size_out: Column, ratio: Column, rule: str) -> Column:
    if rule == "corners":
        return s * (size_out - 1) / F.greatest(size_in - 1, F.lit(1))
    return (s + 0.5) * ratio - 0.5


def _weights(frac: Column, mode: str) -> list[tuple[int, Column]]:
    """(offset, weight) of the taps around the base sample."""
    if mode == "bilinear":
        return [(0, 1 - frac), (1, frac)]
    near = lambda d: ((_CUBIC + 2) * d - (_CUBIC + 3)) * d * d + 1
    far = lambda d: ((_CUBIC * d - 5 * _CUBIC) * d + 8 * _CUBIC) * d - 4 * _CUBIC
    return [(-1, far(frac + 1)), (0, near(frac)), (1, near(1 - frac)), (2, far(2 - frac))]


def _nearest_index(t: Column, size_in: Column, ratio: Column) -> Column:
    return F.least(F.floor(t / ratio).cast("int"), size_in - 1)


def resize(
    lines: DataFrame,
    out_h: Column | int,
    out_w: Column | int,
    mode: str = "bilinear",
    rule: str = "corners",
    ratio_y: Column | None = None,
    ratio_x: Column | None = None,
) -> DataFrame:
    """Resample lines to ``out_h`` x ``out_w`` (numbers or per-image columns).

    ``rule`` picks the coordinates: ``corners`` maps corner pixels onto each
    other, ``centers`` maps pixel centres with borders repeated. ``ratio_*`` is
    the scale of the ``centers`` rule and of nearest sampling when it is not
    exactly out/in. Each line is resampled in x first; then it emits itself to
    the target lines it contributes to, at most 2 (bilinear) or 4 (bicubic)
    source lines meeting per target line.
    """
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    sized = lines.select(
        "image_id", "ch", "y", "h", "w", "vals",
        as_col(out_h).alias("__oh"),
        as_col(out_w).alias("__ow"),
        (ratio_y if ratio_y is not None else as_col(out_h) / F.col("h")).alias("__ry"),
        (ratio_x if ratio_x is not None else as_col(out_w) / F.col("w")).alias("__rx"),
    )
    h, w, oh, ow, ry, rx = (F.col(c) for c in ("h", "w", "__oh", "__ow", "__ry", "__rx"))

    if mode == "nearest":
        wide = let(
            F.col("vals"),
            lambda vs: F.transform(indices(ow), lambda t: F.get(vs, _nearest_index(t, w, rx))),
        )
        # line y serves every target line whose nearest source it is
        lo = F.greatest(F.floor(F.col("y") * ry).cast("int") - 1, F.lit(0))
        hi = F.when(F.col("y") == h - 1, oh - 1).otherwise(
            F.least(F.ceil((F.col("y") + 1) * ry).cast("int") + 1, oh - 1)
        )
        span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        served = F.filter(span, lambda t: _nearest_index(t, h, ry) == F.col("y"))
        picked = sized.select("image_id", "ch", "__oh", "__ow", served.alias("__served"), wide.alias("vals"))
        return picked.select(
            "image_id", "ch", F.explode_outer("__served").alias("y"), oh.alias("h"), ow.alias("w"), "vals"
        ).filter("y IS NOT NULL")

    def at(source: Column, vs: Column) -> Column:
        base = F.floor(source).cast("int")
        picks = [
            wt * F.get(vs, F.least(F.greatest(base + k, F.lit(0)), w - 1))
            for k, wt in _weights(source - F.floor(source), mode)
        ]
        out = picks[0]
        for p in picks[1:]:
            out = out + p
        return out

    wide = let(
        F.col("vals"),
        lambda vs: F.transform(
            indices(ow), lambda t: let(_source(t, w, ow, rx, rule), lambda s: at(s, vs))
        ),
    )
    y = F.col("y")
    lo = F.greatest(F.floor(_target(y - 3.0, h, oh, ry, rule)).cast("int") - 1, F.lit(0))
    hi = F.least(F.ceil(_target(y + 3.0, h, oh, ry, rule)).cast("int") + 1, oh - 1)
    whole = F.when(h == 1, F.sequence(F.lit(0), F.greatest(oh - 1, F.lit(0))))
    span = whole.otherwise(
        F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    )

    def hits(t: Column) -> Column:
        def of(source: Column) -> Column:
            base = F.floor(source).cast("int")
            # weight of this line in target line t: taps clamped onto it add up
            share = [
                F.when(F.least(F.greatest(base + k, F.lit(0)), h - 1) == y, wt).otherwise(0.0)
                for k, wt in _weights(source - F.floor(source), mode)
            ]
            out = share[0]
            for s in share[1:]:
                out = out + s
            return F.struct(t.alias("t"), out.alias("wt"))

        return let(_source(t, h, oh, ry, rule), of)

    targets = F.filter(F.transform(span, hits), lambda s: s["wt"] != 0)
    shares = sized.select("image_id", "ch", "y", "__oh", "__ow", wide.alias("__wide"), targets.alias("__targets"))
    spread = (
        shares.select("image_id", "ch", "y", "__oh", "__ow", "__wide", F.explode_outer("__targets").alias("__t"))
        .filter("__t IS NOT NULL")
        .select(
            "image_id",
            "ch",
            F.col("__t.t").alias("t"),
            oh.alias("h"),
            ow.alias("w"),
            F.struct("y", F.col("__t.wt").alias("wt"), F.col("__wide").alias("vals")).alias("src"),
        )
    )
    # at most four source lines per target line
    rows = F.sort_array(F.collect_list("src"))
    return (
        spread.groupBy("image_id", "ch", "t", "h", "w")
        .agg(rows.alias("__rows"))
        .select("image_id", "ch", F.col("t").alias("y"), "h", "w", _mix("__rows").alias("vals"))
    )


def _mix(rows: str) -> Column:
    return F.aggregate(
        F.col(rows),
        F.array_repeat(F.lit(0.0), F.col("w")),
        lambda acc, r: F.zip_with(acc, r["vals"], lambda a, v: a + r["wt"] * v),
    )


def resize_disparity(lines: DataFrame, out_h: Column | int, out_w: Column | int, **how) -> DataFrame:
    """Resize a disparity raster; values scale with the width."""
    as_col = (out_w if isinstance(out_w, Column) else F.lit(out_w)).cast("double")
    scaled = lines.withColumn(
        "vals", let(as_col / F.col("w"), lambda k: F.transform("vals", lambda v: v * k))
    )
    return resize(scaled, out_h, out_w, **how)
