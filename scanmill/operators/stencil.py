"""Neighbourhood operators over image lines.

Looking up and down needs neighbouring lines. Lines are grouped by bands of
consecutive rows, each band carrying a few lines of its neighbours, so a window
holds one band and never a whole image; the copies cost about 2*radius/band of
the data. Looking left and right is an array expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.functions.arrays import indices, let
from scanmill.operators.lookup import lookup_join

BAND = 64


def _reflect(i: Column, n: Column) -> Column:
    """Mirror without repeating the border sample."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def _edge(i: Column, n: Column) -> Column:
    return F.least(F.greatest(i, F.lit(0)), n - 1)


_BORDER = {"reflect": _reflect, "edge": _edge}


def with_rows_around(
    lines: DataFrame,
    cols: Sequence[str],
    radius: int,
    border: str,
    band: int = BAND,
    keys: Sequence[str] = ("image_id", "ch"),
) -> DataFrame:
    """Add ``{col}_rows``: the 2*radius+1 arrays around each line, top to bottom.

    ``border`` says what stands for rows outside the image: ``reflect`` mirrors
    without repeating the edge, ``edge`` repeats it, ``none`` gives null.
    """
    y = F.col("y")
    last_band = F.floor((F.col("h") - 1) / band)
    bands = F.sequence(
        F.greatest(F.floor((y - radius) / band), F.lit(0)).cast("int"),
        F.least(F.floor((y + radius) / band), last_band).cast("int"),
    )
    spread = lines.withColumn("__band", F.explode_outer(bands))
    around = (
        Window.partitionBy(*keys, "__band").orderBy("y").rowsBetween(-radius, radius)
    )
    near = F.collect_list(F.struct("y", *cols)).over(around)
    held = spread.withColumn("__near", near).filter(F.floor(y / band) == F.col("__band"))

    def pick(col: str) -> Column:
        first_y = F.get("__near", F.lit(0))["y"]

        def row(k: Column) -> Column:
            at = y + k
            if border in _BORDER:
                return F.get("__near", (_BORDER[border](at, F.col("h")) - first_y).cast("int"))[col]
            inside = (at >= 0) & (at < F.col("h"))
            return F.when(inside, F.get("__near", (at - first_y).cast("int"))[col])

        return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), row)

    return held.withColumns({f"{c}_rows": pick(c) for c in cols}).drop("__band", "__near")


def _sum_rows(rows: Column, width: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(
        rows, F.array_repeat(F.lit(0.0), width), lambda acc, r: F.zip_with(acc, r, lambda a, v: a + f(v))
    )


def slide(values: Column, width: Column, radius: int, border: str) -> Column:
    """Sum over the 2*radius+1 samples around each position of one line."""
    at = _BORDER[border]

    def around(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(-radius), F.lit(radius)),
            F.lit(0.0),
            lambda acc, k: acc + F.get(values, at(x + k, width).cast("int")),
        )

    return F.transform(indices(width), around)


def box_mean(lines: DataFrame, col: str = "vals", radius: int = 3) -> DataFrame:
    """Mean over a square window with mirrored borders (separable: rows, then columns)."""
    around = with_rows_around(lines, [col], radius, "reflect")
    area = float((2 * radius + 1) ** 2)
    summed = around.withColumn(col, _sum_rows(F.col(f"{col}_rows"), F.col("w"))).drop(f"{col}_rows")
    meaned = let(F.col(col), lambda s: F.transform(slide(s, F.col("w"), radius, "reflect"), lambda v: v / area))
    return summed.withColumn(col, meaned)


def dilate(lines: DataFrame, iterations: int = 1) -> DataFrame:
    """Maximum over the plus-shaped 5-neighbourhood, repeated."""
    out = lines
    for _ in range(iterations):
        near = with_rows_around(out, ["vals"], 1, "none")
        rows = F.col("vals_rows")
        up, down = F.get(rows, F.lit(0)), F.get(rows, F.lit(2))
        # greatest ignores nulls, so missing neighbours drop out
        best = let(
            F.col("vals"),
            lambda mid: F.transform(
                mid,
                lambda v, x: F.greatest(
                    v, F.get(mid, x - 1), F.get(mid, x + 1), F.get(up, x), F.get(down, x)
                ),
            ),
        )
        out = near.withColumn("vals", best).drop("vals_rows")
    return out


def sobel(lines: DataFrame, out: str = "magnitude") -> DataFrame:
    """Gradient magnitude: smoothed differences in x and y, borders repeated, root mean square."""
    near = with_rows_around(lines, ["vals"], 1, "edge")
    up, mid, down = (F.get("vals_rows", F.lit(i)) for i in range(3))
    # down the rows first: a smoothed and a differenced line, then across
    smooth = let(
        up, lambda u: let(down, lambda d: F.transform(mid, lambda m, x: F.get(u, x) + 2 * m + F.get(d, x)))
    )
    steep = F.zip_with(down, up, lambda d, u: d - u)
    staged = near.withColumns({"__smooth": smooth, "__steep": steep})

    def at(x: Column, s: Column, t: Column) -> Column:
        left, right = F.greatest(x - 1, F.lit(0)), F.least(x + 1, F.col("w") - 1)
        gx = (F.get(s, right) - F.get(s, left)) / 4
        gy = (F.get(t, left) + 2 * F.get(t, x) + F.get(t, right)) / 4
        return F.hypot(gx, gy) / math.sqrt(2.0)

    slope = let(
        F.col("__smooth"),
        lambda s: let(F.col("__steep"), lambda t: F.transform(indices(F.col("w")), lambda x: at(x, s, t))),
    )
    return staged.withColumn(out, slope).drop("vals_rows", "__smooth", "__steep")


def pool_pairs(values: Column) -> Column:
    """Mean of neighbouring pairs; an odd last sample is dropped."""
    return let(
        values,
        lambda vs: F.transform(
            indices(F.floor(F.size(vs) / 2)), lambda i: (F.get(vs, 2 * i) + F.get(vs, 2 * i + 1)) / 2
        ),
    )


def avg_pool_x(lines: DataFrame, col: str = "vals") -> DataFrame:
    return lines.withColumn(col, pool_pairs(F.col(col))).withColumn("w", F.size(col))


def avg_pool(lines: DataFrame, k: int, stride: int, padding: int) -> DataFrame:
    """k x k mean with a stride; padding counts as zeros.

    Pooled in x first, so the lines that are re-keyed are already shorter.
    """
    out_size = lambda n: F.floor((n + 2 * padding - k) / stride + 1).cast("int")
    x_sums = let(
        F.col("vals"),
        lambda vs: F.transform(
            indices(out_size(F.col("w"))),
            lambda o: F.aggregate(
                F.sequence(o * stride - padding, o * stride - padding + (k - 1)),
                F.lit(0.0),
                lambda acc, x: acc + F.coalesce(F.get(vs, x), F.lit(0.0)),
            ),
        ),
    )
    low = F.greatest(F.ceil((F.col("y") + padding - (k - 1)) / stride), F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("y") + padding) / stride), out_size(F.col("h")) - 1).cast("int")
    targets = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    pooled = lines.select(
        "image_id",
        "ch",
        "y",
        x_sums.alias("__sums"),
        targets.alias("__targets"),
        out_size(F.col("h")).alias("__h"),
        out_size(F.col("w")).alias("__w"),
    )
    spread = pooled.select(
        "image_id",
        "ch",
        F.explode_outer("__targets").alias("__oy"),
        F.col("__h").alias("h"),
        F.col("__w").alias("w"),
        F.struct("y", F.col("__sums").alias("vals")).alias("src"),
    ).filter("__oy IS NOT NULL")
    grouped = spread.groupBy("image_id", "ch", "__oy", "h", "w").agg(
        F.sort_array(F.collect_list("src")).alias("__rows")  # at most k lines
    )
    summed = F.aggregate(
        F.col("__rows"),
        F.array_repeat(F.lit(0.0), F.col("w")),
        lambda acc, r: F.zip_with(acc, r["vals"], lambda a, v: a + v),
    )
    return grouped.select(
        "image_id", "ch", F.col("__oy").alias("y"), "h", "w",
        F.transform(summed, lambda v: v / float(k * k)).alias("vals"),
    )


def gauss_blur(lines: DataFrame, n: int = 5, std: Column | float = 1.0, border: str = "zero") -> DataFrame:
    """Normalised n x n Gaussian. ``std`` may be a per-image column; 0 leaves the image alone."""
    r = n // 2
    sigma = std if isinstance(std, Column) else F.lit(float(std))
    sized = lines.withColumn("__std", sigma)
    raw = F.transform(
        F.sequence(F.lit(-r), F.lit(r)),
        lambda k: F.exp(-(k * k) / (2 * F.greatest(F.col("__std"), F.lit(1e-6)) ** 2)),
    )
    kernel = let(raw, lambda g: F.transform(g, lambda v: v / F.aggregate(g, F.lit(0.0), lambda a, q: a + q)))
    near = with_rows_around(sized, ["vals"], r, "none" if border == "zero" else border)
    near = near.withColumn("__kernel", kernel)
    down = F.aggregate(
        F.arrays_zip(F.col("vals_rows").alias("row"), F.col("__kernel").alias("k")),
        F.array_repeat(F.lit(0.0), F.col("w")),
        lambda acc, e: F.when(e["row"].isNull(), acc).otherwise(
            F.zip_with(acc, e["row"], lambda a, v: a + e["k"] * v)
        ),
    )

    def across(line: Column, weights: Column) -> Column:
        def tap(x: Column, k: Column) -> Column:
            at = x + k
            if border == "zero":
                value = F.coalesce(F.get(line, at), F.lit(0.0))
            else:
                value = F.get(line, _BORDER[border](at, F.col("w")).cast("int"))
            return value * F.get(weights, k + r)

        return F.transform(
            indices(F.col("w")),
            lambda x: F.aggregate(
                F.sequence(F.lit(-r), F.lit(r)), F.lit(0.0), lambda acc, k: acc + tap(x, k)
            ),
        )

    blurred = let(down, lambda line: let(F.col("__kernel"), lambda wt: across(line, wt)))
    return near.withColumn("vals", blurred).drop("vals_rows", "__kernel", "__std")


ITER_BLOCK = 256


def refine(start: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction at each iteration: the start plus all updates up to it.

    The running sum is taken in blocks of iterations, plus the total of the
    blocks before, so a key with very many updates is spread over its blocks.
    """
    blocked = updates.withColumn("__block", F.floor(F.col("iter") / ITER_BLOCK))
    totals = blocked.groupBy(*keys, "__block").agg(F.sum("delta").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(earlier), F.lit(0.0)).alias("__before"))
    running = (
        Window.partitionBy(*keys, "__block").orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = blocked.join(before, [*keys, "__block"]).withColumn("__sum", F.sum("delta").over(running))
    joined = lookup_join(summed, start, list(keys))
    return joined.withColumn("disp", F.col("disp") + F.col("__before") + F.col("__sum")).drop(
        "__sum", "__before", "__block", "delta"
    )


def final_prediction(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.max_by("disp", "iter").alias("disp"))
