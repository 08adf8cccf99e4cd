"""From predicted inverse depth to disparity, confidence and clean edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.functions.arrays import let
from scanmill.functions.scalar import uniform
from scanmill.operators.envelope import forward_interpolate  # noqa: F401
from scanmill.operators.lookup import lookup_join
from scanmill.operators.stencil import dilate, sobel, with_rows_around

EDGE_LIMIT = 3.0  # fixed value: gradient magnitude above which a disparity edge is cut


def minmax(lines: DataFrame, cols: Sequence[str] = ("vals",), by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Smallest and largest value per image: reduced per line first, then over lines."""
    per_line = lines.select(
        *by,
        *[F.array_min(c).alias(f"{c}_lo") for c in cols],
        *[F.array_max(c).alias(f"{c}_hi") for c in cols],
    )
    return per_line.groupBy(*by).agg(
        *[F.min(f"{c}_lo").alias(f"{c}_min") for c in cols],
        *[F.max(f"{c}_hi").alias(f"{c}_max") for c in cols],
    )


def _scaled(v: Column, low: Column, high: Column) -> Column:
    # a constant image has no range: its normalised values are null
    return F.when(high > low, (v - low) / (high - low))


def _normalise(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    with_range = lookup_join(lines, minmax(lines, cols), ["image_id"])
    def scale(c: str) -> Column:
        return F.transform(c, lambda v: _scaled(v, F.col(f"{c}_min"), F.col(f"{c}_max")))

    scaled = {c: scale(c) for c in cols}
    return with_range.withColumns(scaled).drop(*[f"{c}_{e}" for c in cols for e in ("min", "max")])


def normalize_depth(lines: DataFrame, col: str = "vals") -> DataFrame:
    """Scale each image to 0..1."""
    return _normalise(lines, [col])


def confidence(lines: DataFrame, depth: str = "depth", flipped: str = "depth_flipped") -> DataFrame:
    """Agreement of the depth of an image with the depth of its mirror image.

    ``flipped`` holds the prediction on the mirrored image; each line is mirrored
    back here. Adds ``conf`` in 0..1 and leaves ``depth`` normalised.
    """
    back = lines.withColumn(flipped, F.reverse(flipped))
    both = _normalise(back, [depth, flipped])
    raw = both.withColumn("conf", F.zip_with(depth, flipped, lambda a, b: 1 - F.abs(a - b)))
    return _normalise(raw, ["conf"])


def disparity_scale(width: Column, u1: Column, u2: Column, a: float = 0.1, b: float = 0.05) -> Column:
    """Largest disparity of an image, drawn from a range relative to its width.

    ``u1`` picks the range (mostly middle, sometimes near, sometimes far) and
    ``u2`` the place in it.
    """
    low = (
        F.when(u1 < 0.1, F.lit(min(a - 2 * b, 0.01)))
        .when(u1 > 0.9, F.lit(a + b))
        .otherwise(F.lit(a - b))
        * width
    )
    high = (
        F.when(u1 < 0.1, F.lit(a - b)).when(u1 > 0.9, F.lit(a + 2 * b)).otherwise(F.lit(a + b)) * width
    )
    return low + u2 * (high - low)


def adaptive_disparity(
    lines: DataFrame,
    depth: str = "vals",
    out: str = "disp",
    u1: Column | None = None,
    u2: Column | None = None,
    seed: int = 0,
    a: float = 0.1,
    b: float = 0.05,
) -> DataFrame:
    """Scale normalised depth to a disparity range drawn per image.

    Draws are given as columns, or come from a hash of the seed and the image.
    """
    u1 = u1 if u1 is not None else uniform("range", seed, F.col("image_id"))
    u2 = u2 if u2 is not None else uniform("place", seed, F.col("image_id"))
    factor = disparity_scale(F.col("w"), u1, u2, a, b)
    return lines.withColumn("__k", factor).withColumn(
        out, let(F.col("__k"), lambda k: F.transform(depth, lambda d: d * k))
    ).drop("__k")


def cut_edges(lines: DataFrame, iterations: int = 1, limit: float = EDGE_LIMIT) -> DataFrame:
    """Dilate the disparity and mark the pixels on its steep edges as holes (zero, ``hole``)."""
    edged = sobel(dilate(lines, iterations))
    hole = F.transform("magnitude", lambda m: m > limit)
    cut = edged.withColumn("hole", hole)
    return cut.withColumn(
        "vals", F.zip_with("vals", "hole", lambda v, h: F.when(h, 0.0).otherwise(v))
    ).drop("magnitude")


def nearest_fill(lines: DataFrame, hole: str = "hole", fill_value: float | None = None) -> DataFrame:
    """Give each hole the value of the nearest known pixel; ties go to the smaller (y, x).

    Exact, without comparing holes to all known pixels. In the first step every
    hole finds the nearest known pixel above and below in its own column. Only
    known pixels that touch a hole can be such an answer, so just holes and
    their border are exploded; a window holds one column of one image. In the
    second step each line has, per column, the vertical distance to that pixel,
    and a hole only looks as far sideways as its own vertical distance.
    A hole of an image without known pixels gets ``fill_value`` (null by default).
    """
    rest = [c for c in lines.columns if c not in ("image_id", "ch", "y")]
    base = lines.withColumn("__known", F.transform(hole, lambda h: ~h))
    near = with_rows_around(base, ["__known"], 1, "none")
    up, down = F.get("__known_rows", F.lit(0)), F.get("__known_rows", F.lit(2))

    def role(v: Column, x: Column, known: Column, above: Column, below: Column) -> Column:
        # the answer for a hole in this column lies at the end of a vertical run of holes
        border = ~F.coalesce(F.get(above, x), F.lit(True)) | ~F.coalesce(F.get(below, x), F.lit(True))
        is_known = F.get(known, x)
        return F.when(~is_known | border, F.struct(x.alias("x"), is_known.alias("known"), v.alias("v")))

    marks = let(
        F.col("__known"),
        lambda kn: let(
            up,
            lambda a: let(
                down,
                lambda b: F.filter(
                    F.transform("vals", lambda v, x: role(v, x, kn, a, b)), lambda e: e.isNotNull()
                ),
            ),
        ),
    )
    # The line itself travels with its marks, under a column number of its own, so
    # that what comes before this step is computed once and not joined back.
    itself = F.array(
        F.struct(
            (-1 - F.col("y")).alias("x"), F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("double").alias("v")
        )
    )
    marked = (
        near.withColumn("__line", F.struct(*rest))
        .select("image_id", "ch", "y", "__line", F.explode_outer(F.concat(itself, marks)).alias("e"))
        .select(
            "image_id", "ch", "y", "e.x", "e.known", "e.v", F.when(F.col("e.x") < 0, F.col("__line")).alias("__line")
        )
    )
    column = Window.partitionBy("image_id", "ch", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = F.when(F.col("known"), F.struct("y", "v"))
    # both directions look back over a growing frame, which costs one step per row
    found = (
        marked.withColumn("__source", source)
        .withColumn("a", F.last("__source", ignorenulls=True).over(column.orderBy("y")))
        .withColumn("b", F.last("__source", ignorenulls=True).over(column.orderBy(F.col("y").desc())))
        .filter((F.col("x") < 0) | ~F.col("known"))
    )
    gap = lambda s: (F.col("y") - s["y"]).cast("long")
    a, b = F.col("a"), F.col("b")
    # of two equally far pixels of a column the upper one wins
    use_above = a.isNotNull() & (b.isNull() | (F.abs(gap(a)) <= F.abs(gap(b))))
    chosen = F.when(use_above, a).otherwise(b)
    answer_of = F.when(F.col("x") >= 0, F.struct("x", F.col("s.y").alias("sy"), F.col("s.v").alias("v")))
    joined = (
        found.select("image_id", "ch", "y", "x", "__line", chosen.alias("s"))
        .groupBy("image_id", "ch", "y")
        .agg(
            F.first("__line", ignorenulls=True).alias("__line"),
            F.sort_array(F.collect_list(answer_of)).alias("__holes"),
        )
        .select("image_id", "ch", "y", *[F.col("__line").getField(c).alias(c) for c in rest], "__holes")
    )
    y = F.col("y")

    def dense(vals: Column, flags: Column, holes: Column) -> Column:
        """One (sy, v) per column: the pixel itself, or what its column offers."""
        spots = F.transform(
            F.filter(F.transform(flags, lambda h, x: F.when(~h, x)), lambda x: x.isNotNull()),
            lambda x: F.struct(x.alias("x"), y.alias("sy"), F.get(vals, x).alias("v")),
        )
        both = F.sort_array(F.concat(spots, holes))
        return both

    def fill(vals: Column, flags: Column, cells: Column) -> Column:
        width = F.size(vals)

        def answer(x: Column, own: Column) -> Column:
            dy = F.abs(own["sy"] - y)
            reach = F.when(own["sy"].isNull(), width).otherwise(dy)
            first = F.greatest(x - reach, F.lit(0))
            last = F.least(x + reach, width - 1)
            around = F.slice(cells, first + 1, last - first + 1)

            def cost(c: Column) -> Column:
                d = (c["sy"] - y).cast("long")
                e = (c["x"] - x).cast("long")
                return F.struct(
                    (d * d + e * e).alias("d2"), c["sy"].alias("sy"), c["x"].alias("sx"), c["v"].alias("v")
                )

            candidates = F.transform(F.filter(around, lambda c: c["sy"].isNotNull()), cost)
            return F.array_min(candidates)["v"]

        return F.transform(
            vals,
            lambda v, x: F.when(~F.get(flags, x), v).otherwise(
                F.coalesce(answer(x, F.get(cells, x)), F.lit(fill_value).cast("double"))
            ),
        )

    filled = let(
        F.col("vals"),
        lambda vs: let(
            F.col(hole),
            lambda fl: let(dense(vs, fl, F.col("__holes")), lambda cells: fill(vs, fl, cells)),
        ),
    )
    return joined.withColumn(
        "vals", F.when(F.size("__holes") == 0, F.col("vals")).otherwise(filled)
    ).drop("__holes")
