"""Warping between the two views. Everything happens along a line, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import clip, indices, let

NO_SOURCE = 10000.0  # fixed value: weight of a target no source pixel reached
_COLUMN_BITS = 31  # an array has fewer than 2^31 entries, so bin and column fit into one whole number
WEIGHT_FLOOR = 1e-7  # fixed value: keeps the weight sum away from zero


def shifted(disp: Column) -> Column:
    """Column each pixel moves to in the other view."""
    return F.transform(disp, lambda d, x: x.cast("double") - d)


def _last_hits(shift: Column) -> Column:
    """For each bin 0 .. w: the rightmost pixel whose floor or ceiling is that bin, -1 if none.

    (bin, column) pairs are packed into whole numbers, one empty entry added per
    bin, and sorted; the last entry of each bin is its answer.
    """
    width = F.size(shift)
    pack = lambda code, x: code.cast("long") * (1 << _COLUMN_BITS) + x
    # bins left of the image share code 0, bins right of it the code after the last
    code = lambda b: F.least(F.greatest(b + 1, F.lit(0).cast("long")), (width + 2).cast("long"))
    near = lambda s: clip(s, -1e12, 1e12)  # keeps infinite positions within whole numbers
    low = F.transform(shift, lambda s, x: pack(code(F.floor(near(s))), x + 1))
    high = F.transform(shift, lambda s, x: pack(code(F.ceil(near(s))), x + 1))
    none = F.transform(F.sequence(F.lit(1).cast("long"), (width + 1).cast("long")), lambda c: pack(c, F.lit(0)))
    bin_of = lambda e: F.shiftright(e, _COLUMN_BITS)

    def lasts(es: Column) -> Column:
        ends = F.filter(
            es,
            lambda e, i: (bin_of(e) > 0)
            & (bin_of(e) <= width + 1)
            & (bin_of(e) != F.coalesce(bin_of(F.get(es, i + 1)), F.lit(-1))),
        )
        return F.transform(ends, lambda e: (e.bitwiseAND(F.lit((1 << _COLUMN_BITS) - 1)) - 1).cast("int"))

    return let(F.sort_array(F.concat(low, high, none)), lasts)


def _free(s: Column, x: Column, hits: Column) -> Column:
    """Not covered in the floor or not covered in the ceiling bin."""
    uncovered = lambda b: F.get(hits, b.cast("int")) - x < 2
    return uncovered(F.floor(s)) | uncovered(F.ceil(s))


def non_occlusion(shift: Column, hits: Column | None = None) -> Column:
    """Which pixels stay visible, from the shifted positions of one line.

    A pixel is covered in a bin (floor or ceiling of its position) when a pixel
    two or more columns to its right falls in the same bin, that is when the
    rightmost pixel of the bin is that far away. It is kept when its position is
    positive and at least one of its bins is not covered. ``hits`` is
    :func:`_last_hits` of the line where it is at hand.
    """

    def kept(line: Column, hits: Column) -> Column:
        beyond = F.size(line).cast("double")
        # a bin right of the image: compare with its own pixels only
        far = lambda s, x: _covered_far(line, s, x)
        return F.transform(
            line,
            lambda s, x: F.when(s <= 0, False).when(s > beyond, ~far(s, x)).otherwise(_free(s, x, hits)),
        )

    if hits is not None:
        return kept(shift, hits)
    return let(shift, lambda line: let(_last_hits(line), lambda found: kept(line, found)))


def _covered_far(line: Column, s: Column, x: Column) -> Column:
    """Both bins of a position right of the image are hit later (only negative disparities go there)."""
    hit = lambda b: F.exists(
        F.transform(line, lambda r, i: (i >= x + 2) & ((F.floor(r) == b) | (F.ceil(r) == b))), lambda h: h
    )
    return hit(F.floor(s)) & hit(F.ceil(s))


def _plane(moved: Column, hits: Column, hidden: Column, width: Column, upper: bool) -> Column:
    """Best (weight, column) per target in the ceiling or the floor plane, null where none.

    A kept pixel is the rightmost of one of its two bins or the one before it, so
    a target has four candidates at most. Two kinds of pixels come on top:
    ``hidden``, the rightmost occluded pixel when those are sent to column 0, and
    pixels right of the image, which all go to the last column.
    """

    last = (width - 1).cast("long")

    def candidate(x: Column, t: Column) -> Column:
        s = F.get(moved, x)
        lands = (F.ceil(s) if upper else F.floor(s)) == t
        weight = t - s if upper else 1 - (F.least(F.ceil(s), last) - s)
        return F.when(lands, F.struct(weight.alias("wt"), (-x).alias("later")))

    def best(t: Column) -> Column:
        near = F.get(hits, t - 1 if upper else t + 1)
        own = F.get(hits, t)
        # smallest weight, then the larger column; least passes over nulls
        return F.least(candidate(near, t), candidate(near - 1, t), candidate(own, t), candidate(own - 1, t))

    def outside() -> Column:
        """Best of the pixels whose position is clipped to the last column."""
        clipped = F.transform(
            moved,
            lambda s, x: F.when(
                (F.ceil(s) if upper else F.floor(s)) > last,
                F.struct((last - s if upper else 1 - (last - s)).alias("wt"), (-x).alias("later")),
            ),
        )
        return F.array_min(F.filter(clipped, lambda e: e["wt"] < NO_SOURCE))

    def edge(t: Column, found: Column) -> Column:
        quirk = F.when(
            (t == 0) & (hidden >= 0) & (width < NO_SOURCE if upper else F.lit(True)),
            F.struct((width if upper else 1 - width).cast("double").alias("wt"), (-hidden).alias("later")),
        )
        spill = F.when((t == width - 1) & (F.array_max(moved) > width - 1), outside())
        return F.when((t == 0) | (t == width - 1), F.least(found, quirk, spill)).otherwise(found)

    return F.transform(indices(width), lambda t: edge(t, best(t)))


def forward_warp(
    lines: DataFrame, compat: str = "reference", values: str = "vals", disp: str = "disp"
) -> DataFrame:
    """Splat each line into the other view along its disparity.

    Needs array columns ``values`` and ``disp``; adds ``mask_nocc`` (source
    grid), ``mask_inpaint`` (target grid) and replaces ``values`` by the warped
    line. ``compat="reference"`` sends occluded pixels to column 0 with weight
    ``w``, as the original rule does; ``"strict"`` drops them.
    """
    if compat not in ("reference", "strict"):
        raise ValueError(f"unknown mode: {compat}")
    width = F.size(values)
    base = (
        lines.withColumn("__shift", shifted(F.col(disp)))
        .withColumn("__hits", _last_hits(F.col("__shift")))
        .withColumn("mask_nocc", non_occlusion(F.col("__shift"), F.col("__hits")))
    )
    moved = F.zip_with("__shift", "mask_nocc", lambda s, keep: F.when(keep, s))
    occluded = F.array_max(F.transform("mask_nocc", lambda keep, x: F.when(~keep, x)))
    hidden = F.coalesce(occluded, F.lit(-1)) if compat == "reference" else F.lit(-1)
    base = base.withColumns({"__moved": moved, "__hidden": hidden})

    def blend(u: Column, d: Column, line: Column) -> Column:
        w_up, w_down = F.coalesce(u["wt"], F.lit(NO_SOURCE)), F.coalesce(d["wt"], F.lit(NO_SOURCE))
        color = lambda e: F.coalesce(F.get(line, -e["later"]), F.lit(0.0))
        mixed = (color(u) * w_down + color(d) * w_up) / (w_up + w_down + WEIGHT_FLOOR)
        hole = u.isNull() & d.isNull()
        return F.struct(F.when(hole, 0.0).otherwise(mixed).alias("v"), hole.alias("hole"))

    def splat(line: Column, m: Column, hits: Column) -> Column:
        plane = lambda upper: _plane(m, hits, F.col("__hidden"), width, upper)
        return F.zip_with(plane(True), plane(False), lambda u, d: blend(u, d, line))

    out = base.withColumn(
        "__out",
        let(
            F.col(values),
            lambda line: let(F.col("__moved"), lambda m: splat(line, m, F.col("__hits"))),
        ),
    )
    return out.withColumns(
        {
            values: F.transform("__out", lambda o: o["v"]),
            "mask_inpaint": F.transform("__out", lambda o: o["hole"]),
        }
    ).drop("__shift", "__hits", "__moved", "__hidden", "__out")


def inpaint_mask(lines: DataFrame, compat: str = "reference") -> DataFrame:
    """Target columns no source reached."""
    return forward_warp(lines, compat).select("image_id", "ch", "y", "h", "w", "mask_inpaint")


def gather(values: Column, positions: Column, pad: str = "border", mode: str = "bilinear") -> Column:
    """Sample one line at fractional columns.

    ``border`` clamps positions to the line, ``zeros`` gives 0 for samples
    outside; ``nearest`` rounds half to even.
    """

    def sample(p: Column, line: Column) -> Column:
        # two columns outside the line nothing is reached any more
        margin = 0.0 if pad == "border" else 2.0
        q = clip(p, -margin, (F.size(line) - 1).cast("double") + margin)
        inside = lambda i: F.coalesce(F.get(line, i.cast("int")), F.lit(0.0))
        if mode == "nearest":
            return inside(F.rint(q))

        def linear(r: Column) -> Column:
            def mix(base: Column) -> Column:
                return inside(base) * (base + 1 - r) + inside(base + 1) * (r - base)

            return let(F.floor(r), mix)

        return let(q, linear)

    return let(values, lambda line: F.transform(positions, lambda p: sample(p, line)))


def backward_warp(values: Column, disp: Column, pad: str = "border", mode: str = "bilinear") -> Column:
    """Fetch each pixel of one view from the other at ``x - disp``."""
    return gather(values, shifted(disp), pad, mode)


def warped_real_mask(mask_inpaint: Column, disp: Column) -> Column:
    """Whether the pixel a left pixel maps to was real, not filled in."""
    real = F.transform(mask_inpaint, lambda m: 1.0 - m.cast("double"))
    return F.transform(backward_warp(real, disp, "zeros", "nearest"), lambda v: v != 0)
