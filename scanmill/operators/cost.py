"""Cost volumes between the two views of a line.

``features(image_id, side, y, x, vec)`` become one row per line with the
feature vectors of both views as arrays. A volume entry only compares pixels of
the same line, so the volume is an array expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import blend_at, dot, indices, let, total
from scanmill.operators.stencil import pool_pairs, with_rows_around


def feature_lines(features: DataFrame) -> DataFrame:
    """(image_id, y, left, right): feature vectors of both views, by column."""
    side = lambda s: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("x", "vec")))), lambda e: e["vec"]
    )
    return features.groupBy("image_id", "y").agg(side("left").alias("left"), side("right").alias("right"))


def scaled_dot(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(F.size(a).cast("double"))


def group_mean_product(a: Column, b: Column, groups: int) -> Column:
    """Mean product of each of ``groups`` equal channel groups; the groups must divide."""

    def of(p: Column, q: Column) -> Column:
        per = F.floor(F.size(p) / groups).cast("int")
        whole = per * groups == F.size(p)
        means = F.transform(
            indices(F.lit(groups)),
            lambda g: dot(F.slice(p, g * per + 1, per), F.slice(q, g * per + 1, per)) / per,
        )
        return F.when(whole, means).otherwise(
            F.raise_error(F.lit("channels do not divide into groups")).cast("array<double>")
        )

    return let(a, lambda p: let(b, lambda q: of(p, q)))


def norm_corr(a: Column, b: Column) -> Column:
    """Mean product of the vectors scaled to unit length (guarded by 1e-5)."""
    length = lambda v: F.sqrt(dot(v, v)) + 1e-5
    return let(
        length(a),
        lambda la: let(
            length(b),
            lambda lb: total(F.zip_with(a, b, lambda p, q: (p / la) * (q / lb))) / F.size(a),
        ),
    )


def corr(a: Column, b: Column) -> Column:
    return dot(a, b)


# --- all pairs of a line ----------------------------------------------------------------------


def row_correlation(lines: DataFrame, scale: bool = True, plan: str = "line") -> DataFrame:
    """Correlation of every left pixel with every right pixel of its line.

    ``plan="line"`` keeps one row per line (``corr`` is x by x'); ``plan="pixel"``
    gives one row per left pixel with its array over x', which is the shape the
    pyramid works on. Neither emits pairs as rows.
    """
    product = scaled_dot if scale else dot
    against = lambda l, rs: F.transform(rs, lambda r: product(l, r))
    if plan == "line":
        table = let(F.col("right"), lambda rs: F.transform("left", lambda l: against(l, rs)))
        return lines.select("image_id", "y", table.alias("corr"))
    if plan == "pixel":
        # made on the line and exploded after, so the right line isn't copied to every left pixel
        table = let(F.col("right"), lambda rs: F.transform("left", lambda l: against(l, rs)))
        return lines.select("image_id", "y", F.posexplode_outer(table).alias("x", "corr"))
    raise ValueError(f"unknown plan: {plan}")


def pyramid(costs: DataFrame, levels: int, col: str = "corr") -> DataFrame:
    """Adds ``{col}_l0 .. {col}_l{levels-1}``, each half as long as the one before."""
    out = costs.withColumn(f"{col}_l0", F.col(col))
    for i in range(1, levels):
        out = out.withColumn(f"{col}_l{i}", pool_pairs(F.col(f"{col}_l{i - 1}")))
    return out


def _taps(line: Column, center: Column, steps: Column) -> Column:
    return F.transform(steps, lambda k: blend_at(line, center + k, F.size(line)))


def _strictly_inside(steps: Column, center: Column, width: Column) -> Column:
    return F.transform(steps, lambda k: (center + k > 0) & (center + k < width - 1))


def lookup(
    pyr: DataFrame,
    coords: Column,
    radius: int,
    levels: int,
    col: str = "corr",
    out: str = "taps",
    flag: str | None = None,
) -> DataFrame:
    """2*radius+1 interpolated taps around ``coords`` at each level, zeros outside.

    ``flag`` adds an array telling which taps lie strictly inside their level.
    """
    taps, inside = [], []
    for i in range(levels):
        source = F.col(f"{col}_l{i}")
        center = coords / float(2**i)
        steps = F.sequence(F.lit(-radius), F.lit(radius))
        taps.append(
            let(source, lambda s, c=center: _taps(s, c, steps))
        )
        inside.append(_strictly_inside(steps, center, F.size(source)))
    found = pyr.withColumn(out, F.flatten(F.array(*taps)))
    return found.withColumn(flag, F.flatten(F.array(*inside))) if flag else found


def lookup_features(
    lines: DataFrame, coords: str, radius: int, levels: int, out: str = "taps"
) -> DataFrame:
    """Like :func:`lookup`, sampling the right features instead of stored costs.

    ``coords`` is an array column with one position per left pixel. Gives one
    row per left pixel; the line of right features is pooled once per level.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))

    def halve(vecs: Column) -> Column:
        return let(
            vecs,
            lambda v: F.transform(
                indices(F.floor(F.size(v) / 2)),
                lambda i: F.zip_with(F.get(v, 2 * i), F.get(v, 2 * i + 1), lambda p, q: (p + q) / 2),
            ),
        )

    staged = lines.withColumn("__f0", F.col("right"))
    for i in range(1, levels):
        staged = staged.withColumn(f"__f{i}", halve(F.col(f"__f{i - 1}")))
    def at(p: Column, feats: Column, l: Column) -> Column:
        def sampled(base: Column) -> Column:
            frac = p - F.floor(p)
            part = lambda j: F.when((j >= 0) & (j < F.size(feats)), dot(F.get(feats, j), l)).otherwise(0.0)
            return part(base) * (1 - frac) + part(base + 1) * frac

        return let(F.floor(p).cast("int"), sampled)

    def level(i: int, e: Column) -> Column:
        feats = F.col(f"__f{i}")
        return F.transform(
            steps,
            lambda k: let(e["c"] / float(2**i) + k, lambda p: at(p, feats, e["l"])) / F.sqrt(F.size(e["l"]).cast("double")),
        )

    # made on the line and exploded after, so no pixel carries the right line
    pixels = F.arrays_zip(F.col("left").alias("l"), F.col(coords).alias("c"))
    taps = F.transform(pixels, lambda e: F.flatten(F.array(*[level(i, e) for i in range(levels)])))
    return staged.select("image_id", "y", F.posexplode_outer(taps).alias("x", out))


def groups_first(cost: Column, groups: int) -> Column:
    """Turn an array over d of group vectors into one array over d per group."""
    return let(
        cost,
        lambda cs: F.transform(indices(F.lit(groups)), lambda g: F.transform(cs, lambda c: F.get(c, g))),
    )


def group_pyramid(costs: DataFrame, levels: int, col: str = "geo") -> DataFrame:
    """:func:`pyramid` for a volume with groups: each group is halved along d."""
    out = costs.withColumn(f"{col}_l0", F.col(col))
    for i in range(1, levels):
        out = out.withColumn(f"{col}_l{i}", F.transform(f"{col}_l{i - 1}", pool_pairs))
    return out


def _group_taps(groups: Column, center: Column, steps: Column) -> Column:
    return F.transform(groups, lambda g: _taps(g, center, steps))


def combined_lookup(
    pyr: DataFrame, disp: Column, x: Column, radius: int, levels: int, geo: str = "geo", init: str = "corr"
) -> DataFrame:
    """Per level: taps of each cost group around the disparity, then of the correlation around x - disp.

    ``{geo}_l{i}`` are arrays over groups of arrays over d, ``{init}_l{i}`` arrays over x'.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    parts = []
    for i in range(levels):
        k = float(2**i)
        parts.append(F.flatten(_group_taps(F.col(f"{geo}_l{i}"), disp / k, steps)))
        parts.append(let(F.col(f"{init}_l{i}"), lambda c, k=k: _taps(c, x / k - disp / k, steps)))
    return pyr.withColumn("taps", F.flatten(F.array(*parts)))


# --- banded volumes ---------------------------------------------------------------------------


def _volume(lines: DataFrame, maxdisp: int, cell, absent) -> DataFrame:
    """One row per left pixel; ``cost`` runs over d = 0 .. maxdisp-1.

    The costs are made on the line and exploded after: no row but the line holds the right features.
    """
    def band(l: Column, x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(maxdisp - 1)),
            lambda d: F.when(d <= x, cell(l, F.get("right", x - d))).otherwise(absent(l)),
        )

    return lines.select("image_id", "y", F.posexplode_outer(F.transform("left", band)).alias("x", "cost"))


def gwc_volume(lines: DataFrame, maxdisp: int, groups: int) -> DataFrame:
    """Group-wise correlation with the right pixel ``d`` columns to the left; zero off the image."""
    zeros = F.array_repeat(F.lit(0.0), groups)
    return _volume(lines, maxdisp, lambda l, r: group_mean_product(l, r, groups), lambda l: zeros)


def norm_volume(lines: DataFrame, maxdisp: int) -> DataFrame:
    return _volume(lines, maxdisp, norm_corr, lambda l: F.lit(0.0))


def corr_volume(lines: DataFrame, maxdisp: int) -> DataFrame:
    return _volume(lines, maxdisp, corr, lambda l: F.lit(0.0))


def concat_volume(lines: DataFrame, maxdisp: int) -> DataFrame:
    """Left features always, right features zero off the image."""
    zeros = lambda l: F.array_repeat(F.lit(0.0), F.size(l))
    return _volume(lines, maxdisp, lambda l, r: F.concat(l, r), lambda l: F.concat(l, zeros(l)))


def band_pairs(lines: DataFrame, maxdisp: int) -> DataFrame:
    """Pairs within the disparity band, ``maxdisp`` rows per left pixel at most."""
    def band(l: Column, x: Column) -> Column:
        reach = F.least(x, F.lit(maxdisp - 1))
        return F.transform(F.sequence(F.lit(0), reach), lambda d: F.get("right", x - d))

    cells = F.transform("left", lambda l, x: F.struct(l.alias("l"), band(l, x).alias("r")))
    px = lines.select("image_id", "y", F.posexplode_outer(cells).alias("x", "c"))
    return px.select("image_id", "y", "x", "c.l", F.posexplode_outer("c.r").alias("d", "r")).select("image_id", "y", "x", "d", "l", "r")


def softmax(values: Column) -> Column:
    """Shifted by the maximum, so large costs do not overflow."""
    exps = let(
        values, lambda vs: let(F.array_max(vs), lambda m: F.transform(vs, lambda v: F.exp(v - m)))
    )
    return let(exps, lambda es: let(total(es), lambda s: F.transform(es, lambda e: e / s)))


def disparity_regression(prob: Column) -> Column:
    """Expected disparity under a distribution over 0 .. n-1."""
    return total(F.transform(prob, lambda p, d: p * d))


def soft_argmin(cost: Column) -> Column:
    return disparity_regression(softmax(cost))


def convex_upsample(
    low: DataFrame, weights: DataFrame, factor: int, scale: float = 1.0, normalise: bool = False
) -> DataFrame:
    """Up-sample by mixing the 3x3 low-resolution neighbours (zeros outside).

    ``weights(image_id, y, wts)`` has, per high-resolution line, an array over x
    of nine weights in row-major neighbour order; ``normalise`` applies a softmax
    to them first. ``scale`` multiplies the low-resolution values.
    """
    near = with_rows_around(low, ["vals"], 1, "none")
    # rows and columns outside the image come back null and count as zero
    nine = let(
        F.col("vals_rows"),
        lambda rows: F.transform(
            indices(F.col("w")),
            lambda x: F.flatten(
                F.transform(
                    rows,
                    lambda r: F.transform(
                        F.sequence(F.lit(-1), F.lit(1)),
                        lambda k: F.coalesce(F.get(r, x + k), F.lit(0.0)) * scale,
                    ),
                )
            ),
        ),
    )
    rows = near.select(
        "image_id", "ch", "h", "w", F.explode_outer(F.sequence(F.col("y") * factor, F.col("y") * factor + factor - 1)).alias("y"),
        nine.alias("__nine"),
    )
    joined = rows.join(weights, ["image_id", "y"])
    prepare = (lambda w: softmax(w)) if normalise else (lambda w: w)
    mixed = let(
        F.col("__nine"),
        lambda n: F.transform(
            "wts", lambda wt, x: dot(F.get(n, F.floor(x / factor).cast("int")), prepare(wt))
        ),
    )
    return joined.select(
        "image_id", "ch", "y", (F.col("h") * factor).alias("h"), (F.col("w") * factor).alias("w"), mixed.alias("vals")
    )
