"""Error statistics and losses over predicted and true disparities.

Every statistic is reduced per line in the scan stage (one small row per line),
then summed per group, so only counters are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.arrays import let
from scanmill.functions.scalar import iteration_weight, loss_valid, smooth_l1
from scanmill.operators.lookup import lookup_join
from scanmill.operators.stencil import slide, with_rows_around
from scanmill.operators.warp import backward_warp, warped_real_mask

# The stabilising constants of the structural similarity index.
SSIM_C1 = 0.01**2
SSIM_C2 = 0.03**2
# The public outlier definition of the driving benchmark.
D1_PIXELS = 3.0
D1_SHARE = 0.05


def _mean(total: str, count: str) -> Column:
    """Null over nothing."""
    return F.when(F.sum(count) > 0, F.try_divide(F.sum(total), F.sum(count)))


def masked_mean(df: DataFrame, value: Column, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` where ``mask`` holds; null when it never does."""
    return df.groupBy(*by).agg(F.avg(F.when(mask, value)).alias("mean"))


def line_errors(pred: str, gt: str, valid: str, max_disp: float | None = None) -> Column:
    """Absolute errors of the valid pixels of one line."""
    cells = F.arrays_zip(F.col(pred).alias("p"), F.col(gt).alias("g"), F.col(valid).alias("m"))
    ok = lambda c: (
        F.coalesce(c["m"].cast("double") >= 0.5, F.lit(False))
        if max_disp is None
        else loss_valid(c["m"].cast("double"), c["g"], max_disp)
    )
    return F.transform(F.filter(cells, ok), lambda c: F.abs(c["p"] - c["g"]))


def _count(errors: Column, test) -> Column:
    """How many errors pass ``test``."""
    return F.size(F.filter(errors, test)).cast("long")


def _closer(errors: Column, limit: float) -> Column:
    return _count(errors, lambda e: e < limit)


def _sum(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)


def epe_metrics(
    lines: DataFrame,
    pred: str = "pred",
    gt: str = "gt",
    valid: str = "valid",
    by: Sequence[str] = (),
    max_disp: float = 700.0,
) -> DataFrame:
    """Mean absolute error and the share of pixels closer than 1, 3 and 5 pixels."""
    err = F.col("__err")
    per_line = lines.select(*by, line_errors(pred, gt, valid, max_disp).alias("__err")).select(
        *by,
        F.size(err).cast("long").alias("n"),
        _sum(err).alias("s"),
        *[_closer(err, k).alias(f"n{k}") for k in (1, 3, 5)],
    )
    return per_line.groupBy(*by).agg(
        _mean("s", "n").alias("epe"), *[_mean(f"n{k}", "n").alias(f"px{k}") for k in (1, 3, 5)]
    )


def mae(lines: DataFrame, pred: str = "pred", gt: str = "gt", valid: str = "valid", by: Sequence[str] = ()) -> DataFrame:
    err = F.col("__err")
    per_line = lines.select(*by, line_errors(pred, gt, valid).alias("__err")).select(
        *by, F.size(err).cast("long").alias("n"), _sum(err).alias("s")
    )
    return per_line.groupBy(*by).agg(_mean("s", "n").alias("mae"))


def image_scores(lines: DataFrame, pred: str = "pred", gt: str = "gt", valid: str = "valid") -> DataFrame:
    """Per image: mean error and share of outliers beyond the dataset's ``outlier_px``."""
    err = F.col("__err")
    keys = ["dataset", "image_id"]
    per_line = lines.select(*keys, "outlier_px", line_errors(pred, gt, valid).alias("__err")).select(
        *keys,
        F.size(err).cast("long").alias("n"),
        _sum(err).alias("s"),
        let(F.col("outlier_px"), lambda o: _count(err, lambda e: e > o)).alias("bad"),
    )
    return per_line.groupBy(*keys).agg(_mean("s", "n").alias("epe"), _mean("bad", "n").alias("out"))


def evaluate(lines: DataFrame, registry: DataFrame, **cols) -> DataFrame:
    """Bad-pixel table: per-image means, then their unweighted mean per dataset, in percent.

    Names match whatever their case; a dataset the registry has no rule for fails the job. ``images`` counts the
    images with a score, which are those the means are over.
    """
    rules = registry.select(F.lower("name").alias("__name"), "outlier_px")
    ruled = lookup_join(lines.withColumn("__name", F.lower("dataset")), rules, ["__name"], how="left").drop("__name")
    unknown = F.raise_error(F.concat(F.lit("no rule for dataset "), F.coalesce("dataset", F.lit("null")))).cast("int")
    scored = image_scores(ruled.withColumn("outlier_px", F.coalesce("outlier_px", unknown)), **cols)
    return scored.groupBy("dataset").agg(
        F.avg("epe").alias("epe"),
        (100 * F.avg("out")).alias("bad_px"),
        F.count("epe").alias("images"),
    )


def d1_all(lines: DataFrame, pred: str = "pred", gt: str = "gt", valid: str = "valid", by: Sequence[str] = ()) -> DataFrame:
    """Percentage of valid pixels off by more than 3 px and more than 5 % of the truth."""
    cells = F.filter(
        F.arrays_zip(F.col(pred).alias("p"), F.col(gt).alias("g"), F.col(valid).alias("m")),
        lambda c: F.coalesce(c["m"].cast("double") >= 0.5, F.lit(False)),
    )

    def off(c: Column) -> Column:
        e = F.abs(c["p"] - c["g"])
        return (e > D1_PIXELS) & (e > D1_SHARE * F.abs(c["g"]))

    per_line = lines.select(*by, cells.alias("__c")).select(
        *by, F.size("__c").cast("long").alias("n"), _count(F.col("__c"), off).alias("bad")
    )
    return per_line.groupBy(*by).agg((100 * _mean("bad", "n")).alias("d1_all"))


def cross_shard_mean(metrics: DataFrame) -> DataFrame:
    """Mean of logged scalars over shards."""
    return metrics.groupBy("step", "name").agg(F.avg("value").alias("value"))


# --- photometric error ------------------------------------------------------------------------


def _box_mean(rows: Sequence[Column], width: Column, radius: int, f) -> Column:
    """Box mean of f over one or two views: summed down the rows, then along the line."""
    zero = F.array_repeat(F.lit(0.0), width)
    if len(rows) == 1:
        sums = F.aggregate(rows[0], zero, lambda acc, r: F.zip_with(acc, r, lambda s, v: s + f(v)))
    else:
        pairs = F.arrays_zip(rows[0].alias("p"), rows[1].alias("q"))
        sums = F.aggregate(pairs, zero, lambda acc, r: F.zip_with(acc, F.zip_with(r["p"], r["q"], f), lambda s, v: s + v))
    area = float((2 * radius + 1) ** 2)
    return let(sums, lambda s: F.transform(slide(s, width, radius, "reflect"), lambda v: v / area))


def own_means(rows: Column, width: Column, radius: int) -> Column:
    """Box means of one view and of its squares."""
    return F.arrays_zip(
        _box_mean([rows], width, radius, lambda p: p).alias("m"), _box_mean([rows], width, radius, lambda p: p * p).alias("sq"))


def ssim_values(a_rows: Column, b_rows: Column, width: Column, radius: int, a_means: Column | None = None) -> Column:
    """(1 - SSIM) / 2 of one line, from the 2*radius+1 lines of both views around it.

    ``a_means`` are the :func:`own_means` of the first view, if it is compared more than once.
    """
    moments = F.zip_with(
        F.zip_with(
            own_means(a_rows, width, radius) if a_means is None else a_means, own_means(b_rows, width, radius),
            lambda a, b: F.struct(a["m"].alias("mx"), a["sq"].alias("xx"), b["m"].alias("my"), b["sq"].alias("yy"))),
        _box_mean([a_rows, b_rows], width, radius, lambda p, q: p * q),
        lambda m, xy: F.struct(m["mx"].alias("mx"), m["xx"].alias("xx"), m["my"].alias("my"), m["yy"].alias("yy"), xy.alias("xy")),
    )

    def distance(m: Column) -> Column:
        mx, my = m["mx"], m["my"]
        var = (m["xx"] - mx * mx) + (m["yy"] - my * my)
        cov = m["xy"] - mx * my
        top = (2 * mx * my + SSIM_C1) * (2 * cov + SSIM_C2)
        bottom = (mx * mx + my * my + SSIM_C1) * (var + SSIM_C2)
        return F.least(F.greatest((1 - top / bottom) / 2, F.lit(0.0)), F.lit(1.0))

    return F.transform(moments, distance)


def ssim_distance(lines: DataFrame, a: str, b: str, radius: int = 3, out: str = "ssim") -> DataFrame:
    """(1 - SSIM) / 2 clamped to 0..1 from mirrored box means of both views."""
    near = with_rows_around(lines, [a, b], radius, "reflect")
    ssim = ssim_values(F.col(f"{a}_rows"), F.col(f"{b}_rows"), F.col("w"), radius)
    return near.withColumn(out, ssim).drop(f"{a}_rows", f"{b}_rows")


def photometric(lines: DataFrame, a: str, b: str, beta: float = 0.85, out: str = "photo") -> DataFrame:
    """Weighted SSIM distance and absolute difference, both averaged over channels.

    One row per (image, y) and any further columns equal over channels are dropped.
    """
    scored = ssim_distance(lines, a, b)
    mixed = scored.withColumn(
        out,
        F.zip_with(
            "ssim",
            F.zip_with(a, b, lambda p, q: F.abs(p - q)),
            lambda s, d: beta * s + (1 - beta) * d,
        ),
    )
    stacked = mixed.groupBy("image_id", "y").agg(
        F.max("h").alias("h"),
        F.max("w").alias("w"),
        F.sort_array(F.collect_list(F.struct("ch", F.col(out).alias("v")))).alias("__c"),
    )
    averaged = F.aggregate(
        F.col("__c"),
        F.array_repeat(F.lit(0.0), F.col("w")),
        lambda acc, c: F.zip_with(acc, c["v"], lambda s, v: s + v),
    )
    return stacked.withColumn(
        out, let(F.size("__c").cast("double"), lambda n: F.transform(averaged, lambda v: v / n))
    ).drop("__c")


# --- losses -----------------------------------------------------------------------------------


def sequence_loss(
    lines: DataFrame,
    n: int,
    gamma: float = 0.9,
    max_disp: float = 700.0,
    negate: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted sum over iterations of the mean absolute error of the valid pixels.

    ``lines(iter, pred, gt, valid)``; flow predictions are negative disparities,
    hence ``negate``. The loss is null if one of the ``n`` iterations is missing or
    has no valid pixel.
    """
    signed = lines.withColumn("pred", F.transform("pred", lambda v: -v)) if negate else lines
    err = F.col("__err")
    per_line = signed.select(*by, "iter", line_errors("pred", "gt", "valid", max_disp).alias("__err")).select(
        *by, "iter", F.size(err).cast("long").alias("n"), _sum(err).alias("s")
    )
    per_iter = per_line.groupBy(*by, "iter").agg(_mean("s", "n").alias("m"))
    weight = iteration_weight(F.col("iter"), F.lit(n), gamma)
    return per_iter.groupBy(*by).agg(_complete_sum(weight * F.col("m"), n).alias("loss"))


def _complete_sum(part: Column, n: int) -> Column:
    """Sum of ``n`` parts; null if one is null or absent."""
    return F.when((F.count(part) == n) & (F.count(F.lit(1)) == n), F.sum(part))


def _confidence_loss_terms(
    preds: DataFrame, maps: DataFrame, views: DataFrame, max_disp: float, iters: Sequence[int], smooth: Sequence[int] = (),
    beta: float = 0.85, radius: int = 3,
) -> DataFrame:
    """Per iteration: mean confidence-weighted error and mean photometric error.

    ``preds(iter, image_id, y, disp)``, ``maps(image_id, y, gt, conf, mask_nocc,
    mask_inpaint, valid)``, ``views(image_id, ch, y, h, w, left, right)``. The
    iterations of a line travel together: three tables meet on (image, line), and
    one exchange by bands brings each line its neighbours, the left view once for
    all iterations. The terms are null if a line lacks an iteration, has one
    twice or one that is not in ``iters``. Errors of the iterations in ``smooth`` are smooth-L1.
    """
    by = ["image_id", "y"]
    steps = preds.groupBy(*by).agg(F.collect_list(F.struct("iter", "disp")).alias("__steps"))
    views = views.groupBy(*by).agg(
        F.max("h").alias("h"), F.max("w").alias("w"),
        F.sort_array(F.collect_list(F.struct("ch", "left", "right"))).alias("__views"),
    )
    numbers = F.array(*[F.lit(i) for i in iters])
    pred_of = lambda i: F.get(F.filter("__steps", lambda s: s["iter"] == i), F.lit(0))["disp"]
    lines = steps.join(views, by).join(maps, by).select(
        *by, "h", "w", "gt", "conf", "mask_nocc", "valid",
        warped_real_mask(F.col("mask_inpaint"), F.col("gt")).alias("real"),
        F.transform(numbers, pred_of).alias("preds"),
        F.transform("__views", lambda v: v["left"]).alias("lefts"),
        "__views", (F.size("__steps") != len(iters)).alias("uneven"),
    )
    warped = F.transform("preds", lambda p: F.transform("__views", lambda v: backward_warp(v["right"], p)))
    lines = lines.withColumn("warped", warped).drop("__views")
    near = with_rows_around(lines, ["lefts", "warped"], radius, "reflect", keys=("image_id",))
    width, n_views = F.col("w"), F.size("lefts")

    channels = F.sequence(F.lit(0), n_views - 1)
    left_rows = lambda c: F.transform("lefts_rows", lambda r: F.get(r, c))
    left_means = F.transform(channels, lambda c: let(left_rows(c), lambda rows: own_means(rows, width, radius)))

    def photo(k: Column, means: Column) -> Column:
        """Weighted SSIM distance and absolute difference of iteration ``k``, both averaged over channels."""

        def of(c: Column) -> Column:
            other = F.transform("warped_rows", lambda r: F.get(F.get(r, k), c))
            apart = F.zip_with(F.get("lefts", c), F.get(F.get("warped", k), c), lambda p, q: F.abs(p - q))
            ssim = let(left_rows(c), lambda a: let(other, lambda b: ssim_values(a, b, width, radius, F.get(means, c))))
            return F.zip_with(ssim, apart, lambda s, d: beta * s + (1 - beta) * d)

        total = F.aggregate(
            channels, F.array_repeat(F.lit(0.0), width), lambda acc, c: F.zip_with(acc, of(c), lambda s, v: s + v)
        )
        return F.transform(total, lambda v: v / n_views)

    def terms(k: Column, means: Column) -> Column:
        cells = F.arrays_zip(
            F.get("preds", k).alias("p"), F.col("gt").alias("g"), F.col("conf").alias("c"),
            F.col("mask_nocc").alias("nocc"), F.col("real").alias("real"), F.col("valid").alias("valid"), photo(k, means).alias("photo"),
        )
        number = F.get(numbers, k)

        def error(e: Column) -> Column:
            return F.when(number.isin(*smooth), smooth_l1(e)).otherwise(F.abs(e)) if smooth else F.abs(e)

        def sums(c: Column) -> Column:
            d = F.transform(
                F.filter(c, lambda x: loss_valid(x["valid"].cast("double"), x["g"], max_disp)), lambda x: error(x["p"] - x["g"]) * x["c"]
            )
            p = F.transform(
                F.filter(c, lambda x: x["nocc"].cast("boolean") & x["real"]), lambda x: x["photo"] * (1 - x["c"])
            )
            return F.struct(
                number.alias("iter"), (F.col("uneven") | F.get("preds", k).isNull()).alias("lost"),
                F.size(d).cast("long").alias("dn"), _sum(d).alias("ds"), F.size(p).cast("long").alias("pn"), _sum(p).alias("ps"),
            )

        return let(cells, sums)

    all_terms = let(left_means, lambda m: F.transform(F.sequence(F.lit(0), F.lit(len(iters) - 1)), lambda k: terms(k, m)))
    per_line = near.select(F.explode_outer(all_terms).alias("t")).select("t.*")
    whole = ~F.bool_or("lost")
    return per_line.groupBy("iter").agg(
        F.when(whole, _mean("ds", "dn")).alias("d_loss"), F.when(whole, _mean("ps", "pn")).alias("p_loss"))


def confidence_loss_flow(
    preds: DataFrame, maps: DataFrame, views: DataFrame, n: int,
    gamma: float = 0.9, mu: float = 0.1, max_disp: float = 700.0,
) -> DataFrame:
    """Confidence-weighted loss for flow predictions (negative disparities)."""
    flipped = preds.withColumn("disp", F.transform("disp", lambda v: -v))
    terms = _confidence_loss_terms(flipped, maps, views, max_disp, range(n))
    weight = iteration_weight(F.col("iter"), F.lit(n), gamma)
    return terms.agg(_complete_sum(weight * (F.col("d_loss") + mu * F.col("p_loss")), n).alias("loss"))


def confidence_loss_disp(
    init: DataFrame, preds: DataFrame, maps: DataFrame, views: DataFrame, n: int,
    gamma: float = 0.9, mu: float = 0.1, max_disp: float = 700.0,
) -> DataFrame:
    """The same for disparity predictions, plus a smooth-L1 term of the initial one."""
    # the initial prediction goes as one more iteration through the same plan
    both = preds.select("iter", "image_id", "y", "disp").unionByName(init.select(F.lit(-1).alias("iter"), "image_id", "y", "disp"))
    terms = _confidence_loss_terms(both, maps, views, max_disp, range(-1, n), smooth=(-1,))
    weight = iteration_weight(F.col("iter"), F.lit(n), gamma)
    part = F.when(F.col("iter") < 0, F.col("d_loss") + 0.1 * F.col("p_loss")).otherwise(
        weight * (F.col("d_loss") + mu * F.col("p_loss")))
    return terms.agg(_complete_sum(part, n + 1).alias("loss"))
