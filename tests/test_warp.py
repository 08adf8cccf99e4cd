import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import images, kept_pixels, lines, splat
from scanmill.operators.warp import backward_warp, forward_warp, non_occlusion, shifted


def run(spark, values, disp, compat="reference"):
    df = lines(spark, {0: values}).join(
        lines(spark, {0: disp}).select("y", F.col("vals").alias("disp")), "y"
    )
    out = forward_warp(df, compat).orderBy("y").collect()
    return [(r["vals"], r["mask_inpaint"], r["mask_nocc"]) for r in out]


def check(spark, values, disp):
    for compat in ("reference", "strict"):
        got = run(spark, values, disp, compat)
        for y, (v, hole, keep) in enumerate(got):
            want, holes, kept = splat(list(values[y]), list(disp[y]), compat == "strict")
            assert keep == kept
            assert hole == holes
            assert np.allclose(v, want, atol=1e-9)


def test_zero_disparity_keeps_interior(spark):
    (v, hole, keep), = run(spark, [[1, 2, 3, 4, 5]], [[0] * 5])
    assert keep == [False, True, True, True, True]  # column 0 lands on 0, which is not positive
    assert np.allclose(v[1:], [2, 3, 4, 5], atol=1e-5)
    assert hole[1:] == [False] * 4


def test_whole_shift_leaves_right_edge_open(spark):
    (v, hole, _), = run(spark, [[1, 2, 3, 4, 5]], [[1] * 5], "strict")
    assert np.allclose(v[1:4], [3, 4, 5], atol=1e-5)
    assert hole == [True, False, False, False, True]


def test_half_shift_blends(spark):
    (v, _, _), = run(spark, [[0, 10, 20, 30, 40]], [[0.5] * 5], "strict")
    assert np.allclose(v[1:4], [15, 25, 35], atol=1e-4)


def test_occluded_pixel_reaches_column_zero_only_in_reference_mode(spark):
    values, disp = [[1, 2, 3, 4, 5, 6]], [[0, 0, 0, 0, 2, 2]]
    (ref, ref_hole, keep), = run(spark, values, disp)
    (strict, strict_hole, _), = run(spark, values, disp, "strict")
    assert keep[2] is False and keep[3] is False
    assert not ref_hole[0] and strict_hole[0]
    assert np.isclose(ref[0], splat(values[0], disp[0])[0][0])


def test_tie_goes_to_larger_column(spark):
    # columns 2 and 3 both land on 1.5
    check(spark, [[1, 2, 3, 4, 5, 6]], [[0, 0, 0.5, 1.5, 2.5, 3.5]])


@pytest.mark.parametrize("seed", range(4))
def test_random_lines_match_plain_rule(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(12, 17))
    step = [1, 2, 4, 1000][seed]
    # negative disparities push pixels beyond the right edge
    disp = np.round(rng.uniform(-4, 9, size=(12, 17)) * step) / step
    check(spark, values, disp)


def test_non_occlusion_far_right(spark):
    shift = [0.0, 9.0, 9.0, 9.0, 9.0, 2.0]
    row = spark.range(1).select(non_occlusion(F.array(*[F.lit(s) for s in shift])).alias("k")).first()
    assert row["k"] == kept_pixels(shift)


def test_backward_warp_of_zero_disparity_is_identity(spark):
    df = lines(spark, {0: [[3, 1, 4, 1, 5]]}).withColumn("disp", F.transform("vals", lambda v: F.lit(0.0)))
    for pad in ("border", "zeros"):
        for mode in ("bilinear", "nearest"):
            row = df.select(backward_warp(F.col("vals"), F.col("disp"), pad, mode).alias("v")).first()
            assert row["v"] == [3, 1, 4, 1, 5]


def test_backward_warp_borders(spark):
    df = lines(spark, {0: [[10, 20, 30]]}).withColumn("disp", F.array(F.lit(0.5), F.lit(-5.0), F.lit(0.25)))
    pick = lambda *how: df.select(backward_warp(F.col("vals"), F.col("disp"), *how).alias("v")).first()["v"]
    assert pick("border", "bilinear") == [10, 30, 27.5]
    assert pick("zeros", "bilinear") == [5, 0, 27.5]
    assert pick("zeros", "nearest") == [10, 0, 30]  # -0.5 rounds to even, that is to 0


def test_same_result_for_any_partitioning(spark):
    rng = np.random.default_rng(9)
    image = {i: rng.normal(size=(6, 9)) for i in range(3)}
    outs = []
    for parts in (1, 8):
        df = lines(spark, image, parts).withColumn("disp", F.transform("vals", lambda v: F.abs(v) * 3))
        outs.append(images(forward_warp(df)))
    assert outs[0].keys() == outs[1].keys()
    assert all(np.array_equal(outs[0][k], outs[1][k]) for k in outs[0])


def test_shift_is_column_minus_disparity(spark):
    row = spark.range(1).select(shifted(F.array(F.lit(0.5), F.lit(0.5))).alias("s")).first()
    assert row["s"] == [-0.5, 0.5]
