import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import images, lines
from scanmill.operators import augment as A


def test_noise_is_seeded_clipped_and_has_the_right_spread(spark):
    flat = {(i, 0): np.full((40, 50), 128.0) for i in range(3)}
    noise = lambda seed, parts: images(A.add_noise(lines(spark, flat, parts), 0.02, seed))
    a = noise(1, 1)
    assert all(np.array_equal(a[k], noise(1, 8)[k]) for k in a)
    assert not np.array_equal(a[0, 0], noise(2, 1)[0, 0]) and not np.array_equal(a[0, 0], a[1, 0])
    spread = np.concatenate([v.ravel() for v in a.values()]) - 128
    assert abs(spread.mean()) < 0.3 and abs(spread.std() - 0.02 * 255) < 0.2
    edge = images(A.add_noise(lines(spark, {0: np.full((20, 20), 255.0)}), 0.1, 3))[0, 0]
    assert edge.max() == 255 and edge.min() < 255


def test_blur_leaves_some_images_alone(spark):
    rng = np.random.default_rng(0)
    stack = {i: rng.uniform(0, 255, size=(6, 6)) for i in range(30)}
    got = images(A.random_blur(lines(spark, stack), 0.5, seed=1))
    same = sum(np.allclose(got[i, 0], stack[i]) for i in stack)
    assert 5 < same < 28


def colors(spark, rgb, view="left"):
    rgb = np.asarray(rgb, float)
    rows = [(0, view, y, *rgb.shape[:2], *(row[:, c].tolist() for c in range(3))) for y, row in enumerate(rgb)]
    return spark.createDataFrame(
        rows, "image_id long, view string, y int, h int, w int, r array<double>, g array<double>, b array<double>"
    )


@pytest.mark.parametrize("shift", [-0.3, -0.1, 0.0, 0.25, 0.5])
def test_hue_matches_the_standard_conversion(spark, shift):
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, size=(5, 8, 3)).astype(float)
    rgb[0, 0] = 77  # a gray pixel has no hue
    factors = {"brightness": F.lit(1.0), "contrast": F.lit(1.0), "saturation": F.lit(1.0), "hue": F.lit(shift), "stacked": F.lit(False)}
    got = A.color_jitter(colors(spark, rgb), factors, whole=False).orderBy("y").collect()
    for y, row in enumerate(got):
        for x in range(8):
            h, s, v = colorsys.rgb_to_hsv(*(rgb[y, x] / 255))
            want = np.array(colorsys.hsv_to_rgb((h + shift) % 1, s, v)) * 255
            assert np.allclose([row["r"][x], row["g"][x], row["b"][x]], want, atol=1e-9)


def test_shared_draw_uses_one_mean_for_both_views(spark):
    dark, light = np.full((2, 2, 3), 10.0), np.full((2, 2, 3), 110.0)
    both = colors(spark, dark, "left").unionByName(colors(spark, light, "right"))
    base = {"brightness": F.lit(1.0), "contrast": F.lit(0.0), "saturation": F.lit(1.0), "hue": F.lit(0.0)}
    level = lambda stacked: {r["view"]: r["r"][0] for r in A.color_jitter(both, {**base, "stacked": F.lit(stacked)}).collect()}
    assert level(True) == {"left": 60, "right": 60}
    assert level(False) == {"left": 10, "right": 110}


def test_factors_are_shared_unless_asymmetric(spark):
    views = spark.range(300).withColumn("image_id", F.col("id")).withColumn("view", F.explode(F.array(F.lit("left"), F.lit("right"))))
    got = views.select("image_id", "view", *[c.alias(n) for n, c in A.color_factors(1, 0, A.AugmentParams()).items()])
    pairs = got.groupBy("image_id").agg(F.count_distinct("brightness").alias("n"), F.first("stacked").alias("stacked")).collect()
    assert all((r["n"] == 1) == r["stacked"] for r in pairs)
    share = np.mean([r["n"] == 2 for r in pairs])
    assert 0.1 < share < 0.3
    low, high = got.agg(F.min("saturation"), F.max("saturation")).first()
    assert 0 <= low < 0.1 and 1.3 < high <= 1.4


def test_erase_rectangles(spark):
    image = np.arange(20.0).reshape(4, 5)
    rects = spark.createDataFrame([(0, 3, 2, 9, 1), (0, 0, 0, 2, 2)], "image_id long, x0 int, y0 int, dx int, dy int")
    got = images(A.erase(lines(spark, {0: image, 1: image}), rects))
    want = image.copy()
    want[2:3, 3:] = want[0:2, 0:2] = image.mean()
    assert np.allclose(got[0, 0], want) and np.array_equal(got[1, 0], image)


def test_drawn_rectangles_stay_in_bounds(spark):
    heads = spark.range(400).select(F.col("id").alias("image_id"), F.lit(30).alias("h"), F.lit(60).alias("w"))
    rects = A.draw_rects(heads, 1, 0, A.AugmentParams()).collect()
    per = np.bincount([r["image_id"] for r in rects], minlength=400)
    assert set(per) == {0, 1, 2} and 0.35 < np.mean(per == 0) < 0.65
    assert all(0 <= r["x0"] < 60 and 0 <= r["y0"] < 30 and 50 <= r["dx"] < 100 for r in rects)


@pytest.mark.parametrize("fx, fy", [(0.5, 0.5), (1.5, 0.8), (0.7, 1.3)])
def test_sparse_rescale(spark, fx, fy):
    rng = np.random.default_rng(7)
    disp, valid = rng.uniform(1, 9, size=(9, 11)), rng.uniform(size=(9, 11)) > 0.4
    h, w = int(np.round(9 * fy)), int(np.round(11 * fx))
    want, hit = np.zeros((h, w)), np.zeros((h, w))
    for y in range(9):
        for x in range(11):
            ty, tx = int(np.round(y * fy)), int(np.round(x * fx))
            if valid[y, x] and 0 < ty < h and 0 < tx < w:
                want[ty, tx], hit[ty, tx] = disp[y, x] * fx, 1
    df = lines(spark, {0: disp}).withColumnRenamed("vals", "disp").join(
        lines(spark, {0: valid}).select("y", F.col("vals").alias("valid")), "y"
    )
    out = A.rescale_sparse(df, F.lit(fx), F.lit(fy)).withColumn("ch", F.lit(0))
    assert np.allclose(images(out, "disp")[0, 0], want) and np.array_equal(images(out, "valid")[0, 0], hit)


def test_scale_never_falls_below_the_crop(spark):
    p = A.AugmentParams(crop_height=100, crop_width=100)
    heads = spark.range(300).select(F.col("id").alias("image_id"), F.lit(90).alias("h"), F.lit(200).alias("w"))
    rows = A.scale_params(heads, p, 1).collect()
    assert all(r["sx"] >= 101 / 90 and r["sy"] >= 101 / 90 for r in rows)
    assert len({r["sx"] for r in rows}) > 100 and any(r["sx"] != r["sy"] for r in rows)


def test_crop_windows_fit_and_jitter(spark):
    p = A.AugmentParams(crop_height=10, crop_width=20)
    heads = spark.range(300).select(F.col("id").alias("image_id"), F.lit(16).alias("h"), F.lit(33).alias("w"))
    rows = A.crop_params(heads, p, 1).collect()
    assert all(2 <= r["y0"] <= 4 and 0 <= r["x0"] <= 13 and abs(r["y1"] - r["y0"]) <= 2 and 0 <= r["y1"] <= 6 for r in rows)
    assert len({r["y1"] - r["y0"] for r in rows}) == 5
    tight = A.crop_params(heads.withColumn("h", F.lit(10)), p, 1).collect()
    assert all(r["y0"] == r["y1"] == 0 for r in tight)


def test_chain_keeps_rasters_aligned(spark):
    rng = np.random.default_rng(8)
    ramp = np.tile(np.arange(40.0), (30, 1))
    rgb = {(i, c): ramp for i in range(3) for c in range(3)}
    heads = spark.createDataFrame([(i, 30, 40) for i in range(3)], "image_id long, h int, w int")
    p = A.AugmentParams(crop_height=20, crop_width=24, steps=frozenset({"scale"}))
    single = {i: ramp for i in range(3)}
    out = A.augment(
        {"left": lines(spark, rgb), "right": lines(spark, rgb), "left_clean": lines(spark, rgb), "disp": lines(spark, single),
         "valid": lines(spark, {i: rng.uniform(size=(30, 40)) > 0.5 for i in range(3)})}, heads, p, seed=4,
    )
    left, clean, disp, valid = (images(out[k]) for k in ("left", "left_clean", "disp", "valid"))
    for i in range(3):
        assert left[i, 0].shape == disp[i, 0].shape == valid[i, 0].shape == (20, 24)
        assert np.array_equal(left[i, 0], clean[i, 0])
        # the disparity went through the same scale and crop, times the scale in x
        ratio = disp[i, 0][:, 1:-1] / left[i, 0][:, 1:-1]
        assert np.allclose(ratio, ratio[0, 0])
        assert set(np.unique(valid[i, 0])) <= {0.0, 1.0}
    again = images(A.augment({"left": lines(spark, rgb, 8), "right": lines(spark, rgb)}, heads, p, seed=4)["left"])
    assert all(np.array_equal(left[k], again[k]) for k in left)


def test_sparse_chain(spark):
    ramp = np.tile(np.arange(1.0, 41.0), (30, 1))
    rgb = {(0, c): ramp for c in range(3)}
    heads = spark.createDataFrame([(0, 30, 40)], "image_id long, h int, w int")
    p = A.AugmentParams(crop_height=20, crop_width=24, sparse=True, steps=frozenset({"scale"}))
    out = A.augment(
        {"left": lines(spark, rgb), "right": lines(spark, rgb), "disp": lines(spark, {0: ramp}), "valid": lines(spark, {0: ramp > 0})},
        heads, p, seed=2,
    )
    assert images(out["disp"])[0, 0].shape == images(out["valid"])[0, 0].shape == (20, 24)
