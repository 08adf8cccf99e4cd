import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import images, lines, nearest
from scanmill.operators.depth import (
    adaptive_disparity,
    confidence,
    cut_edges,
    forward_interpolate,
    nearest_fill,
    normalize_depth,
)
from scanmill.operators.stencil import dilate, sobel


def test_constant_image_has_no_range(spark):
    out = normalize_depth(lines(spark, {0: [[2, 2], [2, 2]], 1: [[0, 1], [2, 4]]})).collect()
    got = {(r["image_id"], r["y"]): r["vals"] for r in out}
    assert got[0, 0] == [None, None]
    assert got[1, 1] == [0.5, 1.0]


def test_confidence_is_high_where_both_predictions_agree(spark):
    a = np.array([[0.0, 1.0, 2.0, 4.0]])
    df = lines(spark, {0: a}).withColumnRenamed("vals", "depth")
    same = df.withColumn("depth_flipped", F.reverse(F.transform("depth", lambda v, x: F.when(x == 1, v + 1).otherwise(v))))
    conf = confidence(same).first()["conf"]
    assert conf == [1, 0, 1, 1]


@pytest.mark.parametrize("u1, low, high", [(0.05, 0.0, 0.05), (0.5, 0.05, 0.15), (0.95, 0.15, 0.2)])
def test_disparity_range(spark, u1, low, high):
    df = lines(spark, {0: [[1.0] * 100]})
    for u2, want in ((0.0, low), (1.0, high)):
        disp = adaptive_disparity(df, u1=F.lit(u1), u2=F.lit(u2)).first()["disp"]
        assert np.allclose(disp, want * 100)


def test_seeded_draws_repeat(spark):
    df = lines(spark, {i: [[1.0] * 10] for i in range(20)})
    pick = lambda seed: sorted((r["image_id"], r["disp"][0]) for r in adaptive_disparity(df, seed=seed).collect())
    assert pick(1) == pick(1) != pick(2)


def test_dilate_is_plus_shaped(spark):
    image = np.zeros((5, 5))
    image[2, 2] = 1
    got = images(dilate(lines(spark, {0: image})))[0, 0]
    want = np.zeros((5, 5))
    want[2, 1:4] = want[1:4, 2] = 1
    assert np.array_equal(got, want)
    twice = images(dilate(lines(spark, {0: image}), 2))[0, 0]
    assert twice.sum() == 13


def test_sobel_of_a_step(spark):
    image = np.zeros((5, 5))
    image[:, 3:] = 8
    got = images(sobel(lines(spark, {0: image})), "magnitude")[0, 0]
    assert np.allclose(got, np.array([[0, 0, 8, 8, 0]] * 5) / np.sqrt(2))
    cut = images(cut_edges(lines(spark, {0: image}), 1), "hole")[0, 0]
    assert np.array_equal(cut, np.array([[0, 1, 1, 0, 0]] * 5))


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 0.97])
def test_nearest_fill_matches_plain_search(spark, share):
    rng = np.random.default_rng(int(share * 100))
    # more rows than one band, and values that tell sources apart
    stack = {i: rng.normal(size=(80, 11)) for i in range(2)}
    holes = {i: rng.uniform(size=(80, 11)) < share for i in stack}
    df = lines(spark, stack).join(
        lines(spark, holes).select("image_id", "y", F.transform("vals", lambda v: v > 0).alias("hole")), ["image_id", "y"]
    )
    got = images(nearest_fill(df))
    for i in stack:
        assert np.array_equal(got[i, 0], nearest(stack[i], holes[i]))


def test_nearest_fill_without_known_pixels(spark):
    df = lines(spark, {0: np.ones((3, 3))}).withColumn("hole", F.transform("vals", lambda v: F.lit(True)))
    assert all(v is None for r in nearest_fill(df).collect() for v in r["vals"])
    assert all(v == 7 for r in nearest_fill(df, fill_value=7).collect() for v in r["vals"])


@pytest.mark.parametrize("size", [1.5, 30.0])
def test_forward_interpolate_matches_plain_search(spark, size):
    rng = np.random.default_rng(11)
    h, w = 24, 100
    dx, dy = rng.normal(size=(h, w)) * size, rng.normal(size=(h, w)) * size
    dx[:, 40:], dy[:, 40:] = 500, 500  # most of the pixels leave the image, so some holes are wide
    df = lines(spark, {0: dx}).select("image_id", "y", "h", "w", F.col("vals").alias("dx")).join(
        lines(spark, {0: dy}).select("image_id", "y", F.col("vals").alias("dy")), ["image_id", "y"]
    )
    moved = [
        (x + dx[y, x], y + dy[y, x], y, x) for y in range(h) for x in range(w)
        if 0 < x + dx[y, x] < w and 0 < y + dy[y, x] < h
    ]
    got = {r["y"]: r for r in forward_interpolate(df).collect()}
    assert len(got) == h
    for y in range(h):
        for x in range(w):
            best = min(moved, key=lambda p: ((p[0] - x) ** 2 + (p[1] - y) ** 2, p[2], p[3]))
            assert got[y]["dx"][x] == dx[best[2], best[3]] and got[y]["dy"][x] == dy[best[2], best[3]]


def test_forward_interpolate_when_all_leave(spark):
    df = lines(spark, {0: np.full((3, 4), 99.0)}).select("image_id", "y", "h", "w", F.col("vals").alias("dx"), F.col("vals").alias("dy"))
    assert all(v == 0 for r in forward_interpolate(df).collect() for v in r["dx"] + r["dy"])


def flow_of(spark, images):
    rows = [(k, y, dx.shape[0], dx.shape[1], [float(v) for v in dx[y]], [float(v) for v in dy[y]])
            for k, (dx, dy) in images.items() for y in range(dx.shape[0])]
    return spark.createDataFrame(rows, "image_id long, y int, h int, w int, dx array<double>, dy array<double>")


@pytest.mark.parametrize("kind", ["steps", "still", "one corner", "one point", "to the middle"])
def test_forward_interpolate_over_several_bands_with_ties(spark, kind):
    rng = np.random.default_rng(3)
    h, w = 150, 23
    y, x = np.mgrid[0:h, 0:w].astype(float)
    dx, dy = {
        "steps": (rng.integers(-16, 17, (h, w)) / 4, rng.integers(-400, 401, (h, w)) / 4),  # many equally near points
        "still": (np.zeros((h, w)), np.zeros((h, w))),
        "one corner": (np.where((x < 3) & (y < 3), 0.25, 900.0), np.full((h, w), 0.5)),
        "one point": (11.5 - x, 75.0 - y),
        "to the middle": ((11.5 - x) * 0.999, (75.0 - y) * 0.999),
    }[kind]
    out = {r["y"]: r for r in forward_interpolate(flow_of(spark, {5: (dx, dy)})).collect()}
    px, py = (x + dx).ravel(), (y + dy).ravel()
    inside = np.flatnonzero((px > 0) & (px < w) & (py > 0) & (py < h))
    assert sorted(out) == list(range(h))
    for line in range(h):
        for column in range(w):
            d2 = (px[inside] - column) ** 2 + (py[inside] - line) ** 2
            best = inside[np.argmin(d2)]  # sources are in the order of (y, x)
            assert out[line]["dx"][column] == dx.ravel()[best] and out[line]["dy"][column] == dy.ravel()[best]


def test_forward_interpolate_keeps_images_apart_and_gathers_no_image(spark):
    rng = np.random.default_rng(4)
    images = {k: (rng.normal(size=(n, 9)), rng.normal(size=(n, 9))) for k, n in ((1, 3), (2, 70))}
    df = forward_interpolate(flow_of(spark, images))
    assert {(r["image_id"], r["y"]) for r in df.collect()} == {(k, y) for k, (dx, _) in images.items() for y in range(len(dx))}
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert forward_interpolate(flow_of(spark, {})).count() == 0
