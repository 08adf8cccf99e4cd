import json
import os

import numpy as np
from pyspark.sql import functions as F

from helpers import images, lines, splat
from scanmill.operators.augment import AugmentParams
from scanmill.operators.grid import align
from scanmill.plans import pseudo_stereo as ps
from scanmill.sources import sinks


def shrink(image, scale, cubic):
    """Pixel-centre resampling to 1/scale, borders repeated."""
    h, w = image.shape
    weight = lambda d: (1.25 * d - 2.25) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3

    def axis(values, n):
        out = []
        for t in range(n // scale):
            s = (t + 0.5) * (n / (n // scale)) - 0.5
            b = int(np.floor(s))
            taps = range(b - 1, b + 3) if cubic else range(b, b + 2)
            f = (lambda k: weight(abs(s - k))) if cubic else (lambda k: 1 - abs(s - k))
            out.append(sum(f(k) * values[min(max(k, 0), n - 1)] for k in taps))
        return np.array(out)

    return axis(axis(image, h).T, w).T


def test_warp_samples_at_reduced_size(spark):
    rng = np.random.default_rng(3)
    image = {0: rng.uniform(0, 255, size=(8, 12)), 1: rng.uniform(0, 255, size=(5, 7))}
    disp = {i: rng.uniform(0, 4, size=v.shape) for i, v in image.items()}
    out = ps.warp_samples(lines(spark, image), lines(spark, disp), limit=4).cache()
    scales = {r["image_id"]: (r["scale"], r["full_h"], r["full_w"]) for r in out.collect()}
    assert scales == {0: (2, 8, 12), 1: (1, 5, 7)}
    got, holes = images(out), images(out, "mask_inpaint")
    for i, scale in ((0, 2), (1, 1)):
        img = np.clip(shrink(image[i], 2, True), 0, 255) if scale == 2 else image[i]
        dsp = shrink(disp[i], 2, False) / 2 if scale == 2 else disp[i]
        for y in range(len(img)):
            v, hole, _ = splat(img[y].tolist(), dsp[y].tolist())
            assert np.allclose(got[i, 0][y], v, atol=1e-6) and np.array_equal(holes[i, 0][y], hole)
    back = ps.enlarge(out.withColumn("vals", F.transform("vals", lambda v: v / 127.5 - 1)))
    assert images(back["right"])[0, 0].shape == (8, 12) and images(back["mask_inpaint"])[1, 0].shape == (5, 7)
    assert set(np.unique(images(back["mask_nocc"])[0, 0])) <= {0.0, 1.0}


def test_pseudo_stereo_invariants(spark):
    rng = np.random.default_rng(4)
    depth = {i: np.cumsum(rng.uniform(size=(20, 30)), axis=1) for i in range(2)}
    df = lines(spark, depth).withColumnRenamed("vals", "depth").withColumn("depth_flipped", F.reverse("depth"))
    rgb = lines(spark, {(i, c): rng.uniform(0, 255, size=(20, 30)) for i in range(2) for c in range(3)})
    out = ps.pseudo_stereo(rgb, df, seed=5).collect()
    assert len(out) == 2 * 3 * 20
    masks = {}
    for r in out:
        # both predictions agree everywhere, so confidence has no range
        assert r["conf"] == [None] * 30
        assert all(v == 0 for v, m in zip(r["vals"], r["mask_inpaint"]) if m)
        masks.setdefault((r["image_id"], r["y"]), set()).add(str(r["mask_inpaint"]))
    assert all(len(m) == 1 for m in masks.values())  # the same holes in every channel


def test_filled_holes(spark):
    image = lines(spark, {0: np.ones((2, 6))})
    maps = lines(spark, {0: np.full((2, 6), 2.0)}).select("image_id", "y", F.col("vals").alias("disp"))
    warped = ps.warp_view(image, maps, "strict")
    filled = ps.fill_holes(warped, lambda df: df.withColumn("pred", F.transform("vals", lambda v: F.lit(9.0))))
    assert np.array_equal(images(filled)[0, 0] == 9, images(warped, "mask_inpaint")[0, 0] == 1)


def test_sample_tables(spark):
    rng = np.random.default_rng(6)
    rgb = lines(spark, {(0, c): rng.uniform(0, 255, size=(12, 16)) for c in range(4)})
    disp = lines(spark, {0: rng.uniform(-1, 3, size=(12, 16))})
    mask = lines(spark, {0: rng.choice([0.0, 128.0, 255.0], size=(12, 16))})
    heads = spark.createDataFrame([(0, 12, 16)], "image_id long, h int, w int")
    nine = ps.stereo_samples(rgb.filter("ch < 3"), rgb.filter("ch < 3"), disp, disp, mask, mask)
    assert len(nine) == 9
    assert np.array_equal(images(nine["mask_nocc"])[0, 0] == 1, images(mask)[0, 0] == 255)
    assert np.array_equal(images(nine["valid"])[0, 0] == 1, images(disp)[0, 0] > 0)
    p = AugmentParams(crop_height=6, crop_width=8, erase_bound=(2, 4))
    cut = ps.stereo_samples(rgb.filter("ch < 3"), rgb.filter("ch < 3"), disp, disp, mask, mask, heads, p, seed=1)
    assert all(images(df)[0, 0].shape == (6, 8) for df in cut.values())

    truth = disp.withColumnRenamed("vals", "disp").withColumn("valid", F.transform("disp", lambda d: d > 0))
    triple = ps.fill_samples(rgb, rgb, truth).collect()
    assert {r["ch"] for r in triple} == {0, 1, 2} and len(triple) == 36
    triple = ps.fill_samples(rgb, rgb, truth, heads, p, seed=2).collect()
    assert len(triple) == 18 and all(len(r["warped_right"]) == len(r["right"]) == 8 for r in triple)
    assert ps.eval_samples(rgb, rgb, truth).count() == 48


def test_align_drops_lines_a_raster_lacks(spark):
    a, b = lines(spark, {0: np.ones((3, 2))}), lines(spark, {0: np.zeros((2, 2))})
    assert align({"a": a, "b": b}).count() == 2


# --- sinks ------------------------------------------------------------------------------------


def test_maps_are_partitioned_and_complete(spark, tmp_path):
    df = lines(spark, {i: np.full((4, 3), i) for i in range(3)}).withColumns(
        {"dataset": F.lit("d"), "left_path": F.concat(F.lit("/x/left/"), F.col("image_id").cast("string"), F.lit(".jpg"))}
    )
    both = sinks.products(df, "disparity").unionByName(sinks.products(df, "confidence"))
    sinks.write_dataset(both, str(tmp_path / "out"), seed=7, a=0.1, b=0.05)
    stored = spark.read.parquet(str(tmp_path / "out" / "data"))
    assert stored.count() == 24 and os.path.isdir(tmp_path / "out" / "data" / "dataset=d" / "kind=disparity")
    assert stored.filter("kind = 'disparity'").select("out_path").distinct().count() == 3
    meta = [json.loads(l) for f in os.listdir(tmp_path / "out" / "meta") if f.endswith(".json") for l in open(tmp_path / "out" / "meta" / f)]
    assert meta == [{
        "contents": [{"dataset": "d", "kind": k, "images": 3, "lines": 12} for k in ("confidence", "disparity")],
        "parameters": {"a": 0.1, "b": 0.05}, "seed": 7,
    }]


def test_bytes_round_half_to_even(spark):
    df = lines(spark, {0: [[-1.0, 1.0, 1 / 255, 0.0]]})
    assert sinks.to_bytes(df).first()["vals"] == [0, 255, 128, 128]
    assert sinks.to_bytes(df, signed=False).first()["vals"] == [-255, 255, 1, 0]


def test_rendering_spans_the_palette(spark):
    palette = spark.range(256).selectExpr("cast(id as int) idx", "cast(id as int) r", "0 g", "0 b")
    out = sinks.render_disparity(lines(spark, {0: [[0.0, 5.0, 10.0]], 1: [[3.0, 3.0]]}), palette)
    assert {r["image_id"]: r["r"] for r in out.collect()} == {0: [0, 128, 255], 1: [0, 0]}


def test_metric_log_and_result_files(spark, tmp_path):
    table = spark.createDataFrame([("KITTI", 1.5, 20.0)], "dataset string, epe double, bad_px double")
    sinks.log_metrics(table, 10, str(tmp_path / "m"))
    sinks.log_metrics(table, 20, str(tmp_path / "m"))
    got = {(r["step"], r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == {(s, f"KITTI/{n}", v) for s in (10, 20) for n, v in (("epe", 1.5), ("bad_px", 20.0))}
    res = spark.createDataFrame([("a.jpg", "Processed on cpu")], "filename string, value string")
    sinks.write_result_files(res, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "Processed on cpu"
