import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import lines
from scanmill.functions.scalar import iteration_weight
from scanmill.operators import cost, metrics
from scanmill.sources.registry import evaluation_registry

SCORED = "dataset string, image_id long, y int, pred array<double>, gt array<double>, valid array<double>"


def test_two_level_mean_is_not_flat(spark):
    rows = [
        ("KITTI", 0, 0, [0.0, 0.0, 0.0, 0.0], [4.0, 0.0, 0.0, 0.0], [1.0] * 4),
        ("KITTI", 1, 0, [0.0, 9.0], [4.0, 0.0], [1.0, 0.0]),
        ("ETH3D", 2, 0, [0.0, 0.0], [2.0, 1.0], [1.0, 1.0]),
    ]
    out = {r["dataset"]: r for r in metrics.evaluate(spark.createDataFrame(rows, SCORED), evaluation_registry(spark)).collect()}
    assert out["KITTI"]["epe"] == (1 + 4) / 2 and out["KITTI"]["bad_px"] == 100 * (0.25 + 1) / 2
    assert out["ETH3D"]["bad_px"] == 50 and out["ETH3D"]["images"] == 1


def test_empty_mask_gives_null(spark):
    df = spark.createDataFrame([("d", 0, 0, [1.0], [2.0], [0.0])], SCORED)
    row = metrics.epe_metrics(df).first()
    assert row["epe"] is None and row["px1"] is None
    assert metrics.masked_mean(df, F.lit(1.0), F.lit(False)).first()["mean"] is None


def test_pixel_rates_are_accuracies_and_limits_are_strict(spark):
    df = spark.createDataFrame([("d", 0, 0, [0.0] * 5, [0.5, 1.0, 3.0, 4.0, 800.0], [1.0] * 5)], SCORED)
    row = metrics.epe_metrics(df).first()
    assert (row["px1"], row["px3"], row["px5"]) == (0.25, 0.5, 1.0)  # 800 is beyond the limit


def test_iteration_weight(spark):
    row = spark.range(1).select(
        *[iteration_weight(F.lit(i), F.lit(4)).alias(f"w{i}") for i in range(4)], iteration_weight(F.lit(0), F.lit(1)).alias("one")
    ).first()
    assert row["w3"] == 1 and np.isclose(row["w0"], 0.9**15) and row["one"] == 1


def test_ssim_distance_of_equal_images_is_zero(spark):
    image = np.random.default_rng(1).normal(size=(9, 9))
    df = lines(spark, {0: image}).withColumn("other", F.col("vals"))
    got = metrics.ssim_distance(df, "vals", "other").collect()
    assert np.allclose([r["ssim"] for r in got], 0)


def test_photometric_of_opposites(spark):
    df = lines(spark, {(0, 0): np.eye(9), (0, 1): np.eye(9)}).withColumn("other", F.transform("vals", lambda v: -v))
    rows = metrics.photometric(df, "vals", "other").collect()
    assert len(rows) == 9 and all(0 <= v <= 0.85 + 0.15 * 2 for r in rows for v in r["photo"])


@pytest.mark.parametrize("plan", ["line", "pixel"])
def test_correlation_plans_agree(spark, plan):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    feats = [(0, side, 0, x, v.tolist()) for side, f in (("left", left), ("right", right)) for x, v in enumerate(f)]
    df = cost.feature_lines(spark.createDataFrame(feats, "image_id long, side string, y int, x int, vec array<double>").repartition(3))
    out = cost.row_correlation(df, plan=plan)
    got = out.first()["corr"] if plan == "line" else [r["corr"] for r in out.orderBy("x").collect()]
    assert np.allclose(got, left @ right.T / 2)
    with pytest.raises(ValueError):
        cost.row_correlation(df, plan="other")


def test_groups_must_divide(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="divide into groups"):
        df.select(cost.group_mean_product(F.col("v"), F.col("v"), 2)).collect()


def test_softmax_of_large_costs(spark):
    row = spark.range(1).select(cost.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p"), cost.soft_argmin(F.array(*[F.lit(v) for v in (0.0, 800.0, 0.0)])).alias("d")).first()
    assert row["p"] == [0.5, 0.5] and row["d"] == 1.0


def test_pyramid_drops_odd_tail(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0, 100.0],)], "corr array<double>")
    row = cost.pyramid(df, 3).first()
    assert row["corr_l1"] == [2, 6] and row["corr_l2"] == [4]
