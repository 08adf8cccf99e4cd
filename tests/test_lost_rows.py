"""Nothing is dropped without a word: gaps, unknown names, doubled keys and missing lines show or fail."""

import pytest
from pyspark.sql import functions as F

from scanmill.operators import grid, jobs, metrics, ordinal
from scanmill.plans import pseudo_stereo as ps
from scanmill.sources import sinks
from scanmill.sources.listings import LAYOUTS
from scanmill.sources.registry import EVALUATION, evaluation_registry

LINE = "image_id long, ch int, y int, h int, w int, vals array<double>"


def test_loss_is_null_when_an_iteration_is_empty_or_absent(spark):
    schema = "iter int, pred array<double>, gt array<double>, valid array<boolean>"
    full = [(i, [-1.0], [2.0], [True]) for i in range(3)]
    assert metrics.sequence_loss(spark.createDataFrame(full, schema), 3).first()["loss"] > 0
    empty = full[:2] + [(2, [-1.0], [2.0], [False])]
    assert metrics.sequence_loss(spark.createDataFrame(empty, schema), 3).first()["loss"] is None
    assert metrics.sequence_loss(spark.createDataFrame(full[:2], schema), 3).first()["loss"] is None


@pytest.mark.parametrize("loss", ["flow", "disp"])
def test_confidence_losses_are_null_then_too(spark, loss):
    h, w = 4, 5
    preds = [(i, 1, y, [1.0] * w) for i in range(2) for y in range(h)]
    maps = [(1, y, [2.0] * w, [0.5] * w, [True] * w, [False] * w, [True] * w) for y in range(h)]
    views = [(1, 0, y, h, w, [0.1 * x for x in range(w)], [0.2] * w) for y in range(h)]
    p = spark.createDataFrame(preds, "iter int, image_id long, y int, disp array<double>")
    m = spark.createDataFrame(maps, "image_id long, y int, gt array<double>, conf array<double>, mask_nocc array<boolean>, mask_inpaint array<boolean>, valid array<boolean>")
    v = spark.createDataFrame(views, "image_id long, ch int, y int, h int, w int, left array<double>, right array<double>")

    def run(predictions, maps):
        if loss == "flow":
            return metrics.confidence_loss_flow(predictions, maps, v, 2).first()["loss"]
        return metrics.confidence_loss_disp(predictions.filter("iter = 0").drop("iter"), predictions, maps, v, 2).first()["loss"]

    assert run(p, m) is not None
    assert run(p.filter("iter = 0"), m) is None
    assert run(p, m.withColumn("mask_nocc", F.transform("mask_nocc", lambda x: F.lit(False)))) is None
    assert run(p.filter("iter = 0 OR y <> 2"), m) is None  # one line lacks an iteration
    assert run(p.unionByName(p.filter("iter = 1 AND y = 2")), m) is None  # one has it twice
    assert run(p.unionByName(p.filter("iter = 1").withColumn("iter", F.lit(7))), m) is None  # nobody asked for the seventh


def test_confidence_losses_take_four_exchanges(spark):
    p = spark.range(4).selectExpr("0 AS iter", "id AS image_id", "0 AS y", "array(1.0D, 2.0D) AS disp")
    m = spark.range(4).selectExpr("id AS image_id", "0 AS y", "array(1.0D, 2.0D) AS gt", "array(0.5D, 0.5D) AS conf", "array(true, true) AS mask_nocc",
                                  "array(false, false) AS mask_inpaint", "array(true, true) AS valid")
    v = spark.range(4).selectExpr("id AS image_id", "0 AS ch", "0 AS y", "1 AS h", "2 AS w", "array(1.0D, 2.0D) AS left", "array(1.0D, 2.0D) AS right")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for loss in (metrics.confidence_loss_flow(p, m, v, 1), metrics.confidence_loss_disp(p.drop("iter"), p, m, v, 1)):
            plan = loss._jdf.queryExecution().executedPlan().toString()
            # two of them are the last sums: per iteration, and over iterations
            assert plan.count("Exchange hashpartitioning") <= 5 and plan.count("Exchange SinglePartition") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_listed_names_have_rules(spark):
    assert {d.name for d in EVALUATION} <= set(LAYOUTS)
    schema = "dataset string, image_id long, pred array<double>, gt array<double>, valid array<boolean>"
    rows = [(d, k, [5.0, 1.0], [1.0, 1.0], [True, True]) for k, d in enumerate(("kitti", "eth3d", "ETH3D"))]
    got = metrics.evaluate(spark.createDataFrame(rows, schema), evaluation_registry(spark)).collect()
    assert {r["dataset"] for r in got} == {"kitti", "eth3d", "ETH3D"}
    with pytest.raises(Exception, match="no rule for dataset other"):
        other = spark.createDataFrame(rows + [("other", 9, [1.0], [1.0], [True])], schema)
        metrics.evaluate(other, evaluation_registry(spark)).collect()


def test_doubled_keys_fail_and_unpaired_ones_are_named(spark):
    rows = [("d", "left", "a/1"), ("d", "right", "b/1"), ("d", "left", "a/2")]
    assets = spark.createDataFrame(rows, "dataset string, role string, path string")
    key = F.substring_index("path", "/", -1)
    assert [r["left_path"] for r in ordinal.pair_by_key(assets, ["left", "right"], key).collect()] == ["a/1"]
    assert [(r["pair_key"], r["n_right"]) for r in ordinal.unpaired_keys(assets, ["left", "right"], key).collect()] == [("2", 0)]
    with pytest.raises(Exception, match="two left paths"):
        ordinal.pair_by_key(assets.union(spark.createDataFrame([("d", "left", "c/1")], assets.schema)), ["left", "right"], key).collect()


def test_missing_and_doubled_lines_fail(spark):
    a = spark.createDataFrame([(1, 0, y, 3, 2, [1.0, 2.0]) for y in range(3)], LINE)
    b = a.filter("y < 2")
    assert grid.align({"a": a, "b": a}).count() == 3
    assert grid.align({"a": a, "b": b}).count() == 2
    assert [(r["y"], r["n_a"], r["n_b"]) for r in grid.misaligned({"a": a, "b": b}).collect()] == [(2, 1, 0)]
    with pytest.raises(Exception, match="b lacks a line"):
        grid.align({"a": a, "b": b}, missing="fail").collect()
    with pytest.raises(Exception, match="a has more than one"):
        grid.align({"a": a.union(a.filter("y = 0")), "b": a}).collect()


def test_predictor_that_adds_a_column_is_not_joined(spark):
    warped = spark.createDataFrame([(1, 0, 0, [1.0, 0.0], [False, True])], "image_id long, ch int, y int, vals array<double>, mask_inpaint array<boolean>")
    nine = F.transform("vals", lambda v: F.lit(9.0))
    added = ps.fill_holes(warped, lambda df: df.withColumn("pred", nine))
    assert added.first()["vals"] == [1.0, 9.0]
    assert "Join" not in added._jdf.queryExecution().toString()
    assert ps.fill_holes(warped, lambda df: df.select("image_id", "ch", "y", nine.alias("pred"))).first()["vals"] == [1.0, 9.0]
    with pytest.raises(Exception, match="no prediction"):
        ps.fill_holes(warped, lambda df: df.select("image_id", "ch", "y", nine.alias("pred")).filter("y > 0")).collect()


def test_odd_palettes_fail(spark):
    entries = [(i, 0, 0, 0) for i in range(256)]
    lines = spark.createDataFrame([(1, 0, 0, 1, 2, [1.0, 2.0])], LINE)
    make = lambda rows: spark.createDataFrame(rows, "idx int, r int, g int, b int")
    assert sinks.render_disparity(lines, make(entries)).count() == 1
    for odd in (entries + [(256, 1, 1, 1)], entries + [(3, 1, 1, 1)], entries[1:] + [(-1, 0, 0, 0)]):
        with pytest.raises(ValueError):
            sinks.render_disparity(lines, make(odd))


@pytest.mark.parametrize("n, k", [(1, 5), (7, 1), (10, 3), (10, 10), (3, 10), (501, 500), (1000, 37), (2, 2), (999, 500)])
def test_even_sample_by_arithmetic(spark, n, k):
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    want = sorted({n - 1 if i == k - 1 and i > 0 else int(i * step) for i in range(k)})
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("path"))
    assert sorted(r["ordinal"] for r in ordinal.even_sample(df, ["path"], k).collect()) == want


def test_device_errors_are_retried_and_failing_loads_are_reported(spark):
    class Device(RuntimeError):
        pass

    def apply(_, row, scale):
        if scale < 3:
            raise Device("full")
        return None

    assert jobs.with_retry(apply, 3, (Device,))(None, {}) == (None, 3)
    with pytest.raises(Device):
        jobs.with_retry(apply, 5)(None, {})
    items = spark.createDataFrame([("a/x",), ("a/y",)], "path string")

    def load():
        raise OSError("no model")

    got = jobs.map_with_scale(items, load, apply, max_scale=3).collect()
    assert {(r["filename"], r["status"]) for r in got} == {("x", "FAILED: no model"), ("y", "FAILED: no model")}
