import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import images, lines
from scanmill.operators import grid, stencil
from scanmill.functions.scalar import pad_amounts, target_size


@pytest.mark.parametrize("h, w", [(28, 28), (29, 31), (5, 9)])
@pytest.mark.parametrize("mode", ["even", "top0"])
def test_unpad_undoes_pad(spark, h, w, mode):
    image = np.random.default_rng(1).normal(size=(h, w))
    padded = grid.pad(lines(spark, {0: image}), 14, mode)
    got = images(padded)[0, 0]
    assert got.shape[0] % 14 == 0 and got.shape[1] % 14 == 0
    back = images(grid.unpad(padded, F.lit(h), F.lit(w), 14, mode))[0, 0]
    assert np.array_equal(back, image)


@pytest.mark.parametrize("size, k, want", [(28, 14, 0), (29, 14, 13), (63, 32, 1)])
def test_pad_amounts(spark, size, k, want):
    p = pad_amounts(F.lit(size), F.lit(size), k)
    row = spark.range(1).select(*[c.alias(n) for n, c in p.items()]).first()
    assert row["left"] + row["right"] == want and row["top"] == want // 2


def test_flip_twice_is_identity(spark):
    image = np.arange(12.0).reshape(3, 4)
    df = lines(spark, {0: image})
    assert np.array_equal(images(grid.flip_y(grid.flip_x(df)))[0, 0], image[::-1, ::-1])
    assert np.array_equal(images(grid.flip_x(grid.flip_x(df)))[0, 0], image)


def test_tiles_must_divide(spark):
    with pytest.raises(Exception, match="not a multiple"):
        grid.split_tiles(lines(spark, {0: np.zeros((4, 5))}), 2).collect()


@pytest.mark.parametrize("h, w", [(4, 5), (7, 8), (3, 2), (9, 11)])
def test_border_tiles_hold_what_is_there(spark, h, w):
    image = np.random.default_rng(8).normal(size=(h, w))
    cut = grid.split_tiles(lines(spark, {0: image}), 4, border="keep")
    for r in cut.collect():
        part = image[r["tile_y"] * 4 : r["tile_y"] * 4 + 4, r["tile_x"] * 4 : r["tile_x"] * 4 + 4]
        assert r["vals"] == part.ravel().tolist() and r["token"] == r["tile_y"] * -(-w // 4) + r["tile_x"]
    assert np.array_equal(images(grid.join_tiles(cut, 4))[0, 0], image)


@pytest.mark.parametrize("name", ["tile_split", "tile_round_trip"])
@pytest.mark.parametrize("rows", [65, 130, 191])
def test_tile_queries_take_any_number_of_vectors(spark, tmp_path, name, rows):
    import duckdb

    import __spark_entry__ as entry

    spark.range(rows).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST(id * 64 + i AS FLOAT)) AS embedding").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    got = entry.queries()[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == rows * 64


def test_box_mean_is_mirrored(spark):
    image = np.random.default_rng(2).normal(size=(70, 8))
    want = np.pad(image, 3, mode="reflect")
    want = np.lib.stride_tricks.sliding_window_view(want, (7, 7)).mean((-1, -2))
    got = images(stencil.box_mean(lines(spark, {0: image})))[0, 0]
    assert np.allclose(got, want)


@pytest.mark.parametrize("k, s", [(3, 2), (5, 4)])
def test_avg_pool(spark, k, s):
    image = np.random.default_rng(3).normal(size=(13, 9))
    want = np.lib.stride_tricks.sliding_window_view(np.pad(image, 1), (k, k))[::s, ::s].mean((-1, -2))
    assert np.allclose(images(stencil.avg_pool(lines(spark, {0: image}), k, s, 1))[0, 0], want)


def test_gauss_blur_borders(spark):
    image = np.random.default_rng(4).normal(size=(6, 7))
    g = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    g /= g.sum()
    kernel = np.outer(g, g)
    for border, how in (("zero", {"mode": "constant"}), ("edge", {"mode": "edge"})):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(image, 2, **how), (5, 5))
        got = images(stencil.gauss_blur(lines(spark, {0: image}), border=border))[0, 0]
        assert np.allclose(got, (windows * kernel).sum((-1, -2)))
    same = images(stencil.gauss_blur(lines(spark, {0: image}), std=0.0, border="edge"))[0, 0]
    assert np.allclose(same, image)


def test_resize_to_same_size_is_identity(spark):
    image = np.random.default_rng(5).normal(size=(7, 9))
    for mode in ("bilinear", "bicubic", "nearest"):
        for rule in ("corners", "centers"):
            got = images(grid.resize(lines(spark, {0: image}), 7, 9, mode, rule))[0, 0]
            assert np.allclose(got, image)


def test_resize_single_row_and_column(spark):
    got = images(grid.resize(lines(spark, {0: [[5.0]]}), 3, 4))[0, 0]
    assert np.array_equal(got, np.full((3, 4), 5.0))


def test_resize_per_image_size(spark):
    df = lines(spark, {1: np.ones((4, 4)), 2: np.ones((6, 6))})
    out = grid.resize(df, (F.col("h") * F.col("image_id")).cast("int"), (F.col("w") / 2).cast("int"))
    got = images(out)
    assert got[1, 0].shape == (4, 2) and got[2, 0].shape == (12, 3)


@pytest.mark.parametrize("method, want", [("lower_bound", (686, 518)), ("upper_bound", (518, 392)), ("minimal", (686, 518))])
def test_target_size_keeps_aspect(spark, method, want):
    w, h = target_size(F.lit(640), F.lit(480), 518, 518, method, 14, keep_aspect=True)
    row = spark.range(1).select(w.alias("w"), h.alias("h")).first()
    # scales are 0.809 (width) and 1.079 (height): the height one is nearer to 1
    assert (row["w"], row["h"]) == want
