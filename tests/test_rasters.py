"""Raster files: filters at speed, encoders, the data source's planning and pruning, bad files, paths in a column."""

import os
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmill.sources import rasters
from scanmill.sources.encode import encode_npy, encode_pfm, encode_png, write_files
from scanmill.sources.files import list_sizes
from scanmill.sources.raster_source import RasterReader, decode_paths, head_shape, line_batches, read_rasters

from helpers import lines
from test_sources import png, write


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 0, 3, 1, 2), (0, 1, 2)])
@pytest.mark.parametrize("shape, bits", [((9, 5), 8), ((1, 7), 16), ((7, 1), 8), ((6, 8, 3), 16), ((5, 5, 4), 8)])
def test_filters(filters, shape, bits):
    image = np.random.default_rng(len(filters)).integers(0, 2**bits, size=shape)
    want = image.reshape(*shape[:2], -1)
    assert np.array_equal(rasters.decode_png(png(image, bits, filters)), want)
    assert np.array_equal(rasters.decode_png(encode_png(want, bits, filters)), want)


def test_filters_take_under_a_microsecond_a_pixel():
    image = np.random.default_rng(5).integers(0, 256, size=(700, 900, 1))
    data = encode_png(image, filters=(3, 4))
    start = time.process_time()
    assert np.array_equal(rasters.decode_png(data), image)
    assert time.process_time() - start < image.size * 1e-6


def test_unknown_filter():
    data = png(np.zeros((2, 2), int), 8, filters=(0,))
    with pytest.raises(ValueError, match="unknown PNG filter"):
        rasters._unfilter(np.array([0, 7]), np.zeros((2, 2, 1), np.uint8))
    assert rasters.decode_png(data).shape == (2, 2, 1)


@pytest.mark.parametrize("ext, encode", [("pfm", encode_pfm), ("npy", encode_npy), ("png", partial(encode_png, bits=16))])
@pytest.mark.parametrize("channels", [1, 3])
def test_heads_agree_with_bodies(tmp_path, ext, encode, channels):
    image = np.arange(4 * 5 * channels, dtype="f4").reshape(4, 5, channels)
    path = write(str(tmp_path / f"a.{ext}"), encode(image))
    assert head_shape(path, open(path, "rb").read(200)) == (4, 5, channels)
    whole = [r for b in line_batches(path, ["ch", "y", "h", "w", "vals", "error"]) for r in b.to_pylist()]
    heads = [r for b in line_batches(path, ["ch", "y", "h", "w", "error"]) for r in b.to_pylist()]
    assert [{k: v for k, v in r.items() if k != "vals"} for r in whole] == heads
    assert all(r["vals"] == image[r["y"], :, r["ch"]].tolist() for r in whole)


def test_written_files_come_back(spark, tmp_path):
    images = {k: np.random.default_rng(k).normal(size=(300 if k == 0 else 4, 5)) for k in range(3)}
    named = lines(spark, images, parts=4).withColumn("name", F.concat(F.lit("sub/"), F.col("image_id").cast("string"), F.lit(".npy")))
    out = write_files(named, str(tmp_path), encode_npy).collect()
    assert {r["path"] for r in out} == {str(tmp_path / "sub" / f"{k}.npy") for k in images}
    assert sorted(os.listdir(tmp_path / "sub")) == ["0.npy", "1.npy", "2.npy"]  # no drafts are left
    rows = read_rasters(spark, str(tmp_path)).collect()
    for k, image in images.items():
        own = sorted((r["y"], r["vals"]) for r in rows if r["path"].endswith(f"/{k}.npy"))
        assert np.array_equal([v for _, v in own], image)


def test_a_lost_line_is_no_image(spark, tmp_path):
    named = lines(spark, {1: np.ones((4, 3))}).where("y <> 2").withColumn("name", F.lit("x.npy"))
    with pytest.raises(Exception, match="lines are missing"):
        write_files(named, str(tmp_path), encode_npy)


def test_partitions_follow_sizes_and_paths_are_pruned(spark, tmp_path):
    for k in range(10):
        write(str(tmp_path / f"{k}.npy"), encode_npy(np.full((2, 2, 1), float(k))))
    size = next(list_sizes(str(tmp_path)))[1]
    reader = RasterReader(["path"], {"path": str(tmp_path), "partitionBytes": str(3 * size)})
    assert [len(p.value) for p in reader.partitions()] == [3, 3, 3, 1]
    write(str(tmp_path / "5.npy"), b"never opened")
    df = read_rasters(spark, str(tmp_path), partition_bytes=3 * size)
    assert df.rdd.getNumPartitions() == 4
    some = df.where(F.col("path").isin(str(tmp_path / "3.npy"), str(tmp_path / "4.npy")) & (F.col("y") == 1))
    assert sorted(r["vals"] for r in some.collect()) == [[3.0, 3.0], [4.0, 4.0]]
    assert some.rdd.getNumPartitions() == 1
    assert [r["error"] is None for r in df.where(F.col("path").endswith("5.npy")).collect()] == [False]


def test_globs_stay_within_a_folder(tmp_path):
    for name in ("a/x.png", "a/b/x.png", "c/y.png", "c/y.npy"):
        write(str(tmp_path / name), b"1")
    found = lambda glob: [p.removeprefix(str(tmp_path)) for p, _ in list_sizes(f"{tmp_path}/{glob}")]
    assert found("*/*.png") == ["/a/x.png", "/c/y.png"]
    assert found("?/b/*") == ["/a/b/x.png"]
    assert found("c") == ["/c/y.npy", "/c/y.png"]
    assert found("none/*.png") == []
    with pytest.raises(FileNotFoundError):
        found("none")


def test_empty_folders_give_no_lines(spark, tmp_path):
    assert read_rasters(spark, f"{tmp_path}/*.png").count() == 0


def test_one_broken_file_gives_the_others(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, size=(3, 4, 3))
    write(str(tmp_path / "good.png"), encode_png(image))
    write(str(tmp_path / "bad.png"), encode_png(image)[:50])
    for df in (rasters.read_images(spark, str(tmp_path)), read_rasters(spark, str(tmp_path)), rasters.read_png16(spark, f"{tmp_path}/*.png")):
        assert {os.path.basename(r["path"]) for r in rasters.decode_errors(df).collect()} == {"bad.png"}
        assert rasters.decoded(df).count() == 9
    # Spark's own file sources pass over files without a byte; this one names them
    write(str(tmp_path / "empty.png"), b"")
    assert rasters.decode_errors(read_rasters(spark, str(tmp_path))).count() == 2


def test_paths_in_a_column_keep_their_keys(spark, tmp_path):
    path = write(str(tmp_path / "a.pfm"), encode_pfm(np.ones((2, 3, 1))))
    jpeg = write(str(tmp_path / "b.jpg"), b"\xff\xd8")
    df = spark.createDataFrame([(7, "x", path), (8, "y", str(tmp_path / "none.npy")), (9, "z", None), (10, "x", jpeg)], "id long, s string, p string")
    rows = decode_paths(df, "p", ["id", "s"]).collect()
    assert sorted((r["id"], r["s"], r["y"], r["error"] is None) for r in rows if r["y"] is not None) == [(7, "x", 0, True), (7, "x", 1, True)]
    errors = {r["id"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {8, 9, 10} and errors[9] == "no path" and errors[10] == "no decoder for .jpg files"
