import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmill.sources import listings, rasters, readers, sidecar
from scanmill.sources.manifest import left_out, read_manifest


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def pfm(image, order="<"):
    magic = b"PF" if image.ndim == 3 else b"Pf"
    head = magic + b"\n%d %d\n%s\n" % (image.shape[1], image.shape[0], b"-2.5" if order == "<" else b"2.5")
    return head + image[::-1].astype(order + "f4").tobytes()


def png(image, bits=8, filters=(0,)):
    """Encode with the given row filters in turn."""
    channels = 1 if image.ndim == 2 else image.shape[2]
    step = channels * bits // 8
    rows = image.astype(">u2" if bits == 16 else "u1").reshape(len(image), -1).view("u1").astype(int)
    out, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows):
        kind = filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), row[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((row - guess) % 256).astype("u1").tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], bits, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def image_of(df):
    rows = df.filter("error IS NULL").collect()
    h, w = rows[0]["h"], rows[0]["w"]
    out = np.zeros((h, w, 1 + max(r["ch"] for r in rows)))
    for r in rows:
        out[r["y"], :, r["ch"]] = r["vals"]
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("shape", [(3, 4), (2, 5, 3)])
def test_pfm(spark, tmp_path, order, shape):
    image = np.random.default_rng(1).normal(size=shape).astype("f4")
    path = write(str(tmp_path / "a.pfm"), pfm(image, order))
    assert np.array_equal(image_of(rasters.read_pfm(spark, path)), image.reshape(*shape[:2], -1))


def test_bad_pfm_is_reported_and_others_go_on(spark, tmp_path):
    write(str(tmp_path / "good.pfm"), pfm(np.ones((2, 2), "f4")))
    write(str(tmp_path / "magic.pfm"), b"P6\n2 2\n1\n")
    write(str(tmp_path / "size.pfm"), b"Pf\n2x2\n1\n")
    df = rasters.read_pfm(spark, str(tmp_path / "*.pfm"))
    errors = {os.path.basename(r["path"]): r["error"] for r in rasters.decode_errors(df).collect()}
    assert errors == {"magic.pfm": "not a PFM file", "size.pfm": "malformed PFM header"}
    assert rasters.decoded(df).count() == 2


def test_npy(spark, tmp_path):
    image = np.arange(6, dtype="f4").reshape(2, 3)
    np.save(tmp_path / "a.npy", image)
    assert np.array_equal(image_of(rasters.read_npy(spark, str(tmp_path / "a.npy")))[:, :, 0], image)


@pytest.mark.parametrize("bits, shape", [(16, (7, 5)), (8, (7, 5)), (8, (7, 5, 3)), (16, (6, 4, 3))])
def test_png_keeps_every_bit(spark, tmp_path, bits, shape):
    image = np.random.default_rng(2).integers(0, 2**bits, size=shape)
    path = write(str(tmp_path / "a.png"), png(image, bits, filters=(0, 1, 2, 3, 4)))
    assert np.array_equal(image_of(rasters.read_png16(spark, path)), image.reshape(*shape[:2], -1))


def test_builtin_images_in_either_channel_order(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, size=(4, 6, 3))
    path = write(str(tmp_path / "a.png"), png(image))
    assert np.array_equal(image_of(rasters.read_images(spark, path)), image)
    assert np.array_equal(image_of(rasters.read_images(spark, path, rgb=False)), image[:, :, ::-1])


def test_sidecar(spark, tmp_path):
    for name, fx in (("s1", 700.5), ("s2", 300.0)):
        settings = {"camera_settings": [{"intrinsic_settings": {"fx": fx, "fy": 1}}, {"intrinsic_settings": {"fx": 1}}]}
        write(str(tmp_path / name / "_camera_settings.json"), json.dumps(settings).encode())
        write(str(tmp_path / name / "0.left.depth.png"), png(np.full((1, 2), 100), 16))
    depth = rasters.decoded(rasters.read_png16(spark, str(tmp_path / "*" / "*.depth.png")))
    cameras = sidecar.read_cameras(listings.list_files(spark, str(tmp_path / "*" / "*.depth.png")))
    lines = readers.disparity_lines(sidecar.with_camera(depth, cameras), "falling_things")
    got = {os.path.basename(os.path.dirname(r["path"])): r["disp"] for r in lines.collect()}
    assert np.allclose(got["s1"], 700.5 * 6) and np.allclose(got["s2"], 300 * 6)
    write(str(tmp_path / "s3" / "0.left.depth.png"), png(np.full((1, 2), 100), 16))  # a folder without settings
    cameras = sidecar.read_cameras(listings.list_files(spark, str(tmp_path / "*" / "*.depth.png")))
    assert {os.path.basename(r["dir"]): r["fx"] for r in cameras.collect()} == {"s1": 700.5, "s2": 300.0, "s3": None}


def test_readers_handle_zero_and_far_values(spark):
    df = spark.createDataFrame([([0.0, 80.0, 65500.0, -1.0],)], "vals array<double>")
    one = lambda name: readers.disparity_lines(df, name).first()
    tartan = one("tartanair")
    assert tartan["disp"][0] == float("inf") and tartan["disp"][1] == 1 and tartan["valid"] == [True, True, True, False]
    vk = one("vkitti2")
    assert vk["disp"][0] == 0 and vk["disp"][2] == 0 and vk["valid"] == [False, True, False, False]
    assert np.isclose(vk["disp"][1], 0.532725 * 725.0087 / np.float32(0.8))
    assert one("kitti")["valid"] == [False, True, True, False]
    assert one("sceneflow")["valid"] == [True, True, False, True]
    nocc = df.withColumn("nocc", F.array(*[F.lit(float(v)) for v in (0, 128, 255, 255)]))
    assert readers.disparity_lines(nocc, "eth3d", "all").first()["valid"] == [False, True, True, True]
    assert readers.disparity_lines(nocc, "middlebury", "noc").first()["valid"] == [False, False, True, True]
    with pytest.raises(ValueError):
        readers.disparity_lines(nocc, "eth3d", "some")


# --- listings ---------------------------------------------------------------------------------


def touch(root, *names):
    for n in names:
        write(os.path.join(root, n), b"x")


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        listings.list_images(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        listings.list_dataset(spark, "kitti", str(tmp_path / "none"))


def test_list_images(spark, tmp_path):
    touch(str(tmp_path), "b.jpg", "a.jpg", "c.png")
    got = [r["path"] for r in listings.list_images(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == [str(tmp_path / "a.jpg"), str(tmp_path / "b.jpg")]


def test_kitti_is_strict(spark, tmp_path):
    root = str(tmp_path)
    base = "2015/training"
    for i in range(3):
        touch(root, f"{base}/image_2/{i:03}_10.png", f"{base}/image_3/{i:03}_10.png", f"{base}/disp_occ_0/{i:03}_10.png")
    touch(root, f"{base}/image_2/000_11.png")
    rows = listings.list_dataset(spark, "kitti", root).orderBy("ordinal").collect()
    assert [os.path.basename(r["disp_path"]) for r in rows] == ["000_10.png", "001_10.png", "002_10.png"]
    touch(root, f"{base}/image_2/009_10.png")
    with pytest.raises(ValueError, match="differ in length"):
        listings.list_dataset(spark, "kitti", root)


def test_falling_things_appends_levels_and_truncates(spark, tmp_path):
    root = str(tmp_path)
    for d in ("mixed/z", "single/obj/a"):
        touch(root, f"{d}/0.left.jpg", f"{d}/0.right.jpg", f"{d}/0.left.depth.png")
    touch(root, "single/obj/a/1.left.jpg")
    rows = listings.list_dataset(spark, "falling_things", root).orderBy("ordinal").collect()
    assert [r["left_path"].removeprefix(root) for r in rows] == ["/mixed/z/0.left.jpg", "/single/obj/a/0.left.jpg"]


@pytest.mark.parametrize(
    "name, files",
    [
        ("middlebury", ("MiddEval3/trainingH/A/im0.png", "MiddEval3/trainingH/A/im1.png", "MiddEval3/trainingH/A/disp0GT.pfm")),
        ("eth3d", ("two_view_training/a/im0.png", "two_view_training/a/im1.png", "two_view_training_gt/a/disp0GT.pfm")),
        ("tartanair", ("a/b/c/d/image_left/0.png", "a/b/c/d/image_right/0.png", "a/b/c/d/depth_left/0.npy")),
        ("crestereo", ("s/0_left.jpg", "s/0_right.jpg", "s/0_left.disp.png")),
        ("vkitti2", tuple(f"Scene01/x/frames/{p}" for p in ("rgb/Camera_0/rgb0.jpg", "rgb/Camera_1/rgb0.jpg", "depth/Camera_0/depth0.png"))),
    ],
)
def test_layouts(spark, tmp_path, name, files):
    touch(str(tmp_path), *files)
    (row,) = listings.list_dataset(spark, name, str(tmp_path)).collect()
    assert [row[f"{r}_path"].removeprefix(str(tmp_path) + "/") for r in listings.ROLES] == list(files)


def test_sceneflow(spark, tmp_path):
    root = str(tmp_path)
    touch(root, "fp/TRAIN/A/0000/left/1.png", "fp/TRAIN/monkaa/left/2.png", "fp/TRAIN/x/y/z/left/3.png")
    touch(root, *[f"fp/TEST/A/0/left/{i:04}.png" for i in range(30)])
    rows = listings.list_sceneflow(spark, root, "fp").orderBy("ordinal").collect()
    assert [r["left_path"][-5] for r in rows] == ["1", "2", "3"]
    assert rows[0]["right_path"].endswith("fp/TRAIN/A/0000/right/1.png")
    assert rows[0]["disp_path"].endswith("disparity/TRAIN/A/0000/left/1.pfm")
    assert listings.list_sceneflow(spark, root, "fp", augmented=False).count() == 30


# --- manifests --------------------------------------------------------------------------------


def test_manifest_stops_at_blank_line(spark, tmp_path):
    path = str(tmp_path / "m.txt")
    write(path, b"l/a.png r/a.png d/a.npy\nl/b.png r/b.png /abs/b.npy\n\nl/c.png r/c.png d/c.npy\nx y z")
    rows = read_manifest(spark, path, "/data", cols=(0, 2)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["left_path"], r["disp_path"]) for r in rows] == [
        (0, "/data/l/a.png", "/data/d/a.npy"),
        (1, "/data/l/b.png", "/abs/b.npy"),
    ]
    write(str(tmp_path / "whole.txt"), b"l/a.png r/a.png d/a.npy\n\n")
    assert [(os.path.basename(r["manifest"]), r["lines"]) for r in left_out(spark, str(tmp_path / "*.txt")).collect()] == [("m.txt", 2)]


def test_manifest_order_holds_over_splits(spark, tmp_path):
    path = str(tmp_path / "m.txt")
    write(path, "".join(f"left/{i}.png\n" for i in range(5000)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_manifest(spark, path, "", cols=(0,)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["sample_id"]: r["left_path"] for r in rows} == {i: f"left/{i}.png" for i in range(5000)}


def test_manifest_with_too_few_columns(spark, tmp_path):
    path = write(str(tmp_path / "m.txt"), b"a b\nc\n")
    with pytest.raises(Exception, match="too few paths"):
        read_manifest(spark, path, "/r", cols=(0, 1)).collect()
