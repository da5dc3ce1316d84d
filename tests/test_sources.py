"""Containers, encoders and file scans."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from prismora.operators import codec
from prismora.plans import frames
from prismora.sources import images, paths, raw


@pytest.mark.parametrize("bits", [12, 14, 16])
@pytest.mark.parametrize("e", ["<", ">"])
def test_mosaics_of_all_depths_are_alike(bits, e):
    assert (raw.mosaic(raw.synthetic(18, 10, bits, e)) == raw.mosaic(raw.synthetic(18, 10))).all()


def test_folder_to_samples(spark, tmp_path):
    for name in ("b.NEF", "a.dng", "skip.jpg", "broken.dng"):
        (tmp_path / name).write_bytes(b"II*\0" if name.startswith("broken") else raw.synthetic())
    files = raw.read_files(spark, str(tmp_path))
    rows = raw.bayer_rows(files).collect()
    assert len([r for r in rows if r.error is None]) == 32 and [r.path.endswith("broken.dng") for r in rows if r.error] == [True]
    s = {r.path.rpartition("/")[2]: r for r in raw.summary(raw.read_tags(files)).collect()}
    assert s["a.dng"].num["width"] == 16 and s["b.NEF"].str["model"] == "Model One" and s["a.dng"].num["as_shot_neutral"] == 1


def test_cyclic_links_end():
    data = bytearray(raw.synthetic())
    data[-4:] = data[4:8]
    assert len(list(raw.Container(bytes(data)).directories())) == 1


def test_encoders(spark):
    px = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert images.size(images.png(px)) == images.size(images.tiff(px)) == (7, 5)
    rows = [(1, y, x, *map(int, px[y, x])) for y in range(5) for x in range(7)]
    (got,) = images.encode(spark.createDataFrame(rows, "photo long, y int, x int, r int, g int, b int"), "ppm").collect()
    assert bytes(got.image) == images.ppm(px)
    idat = images.png(px)[41:-16]
    assert np.frombuffer(zlib.decompress(idat), np.uint8).reshape(5, 22)[:, 1:].reshape(5, 7, 3).tolist() == px.tolist()
    assert images.size(b"") == images.size(b"\xff\xd8") == (0, 0)


def test_writer_replaces_whole_files(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22"))], "name string, image binary")
    for _ in range(2):
        assert sorted(map(tuple, images.write(df, str(tmp_path / "out"), ".ppm").collect())) == [("a", 1), ("b", 2)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.ppm", "b.ppm"]


def test_paths(spark):
    names = ["/x/A.NEF", "/x/.nef", "/x/nef", "/x/b.tar.dng", "/x/c.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in paths.discover(df).collect()] == ["/x/A.NEF", "/x/b.tar.dng"]


def test_profiles_keep_neutral():
    for m in frames.MATRICES.values():
        assert np.allclose(np.array(frames.camera_to_srgb(m)).sum(axis=1), 1)


def test_unpack_rejects_wrong_lengths(spark):
    df = spark.createDataFrame([(bytearray(3), 3)], "packed binary, width int")
    with pytest.raises(Exception, match="3 bytes for 3 samples"):
        df.select(codec.unpack("packed", "width", 12)).collect()
