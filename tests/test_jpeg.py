import struct

import numpy as np
import pytest

from gridloom.operators import blocks
from gridloom.options import PyramidOptions
from gridloom.plans import pipeline
from gridloom.sources import archive, codecs, jpeg, tiff


def smooth(h, w, gray=False):
    y, x = np.mgrid[0:h, 0:w]
    c = [128 + 100 * np.sin(x / 17 + k) * np.cos(y / 23) for k in range(3)]
    p = np.stack([*(c[:1] * 3 if gray else c), np.full((h, w), 255)], -1)
    return p.astype(np.uint8)


@pytest.mark.parametrize("gray", [False, True])
@pytest.mark.parametrize("shape", [(8, 8), (100, 131), (256, 256), (1, 1)])
def test_round_trip(shape, gray):
    p = smooth(*shape, gray)
    back = jpeg.decode(jpeg.encode(p, 95))
    assert back.shape == p.shape and np.abs(back.astype(int) - p).mean() < 2


def test_noise_and_one_colour():
    noise = np.random.default_rng(0).integers(0, 256, (64, 64, 4)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise)[..., :3].mean() < 3
    flat = np.full((32, 32, 4), 77, np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(flat)).astype(int)[..., :3] - 77).max() <= 2
    assert len(jpeg.encode(noise, 20)) < len(jpeg.encode(noise, 90)) and jpeg.encode(noise, 0) == jpeg.encode(noise, 85)


def test_long_codes_are_cut():
    counts = {i: 2**i for i in range(40)}
    lengths = jpeg._lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0 ** -n for n in lengths.values()) < 1


def test_other_readers_agree(spark, tmp_path):
    """Spark's own image source (the JVM's decoder) reads what is written here."""
    p = smooth(90, 120)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(p, 90))
    row = spark.read.format("image").load(f"{tmp_path}/a.jpg").select("image.*").first()
    other = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)[..., ::-1]
    assert np.abs(other.astype(int) - jpeg.decode(jpeg.encode(p, 90))[..., :3]).max() <= 4


def test_other_writers_are_read(spark, tmp_path):
    """Pictures by the JVM's encoder, whose colours have half the resolution."""
    jvm = spark.sparkContext._jvm
    p = smooth(45, 77)
    image = jvm.java.awt.image.BufferedImage(77, 45, 1)
    for y in range(45):
        for x in range(77):
            image.setRGB(x, y, int(p[y, x, 0]) << 16 | int(p[y, x, 1]) << 8 | int(p[y, x, 2]))
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(f"{tmp_path}/b.jpg"))
    back = jpeg.decode((tmp_path / "b.jpg").read_bytes())
    assert np.abs(back.astype(int) - p)[..., :3].mean() < 8


def test_broken_pictures_raise():
    good = jpeg.encode(smooth(16, 16))
    for bad in (b"", b"GIF89a", good[:40], good[:2] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            jpeg.decode(bad)


def test_jpeg_blocks_in_a_raster(tmp_path, monkeypatch):
    """A block whose tables stand apart."""
    p = smooth(32, 32)
    data = jpeg.encode(p, 95)
    cut = data.index(b"\xff\xc0")
    tables, rest = data[:cut] + b"\xff\xd9", data[:2] + data[cut:]
    lv = tiff.Level(32, 32, 3, 8, False, "jpeg", 1, 32, 32, [0], [len(rest)], False, 6, tables)

    class File:
        def read_at(self, n, at):
            return rest[at : at + n]

    assert np.abs(tiff.read_block(File(), lv, True, 0, 0).astype(int) - p[..., :3]).mean() < 2


def test_jpeg_pyramid(spark, tmp_path):
    y, x = np.mgrid[0:256, 0:256]
    tiff.write_tiff(f"{tmp_path}/g.tif", np.stack([x, y, np.full_like(x, 128)], -1).astype(np.uint8), (-25.0, 70.0), 0.1)
    h = pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o.tiles", PyramidOptions(format="jpeg", min_zoom=1, max_zoom=2, resampling="bilinear"))
    a = archive.Archive(f"{tmp_path}/o.tiles")
    tile = next(a.tile(2, x, y) for x in range(4) for y in range(4) if a.tile(2, x, y))
    assert h.tile_type == 3 and codecs.codec("jpg")[1](tile).shape == (256, 256, 4)
    assert blocks.halve(codecs.codec("jpeg")[1](tile), "bilinear").shape == (128, 128, 4)
