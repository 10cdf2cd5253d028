"""Runs over generated rasters: bands, masks, fill, rebuild, alike in kind to real sources."""

import numpy as np
import pytest

from gridloom.options import BandConfig, PyramidOptions, TransformOptions
from gridloom.plans import pipeline
from gridloom.sources import archive, codecs, tiff


def raster(path, w, h, n, f, pixel=0.1, origin=(-25.0, 70.0), dtype=np.uint8, **more):
    y, x = np.mgrid[0:h, 0:w]
    bands = [np.broadcast_to(f(x, y, b), (h, w)) for b in range(n)]
    tiff.write_tiff(path, np.stack(bands, -1).astype(dtype), origin, pixel, **more)


def tiles(path):
    a = archive.Archive(path)
    h = a.header
    out = {}
    for z in range(h.min_zoom, h.max_zoom + 1):
        for x in range(2**z):
            for y in range(2**z):
                if data := a.tile(z, x, y):
                    out[z, x, y] = codecs.png_decode(data)
    return h, out


def test_half_transparent(spark, tmp_path):
    raster(f"{tmp_path}/a.tif", 512, 512, 4, lambda x, y, b: np.where(x >= 256, 0, 255) if b == 3 else 200)
    pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o", PyramidOptions(min_zoom=0, max_zoom=2))
    h, got = tiles(f"{tmp_path}/o")
    values = {tuple(p) for t in got.values() for p in np.unique(t.reshape(-1, 4), axis=0).tolist()}
    assert {z for z, _, _ in got} == {0, 1, 2} and (0, 0, 0, 0) in values and (200, 200, 200, 255) in values
    assert all(p[:3] in ((200, 200, 200), (0, 0, 0)) for p in values)


def test_gray_nodata(spark, tmp_path):
    raster(f"{tmp_path}/a.tif", 256, 256, 1, lambda x, y, b: np.where((x < 64) & (y < 64), 0, 180), pixel=0.2, nodata="0")
    pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o", PyramidOptions(min_zoom=0, max_zoom=1, resampling="nearest"))
    _, got = tiles(f"{tmp_path}/o")
    values = {tuple(p) for t in got.values() for p in np.unique(t.reshape(-1, 4), axis=0).tolist()}
    assert values == {(0, 0, 0, 0), (180, 180, 180, 255)}


def test_sixteen_bit_bands(spark, tmp_path):
    raster(f"{tmp_path}/a.tif", 512, 512, 4, lambda x, y, b: 100 + (x + y * b) % 9900, dtype=np.uint16)
    config = BandConfig(bands=(1, 2, 3), alpha=0, rescale="linear", range=(0.0, 10000.0))
    pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o", PyramidOptions(min_zoom=0, max_zoom=2, bands=config, resampling="nearest"))
    _, got = tiles(f"{tmp_path}/o")
    deep = np.concatenate([t.reshape(-1, 4) for k, t in got.items() if k[0] == 2])
    seen = deep[deep[:, 3] > 0]
    assert len(seen) and seen[:, 0].min() >= 2 and seen[:, 0].max() <= 17


@pytest.mark.parametrize("mode", ["passthrough", "rebuild", "reencode"])
def test_transforms(spark, tmp_path, mode):
    raster(f"{tmp_path}/a.tif", 256, 256, 3, lambda x, y, b: (x * 3 + y * 7 + b * 11) % 256, pixel=0.05, origin=(8.0, 47.5))
    pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o", PyramidOptions(min_zoom=2, max_zoom=4))
    before, own = tiles(f"{tmp_path}/o")
    options = {"passthrough": TransformOptions(), "rebuild": TransformOptions(min_zoom=0, fill=(128, 0, 128, 255)), "reencode": TransformOptions(format="jpeg")}[mode]
    h = pipeline.transform_archive(spark, f"{tmp_path}/o", f"{tmp_path}/t", options)
    assert all(r.ok for r in archive.check_archive(spark, f"{tmp_path}/t").collect())
    if mode == "passthrough":
        assert tiles(f"{tmp_path}/t")[1].keys() == own.keys() and h.data_length == before.data_length
    elif mode == "reencode":
        assert h.tile_type == 3 and h.addressed == before.addressed
    else:
        _, got = tiles(f"{tmp_path}/t")
        assert {z for z, _, _ in got} == {0, 1, 2, 3, 4} and len(got) >= len(own)
        assert (128, 0, 128, 255) in {tuple(p) for p in got[0, 0, 0].reshape(-1, 4)[::7].tolist()}


def test_gamma_brightens_the_deepest_level_only(spark, tmp_path):
    raster(f"{tmp_path}/a.tif", 128, 128, 3, lambda x, y, b: 64, pixel=0.2)
    for name, gamma in (("a", 1.0), ("b", 2.2)):
        pipeline.build_pyramid(spark, [f"{tmp_path}/a.tif"], f"{tmp_path}/{name}", PyramidOptions(min_zoom=2, max_zoom=2, gamma=gamma, resampling="bilinear"))
    plain, bright = (max(int(t[..., 0].max()) for t in tiles(f"{tmp_path}/{n}")[1].values()) for n in "ab")
    assert plain == 64 and bright == round((64 / 255) ** (1 / 2.2) * 255)


def test_scattered_options_raise(spark, tmp_path):
    raster(f"{tmp_path}/a.tif", 16, 16, 3, lambda x, y, b: 1)
    with pytest.raises(Exception, match="webp"):
        pipeline.build_pyramid(spark, [str(tmp_path)], f"{tmp_path}/o", PyramidOptions(format="webp", min_zoom=0, max_zoom=0))
