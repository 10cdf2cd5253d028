import pytest

from gridloom.options import BandConfig
from gridloom.plans import presets
from gridloom.sources.tiff import Level, Raster


def raster(bits=16, floating=False, **more):
    return Raster("x", True, [Level(1, 1, 4, bits, floating, "none", 1, 1, 1, [0], [1], False)], **more)


def test_named_bands():
    items = {i: {"DESCRIPTION": d, "SCALE": "0.0001"} for i, d in enumerate(("Blue", "Green", "Red", "NIR"))}
    assert presets.detect(raster(band_items=items)) == presets.Preset("multispectral-rgbnir", BandConfig((3, 2, 1), 0, "linear", (0.0, 10000.0)), "png")


def test_near_infrared_is_not_red():
    items = {i: {"DESCRIPTION": d} for i, d in enumerate(("Near-Infrared", "Red", "Green", "Blue"))}
    assert presets.band_roles(raster(band_items=items)) == {"nir": 1, "red": 2, "green": 3, "blue": 4}


@pytest.mark.parametrize(("items", "limits"), [({"SCALE": "0.0001", "OFFSET": "-0.1"}, (1000.0, 10000.0)), ({"SCALE": "x"}, (0.0, 10000.0)), ({}, (0.0, 10000.0)), ({"SCALE": "0.01"}, (0.0, 100.0))])
def test_range(items, limits):
    assert presets.value_range(raster(band_items={0: items})) == limits


def test_lines_and_others():
    words = {"NOTES": "Band 1: B04 (Red) Band 2: B03 (Green) Band 3: B02 (Blue)"}
    assert presets.detect(raster(items=words)).bands.bands == (1, 2, 3)
    assert presets.detect(raster(bits=32, floating=True)).format == "terrarium"
    assert presets.detect(raster(bits=8, items=words)) is None and presets.detect(raster()) is None
