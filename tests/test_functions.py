import math

import pytest
from pyspark.sql import functions as F

from gridloom import options
from gridloom.functions import bands, geo, hilbert, kernels, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("lon", "lat", "z", "x", "y"), [(0, 0, 0, 0, 0), (-0.1278, 51.5074, 10, 511, 340), (8.5417, 47.3769, 10, 536, 358), (-74.0060, 40.7128, 10, 301, 385), (139.6917, 35.6895, 10, 909, 403), (0, -89.9, 1, 1, 1), (0, 89.9, 1, 1, 0)])
def test_tile_of(spark, lon, lat, z, x, y):
    assert one(spark, *geo.lonlat_to_tile(F.lit(float(lon)), F.lit(float(lat)), F.lit(z))) == (x, y)


@pytest.mark.parametrize(("pixel", "zoom"), [(10.0, 13), (1.0, 17), (100.0, 10), (0.0, 0), (-1.0, 0)])
def test_max_zoom(spark, pixel, zoom):
    assert one(spark, geo.max_zoom(F.lit(pixel), F.lit(0.0))) == (zoom,)


@pytest.mark.parametrize(("box", "zoom"), [((5.9, 45.8, 10.6, 47.9), 6), ((8.54, 47.37, 8.55, 47.38), 13), ((8.5, 47.3, 8.5, 47.3), 28), ((-180.0, -85.0, 180.0, 85.0), 0), ((-179.0, -80.0, -1.0, 80.0), 0)])
def test_single_tile_zoom(spark, box, zoom):
    assert one(spark, geo.min_single_tile_zoom(*map(F.lit, box))) == (zoom,)


@pytest.mark.parametrize(("e", "n", "lon", "lat", "tol"), [(2600000.0, 1200000.0, 7.438632, 46.951083, 0.001), (2683474.0, 1247862.0, 8.5417, 47.3769, 0.005), (2500560.0, 1118017.0, 6.1432, 46.2075, 0.01)])
def test_swiss(spark, e, n, lon, lat, tol):
    assert one(spark, *geo.lv95_to_wgs84(F.lit(e), F.lit(n))) == pytest.approx((lon, lat), abs=tol)


def test_projections(spark):
    for epsg in (4326, 3857, 2056):
        to, back = geo.projection(epsg)
        assert one(spark, *to(*back(F.lit(8.2), F.lit(46.9)))) == pytest.approx((8.2, 46.9), abs=1e-4)
    with pytest.raises(ValueError, match="EPSG:1"):
        geo.projection(1)


def test_curve_in_python_and_spark(spark):
    rows = spark.range(1, 3000, 7).select("id", hilbert.id_to_zxy(F.col("id")).alias("p")).select("id", "p.*")
    for r in rows.withColumn("back", hilbert.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect():
        assert (r.z, r.x, r.y) == hilbert.zxy_of(r.id) and r.back == r.id == hilbert.tile_id_of(r.z, r.x, r.y)
    for z in range(6):
        ids = sorted(hilbert.tile_id_of(z, x, y) for x in range(2**z) for y in range(2**z))
        assert ids == list(range(*hilbert.zoom_ids(z)))


@pytest.mark.parametrize("mode", ["bilinear", "bicubic", "lanczos"])
def test_kernels(spark, mode):
    import numpy as np

    n = kernels.TAPS[mode]
    assert kernels.weights(mode, np.array([0.0]))[0] == 1 and np.allclose(kernels.weights(mode, np.arange(1, n // 2 + 1)), 0, atol=1e-12)
    assert math.isclose(sum(kernels.half_weights(mode)), 1)
    x = np.linspace(-3, 3, 41)
    assert np.allclose([one(spark, kernels.weight(mode, F.lit(float(v))))[0] for v in x[::8]], kernels.weights(mode, x[::8]), atol=1e-12)
    assert np.allclose(kernels.lut_weight(kernels.lut(mode), mode, x), kernels.weights(mode, x), atol=1e-4)


def test_bands(spark):
    s = F.array(*map(F.lit, (10, 20, 30, 0)))
    assert one(spark, bands.to_rgba(s, 8, 4)) == ((0, 0, 0, 0),)
    assert one(spark, bands.to_rgba(s, 8, 4, options.BandConfig(alpha=0, bands=(3, 2)))) == ((30, 20, 0, 255),)
    assert one(spark, bands.rescale(F.lit(5), "linear", (5.0, 5.0))) == (0,)
    assert one(spark, bands.elevation_decode(*(bands.elevation_encode(F.lit(1234.5))[c] for c in "rgba"))) == (1234.5,)


def test_options():
    assert options.parse_colour("1,2,3") == (1, 2, 3, 255) and options.parse_colour("#01020304") == (1, 2, 3, 4) and options.parse_colour(" ") is None
    for bad in ("1,2", "300,0,0", "#12345"):
        with pytest.raises(ValueError):
            options.parse_colour(bad)
    assert options.parse_range("0,1.5") == (0.0, 1.5) and options.parse_bands("3,2,1") == (3, 2, 1)
    with pytest.raises(ValueError):
        options.PyramidOptions(min_zoom=5, max_zoom=4)
    assert options.transform_mode("png", 0, options.TransformOptions(format="jpeg")) == "reencode"


def test_text(spark):
    assert one(spark, text.human_duration(F.lit(3725))) == ("1h02m",) and one(spark, text.human_size(F.lit(1536).cast("long"))) == ("1.5 KB",)
    m = one(spark, text.patch_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), {"a": "9", "c": "3"}, ["b"]))[0]
    assert m == {"a": "9", "c": "3"}


def test_stream(spark, tmp_path):
    import numpy as np

    from gridloom import streaming
    from gridloom.sources import tiff

    (tmp_path / "in").mkdir()
    tiff.write_tiff(f"{tmp_path}/in/a.tif", np.zeros((4, 4, 1), np.uint8), (0.0, 1.0), 0.1, tile=16)
    for _ in range(2):
        streaming.describe_batches(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_xml_items(spark):
    from gridloom.functions import text

    xml = '<GDALMetadata><Item name="x"></Item><Item name="y" sample="2" role="scale">7</Item><Item name="e"/>\n<Item name="z">8 &amp; 9</Item></GDALMetadata>'
    got = spark.createDataFrame([(xml,), ("<GDALMetadata/>",)], "xml string").select(text.xml_items(F.col("xml")).alias("i")).collect()
    assert [tuple(i) for i in got[0].i] == [("x", None, ""), ("y", 2, "7"), ("e", None, ""), ("z", None, "8 & 9")] and got[1].i == []


def test_overlap_join_of_all_sizes(spark):
    """Boxes from a point to the whole box against each other; no nested loop in the plan."""
    import random

    from gridloom.operators import mosaic

    r = random.Random(5)

    def boxes(n, first):
        out = []
        for i in range(n):
            w, h = (r.choice((0, 0.1, 3, 40, 100)) * r.random() for _ in range(2))
            x, y = r.uniform(-60, 100), r.uniform(-40, 60)
            out.append((first + i, x, y, x + w, y + h))
        return out

    t, s = boxes(120, 0), boxes(90, 1000)
    tiles = spark.createDataFrame(t, "tile long, min_x double, min_y double, max_x double, max_y double")
    sources = spark.createDataFrame(s, "source_id long, min_x double, min_y double, max_x double, max_y double")
    for levels in (0, 3, 12):
        got = mosaic.overlap_join(tiles, sources, levels)
        pairs = [(x.tile, x.source_id) for x in got.select("tile", "source_id").collect()]
        assert sorted(pairs) == sorted((a[0], b[0]) for a in t for b in s if a[3] >= b[1] and a[1] <= b[3] and a[4] >= b[2] and a[2] <= b[4])
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert mosaic.overlap_join(tiles, sources.limit(0)).count() == 0


def test_coverage_gaps_equal_a_plain_flood(spark):
    """All sources of the small table, cells at their production size, against a flood cell by cell."""
    from gridloom.plans import queries, relations

    sf = "/root/testdata/sf0.01"
    boxes = [(r.min_x, r.min_y, r.max_x, r.max_y) for r in relations.sources(spark, sf).collect()]
    x0, y0, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
    nx = math.ceil((x1 - x0) / (sum(b[2] - b[0] for b in boxes) / len(boxes) / 2))
    ny = math.ceil((y1 - y0) / (sum(b[3] - b[1] for b in boxes) / len(boxes) / 2))
    w, h = (x1 - x0) / nx, (y1 - y0) / ny
    assert nx > 50 and ny > 20
    free = {(i, j) for i in range(nx) for j in range(ny) if not any(b[0] <= x0 + (i + 0.5) * w <= b[2] and b[1] <= y0 + (j + 0.5) * h <= b[3] for b in boxes)}
    want = []
    while free:
        hole, edge = set(), [free.pop()]
        while edge:
            i, j = edge.pop()
            hole.add((i, j))
            near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & free
            free -= near
            edge += near
        xs, ys = [c[0] for c in hole], [c[1] for c in hole]
        want.append((round(x0 + min(xs) * w, 4), round(y0 + min(ys) * h, 4), round(x0 + (max(xs) + 1) * w, 4), round(y0 + (max(ys) + 1) * h, 4), len(hole)))
    got = [(*(round(v, 4) for v in r[:4]), r[4]) for r in queries.coverage_gaps(spark, sf).collect()]
    assert sorted(got) == sorted(want)
