import struct
import zlib

import numpy as np
import pytest

from gridloom.operators import blocks, pyramid
from gridloom.options import BandConfig, PyramidOptions, TransformOptions
from gridloom.plans import pipeline
from gridloom.sources import archive, codecs, connectors, tiff


def picture(h, w, n, f, dtype=np.uint8):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([np.broadcast_to(f(x, y, b), (h, w)) for b in range(n)], -1).astype(dtype)


@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_tiff_round_trip(tmp_path, compression):
    p = picture(300, 520, 4, lambda x, y, b: 100 + (x + y * b) % 9900, np.uint16)
    tiff.write_tiff(f"{tmp_path}/a.tif", p, (-25.0, 70.0), 0.1, compression=compression, nodata="0", xml='<GDALMetadata><Item name="A">1</Item><Item name="description" sample="2">Red</Item></GDALMetadata>')
    r = tiff.read_raster(f"{tmp_path}/a.tif")
    assert (r.epsg, r.origin, r.pixel, r.nodata) == (4326, (-25.0, 70.0), (0.1, 0.1), "0") and r.items == {"A": "1"} and r.band_items == {2: {"DESCRIPTION": "Red"}}
    with tiff.open_file(r.path) as f:
        assert (tiff.read_window(f, r, 0, 250, 20, 520, 300) == p[20:300, 250:520]).all()


def lzw_pack(data):
    """A plain encoder, for the test."""
    bits, table, width, now = [], {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        bits.append(f"{code:0{width}b}")

    put(256)
    size = 258
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        table[now + bytes([b])] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        now = bytes([b])
    if now:
        put(table[now])
    put(257)
    raw = "".join(bits)
    raw += "0" * (-len(raw) % 8)
    return bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8))


def test_lzw():
    r = np.random.default_rng(0)
    for data in (b"", b"aaaaaaaaaaaa", bytes(r.integers(0, 4, 3000, dtype=np.uint8))):
        assert tiff.lzw(lzw_pack(data)) == data


def test_predictors():
    lv = tiff.Level(4, 2, 1, 32, True, "none", 3, 4, 2, [], [], False)
    v = np.array([[1.5, -2.25, 3e9, 0], [7, 8, 9, 1e-9]], "f4")
    shuffled = np.ascontiguousarray(v.astype(">f4")).view(np.uint8).reshape(2, 4, 4).transpose(0, 2, 1).reshape(2, 16)
    raw = np.concatenate([shuffled[:, :1], shuffled[:, 1:] - shuffled[:, :-1]], 1).astype(np.uint8).tobytes()
    assert (tiff.undo_predictor(np.zeros((2, 4, 1), "f4"), raw, lv, True, 2)[..., 0] == v).all()
    lv2 = tiff.Level(4, 1, 1, 8, False, "none", 2, 4, 1, [], [], False)
    assert tiff.undo_predictor(np.array([[[250], [10], [1], [255]]], np.uint8), b"", lv2, True, 1).ravel().tolist() == [250, 4, 5, 4]


def test_world_file():
    assert tiff.parse_world("0.5\n0\n0\n-0.5\n10.25\n49.75\n") == ((10.0, 50.0), (0.5, 0.5))
    with pytest.raises(tiff.BadRaster):
        tiff.parse_world("0.5\n0.1\n0\n-0.5\n10\n50\n")


@pytest.mark.parametrize("n", [1, 3, 4])
def test_png_round_trip(n):
    p = picture(16, 24, 4, lambda x, y, b: (x * 7 + y * 13 + (b if n > 1 else 0) * 31) % 256)
    if n < 4:
        p[..., 3] = 255
    assert (codecs.png_decode(codecs.png_encode(p)) == p).all()


def test_png_filters():
    """Rows with each of the five filters."""
    w, r = 5, np.random.default_rng(1)
    rows = r.integers(0, 256, (5, w * 3), dtype=np.uint8)
    out, above = b"", np.zeros(w * 3, int)
    for kind, row in enumerate(rows):
        line = []
        for i, v in enumerate(row.tolist()):
            a, b, c = int(row[i - 3]) if i >= 3 else 0, int(above[i]), int(above[i - 3]) if i >= 3 else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            line.append((v - guess) % 256)
        out += bytes([kind, *line])
        above = row
    data = codecs.SIGNATURE + codecs._chunk(b"IHDR", struct.pack(">IIBBBBB", w, 5, 8, 2, 0, 0, 0)) + codecs._chunk(b"IDAT", zlib.compress(out)) + codecs._chunk(b"IEND", b"")
    assert (codecs.png_decode(data)[..., :3].reshape(5, -1) == rows).all()


def test_elevations_round_trip():
    e = np.array([[0.0, -32768.0, 8848.5], [np.nan, 12.25, 32767.0]])
    back = codecs.pixel_elevations(codecs.elevation_pixels(e))
    assert np.allclose(back, e, atol=1 / 256, equal_nan=True)


@pytest.mark.parametrize("mode", ["bilinear", "nearest", "mode", "bicubic", "lanczos"])
def test_arrays_and_rows_halve_alike(spark, mode):
    r = np.random.default_rng(2)
    tile = r.integers(0, 4 if mode == "mode" else 256, (16, 16, 4)).astype(np.uint8)
    tile[..., 3] = np.where(r.random((16, 16)) < 0.3, 0, 255)
    rows = [(1, x, y, *map(int, tile[y, x])) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "z int, gx long, gy long, r int, g int, b int, a int")
    want = blocks.halve(tile, mode)
    got = np.zeros((8, 8, 4), int)
    for x in pyramid.halve(df, mode, 16).collect():
        got[x.gy, x.gx] = (x.r, x.g, x.b, x.a)
    seen = want[..., 3] > 0
    assert (got[..., 3] == want[..., 3]).all() and np.abs(got[seen] - want[seen]).max(initial=0) <= (0 if mode in ("bilinear", "nearest", "mode") else 1)


def decoded(header, path):
    a = archive.Archive(path)
    return {(z, x, y): codecs.png_decode(a.tile(z, x, y)) for z in range(header.min_zoom, header.max_zoom + 1) for x in range(2**z) for y in range(2**z) if a.tile(z, x, y)}


def test_pyramid_end_to_end(spark, tmp_path):
    for i, (x, colour) in enumerate(((-25.0, (255, 0, 0)), (0.6, (0, 0, 255)))):
        tiff.write_tiff(f"{tmp_path}/s{i}.tif", picture(256, 256, 3, lambda _x, _y, b, c=colour: c[b]), (x, 70.0), 0.1)
    out = f"{tmp_path}/o.tiles"
    h = pipeline.build_pyramid(spark, [str(tmp_path)], out, PyramidOptions(min_zoom=0, max_zoom=2, tile_size=256, resampling="nearest"))
    assert h.max_lon - h.min_lon >= 25 and all(r.ok for r in archive.check_archive(spark, out).collect())
    tiles = decoded(h, out)
    assert {z for z, _, _ in tiles} == {0, 1, 2}
    colours = {tuple(c) for t in tiles.values() for c in t.reshape(-1, 4)[::97].tolist()}
    assert {(255, 0, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)} <= colours
    connectors.register(spark)
    read = spark.read.format("tilearchive").option("path", out).load()
    assert sorted((r.z, r.x, r.y) for r in spark.read.format("tilearchive").option("path", out).option("min_zoom", 2).load().collect()) == sorted(k for k in tiles if k[0] == 2)
    assert read.count() == len(tiles) == h.addressed
    meta = {r.key: r.value for r in spark.read.format("tilearchive").option("path", out).option("table", "metadata").load().collect()}
    assert meta["format"] == "png" and meta["minzoom"] == "0"

    same = pipeline.transform_archive(spark, out, f"{tmp_path}/same.tiles")
    assert same.addressed == h.addressed and same.data_length == h.data_length
    filled = pipeline.transform_archive(spark, out, f"{tmp_path}/fill.tiles", TransformOptions(rebuild=True, fill=(1, 2, 3, 255), resampling="nearest"))
    full = decoded(filled, f"{tmp_path}/fill.tiles")
    assert filled.addressed >= h.addressed and all((t[..., 3] == 255).all() for t in full.values())

    archive.patch_archive(out, center_zoom=1)
    archive.patch_archive(out, out=f"{tmp_path}/p.tiles", put={"name": "new", "n": "3"}, remove=["type"], rebuild=True)
    a = archive.Archive(f"{tmp_path}/p.tiles")
    assert a.header.center_zoom == 1 and a.metadata()["name"] == "new" and a.metadata()["n"] == 3 and "type" not in a.metadata()
    assert a.header.addressed == h.addressed and all(r.ok for r in archive.check_archive(spark, f"{tmp_path}/p.tiles").collect())
    with pytest.raises(ValueError, match="codec"):
        codecs.codec("webp")


def test_elevation_pyramid(spark, tmp_path):
    y, x = np.mgrid[0:128, 0:128]
    e = (x + 2.0 * y).astype(np.float32)[..., None]
    e[:10, :10] = -9999
    tiff.write_tiff(f"{tmp_path}/e.tif", e, (8.0, 47.0), 0.01, nodata="-9999")
    h = pipeline.build_pyramid(spark, [f"{tmp_path}/e.tif"], f"{tmp_path}/e.tiles", PyramidOptions(format="terrarium", min_zoom=5, max_zoom=7, resampling="bilinear"))
    a = archive.Archive(f"{tmp_path}/e.tiles")
    got = [codecs.pixel_elevations(codecs.png_decode(a.tile(7, x, y))) for x in range(60, 75) for y in range(40, 50) if a.tile(7, x, y)]
    values = np.concatenate([g[np.isfinite(g)] for g in got])
    assert h.tile_type == 2 and 0 <= values.min() and values.max() <= 3 * 128


def test_connector_tables(spark, tmp_path):
    p = picture(40, 70, 1, lambda x, y, b: x + y)
    tiff.write_tiff(f"{tmp_path}/g.tif", p, (0.0, 10.0), 0.5, tile=32)
    connectors.register(spark)
    read = lambda t: spark.read.format("georaster").option("path", str(tmp_path)).option("table", t).load()
    assert read("sources").select("width", "height", "epsg").first() == (70, 40, 4326)
    assert read("blocks").count() == 6
    s = read("samples").filter("px = 69 and py = 39").first()
    assert s.bands == [float(p[39, 69, 0])] and read("samples").count() == 2800
    assert pipeline.describe_source(spark, [str(tmp_path)], 4).count() == 4
    with pytest.raises(FileNotFoundError, match="a.tif, .*b.tif"):
        connectors.raster_files([f"{tmp_path}/a.tif", f"{tmp_path}/b.tif"])


def test_directory_round_trip():
    r = np.random.default_rng(5)
    ids = np.cumsum(r.integers(1, 9, 5000))
    entries, off = [], 0
    for i in ids.tolist():
        n = int(r.integers(1, 900))
        entries.append((i, off if r.random() < 0.8 else int(r.integers(0, 10**9)), n, 1))
        off = entries[-1][1] + n
    assert [tuple(x) for x in archive.unpack_directory(archive.pack_directory(entries)).tolist()] == entries
    assert archive.read_varints(archive.varints([0, 1, 127, 128, 300, 1 << 40])).tolist() == [0, 1, 127, 128, 300, 1 << 40]


def test_large_archive_has_leaves(spark, tmp_path):
    df = spark.range(40000).selectExpr("id + 100000 AS tile_id", "CAST(concat('tile ', id) AS BINARY) AS data")
    h = archive.write_archive(df, f"{tmp_path}/l.tiles", archive.Info(min_zoom=8, max_zoom=9), f"file://{tmp_path}")
    assert h.leaf_length > 0 and all(r.ok for r in archive.check_archive(spark, f"{tmp_path}/l.tiles").collect())
    connectors.register(spark)
    got = spark.read.format("tilearchive").option("path", f"{tmp_path}/l.tiles").load()
    assert got.count() == 40000 and bytes(got.filter("tile_id = 123456").first().data) == b"tile 23456"


def test_gray_by_default():
    out = blocks.to_rgba(np.array([[[5], [0]]]), 8, BandConfig(nodata=0.0))
    assert out[0].tolist() == [[5, 5, 5, 255], [0, 0, 0, 0]]
