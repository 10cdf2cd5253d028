"""A query for each relational operator, over relations derived from the standard tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands as bf
from ..functions import geo, hilbert, text
from ..functions.kernels import half_weights
from ..operators import coverage, layout, mosaic, pyramid, summary
from ..options import BandConfig
from . import relations as rel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- addresses

_TILE = """{p} AS (
  SELECT *, CAST(least(greatest(floor((lon + 180) / 360 * n), 0), n - 1) AS BIGINT) AS x,
    CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * n), 0), n - 1) AS BIGINT) AS y
  FROM (SELECT *, pow(2, z) AS n FROM points, (SELECT unnest([{zs}]) AS z)))"""


def _tiled(spark: SparkSession, sf_dir: str, zooms: list[int]) -> DataFrame:
    p = rel.points(spark, sf_dir).withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    x, y = geo.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    return p.select("event_id", "lon", "lat", "z", x.alias("x"), y.alias("y"))


@query(with_(rel.POINTS, _TILE.format(p="t", zs="4, 10, 14")) + "SELECT event_id, z, x, y FROM t")
def tile_address(spark, sf_dir):
    return _tiled(spark, sf_dir, [4, 10, 14]).select("event_id", "z", "x", "y")


@query(with_(rel.POINTS, _TILE.format(p="t", zs="6")) + """SELECT DISTINCT z, x, y, round(x / n * 360 - 180, 7) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))), 7) AS south,
  round((x + 1) / n * 360 - 180, 7) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / n)))), 7) AS north FROM t""")
def tile_bounds(spark, sf_dir):
    t = _tiled(spark, sf_dir, [6]).select("z", "x", "y").distinct()
    box = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return t.select("z", "x", "y", *(F.round(c, 7).alias(n) for c, n in zip(box, ("west", "south", "east", "north"), strict=True)))


@query(with_(rel.POINTS, _TILE.format(p="t", zs="8")) + """SELECT event_id, round((x + (event_id % 256 + 0.5) / 256) / n * 360 - 180, 7) AS lon,
  round(degrees(atan(sinh(pi() * (1 - 2 * (y + (event_id % 101 + 0.5) / 256) / n)))), 7) AS lat FROM t""")
def pixel_lonlat(spark, sf_dir):
    t = _tiled(spark, sf_dir, [8])
    lon, lat = geo.pixel_to_lonlat(F.col("z"), F.col("x"), F.col("y"), F.col("event_id") % 256, F.col("event_id") % 101, 256)
    return t.select("event_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(with_(rel.POINTS) + """SELECT event_id, round((lon + 180) / 360 * 4096 * 256, 5) AS px,
  round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096 * 256, 5) AS py FROM points""")
def lonlat_pixel(spark, sf_dir):
    px, py = geo.lonlat_to_pixel(F.col("lon"), F.col("lat"), F.lit(12), 256)
    return rel.points(spark, sf_dir).select("event_id", F.round(px, 5).alias("px"), F.round(py, 5).alias("py"))


@query(with_(rel.POINTS) + """SELECT event_id, round(40075016.685578488 * cos(radians(lat)) / pow(2, event_id % 20) / 256, 6) AS metres,
  round(0.001 * (40075016.685578488 / 360) * cos(radians(lat)), 6) AS degrees_metres, round(100 / cos(radians(lat)), 6) AS mercator_pixel FROM points""")
def resolution(spark, sf_dir):
    lat = F.col("lat")
    return rel.points(spark, sf_dir).select("event_id", F.round(geo.resolution(lat, F.col("event_id") % 20), 6).alias("metres"), F.round(geo.pixel_metres(F.lit(0.001), F.lit(4326), lat), 6).alias("degrees_metres"), F.round(geo.metres_to_pixel(F.lit(100.0), F.lit(3857), lat), 6).alias("mercator_pixel"))


@query(with_(rel.POINTS) + """SELECT event_id, CASE WHEN px > 0 THEN CAST(least(greatest(floor(log2(40075016.685578488 * cos(radians(lat)) / (px * 256))), 0), 28) AS INTEGER) ELSE 0 END AS max_zoom
  FROM (SELECT *, CAST(event_id % 1000 AS DOUBLE) / 7 - 1 AS px FROM points)""")
def max_zoom(spark, sf_dir):
    p = rel.points(spark, sf_dir).withColumn("px", (F.col("event_id") % 1000) / F.lit(7.0) - 1)
    return p.select("event_id", geo.max_zoom(F.col("px"), F.col("lat")).alias("max_zoom"))


_XY = "CAST(least(greatest(floor(({lon} + 180) / 360 * n), 0), n - 1) AS BIGINT)"
_YY = "CAST(least(greatest(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * n), 0), n - 1) AS BIGINT)"


@query(with_(rel.SOURCES) + f"""SELECT source_id, CAST(coalesce(min(z) - 1, 28) AS INTEGER) AS zoom FROM (
  SELECT source_id, CASE WHEN {_XY.format(lon="min_x")} <> {_XY.format(lon="max_x")} OR {_YY.format(lat="max_y")} <> {_YY.format(lat="min_y")} THEN z END AS z
  FROM (SELECT *, pow(2, z) AS n FROM sources, (SELECT unnest(range(1, 29)) AS z))) GROUP BY source_id""")
def min_single_tile_zoom(spark, sf_dir):
    return rel.sources(spark, sf_dir).select("source_id", geo.min_single_tile_zoom(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")).alias("zoom"))


@query(with_(rel.SOURCES) + f"""SELECT source_id, 6 AS z, x, y FROM (
  SELECT source_id, x, unnest(range({_YY.format(lat="max_y")}, {_YY.format(lat="min_y")} + 1)) AS y FROM (
    SELECT *, unnest(range({_XY.format(lon="min_x")}, {_XY.format(lon="max_x")} + 1)) AS x FROM (SELECT *, pow(2, 6) AS n FROM sources)))""")
def tiles_in_bounds(spark, sf_dir):
    boxes = rel.sources(spark, sf_dir).withColumn("t", F.explode(geo.tiles_in_bounds(F.lit(6), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))))
    return boxes.select("source_id", "t.z", "t.x", "t.y")


def _curve(zoom: int) -> str:
    """Hilbert index by steps of a recursive query over t(event_id, x, y)."""
    return f"""h AS (
  SELECT event_id, z, x AS x0, y AS y0, x, y, CAST(0 AS BIGINT) AS d, CAST({2 ** (zoom - 1)} AS BIGINT) AS s FROM t
  UNION ALL
  SELECT event_id, z, x0, y0, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y % s ELSE y END, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x % s ELSE x END,
    d + s * s * (CASE WHEN ry = 1 THEN (CASE WHEN rx = 1 THEN 2 ELSE 1 END) ELSE 3 * rx END), s // 2
  FROM (SELECT *, (x // s) % 2 AS rx, (y // s) % 2 AS ry FROM h WHERE s > 0))"""


@query("WITH RECURSIVE " + rel.POINTS + ",\n" + _TILE.format(p="t", zs="10") + ",\n" + _curve(10) + f"SELECT event_id, d + {(4**10 - 1) // 3} AS tile_id FROM h WHERE s = 0")
def hilbert_id(spark, sf_dir):
    return _tiled(spark, sf_dir, [10]).select("event_id", hilbert.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"))


@query(with_(rel.POINTS, _TILE.format(p="t", zs="3, 9, 15")) + "SELECT event_id, z, x, y FROM t")
def hilbert_inverse(spark, sf_dir):
    """There and back: the ids' positions are the tiles' own."""
    t = _tiled(spark, sf_dir, [3, 9, 15]).select("event_id", hilbert.id_to_zxy(hilbert.tile_id(F.col("z"), F.col("x"), F.col("y"))).alias("p"))
    return t.select("event_id", "p.z", "p.x", "p.y")


@query("WITH RECURSIVE " + rel.POINTS + ",\n" + _TILE.format(p="t", zs="10") + ",\n" + _curve(10) + f"""SELECT z, count(DISTINCT d) AS tiles, min(d) + {(4**10 - 1) // 3} AS first_id, max(d) + {(4**10 - 1) // 3} AS last_id FROM h WHERE s = 0 GROUP BY z""")
def zoom_histogram(spark, sf_dir):
    """Tiles of an archive by level, the level told from the id."""
    ids = _tiled(spark, sf_dir, [10]).select(hilbert.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id")).distinct()
    return ids.groupBy(hilbert.id_to_zoom(F.col("tile_id")).alias("z")).agg(F.count("*").alias("tiles"), F.min("tile_id").alias("first_id"), F.max("tile_id").alias("last_id"))


# ---- projections


@query(with_(rel.POINTS) + """SELECT event_id, round(e, 4) AS e, round(n, 4) AS n, round((2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36, 8) AS lon,
  round((16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36, 8) AS lat
FROM (SELECT *, (e - 2600000) / 1e6 AS y, (n - 1200000) / 1e6 AS x FROM (
  SELECT event_id, 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q AS e,
    1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p AS n FROM (
  SELECT event_id, ((46 + lat / 85) * 3600 - 169028.66) / 1e4 AS p, ((8 + lon / 180) * 3600 - 26782.5) / 1e4 AS q FROM points)))""")
def lv95_roundtrip(spark, sf_dir):
    p = rel.points(spark, sf_dir).select("event_id", (F.lit(8.0) + F.col("lon") / 180).alias("lon"), (F.lit(46.0) + F.col("lat") / 85).alias("lat"))
    e, n = geo.wgs84_to_lv95(F.col("lon"), F.col("lat"))
    m = p.select("event_id", e.alias("e"), n.alias("n"))
    lon, lat = geo.lv95_to_wgs84(F.col("e"), F.col("n"))
    return m.select("event_id", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(with_(rel.POINTS) + """SELECT event_id, round(x, 4) AS x, round(y, 4) AS y, round(x / 20037508.342789244 * 180, 8) AS lon, round(degrees(2 * atan(exp(y / 20037508.342789244 * pi())) - pi() / 2), 8) AS lat FROM (
  SELECT event_id, lon / 180 * 20037508.342789244 AS x, ln(tan((lat + 90) * pi() / 360)) / pi() * 20037508.342789244 AS y FROM points)""")
def mercator_roundtrip(spark, sf_dir):
    x, y = geo.wgs84_to_mercator(F.col("lon"), F.col("lat"))
    m = rel.points(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.mercator_to_wgs84(F.col("x"), F.col("y"))
    return m.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(with_(rel.SOURCES) + """SELECT source_id, CASE WHEN k = 0 THEN 4326 WHEN k = 1 THEN 2056 WHEN k = 2 THEN 3857 ELSE 4326 END AS epsg FROM (SELECT source_id, source_id % 4 AS k FROM sources)""")
def epsg_inference(spark, sf_dir):
    """Boxes in degrees, Swiss metres, Web-Mercator metres, and far outside of all."""
    s, k = rel.sources(spark, sf_dir), F.col("source_id") % 4

    def moved(c: str, swiss: float):
        return F.when(k == 0, F.col(c)).when(k == 1, F.col(c) * 100 + swiss).when(k == 2, F.col(c) * 100000).otherwise(F.col(c) * 1e9)

    epsg = geo.infer_epsg(moved("min_x", 2600000), moved("min_y", 1200000), moved("max_x", 2600000), moved("max_y", 1200000))
    return s.select("source_id", epsg.alias("epsg"))


# ---- bands

_SCALE = "CASE WHEN {v} < {lo} THEN 0 WHEN {v} > {hi} THEN 255 ELSE CAST(floor(({v} - {lo}) * (255.0::DOUBLE / ({hi} - {lo})) + 0.5) AS INTEGER) END"


def _scaled(v: str, lo: float = 0, hi: float = 65535) -> str:
    return _SCALE.format(v=f"CAST({v} AS DOUBLE)", lo=f"{lo}::DOUBLE", hi=f"{hi}::DOUBLE")


def _pixels(spark, sf_dir, config: BandConfig) -> DataFrame:
    return rel.bands(spark, sf_dir).select("vec_id", bf.to_rgba(F.col("bands"), 16, 4, config).alias("p")).select("vec_id", "p.*")


@query(with_(rel.BANDS) + f"SELECT vec_id, {_scaled('bands[3]')} AS r, {_scaled('bands[1]')} AS g, 0 AS b, 255 AS a FROM bands")
def band_reorder(spark, sf_dir):
    """Bands 3 and 1, and one that isn't there."""
    return _pixels(spark, sf_dir, BandConfig(bands=(3, 1, 9), alpha=0))


@query(with_(rel.BANDS) + f"""SELECT vec_id, CASE WHEN bands[4] = 0 THEN 0 ELSE {_scaled('bands[1]')} END AS r, CASE WHEN bands[4] = 0 THEN 0 ELSE {_scaled('bands[2]')} END AS g,
  CASE WHEN bands[4] = 0 THEN 0 ELSE {_scaled('bands[3]')} END AS b, CASE WHEN bands[4] = 0 THEN 0 ELSE greatest({_scaled('bands[4]')}, 1) END AS a FROM bands""")
def alpha_band(spark, sf_dir):
    return _pixels(spark, sf_dir, BandConfig(alpha=4))


@query(with_(rel.BANDS) + """SELECT vec_id, len(list_filter(bands, lambda c: c <> 0)) = 0 AS empty FROM bands""")
def nodata_all_bands(spark, sf_dir):
    return rel.bands(spark, sf_dir).select("vec_id", bf.is_nodata(F.col("bands"), 0.0).alias("empty"))


@query(with_(rel.BANDS) + f"SELECT vec_id, {_scaled('bands[1]', 28000, 36000)} AS v FROM bands")
def rescale_linear(spark, sf_dir):
    return rel.bands(spark, sf_dir).select("vec_id", bf.rescale(F.col("bands")[0], "linear", (28000.0, 36000.0)).alias("v"))


@query(with_(rel.BANDS) + """SELECT vec_id, CASE WHEN v < 28000 THEN 0 WHEN v > 36000 THEN 255 ELSE CAST(floor(ln(1 + v - 28000) / ln(8001) * 255 + 0.5) AS INTEGER) END AS v
  FROM (SELECT vec_id, CAST(bands[1] AS DOUBLE) AS v FROM bands)""")
def rescale_log(spark, sf_dir):
    return rel.bands(spark, sf_dir).select("vec_id", bf.rescale(F.col("bands")[0], "log", (28000.0, 36000.0)).alias("v"))


@query(with_(rel.BANDS) + f"SELECT vec_id, bands[2] % 256 AS low_byte, {_scaled('bands[2]')} AS scaled FROM bands")
def rescale_none16(spark, sf_dir):
    """Without a mode: the low byte of 8 bits; 16 bits scaled from their whole range."""
    v = F.col("bands")[1]
    return rel.bands(spark, sf_dir).select("vec_id", bf.rescale(v, "none").alias("low_byte"), bf.rescale(v, *BandConfig().resolved(16)).alias("scaled"))


@query(with_(rel.RASTER) + "SELECT gx, gy, CAST(floor(pow(floor(least(greatest(r / 255.0::DOUBLE, 0), 1) * 4095) / 4095, 1 / 2.2::DOUBLE) * 255 + 0.5) AS INTEGER) AS v FROM raster")
def gamma_encode(spark, sf_dir):
    return rel.raster(spark, sf_dir).select("gx", "gy", bf.gamma_encode(F.col("r"), 2.2).alias("v"))


@query(with_(rel.RASTER) + "SELECT gx, gy, CASE WHEN a = 0 THEN 12 ELSE r END AS r, CASE WHEN a = 0 THEN 34 ELSE g END AS g, CASE WHEN a = 0 THEN 56 ELSE b END AS b, CASE WHEN a = 0 THEN 78 ELSE a END AS a FROM raster")
def fill_substitute(spark, sf_dir):
    p = bf.fill_transparent(F.struct("r", "g", "b", "a"), (12, 34, 56, 78))
    return rel.rgba(spark, sf_dir).select("gx", "gy", p.alias("p")).select("gx", "gy", "p.*")


@query(with_(rel.RASTER) + """SELECT gx, gy, CASE WHEN e IS NULL THEN 0 ELSE CAST(w // 256 AS INTEGER) END AS r, CASE WHEN e IS NULL THEN 0 ELSE CAST(w % 256 AS INTEGER) END AS g,
  CASE WHEN e IS NULL THEN 0 ELSE CAST(floor((v - w) * 256) AS INTEGER) END AS b, CASE WHEN e IS NULL THEN 0 ELSE 255 END AS a
  FROM (SELECT gx, gy, e, v, CAST(floor(v) AS BIGINT) AS w FROM (SELECT gx, gy, e, least(greatest(e + 32768, 0), 65535.99609375) AS v FROM (SELECT gx, gy, elev * 10 - 400 AS e FROM raster)))""")
def elevation_encode(spark, sf_dir):
    return rel.raster(spark, sf_dir).select("gx", "gy", bf.elevation_encode(F.col("elev") * 10 - 400).alias("p")).select("gx", "gy", "p.*")


@query(with_(rel.RASTER) + "SELECT gx, gy, CASE WHEN a <> 0 THEN r * 256.0::DOUBLE + g + b / 256.0::DOUBLE - 32768 END AS metres FROM raster")
def elevation_decode(spark, sf_dir):
    return rel.rgba(spark, sf_dir).select("gx", "gy", bf.elevation_decode(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("metres"))


@query(with_(rel.RASTER) + """SELECT gx, gy, CAST(least(greatest(floor((yy + 91881 * v) / 65536.0::DOUBLE), 0), 255) AS INTEGER) AS r, CAST(least(greatest(floor((yy - 22554 * u - 46802 * v) / 65536.0::DOUBLE), 0), 255) AS INTEGER) AS g,
  CAST(least(greatest(floor((yy + 116130 * u) / 65536.0::DOUBLE), 0), 255) AS INTEGER) AS b, 255 AS a FROM (SELECT gx, gy, r * 65536 + 32768 AS yy, g - 128 AS u, b - 128 AS v FROM raster)""")
def ycbcr_to_rgb(spark, sf_dir):
    return rel.rgba(spark, sf_dir).select("gx", "gy", bf.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b")).alias("p")).select("gx", "gy", "p.*")


# ---- forms of tiles

_FORMS = """forms AS (SELECT gx // 4 AS x, gy // 4 AS y, count(*) AS n, count(DISTINCT [r, g, b, a]) = 1 AS uniform, bool_and(r = g AND g = b AND a = 255) AS gray, count(*) FILTER (a <> 0) AS opaque
  FROM (SELECT gx, gy, CASE WHEN gx < 64 THEN 7 ELSE r END AS r, CASE WHEN gx < 64 THEN 7 WHEN gx < 128 THEN r ELSE g END AS g, CASE WHEN gx < 64 THEN 7 WHEN gx < 128 THEN r ELSE b END AS b, CASE WHEN gx < 128 THEN 255 ELSE a END AS a FROM raster) GROUP BY 1, 2)"""


def _forms(spark, sf_dir) -> DataFrame:
    """Tiles of 4 pixels: one colour on the left, gray next to it, colours elsewhere."""
    x = F.col("gx")
    p = rel.rgba(spark, sf_dir).select("z", "gx", "gy", F.when(x < 64, 7).otherwise(F.col("r")).alias("r"), F.when(x < 64, 7).when(x < 128, F.col("r")).otherwise(F.col("g")).alias("g"), F.when(x < 64, 7).when(x < 128, F.col("r")).otherwise(F.col("b")).alias("b"), F.when(x < 128, 255).otherwise(F.col("a")).alias("a"))
    return pyramid.tile_forms(p, 4)


@query(with_(rel.RASTER, _FORMS) + "SELECT x, y, n FROM forms WHERE uniform")
def uniform_tiles(spark, sf_dir):
    return _forms(spark, sf_dir).filter("kind = 'uniform'").select("x", "y", "n")


@query(with_(rel.RASTER, _FORMS) + "SELECT x, y, n FROM forms WHERE gray AND NOT uniform")
def gray_tiles(spark, sf_dir):
    return _forms(spark, sf_dir).filter("kind = 'gray'").select("x", "y", "n")


@query(with_(rel.RASTER, _FORMS) + "SELECT x, y, opaque, CASE WHEN uniform THEN 'uniform' WHEN gray THEN 'gray' ELSE 'rgba' END AS kind FROM forms")
def tile_kind(spark, sf_dir):
    return _forms(spark, sf_dir).select("x", "y", "opaque", "kind")


# ---- pyramid


def _gray(spark, sf_dir) -> DataFrame:
    return rel.raster(spark, sf_dir).select("z", "gx", "gy", F.col("r").alias("v"))


@query(with_(rel.RASTER) + "SELECT 9 AS z, gx // 2 AS gx, gy // 2 AS gy, CAST((sum(r) + 2) // 4 AS INTEGER) AS v FROM raster GROUP BY gx // 2, gy // 2")
def down_avg_gray(spark, sf_dir):
    return pyramid.average_gray(_gray(spark, sf_dir))


_AVG = """SELECT z - 1 AS z, gx // 2 AS gx, gy // 2 AS gy, CASE WHEN k = 0 THEN 0 ELSE CAST((sr + k // 2) // k AS INTEGER) END AS r, CASE WHEN k = 0 THEN 0 ELSE CAST((sg + k // 2) // k AS INTEGER) END AS g,
  CASE WHEN k = 0 THEN 0 ELSE CAST((sb + k // 2) // k AS INTEGER) END AS b, CASE WHEN k = 0 THEN 0 ELSE CAST((sa + 2) // 4 AS INTEGER) END AS a FROM (
  SELECT z, gx // 2 * 2 AS gx, gy // 2 * 2 AS gy, count(*) FILTER (a <> 0) AS k, coalesce(sum(r) FILTER (a <> 0), 0) AS sr, coalesce(sum(g) FILTER (a <> 0), 0) AS sg, coalesce(sum(b) FILTER (a <> 0), 0) AS sb, sum(a) AS sa
  FROM {t} GROUP BY z, gx // 2, gy // 2)"""


@query(with_(rel.RASTER) + _AVG.format(t="raster"))
def down_avg_rgba(spark, sf_dir):
    return pyramid.average_rgba(rel.rgba(spark, sf_dir))


@query(with_(rel.RASTER) + "SELECT 9 AS z, gx // 2 AS gx, gy // 2 AS gy, r, g, b, a FROM raster WHERE gx % 2 = 0 AND gy % 2 = 0")
def down_nearest(spark, sf_dir):
    return pyramid.nearest(rel.rgba(spark, sf_dir))


@query(with_(rel.RASTER) + """SELECT 9 AS z, gx, gy, cls AS v FROM (SELECT gx, gy, cls, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, p) AS k FROM (
  SELECT gx // 2 AS gx, gy // 2 AS gy, cls, count(*) AS n, min(gy % 2 * 2 + gx % 2) AS p FROM raster GROUP BY 1, 2, 3)) WHERE k = 1""")
def down_mode_gray(spark, sf_dir):
    return pyramid.mode_gray(rel.raster(spark, sf_dir).select("z", "gx", "gy", F.col("cls").alias("v")))


@query(with_(rel.RASTER) + """SELECT 9 AS z, gx, gy, r, g, b, a FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, p) AS k FROM (
  SELECT gx // 2 AS gx, gy // 2 AS gy, r, g, b, a, sum(CASE WHEN a = 0 THEN 0 ELSE 1 END) AS n, min(gy % 2 * 2 + gx % 2) AS p FROM (
    SELECT gx, gy, CASE WHEN a = 0 THEN 0 ELSE cls END AS r, CASE WHEN a = 0 THEN 0 ELSE 9 END AS g, 0 AS b, a FROM raster) GROUP BY ALL)) WHERE k = 1""")
def down_mode_rgba(spark, sf_dir):
    p = rel.raster(spark, sf_dir).select("z", "gx", "gy", F.col("cls").alias("r"), F.lit(9).alias("g"), F.lit(0).alias("b"), "a")
    return pyramid.mode_rgba(p)


@query(with_(rel.RASTER) + "SELECT 9 AS z, gx // 2 AS gx, gy // 2 AS gy, round(avg(elev), 6) AS elev FROM raster GROUP BY gx // 2, gy // 2")
def down_elev_avg(spark, sf_dir):
    e = rel.raster(spark, sf_dir).select("z", "gx", "gy", "elev")
    return pyramid.average_elevation(e).withColumn("elev", F.round("elev", 6))


def _down_kernel(mode: str, size: int) -> str:
    w = half_weights(mode)
    n = len(w)
    off = n // 2 - 1
    ks = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(w))
    total = "sum(w) FILTER (a > 0)"
    colour = ", ".join(f"CASE WHEN coalesce(abs({total}), 0) < 1e-12 THEN 0 ELSE CAST(floor(least(greatest(round(sum(w * {c}) FILTER (a > 0) / {total}, 9), 0), 255) + 0.5) AS INTEGER) END AS {c}" for c in "rgb")
    return f"""k(k, w) AS (VALUES {ks}), near AS (
  SELECT t.gx // {size} * {size // 2} + dx.d AS px, t.gy // {size} * {size // 2} + dy.d AS py, kx.w * ky.w AS w, r, g, b, a FROM raster t
  JOIN k kx ON (t.gx % {size} + {off} - kx.k) % 2 = 0 JOIN k ky ON (t.gy % {size} + {off} - ky.k) % 2 = 0
  JOIN (SELECT unnest(range({size // 2})) AS d) dx ON dx.d = (t.gx % {size} + {off} - kx.k) / 2 JOIN (SELECT unnest(range({size // 2})) AS d) dy ON dy.d = (t.gy % {size} + {off} - ky.k) / 2)
SELECT 9 AS z, px AS gx, py AS gy, {colour}, CASE WHEN coalesce(abs({total}), 0) < 1e-12 THEN 0 ELSE CAST(floor(least(greatest(round(sum(w * a), 9), 0), 255) + 0.5) AS INTEGER) END AS a FROM near GROUP BY px, py"""


@query(with_(rel.RASTER, _down_kernel("bicubic", 64)))
def down_bicubic(spark, sf_dir):
    return pyramid.kernel_rgba(rel.rgba(spark, sf_dir), "bicubic", 64)


@query(with_(rel.RASTER, _down_kernel("lanczos", 64)))
def down_lanczos(spark, sf_dir):
    return pyramid.kernel_rgba(rel.rgba(spark, sf_dir), "lanczos", 64)


_LEVELS = ",\n".join(f"l{i} AS ({_AVG.format(t='raster' if i == 1 else f'l{i - 1}')})" for i in (1, 2, 3))
_ALL = "every AS (SELECT z, gx, gy, r, g, b, a FROM raster UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)"


@query(with_(rel.RASTER, _LEVELS, _ALL) + "SELECT z, gx // 16 AS x, gy // 16 AS y, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r, CAST(sum(a) AS BIGINT) AS a FROM every GROUP BY 1, 2, 3")
def pyramid_counts(spark, sf_dir):
    """Four levels by tile."""
    return pyramid.pyramid(rel.rgba(spark, sf_dir), 3).groupBy("z", F.floor(F.col("gx") / 16).alias("x"), F.floor(F.col("gy") / 16).alias("y")).agg(F.count("*").alias("pixels"), F.sum("r").alias("r"), F.sum("a").alias("a"))


@query("WITH RECURSIVE " + ",\n".join([rel.RASTER, _LEVELS, _ALL, """t AS (SELECT DISTINCT z AS event_id, z, gx // 16 AS x, gy // 16 AS y FROM every)""", _curve(10)]) + """SELECT z, count(*) AS tiles, min(d) AS first_place, max(d) AS last_place FROM h WHERE s = 0 GROUP BY z""")
def pyramid_stats(spark, sf_dir):
    """Tiles of each level, and where they lie on the curve."""
    t = pyramid.pyramid(rel.rgba(spark, sf_dir), 3).select("z", F.floor(F.col("gx") / 16).alias("x"), F.floor(F.col("gy") / 16).alias("y")).distinct()
    place = hilbert.xy_to_hilbert(F.lit(10), F.col("x"), F.col("y"))
    return t.withColumn("d", place).groupBy("z").agg(F.count("*").alias("tiles"), F.min("d").alias("first_place"), F.max("d").alias("last_place"))


@query(with_(rel.RASTER, _FORMS) + "SELECT count(*) AS tiles, count(*) FILTER (opaque = 0) AS empty, count(*) FILTER (uniform) AS uniform, CAST(sum(n) AS BIGINT) AS pixels FROM forms")
def run_statistics(spark, sf_dir):
    return _forms(spark, sf_dir).agg(F.count("*").alias("tiles"), F.count_if(F.col("opaque") == 0).alias("empty"), F.count_if(F.col("kind") == "uniform").alias("uniform"), F.sum("n").alias("pixels"))


# ---- sources on tiles

_GRID = """grid AS (SELECT x, y, x / 32.0::DOUBLE * 360 - 180 AS min_x, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32.0::DOUBLE)))) AS min_y, (x + 1) / 32.0::DOUBLE * 360 - 180 AS max_x,
  degrees(atan(sinh(pi() * (1 - 2 * y / 32.0::DOUBLE)))) AS max_y FROM (SELECT unnest(range(32)) AS x), (SELECT unnest(range(32)) AS y)),
met AS (SELECT x, y, source_id FROM grid g JOIN sources s ON g.max_x >= s.min_x AND g.min_x <= s.max_x AND g.max_y >= s.min_y AND g.min_y <= s.max_y)"""


def _met(spark, sf_dir, levels: int = 12) -> DataFrame:
    t = coverage.grid(spark, 5, 0, 31, 0, 31)
    box = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    t = t.select("x", "y", *(c.alias(n) for c, n in zip(box, mosaic.BOX, strict=True)))
    return mosaic.overlap_join(t, rel.sources(spark, sf_dir), levels).select("x", "y", "source_id")


@query(with_(rel.SOURCES, _GRID) + "SELECT x, y, source_id FROM met")
def source_overlap(spark, sf_dir):
    return _met(spark, sf_dir)


@query(with_(rel.SOURCES, _GRID) + "SELECT x, y, source_id FROM met")
def source_overlap_grid(spark, sf_dir):
    """The same by way of grid cells, as for more sources than can be broadcast."""
    return _met(spark, sf_dir, 3)


_FIRST = """hit AS (SELECT event_id, source_id FROM points p JOIN sources s ON p.lon BETWEEN s.min_x AND s.max_x AND p.lat BETWEEN s.min_y AND s.max_y WHERE (event_id + source_id) % 3 <> 0)"""


@query(with_(rel.POINTS, rel.SOURCES, _FIRST) + "SELECT event_id, min(source_id) AS source_id, CAST(min(source_id) % 256 AS INTEGER) AS r, CAST(event_id % 256 AS INTEGER) AS g, 0 AS b, 255 AS a FROM hit GROUP BY event_id")
def first_opaque_source(spark, sf_dir):
    p = rel.points(spark, sf_dir).select("event_id", F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))
    pairs = mosaic.overlap_join(p, rel.sources(spark, sf_dir))
    samples = pairs.select("event_id", "source_id", (F.col("source_id") % 256).cast("int").alias("r"), (F.col("event_id") % 256).cast("int").alias("g"), F.lit(0).alias("b"), F.when((F.col("event_id") + F.col("source_id")) % 3 == 0, 0).otherwise(255).alias("a"))
    return mosaic.first_opaque(samples, ("event_id",))


@query(with_(rel.POINTS, rel.SOURCES, """hit AS (SELECT event_id, source_id, CASE WHEN (event_id + source_id) % 4 = 0 THEN -9999.0::DOUBLE ELSE CAST(event_id + source_id AS DOUBLE) END AS elev
  FROM points p JOIN sources s ON p.lon BETWEEN s.min_x AND s.max_x AND p.lat BETWEEN s.min_y AND s.max_y)""") + "SELECT event_id, arg_min(elev, source_id) AS elev, min(source_id) AS source_id FROM hit WHERE elev <> -9999 GROUP BY event_id")
def first_valid_elevation(spark, sf_dir):
    p = rel.points(spark, sf_dir).select("event_id", F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))
    k = F.col("event_id") + F.col("source_id")
    samples = mosaic.overlap_join(p, rel.sources(spark, sf_dir)).select("event_id", "source_id", F.when(k % 4 == 0, F.lit(-9999.0)).otherwise(k.cast("double")).alias("elev"))
    return mosaic.first_valid(samples, ("event_id",), -9999.0)


@query(with_(rel.SOURCES) + """SELECT source_id, out_px, CAST(arg_min(level, abs(px / out_px - 1) * 1000 + level * 1e-9) AS INTEGER) AS level FROM (
  SELECT source_id, 0.0007::DOUBLE * (1 + k) AS out_px, level, 0.001::DOUBLE * (1 + source_id % 4) * pow(2, level) AS px FROM sources, (SELECT unnest(range(11)) AS k), (SELECT unnest(range(4)) AS level)) GROUP BY source_id, out_px""")
def level_select(spark, sf_dir):
    s = rel.sources(spark, sf_dir).select("source_id")
    wanted = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("source_id", (F.lit(0.0007) * (F.col("k") + 1)).alias("out_px"))
    levels = s.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("px", F.lit(0.001) * (F.col("source_id") % 4 + 1) * F.pow(F.lit(2.0), "level"))
    return mosaic.select_level(wanted, levels)


# ---- sampling


def _sampled(spark, sf_dir):
    r = rel.raster(spark, sf_dir)
    height = r.agg(F.max("gy")).first()[0]  # whole rows only
    p = rel.table(spark, sf_dir, "events").select(F.col("event_id").alias("point"), (F.col("event_id") * 37 % 5110 / F.lit(10.0)).alias("fx"), (F.col("event_id") * 91 % (10 * height - 5) / F.lit(10.0)).alias("fy"))
    return p, r.filter(F.col("gy") < height), height


_AT = """size AS (SELECT max(gy) AS h FROM raster), pts AS (SELECT event_id AS point, CAST(event_id * 37 % 5110 AS DOUBLE) / 10 AS fx, CAST(event_id * 91 % (10 * h - 5) AS DOUBLE) / 10 AS fy, h FROM events, size)"""
_WEIGHT = {
    "bilinear": "greatest(0, 1 - abs({x}))",
    "bicubic": "CASE WHEN abs({x}) <= 1 THEN 1.5 * abs({x}) ** 3 - 2.5 * abs({x}) ** 2 + 1 WHEN abs({x}) < 2 THEN -0.5 * abs({x}) ** 3 + 2.5 * abs({x}) ** 2 - 4 * abs({x}) + 2 ELSE 0 END",
    "lanczos": "CASE WHEN {x} = 0 THEN 1 WHEN abs({x}) < 3 THEN 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x}) ** 2 ELSE 0 END",
}


def _near(mode: str) -> str:
    taps = {"bilinear": 2, "bicubic": 4, "lanczos": 6}[mode]
    back = taps // 2 - 1
    w = _WEIGHT[mode]
    return f"""near AS (SELECT n.point, w, r, g, b, a, elev FROM (
  SELECT point, ({w.format(x="(fx - ix)")}) * ({w.format(x="(fy - iy)")}) AS w, CAST(least(greatest(ix, 0), 511) AS BIGINT) AS gx, CAST(least(greatest(iy, 0), h - 1) AS BIGINT) AS gy FROM (
    SELECT *, floor(fx) - {back} + i AS ix, floor(fy) - {back} + j AS iy FROM pts, (SELECT unnest(range({taps})) AS i), (SELECT unnest(range({taps})) AS j))) n JOIN raster t ON t.gx = n.gx AND t.gy = n.gy)"""


def _sample_sql(mode: str) -> str:
    total = "sum(w) FILTER (a > 0)"
    colour = ", ".join(f"CASE WHEN coalesce(abs({total}), 0) < 1e-12 THEN 0 ELSE CAST(floor(least(greatest(round(sum(w * {c}) FILTER (a > 0) / {total}, 9), 0), 255) + 0.5) AS INTEGER) END AS {c}" for c in "rgb")
    return with_(rel.RASTER, _AT, _near(mode)) + f"SELECT point, {colour}, CASE WHEN coalesce(abs({total}), 0) < 1e-12 THEN 0 ELSE CAST(floor(least(greatest(round(sum(w * a) / sum(w), 9), 0), 255) + 0.5) AS INTEGER) END AS a FROM near GROUP BY point"


@query(with_(rel.RASTER, _AT) + "SELECT point, r, g, b, a FROM pts JOIN raster ON gx = least(greatest(floor(fx + 0.5), 0), 511) AND gy = least(greatest(floor(fy + 0.5), 0), h - 1)")
def sample_nearest(spark, sf_dir):
    p, r, h = _sampled(spark, sf_dir)
    return mosaic.sample_rgba(p, r, "nearest", rel.WIDTH, h)


@query(_sample_sql("bilinear"))
def sample_bilinear(spark, sf_dir):
    p, r, h = _sampled(spark, sf_dir)
    return mosaic.sample_rgba(p, r, "bilinear", rel.WIDTH, h)


@query(_sample_sql("bicubic"))
def sample_bicubic(spark, sf_dir):
    p, r, h = _sampled(spark, sf_dir)
    return mosaic.sample_rgba(p, r, "bicubic", rel.WIDTH, h)


@query(_sample_sql("lanczos"))
def sample_lanczos(spark, sf_dir):
    p, r, h = _sampled(spark, sf_dir)
    return mosaic.sample_rgba(p, r, "lanczos", rel.WIDTH, h)


_NEAREST = "nearest AS (SELECT point, elev AS e FROM pts JOIN raster ON gx = least(greatest(floor(fx + 0.5), 0), 511) AND gy = least(greatest(floor(fy + 0.5), 0), h - 1))"


@query(with_(rel.RASTER, _AT, _near("bilinear"), _NEAREST) + """SELECT point, round(coalesce(m, e), 6) AS elev FROM (
  SELECT point, CASE WHEN count(*) FILTER (elev IS NULL) = 0 THEN sum(w * elev) / sum(w) END AS m FROM near GROUP BY point) JOIN nearest USING (point)""")
def sample_float_nan(spark, sf_dir):
    p, r, h = _sampled(spark, sf_dir)
    return mosaic.sample_elevation(p, r, "bilinear", rel.WIDTH, h).withColumn("elev", F.round("elev", 6))


@query(with_(rel.RASTER, _AT, _near("bicubic"), _NEAREST) + """SELECT point, round(coalesce(m, e) + 1e-7, 3) AS elev FROM (
  SELECT point, sum(w * elev) FILTER (elev IS NOT NULL) / sum(w) FILTER (elev IS NOT NULL) AS m FROM near GROUP BY point HAVING abs(coalesce(sum(w) FILTER (elev IS NOT NULL), 1)) > 1e-3) JOIN nearest USING (point)""")
def sample_float_bicubic(spark, sf_dir):
    """Points whose valid weights all but cancel are left out, as last bits decide there."""
    p, r, h = _sampled(spark, sf_dir)
    near = mosaic.neighbourhood(p, r, "bicubic", rel.WIDTH, h).groupBy("point").agg(F.abs(F.coalesce(F.sum(F.when(F.col("elev").isNotNull(), F.col("w"))), F.lit(1.0))).alias("t")).filter("t > 1e-3")
    return mosaic.sample_elevation(p, r, "bicubic", rel.WIDTH, h).join(near, "point", "left_semi").withColumn("elev", F.round(F.col("elev") + 1e-7, 3))


@query(with_(rel.RASTER) + "SELECT gx, gy, r, g, b, a FROM raster WHERE gx BETWEEN 100 AND 163 AND gy BETWEEN 2 AND 9")
def window_read(spark, sf_dir):
    return rel.rgba(spark, sf_dir).filter(F.col("gx").between(100, 163) & F.col("gy").between(2, 9)).drop("z")


# ---- positions

_SPARSE = "have AS (SELECT DISTINCT 8 AS z, gx // 8 AS x, gy // 8 AS y FROM raster WHERE (gx // 8 * 7 + gy // 8 * 3) % 5 < 2), positions AS (SELECT 8 AS z, x, y FROM (SELECT unnest(range(n)) AS x FROM (SELECT max(gx) // 8 + 1 AS n FROM raster)), (SELECT unnest(range(n)) AS y FROM (SELECT max(gy) // 8 + 1 AS n FROM raster)))"


def _sparse(spark, sf_dir) -> DataFrame:
    t = rel.raster(spark, sf_dir).select(F.lit(8).alias("z"), F.floor(F.col("gx") / 8).alias("x"), F.floor(F.col("gy") / 8).alias("y"), "r")
    return t.filter((F.col("x") * 7 + F.col("y") * 3) % 5 < 2)


def _positions(spark, sf_dir) -> DataFrame:
    """Every tile of the raster's box."""
    x, y = rel.raster(spark, sf_dir).agg(F.floor(F.max("gx") / 8), F.floor(F.max("gy") / 8)).first()
    return coverage.grid(spark, 8, 0, x, 0, y)


@query(with_(rel.RASTER, _SPARSE) + "SELECT z, x, y FROM positions ANTI JOIN have USING (x, y)")
def missing_positions(spark, sf_dir):
    return coverage.missing(_positions(spark, sf_dir), _sparse(spark, sf_dir))


@query(with_(rel.RASTER, _SPARSE) + "SELECT z, x, y FROM have SEMI JOIN positions USING (x, y)")
def positions_inside(spark, sf_dir):
    return coverage.inside(_sparse(spark, sf_dir).select("z", "x", "y").distinct(), _positions(spark, sf_dir))


@query(with_(rel.RASTER, _SPARSE) + "SELECT DISTINCT CAST(8 - k AS INTEGER) AS z, x // CAST(pow(2, k) AS BIGINT) AS x, y // CAST(pow(2, k) AS BIGINT) AS y FROM have, (SELECT unnest(range(4)) AS k)")
def real_position_propagation(spark, sf_dir):
    return coverage.real_positions(_sparse(spark, sf_dir), 3)


@query(with_(rel.RASTER, _SPARSE, "t AS (SELECT gx // 8 AS x, gy // 8 AS y, max(r) AS r FROM raster GROUP BY 1, 2)") + "SELECT p.z, p.x, p.y, CASE WHEN have.x IS NOT NULL THEN t.r ELSE 99 END AS r, have.x IS NOT NULL AS is_real FROM positions p LEFT JOIN have ON have.x = p.x AND have.y = p.y LEFT JOIN t ON t.x = p.x AND t.y = p.y")
def fill_children(spark, sf_dir):
    tiles = _sparse(spark, sf_dir).groupBy("z", "x", "y").agg(F.max("r").alias("r"))
    return coverage.with_fill(_positions(spark, sf_dir), tiles, r=99)


@query(with_(rel.SOURCES) + "SELECT round(min(min_x), 9) AS west, round(min(min_y), 9) AS south, round(max(max_x), 9) AS east, round(max(max_y), 9) AS north FROM sources")
def merged_bounds(spark, sf_dir):
    b = coverage.merged_bounds(rel.sources(spark, sf_dir))
    return b.select(*(F.round(c, 9).alias(c) for c in b.columns))


@query()  # a flood over up to 2000 x 2000 cells is beyond SQL; tests hold it to a plain one
def coverage_gaps(spark, sf_dir):
    g = coverage.coverage_gaps(rel.sources(spark, sf_dir))
    return g.select(*(F.round(c, 6).alias(c) for c in mosaic.BOX), "cells")


@query(with_(rel.SOURCES) + """SELECT 'sources ' || count(*) || '; box ' || CAST(CAST(floor(min(min_x)) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(min(min_y)) AS BIGINT) AS VARCHAR) AS description FROM sources""")
def provenance_text(spark, sf_dir):
    s = rel.sources(spark, sf_dir)
    return s.agg(F.concat(F.lit("sources "), F.count("*").cast("string"), F.lit("; box "), F.floor(F.min("min_x")).cast("string"), F.lit(","), F.floor(F.min("min_y")).cast("string")).alias("description"))


# ---- archive layout

_DISTINCT = """dist AS (SELECT sha256(data) AS sha, max(octet_length(data)) AS len, min(tile_id) AS first, count(*) AS n FROM payloads WHERE octet_length(data) > 0 GROUP BY 1)"""
_PLACED = """placed AS (SELECT *, coalesce(CAST(sum(len) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM dist)"""
_ENTRIES = """entries AS (SELECT tile_id, off, len FROM payloads p JOIN placed d ON sha256(p.data) = d.sha)"""
_RUNS = """runs AS (SELECT min(tile_id) AS tile_id, off, len, count(*) AS run FROM (SELECT *, tile_id - row_number() OVER (PARTITION BY off, len ORDER BY tile_id) AS island FROM entries) GROUP BY off, len, island)"""


@query(with_(rel.PAYLOADS, _DISTINCT) + "SELECT sha, len, first, n FROM dist")
def payload_dedup(spark, sf_dir):
    return layout.payloads(rel.payloads(spark, sf_dir))


@query(with_(rel.PAYLOADS, _DISTINCT, _PLACED) + "SELECT sha, len, first, n, off FROM placed")
def payload_offsets(spark, sf_dir):
    return layout.offsets(layout.payloads(rel.payloads(spark, sf_dir)))


@query(with_(rel.PAYLOADS, _DISTINCT, _PLACED, _ENTRIES, _RUNS) + "SELECT tile_id, off, len, run FROM runs")
def run_lengths(spark, sf_dir):
    return layout.runs(layout.entries(rel.payloads(spark, sf_dir)))


@query(with_(rel.PAYLOADS, _DISTINCT, _PLACED, _ENTRIES, _RUNS) + "SELECT tile_id, run, (row_number() OVER (ORDER BY tile_id) - 1) // 64 AS leaf FROM runs")
def leaf_assignment(spark, sf_dir):
    return layout.leaves(layout.runs(layout.entries(rel.payloads(spark, sf_dir))), 64).select("tile_id", "run", "leaf")


@query(with_(rel.PAYLOADS, _DISTINCT, _PLACED, _ENTRIES, _RUNS, "leafed AS (SELECT *, (row_number() OVER (ORDER BY tile_id) - 1) // 64 AS leaf FROM runs)") + """SELECT leaf, tile_id, tile_id - coalesce(lag(tile_id) OVER w, 0) AS id_delta, run, len,
  CASE WHEN off = lag(off + len) OVER w THEN 0 ELSE off + 1 END AS off_code FROM leafed WINDOW w AS (PARTITION BY leaf ORDER BY tile_id)""")
def delta_ids(spark, sf_dir):
    return layout.deltas(layout.leaves(layout.runs(layout.entries(rel.payloads(spark, sf_dir))), 64))


@query(with_(rel.PAYLOADS, _DISTINCT, _PLACED, _ENTRIES) + "SELECT tile_id, off, len FROM entries")
def run_expansion(spark, sf_dir):
    return layout.expand(layout.runs(layout.entries(rel.payloads(spark, sf_dir))))


@query(with_(rel.RASTER) + "SELECT gx, gy, CAST(sum(r) OVER (PARTITION BY gy ORDER BY gx) % 256 AS INTEGER) AS v FROM raster")
def predictor2_decode(spark, sf_dir):
    """Differences along each row, summed up modulo 256."""
    row = Window.partitionBy("gy").orderBy("gx").rowsBetween(Window.unboundedPreceding, 0)
    return rel.raster(spark, sf_dir).select("gx", "gy", (F.sum("r").over(row) % 256).cast("int").alias("v"))


# ---- metadata


@query("""SELECT event_id, CAST(event_id % 3 = 0 AS BOOLEAN) AS has_name, '3' AS version, CAST(user_id AS VARCHAR) AS kept FROM events""")
def metadata_set_unset(spark, sf_dir):
    """A key set, one removed, one kept."""
    e = rel.table(spark, sf_dir, "events")
    have = F.create_map(F.lit("version"), F.lit("1"), F.lit("kept"), F.col("user_id").cast("string"), F.lit("name"), F.col("event_type"))
    new = F.when(F.col("event_id") % 3 == 0, text.patch_metadata(have, {"version": "3"}, [])).otherwise(text.patch_metadata(have, {"version": "3"}, ["name"]))
    return e.select("event_id", new.alias("m")).select("event_id", F.map_contains_key("m", "name").alias("has_name"), F.col("m")["version"].alias("version"), F.col("m")["kept"].alias("kept"))


_BAND_TEXTS = [("Band 1: B08 (NIR)", 1), ("Near-Infrared", 2), ("red", 3), ("Green (560nm)", 4), ("blue", 5), ("SWIR 1", 6), ("Alpha", 7), ("infrared", 8)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {r!r})" if r else f"({i}, NULL)" for i, r in ((1, "nir"), (2, "nir"), (3, "red"), (4, "green"), (5, "blue"), (6, "swir"), (7, "alpha"), (8, "nir"))) + ") AS t(band, role)")
def preset_roles(spark, sf_dir):
    return spark.createDataFrame(_BAND_TEXTS, "description string, band int").select("band", text.band_role(F.col("description")).alias("role"))


@query("SELECT event_id, event_id % 12 + 1 AS band, 'R' || (event_id % 5) AS role FROM events")
def band_regex(spark, sf_dir):
    line = F.concat(F.lit("x; Band  "), (F.col("event_id") % 12 + 1).cast("string"), F.lit(": B01 (R"), (F.col("event_id") % 5).cast("string"), F.lit(") y"))
    found = text.band_lines(line)
    return rel.table(spark, sf_dir, "events").select("event_id", found[0]["band"].cast("long").alias("band"), found[0]["role"].alias("role"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 10 ELSE 171 END AS r, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 256 AS INTEGER) ELSE 205 END AS g, CASE WHEN event_id % 2 = 0 THEN 30 ELSE 239 END AS b, CASE WHEN event_id % 2 = 0 THEN 255 ELSE 128 END AS a FROM events""")
def colour_parse(spark, sf_dir):
    words = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10,"), (F.col("event_id") % 256).cast("string"), F.lit(",30"))).otherwise(F.lit("#ABCDEF80"))
    return rel.table(spark, sf_dir, "events").select("event_id", text.parse_colour(words).alias("p")).select("event_id", "p.*")


@query(with_(rel.POINTS) + "SELECT event_id, CAST(round(CAST(CAST(lon AS FLOAT) AS DOUBLE) * 1e7) AS BIGINT) AS lon_e7, CAST(round(CAST(CAST(lat AS FLOAT) AS DOUBLE) * 1e7) AS BIGINT) AS lat_e7 FROM points")
def lonlat_e7(spark, sf_dir):
    return rel.points(spark, sf_dir).select("event_id", text.e7(F.col("lon")).alias("lon_e7"), text.e7(F.col("lat")).alias("lat_e7"))


@query("SELECT event_id, CASE WHEN k = 0 THEN 'unknown' WHEN k = 1 THEN 'mvt' WHEN k = 2 THEN 'png' WHEN k = 3 THEN 'jpeg' WHEN k = 4 THEN 'webp' WHEN k = 5 THEN 'avif' ELSE 'unknown' END AS kind FROM (SELECT event_id, event_id % 7 AS k FROM events)")
def tile_types(spark, sf_dir):
    return rel.table(spark, sf_dir, "events").select("event_id", text.tile_type_name(F.col("event_id") % 7).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (k // 10) || '.' || (k % 10) || ' KB' ELSE (m // 10) || '.' || (m % 10) || ' MB' END AS size FROM (
  SELECT *, (n * 10 + 512) // 1024 AS k, (n * 10 + 524288) // 1048576 AS m FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS n FROM orders))""")
def human_sizes(spark, sf_dir):
    n = F.floor("o_totalprice") * (F.col("o_orderkey") % 40)
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", text.human_size(n).alias("size"))


@query("""SELECT * FROM (VALUES (0, 'passthrough'), (1, 'reencode'), (2, 'reencode'), (3, 'rebuild'), (4, 'rebuild'), (5, 'passthrough')) AS t(id, mode)""")
def mode_planner(spark, sf_dir):
    from ..options import TransformOptions, transform_mode

    cases = [TransformOptions(), TransformOptions(format="jpeg"), TransformOptions(fill=(0, 0, 0, 255)), TransformOptions(rebuild=True), TransformOptions(min_zoom=0), TransformOptions(format="png", min_zoom=6)]
    return spark.createDataFrame([(i, transform_mode("png", 5, c)) for i, c in enumerate(cases)], "id int, mode string")


@query(with_(rel.RASTER) + "SELECT count(*) AS n, count(*) FILTER (elev IS NULL) AS missing, min(elev) AS least, max(elev) AS greatest FROM raster")
def elevation_summary(spark, sf_dir):
    return summary.elevation_summary(rel.raster(spark, sf_dir))


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after FROM (SELECT CAST(event_id AS VARCHAR) AS k, event_type AS v FROM events WHERE event_id * 7919 % 11 <> 0) a
  FULL JOIN (SELECT CAST(event_id AS VARCHAR) AS k, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE event_type END AS v FROM events WHERE event_id * 104729 % 13 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def header_differences(spark, sf_dir):
    """Two versions of all events: each lacks some keys that the other has, and the second has other values."""
    e, k = rel.table(spark, sf_dir, "events"), F.col("event_id")
    a = e.filter(k * 7919 % 11 != 0).select(k.cast("string").alias("k"), F.col("event_type").alias("v"))
    b = e.filter(k * 104729 % 13 != 0).select(k.cast("string").alias("k"), F.when(k % 7 == 0, "x").otherwise(F.col("event_type")).alias("v"))
    return summary.differences(a, b)
