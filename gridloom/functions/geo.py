"""Projections, tile addresses and resolutions as Column expressions. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCUMFERENCE = 40075016.685578488
SHIFT = CIRCUMFERENCE / 2
MAX_LAT = 85.0511287798
MAX_ZOOM = 28

Pair = tuple[Column, Column]


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def side(z: Column) -> Column:
    """Tiles along one side of a zoom level."""
    return F.pow(F.lit(2.0), z)


# ---- tiles and coordinates


def tile_fraction(lon: Column, lat: Column, z: Column) -> Pair:
    phi = F.radians(clamp(lat, -MAX_LAT, MAX_LAT))
    n = side(z)
    return (lon + 180) / 360 * n, (F.lit(1.0) - F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.pi()) / 2 * n


def lonlat_to_tile(lon: Column, lat: Column, z: Column) -> Pair:
    x, y = tile_fraction(lon, lat, z)
    last = side(z).cast("long") - 1
    return clamp(F.floor(x), F.lit(0).cast("long"), last), clamp(F.floor(y), F.lit(0).cast("long"), last)


def tile_lon(x: Column, z: Column) -> Column:
    return _d(x) / side(z) * 360 - 180


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - F.lit(2.0) * _d(y) / side(z)))))


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north in degrees."""
    return tile_lon(x, z), tile_lat(y + 1, z), tile_lon(x + 1, z), tile_lat(y, z)


def pixel_to_lonlat(z: Column, x: Column, y: Column, px: Column, py: Column, size: int) -> Pair:
    """Of the centre of a pixel of a tile."""
    fx, fy = _d(x) + (_d(px) + 0.5) / size, _d(y) + (_d(py) + 0.5) / size
    return tile_lon(fx, z), tile_lat(fy, z)


def lonlat_to_pixel(lon: Column, lat: Column, z: Column, size: int) -> Pair:
    """Global pixel coordinates at a zoom level."""
    x, y = tile_fraction(lon, lat, z)
    return x * size, y * size


def tiles_in_bounds(z: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Array of (z, x, y) that cover the box, row by row; explode it."""
    x0, y0 = lonlat_to_tile(west, north, z)
    x1, y1 = lonlat_to_tile(east, south, z)
    return F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(z.cast("int").alias("z"), x.alias("x"), y.alias("y")))))


# ---- resolutions


def resolution(lat: Column, z: Column, size: int = 256) -> Column:
    """Metres a pixel."""
    return F.lit(CIRCUMFERENCE) * F.cos(F.radians(lat)) / side(z) / size


def pixel_metres(pixel: Column, epsg: Column, lat: Column) -> Column:
    """Ground size of a pixel of a source."""
    return F.when(epsg == 4326, pixel * (CIRCUMFERENCE / 360) * F.cos(F.radians(lat))).when(epsg == 3857, pixel * F.cos(F.radians(lat))).otherwise(pixel)


def metres_to_pixel(metres: Column, epsg: Column, lat: Column) -> Column:
    """The inverse of pixel_metres."""
    return F.when(epsg == 4326, metres / ((CIRCUMFERENCE / 360) * F.cos(F.radians(lat)))).when(epsg == 3857, metres / F.cos(F.radians(lat))).otherwise(metres)


def max_zoom(pixel: Column, lat: Column, size: int = 256) -> Column:
    """The deepest zoom level whose pixels aren't finer than the source's; 0 for sizes that make no sense."""
    raw = F.floor(F.log2(F.lit(CIRCUMFERENCE) * F.cos(F.radians(lat)) / (pixel * size)))
    return F.when(pixel > 0, clamp(raw, F.lit(0).cast("long"), F.lit(MAX_ZOOM).cast("long"))).otherwise(0).cast("int")


def min_single_tile_zoom(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The deepest zoom level at which one tile holds the box."""

    def spans(z: Column) -> Column:
        a, b = lonlat_to_tile(west, north, z), lonlat_to_tile(east, south, z)
        return (a[0] != b[0]) | (a[1] != b[1])

    first = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(MAX_ZOOM)), spans))
    return F.coalesce(first - 1, F.lit(MAX_ZOOM)).cast("int")


def auto_zoom_range(pixel: Column, lat: Column, box: tuple[Column, Column, Column, Column], size: int = 256) -> Pair:
    deepest = max_zoom(pixel, lat, size)
    return F.least(min_single_tile_zoom(*box), deepest), deepest


# ---- projections


def lv95_to_wgs84(e: Column, n: Column) -> Pair:
    y, x = (e - 2600000.0) / 1e6, (n - 1200000.0) / 1e6
    lon = F.lit(2.6779094) + F.lit(4.728982) * y + F.lit(0.791484) * y * x + F.lit(0.1306) * y * x * x - F.lit(0.0436) * y * y * y
    lat = F.lit(16.9023892) + F.lit(3.238272) * x - F.lit(0.270978) * y * y - F.lit(0.002528) * x * x - F.lit(0.0447) * y * y * x - F.lit(0.0140) * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def wgs84_to_lv95(lon: Column, lat: Column) -> Pair:
    p, q = (lat * 3600 - 169028.66) / 1e4, (lon * 3600 - 26782.5) / 1e4
    e = F.lit(2600072.37) + F.lit(211455.93) * q - F.lit(10938.51) * q * p - F.lit(0.36) * q * p * p - F.lit(44.54) * q * q * q
    n = F.lit(1200147.07) + F.lit(308807.95) * p + F.lit(3745.25) * q * q + F.lit(76.63) * p * p - F.lit(194.56) * q * q * p + F.lit(119.79) * p * p * p
    return e, n


def mercator_to_wgs84(x: Column, y: Column) -> Pair:
    return x / SHIFT * 180, F.degrees(F.lit(2.0) * F.atan(F.exp(y / SHIFT * F.pi())) - F.pi() / 2)


def wgs84_to_mercator(lon: Column, lat: Column) -> Pair:
    return lon / 180 * SHIFT, F.ln(F.tan((lat + 90) * F.pi() / 360)) / F.pi() * SHIFT


Transform = Callable[[Column, Column], Pair]
_projections: dict[int, tuple[Transform, Transform]] = {
    4326: (lambda x, y: (x, y), lambda x, y: (x, y)),
    3857: (mercator_to_wgs84, wgs84_to_mercator),
    2056: (lv95_to_wgs84, wgs84_to_lv95),
}


def register_projection(epsg: int, to_wgs84: Transform, from_wgs84: Transform) -> None:
    _projections[epsg] = to_wgs84, from_wgs84


def projection(epsg: int) -> tuple[Transform, Transform]:
    """(to WGS84, from WGS84) of a reference system."""
    if epsg not in _projections:
        raise ValueError(f"EPSG:{epsg} isn't supported; known: {sorted(_projections)}")
    return _projections[epsg]


def _by_epsg(epsg: Column, x: Column, y: Column, way: int) -> Pair:
    out_x = out_y = F.lit(None).cast("double")
    for code, ways in _projections.items():
        px, py = ways[way](x, y)
        out_x, out_y = F.when(epsg == code, px).otherwise(out_x), F.when(epsg == code, py).otherwise(out_y)
    return out_x, out_y


def to_wgs84(epsg: Column, x: Column, y: Column) -> Pair:
    """Each row by its own reference system; null for an unknown one."""
    return _by_epsg(epsg, x, y, 0)


def from_wgs84(epsg: Column, lon: Column, lat: Column) -> Pair:
    return _by_epsg(epsg, lon, lat, 1)


def infer_epsg(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """By the range of the coordinates: degrees, Swiss metres, Web-Mercator metres, else degrees."""
    degrees = (min_x >= -180) & (max_x <= 180) & (min_y >= -90) & (max_y <= 90)
    swiss = (min_x >= 2400000) & (max_x <= 2900000) & (min_y >= 1000000) & (max_y <= 1400000)
    mercator = (min_x >= -SHIFT * 1.01) & (max_x <= SHIFT * 1.01) & (min_y >= -SHIFT * 1.01) & (max_y <= SHIFT * 1.01)
    return F.when(degrees, 4326).when(swiss, 2056).when(mercator, 3857).otherwise(4326)
