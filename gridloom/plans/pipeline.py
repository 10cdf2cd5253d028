"""Rasters to tile archives, and archives to archives.

Tiles travel as whole arrays: a level is one DataFrame (z, x, y, form, pixels), the next one up a group-by on the parent's
address. Uniform tiles carry a colour instead of pixels. Each level is written to shared storage before the next begins, so
lineage stays one level long.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, hilbert
from ..operators import blocks, coverage, mosaic
from ..options import BandConfig, Colour, PyramidOptions, TransformOptions, transform_mode
from ..sources import archive, connectors, tiff
from ..sources.codecs import codec, elevation_pixels, pixel_elevations
from . import presets

TILE = "z int, x long, y long, form string, pixels binary"
KEY = ["z", "x", "y"]


def pack(tile: np.ndarray) -> tuple[str, bytes]:
    """uniform: four bytes; elevation: float32; rgba: all pixels; the last two compressed."""
    if tile.ndim == 2:
        return "elevation", zlib.compress(tile.astype("<f4").tobytes(), 1)
    if (tile == tile[0, 0]).all():
        return "uniform", tile[0, 0].tobytes()
    return "rgba", zlib.compress(np.ascontiguousarray(tile).tobytes(), 1)


def unpack(form: str, data: bytes, size: int) -> np.ndarray:
    if form == "uniform":
        return np.broadcast_to(np.frombuffer(data, np.uint8), (size, size, 4))
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<f4").reshape(size, size).astype(float) if form == "elevation" else np.frombuffer(raw, np.uint8).reshape(size, size, 4)


def shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return base.rstrip("/")


def keep(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def render_level(spark: SparkSession, rasters: list[tiff.Raster], positions: DataFrame, options: PyramidOptions) -> DataFrame:
    """Tiles of the deepest level from the sources that their boxes meet; positions: z, x, y and the ordered list of sources."""
    known, floating = spark.sparkContext.broadcast(rasters), options.format == "terrarium"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "sources")), strict=True):
                tile = blocks.render(z, x, y, options.tile_size, [known.value[i] for i in ids], options.resampling, options.bands, options.gamma, floating)
                if tile is not None:
                    form, data = pack(tile)
                    yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([x], pa.int64()), pa.array([y], pa.int64()), pa.array([form]), pa.array([data], pa.binary())], [*KEY, "form", "pixels"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return positions.select(*KEY, "sources").mapInArrow(run, TILE)


def level_up(tiles: DataFrame, size: int, mode: str) -> DataFrame:
    """Parents of tiles. Four equal uniform children make a uniform parent without any pixels."""
    up = tiles.select((F.col("z") - 1).alias("z"), F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"), (F.col("x") % 2).cast("int").alias("i"), (F.col("y") % 2).cast("int").alias("j"), "form", "pixels")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        if len(group) == 4 and (group["form"] == "uniform").all() and group["pixels"].nunique() == 1:
            form, data = "uniform", first["pixels"]
        else:
            children = {(int(r.i), int(r.j)): unpack(r.form, r.pixels, size) for r in group.itertuples()}
            form, data = pack(blocks.combine(children, size, mode))
        return pd.DataFrame({"z": [first["z"]], "x": [first["x"]], "y": [first["y"]], "form": [form], "pixels": [data]})

    return up.groupBy(*KEY).applyInPandas(join, TILE)


def fill_tiles(tiles: DataFrame, known: DataFrame, positions: DataFrame, fill: Colour) -> DataFrame:
    """A tile of the fill colour wherever there is none. known: the tiles' addresses, from where they needn't be decoded."""
    empty = coverage.missing(positions, known)
    return tiles.unionByName(empty.select(F.col("z").cast("int").alias("z"), "x", "y", F.lit("uniform").alias("form"), F.lit(bytes(fill)).alias("pixels")))


def encode_tiles(tiles: DataFrame, format: str, quality: int, size: int, fill: Colour | None = None) -> DataFrame:
    """tile_id, data. The fill takes the place of transparent pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = codec(format)
        for batch in batches:
            out = []
            for form, data in zip(batch.column("form").to_pylist(), batch.column("pixels").to_pylist(), strict=True):
                tile = unpack(form, data, size)
                if tile.ndim == 2:
                    tile = elevation_pixels(tile)
                elif fill is not None:
                    tile = np.where((tile[..., 3] == 0)[..., None], np.array(fill, np.uint8), tile)
                out.append(encode(tile, quality))
            yield pa.RecordBatch.from_arrays([batch.column("tile_id"), pa.array(out, pa.binary())], ["tile_id", "data"])

    placed = tiles.withColumn("tile_id", hilbert.tile_id(F.col("z"), F.col("x"), F.col("y")))
    return placed.select("tile_id", "form", "pixels").mapInArrow(run, "tile_id long, data binary")


def bounds_of(rasters: list[tiff.Raster]) -> tuple[float, float, float, float]:
    corners = [blocks.to_wgs84(r.epsg, x, y) for r in rasters for x in r.box()[::2] for y in r.box()[1::2]]
    lons, lats = zip(*corners, strict=True)
    return min(lons), max(-geo.MAX_LAT, min(lats)), max(lons), min(geo.MAX_LAT, max(lats))


def _tile(lon: float, lat: float, z: int) -> tuple[int, int]:
    n, phi = 2**z, math.radians(max(-geo.MAX_LAT, min(geo.MAX_LAT, lat)))
    x, y = (lon + 180) / 360 * n, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n
    return max(0, min(n - 1, math.floor(x))), max(0, min(n - 1, math.floor(y)))


def zoom_range(rasters: list[tiff.Raster], box: tuple[float, float, float, float], options: PyramidOptions) -> tuple[int, int]:
    west, south, east, north = box
    lat, r = (south + north) / 2, rasters[0]
    metres = r.pixel[0] * {4326: geo.CIRCUMFERENCE / 360 * math.cos(math.radians(lat)), 3857: math.cos(math.radians(lat))}.get(r.epsg, 1.0)
    deepest = max(0, min(28, math.floor(math.log2(geo.CIRCUMFERENCE * math.cos(math.radians(lat)) / (metres * options.tile_size)))))
    one = next((z - 1 for z in range(1, 29) if _tile(west, north, z) != _tile(east, south, z)), 28)
    high = deepest if options.max_zoom is None else options.max_zoom
    return min(one, high) if options.min_zoom is None else options.min_zoom, high


def positions_in(spark: SparkSession, z: int, box: tuple[float, float, float, float]) -> DataFrame:
    (x0, y0), (x1, y1) = _tile(box[0], box[3], z), _tile(box[2], box[1], z)
    return coverage.grid(spark, z, x0, x1, y0, y1)


def build_pyramid(spark: SparkSession, inputs: list[str], out: str, options: PyramidOptions = PyramidOptions()) -> archive.Header:
    """All inputs as one archive: the deepest level from the sources, each level above from the one below."""
    files = connectors.raster_files(inputs)
    rasters = [tiff.read_raster(p) for p in files]
    if not rasters or any(r.origin is None for r in rasters):
        raise ValueError("no georeferenced rasters among the inputs")
    found = presets.detect(rasters[0])
    if found is not None and found.format == "terrarium":
        options = replace(options, format="terrarium")
    elif found is not None and options.bands == BandConfig():
        options = replace(options, bands=found.bands)
    box = bounds_of(rasters)
    low, high = zoom_range(rasters, box, options)
    root = f"{shared(spark)}/pyramid-{uuid.uuid4().hex}"
    rows = [(i, *_wgs_box(r)) for i, r in enumerate(rasters)]
    sources = spark.createDataFrame(rows, "source_id int, min_x double, min_y double, max_x double, max_y double")
    grid = positions_in(spark, high, box)
    sides = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    grid = grid.select(*KEY, *(c.alias(n) for c, n in zip(sides, mosaic.BOX, strict=True)))
    met = mosaic.overlap_join(grid, sources).groupBy(*KEY).agg(F.sort_array(F.collect_list("source_id")).alias("sources"))
    met = met.withColumn("tile_id", hilbert.tile_id(F.col("z"), F.col("x"), F.col("y")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartitionByRange(4 * n, "tile_id").sortWithinPartitions("tile_id")  # neighbours share blocks
    now = keep(render_level(spark, rasters, met, options), f"{root}/{high}")
    levels = [now]
    for z in range(high - 1, low - 1, -1):
        now = keep(level_up(now, options.tile_size, options.resampling), f"{root}/{z}")
        levels.append(now)
    if options.fill is not None:
        levels = [fill_tiles(t, t, positions_in(spark, high - i, box), options.fill) for i, t in enumerate(levels)]
    every = levels[0]
    for t in levels[1:]:
        every = every.unionByName(t)
    encoded = encode_tiles(every, options.format, options.quality, options.tile_size, options.fill)
    text = f"{len(rasters)} sources; {options.resampling}; zoom {low} to {high}"
    info = archive.Info(options.format, options.name, options.kind, text, options.attribution, box, low, high)
    return archive.write_archive(encoded, out, info, root)


def _wgs_box(r: tiff.Raster) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = r.box()
    corners = [blocks.to_wgs84(r.epsg, x, y) for x in (x0, x1) for y in (y0, y1)]
    lons, lats = zip(*corners, strict=True)
    return min(lons), min(lats), max(lons), max(lats)


def decode_tiles(tiles: DataFrame, format: str, elevation: bool) -> DataFrame:
    """TILE rows from payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = codec(format)
        for batch in batches:
            packed = [pack(pixel_elevations(decode(d)) if elevation else decode(d)) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array([f for f, _ in packed], pa.string()), pa.array([d for _, d in packed], pa.binary())], [*KEY, "form", "pixels"])

    return tiles.select(*KEY, "data").mapInArrow(run, TILE)


def transform_archive(spark: SparkSession, path: str, out: str, options: TransformOptions = TransformOptions()) -> archive.Header:
    """passthrough: payloads as they are, of the zooms asked for; reencode: decoded and encoded; rebuild: the deepest level
    decoded, the levels above made anew."""
    connectors.register(spark)
    source = archive.Archive(path)
    h, words = source.header, source.metadata()
    kind = {v: k for k, v in archive.TYPES.items()}[h.tile_type]
    have = "terrarium" if words.get("format") == "terrarium" else kind
    mode = transform_mode(have, h.min_zoom, options)
    low = h.min_zoom if options.min_zoom is None else options.min_zoom
    high = h.max_zoom if options.max_zoom is None else min(options.max_zoom, h.max_zoom)
    want = options.format or have
    box = (h.min_lon, h.min_lat, h.max_lon, h.max_lat)
    info = archive.Info(want, words.get("name", "gridloom"), words.get("type", "baselayer"), f"{mode}; {words.get('description', '')}", words.get("attribution", ""), box, low, high)

    def level(first: int, last: int) -> DataFrame:
        return spark.read.format("tilearchive").option("path", path).option("min_zoom", first).option("max_zoom", last).load()

    tiles, deepest = level(low, high), level(high, high)
    root = f"{shared(spark)}/transform-{uuid.uuid4().hex}"
    if mode == "passthrough":
        return archive.write_archive(tiles.select("tile_id", "data"), out, info, root)
    elevation = have == "terrarium" and want == "terrarium"
    first = next((r.data for r in deepest.limit(1).collect()), None)
    if first is None:
        raise ValueError("the source has no tiles at its deepest level")
    size = codec(have)[1](bytes(first)).shape[0]
    if mode == "reencode":
        packed = decode_tiles(tiles, have, elevation)
        if options.fill is not None:
            every = functools.reduce(DataFrame.unionByName, (positions_in(spark, z, box) for z in range(low, high + 1)))
            packed = fill_tiles(packed, tiles, every, options.fill)
        return archive.write_archive(encode_tiles(packed, want, options.quality, size), out, info, root)
    now = keep(decode_tiles(deepest, have, elevation), f"{root}/{high}")
    levels = [now]
    for z in range(high - 1, low - 1, -1):
        now = keep(level_up(now, size, options.resampling), f"{root}/{z}")
        levels.append(now)
    if options.fill is not None:
        levels = [fill_tiles(t, t, positions_in(spark, high - i, box), options.fill) for i, t in enumerate(levels)]
    every = levels[0]
    for t in levels[1:]:
        every = every.unionByName(t)
    return archive.write_archive(encode_tiles(every, want, options.quality, size, options.fill), out, info, root)


def describe_source(spark: SparkSession, paths: list[str], samples: int = 0) -> DataFrame:
    """What each raster is; with samples, also the values of that many pixels along its diagonal."""
    connectors.register(spark)
    about = spark.read.format("georaster").option("path", ",".join(paths)).option("table", "sources").load()
    if not samples:
        return about
    rows = []
    for i, p in enumerate(connectors.raster_files(paths)):
        r = tiff.read_raster(p)
        top = r.levels[0]
        with tiff.open_file(p) as f:
            for k in range(samples):
                x, y = top.width * k // samples, top.height * k // samples
                rows.append((i, x, y, tiff.read_window(f, r, 0, x, y, x + 1, y + 1)[0, 0].astype(float).tolist()))
    return spark.createDataFrame(rows, "source_id int, px int, py int, bands array<double>")
