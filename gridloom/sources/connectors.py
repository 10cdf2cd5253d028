"""Python data sources: "georaster" (rasters as sources, levels, blocks, samples) and "tilearchive" (tiles, entries, header, metadata)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.hilbert import zoom_ids, zxy_of
from . import archive, tiff


def raster_files(paths: list[str]) -> list[str]:
    """Files given, and .tif and .tiff files below folders given, in order of path. All missing paths are named at once."""
    found, missing = [], []
    for path in paths:
        fs, name = archive.locate(path)
        info = fs.get_file_info(name)
        if info.type == pyarrow.fs.FileType.NotFound:
            missing.append(path)
        elif info.type == pyarrow.fs.FileType.Directory:
            found += sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(name, recursive=True)) if f.path.lower().endswith((".tif", ".tiff")))
        elif name.lower().endswith((".tif", ".tiff")):
            found.append(path)
    if missing:
        raise FileNotFoundError(f"no such files: {', '.join(missing)}")
    return found


@dataclass
class Piece(InputPartition):
    source: int
    path: str
    level: int = 0
    first: int = 0
    last: int = 0


SCHEMAS = {
    "sources": "source_id int, path string, epsg int, origin_x double, origin_y double, px_x double, px_y double, width int, height int, samples int, bits int, floating boolean, compression string, predictor int, little boolean, nodata string, min_x double, min_y double, max_x double, max_y double, items map<string,string>, band_items map<int,map<string,string>>",
    "levels": "source_id int, level int, width int, height int, block_width int, block_height int, blocks int, px double",
    "blocks": "source_id int, level int, col int, row int, width int, height int, samples int, kind string, data binary",
    "samples": "source_id int, level int, px int, py int, bands array<double>",
}


class GeoRaster(DataSource):
    """Options: path (comma-separated files or folders), table (sources, levels, blocks, samples), level (-1: all), source_id, blocks_per_task."""

    @classmethod
    def name(cls) -> str:
        return "georaster"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "sources")]

    def reader(self, schema) -> DataSourceReader:
        return GeoRasterReader(dict(self.options))


class GeoRasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.paths = options.get("table", "sources"), options["path"].split(",")
        self.level, self.each = int(options.get("level", -1)), int(options.get("blocks_per_task", 64))
        self.wanted = int(options["source_id"]) if "source_id" in options else None

    def partitions(self) -> list[Piece]:
        out = []
        for i, path in enumerate(raster_files(self.paths)):
            if self.wanted is not None and i != self.wanted:
                continue
            if self.table in ("sources", "levels"):
                out.append(Piece(i, path))
                continue
            for k, lv in enumerate(tiff.read_raster(path).levels):
                n = lv.across * lv.down
                if self.level in (-1, k):
                    out += [Piece(i, path, k, b, min(b + self.each, n)) for b in range(0, n, self.each)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        r = tiff.read_raster(piece.path)
        top = r.levels[0]
        if self.table == "sources":
            x, y = r.origin or (None, None)
            px, py = r.pixel or (None, None)
            yield (piece.source, piece.path, r.epsg, x, y, px, py, top.width, top.height, top.samples, top.bits, top.floating, top.compression, top.predictor, r.little, r.nodata, *(r.box() if r.origin else (None,) * 4), r.items, r.band_items)
        elif self.table == "levels":
            for k, lv in enumerate(r.levels):
                yield piece.source, k, lv.width, lv.height, lv.block_width, lv.block_height, lv.across * lv.down, r.pixel[0] * top.width / lv.width if r.pixel else None
        else:
            lv = r.levels[piece.level]
            with tiff.open_file(piece.path) as f:
                for i in range(piece.first, piece.last):
                    col, row = i % lv.across, i // lv.across
                    block = tiff.read_block(f, lv, r.little, col, row)
                    if block is None:
                        continue
                    if self.table == "blocks":
                        yield piece.source, piece.level, col, row, block.shape[1], block.shape[0], lv.samples, lv.dtype.str, block.tobytes()
                        continue
                    x0, y0 = col * lv.block_width, row * lv.block_height
                    h, w = min(block.shape[0], lv.height - y0), min(block.shape[1], lv.width - x0)
                    for j in range(h):
                        for k in range(w):
                            yield piece.source, piece.level, x0 + k, y0 + j, block[j, k].astype(float).tolist()


@dataclass
class Range(InputPartition):
    rows: bytes | None
    offset: int
    length: int


TABLES = {"tiles": "z int, x long, y long, tile_id long, data binary", "entries": "tile_id long, off long, len long, run long", "header": "field string, value string", "metadata": "key string, value string"}


class TileArchive(DataSource):
    """Options: path, table (tiles, entries, header, metadata). A leaf directory is a task; min_zoom and max_zoom leave
    out leaves and payloads of other levels."""

    @classmethod
    def name(cls) -> str:
        return "tilearchive"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "tiles")]

    def reader(self, schema) -> DataSourceReader:
        return TileArchiveReader(dict(self.options))


class TileArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path = options.get("table", "tiles"), options["path"]
        self.low, self.high = zoom_ids(int(options.get("min_zoom", 0)))[0], zoom_ids(int(options.get("max_zoom", 28)))[1]

    def partitions(self) -> list[InputPartition]:
        if self.table in ("header", "metadata"):
            return [Range(None, 0, 0)]
        out: list[InputPartition] = []
        for first, after, rows, offset, length in archive.Archive(self.path).directories():
            if first >= self.high or 0 <= after <= self.low:
                continue
            if rows is None:
                out.append(Range(None, offset, length))
            else:
                out += [Range(rows[i : i + 4096].astype("<i8").tobytes(), 0, 0) for i in range(0, len(rows), 4096)]
        return out

    def read(self, part: Range) -> Iterator:
        a = archive.Archive(self.path)
        if self.table == "header":
            yield from ((k, str(v)) for k, v in asdict(a.header).items())
            return
        if self.table == "metadata":
            yield from ((k, v if isinstance(v, str) else json.dumps(v)) for k, v in a.metadata().items())
            return
        rows = a.leaf(part.offset, part.length) if part.rows is None else np.frombuffer(part.rows, "<i8").reshape(-1, 4)
        if self.table == "entries":
            yield from map(tuple, rows.tolist())
            return
        for first, off, length, run in rows.tolist():
            ids = [i for i in range(first, first + run) if self.low <= i < self.high]
            if ids:
                data = a.file.read_at(length, a.header.data_offset + off)
                z, x, y = zip(*map(zxy_of, ids), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(ids, pa.int64()), pa.array([data] * len(ids), pa.binary())], ["z", "x", "y", "tile_id", "data"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoRaster)
    spark.dataSource.register(TileArchive)
