"""TIFF and BigTIFF rasters: directories, georeference, blocks. Plain Python and NumPy; runs on executors and the driver.

Every directory is a level, but for masks. Strips are read as rows of blocks as wide as the picture. Samples of several
planes are not supported.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pyarrow.fs

from . import jpeg

#: Fixed values of the format. Kinds of numbers: code, struct letter, bytes.
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags: name, number.
TAGS = {
    "subfile": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278,
    "strip_sizes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_sizes": 325, "sample_format": 339, "jpeg_tables": 347,
    "pixel_scale": 33550, "tie_point": 33922, "geo_keys": 34735, "metadata": 42112, "nodata": 42113,
}
COMPRESSIONS = {1: "none", 5: "lzw", 7: "jpeg", 8: "deflate", 32946: "deflate"}


class BadRaster(ValueError):
    pass


@dataclass
class Level:
    """One directory."""

    width: int
    height: int
    samples: int
    bits: int
    floating: bool
    compression: str
    predictor: int
    block_width: int
    block_height: int
    offsets: list[int]
    sizes: list[int]
    strips: bool
    photometric: int = 1
    tables: bytes = b""

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{'f' if self.floating else 'u'}{self.bits // 8}")


@dataclass
class Raster:
    path: str
    little: bool
    levels: list[Level]
    epsg: int | None = None
    origin: tuple[float, float] | None = None
    pixel: tuple[float, float] | None = None
    nodata: str | None = None
    items: dict[str, str] = field(default_factory=dict)
    band_items: dict[int, dict[str, str]] = field(default_factory=dict)

    def box(self) -> tuple[float, float, float, float]:
        (x, y), (px, py), top = self.origin, self.pixel, self.levels[0]
        return x, y - py * top.height, x + px * top.width, y


def open_file(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(name)


def _directory(f, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Values by tag, and the place of the next directory."""
    n_size, e_size, p = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(order + ("Q" if big else "H"), f.read_at(n_size, at))[0]
    raw = f.read_at(n * e_size + struct.calcsize(p), at + n_size)
    values = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + p, raw, i * e_size)
        if kind not in KINDS:
            continue
        size = struct.calcsize("=" + KINDS[kind]) * count
        inline = struct.calcsize(p)
        start = i * e_size + e_size - inline
        data = raw[start : start + size] if size <= inline else f.read_at(size, struct.unpack_from(order + p, raw, start)[0])
        if len(data) < size:
            raise BadRaster("values beyond the end of the file")
        if kind == 2:
            values[tag] = (bytes(data).split(b"\0")[0].decode("utf-8", "replace"),)
        else:
            values[tag] = struct.unpack(order + KINDS[kind] * count, data)
    return values, struct.unpack_from(order + p, raw, n * e_size)[0]


def _level(v: dict[int, tuple]) -> Level:
    def get(name: str, default=None):
        return v.get(TAGS[name], (default,))[0]

    samples, bits = get("samples", 1), get("bits", 8)
    compression = COMPRESSIONS.get(get("compression", 1))
    if compression is None:
        raise BadRaster(f"compression {get('compression')} isn't supported")
    if samples > 1 and get("planar", 1) == 2:
        raise BadRaster("separate planes aren't supported")
    tiled = TAGS["tile_offsets"] in v
    rows = min(get("rows_per_strip", get("height")), get("height"))
    floating = get("sample_format", 1) == 3
    if bits not in (8, 16, 32, 64) or bits in (32, 64) and not floating:
        raise BadRaster(f"{bits}-bit samples aren't supported")
    return Level(
        get("width"), get("height"), samples, bits, floating, compression, get("predictor", 1),
        get("tile_width") if tiled else get("width"), get("tile_height") if tiled else rows,
        list(v[TAGS["tile_offsets" if tiled else "strip_offsets"]]), list(v[TAGS["tile_sizes" if tiled else "strip_sizes"]]), not tiled, get("photometric", 1), bytes(v.get(TAGS["jpeg_tables"], ())),
    )


def _epsg(keys: tuple) -> int | None:
    """The first code given for a projected (3072) or geographic (2048) system."""
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (3072, 2048) and keys[i + 1] == 0 and 0 < keys[i + 3] < 32767:
            return keys[i + 3]
    return None


def parse_items(xml: str) -> tuple[dict[str, str], dict[int, dict[str, str]]]:
    """Items of the whole file, and of each band (from 0). Text that isn't XML has none."""
    whole: dict[str, str] = {}
    bands: dict[int, dict[str, str]] = {}
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return whole, bands
    for item in root.iter("Item"):
        target = whole if item.get("sample") is None else bands.setdefault(int(item.get("sample")), {})
        target[item.get("name", "").upper() if item.get("sample") is not None else item.get("name", "")] = item.text or ""
    return whole, bands


def parse_world(text: str) -> tuple[tuple[float, float], tuple[float, float]]:
    """Origin (upper left corner) and pixel size of a world file; rotated ones are refused."""
    numbers = [float(x) for x in text.split()[:6]]
    if len(numbers) < 6:
        raise BadRaster("a world file has six numbers")
    a, d, b, e, c, f = numbers
    if d or b:
        raise BadRaster("rotated rasters aren't supported")
    return (c - a / 2, f - e / 2), (abs(a), abs(e))


def infer_epsg(box: tuple[float, float, float, float]) -> int:
    x0, y0, x1, y1 = box
    if x0 >= -180 and x1 <= 180 and y0 >= -90 and y1 <= 90:
        return 4326
    if x0 >= 2400000 and x1 <= 2900000 and y0 >= 1000000 and y1 <= 1400000:
        return 2056
    return 3857 if max(map(abs, box)) <= 20037508.342789244 * 1.01 else 4326


SIDECARS = (".tfw", ".TFW", ".tifw", ".TIFW")


def sidecar(path: str) -> str | None:
    stem = path.rsplit(".", 1)[0]
    fs, _ = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    for end in SIDECARS:
        name = pyarrow.fs.FileSystem.from_uri(f"{stem}{end}" if "://" in path else f"file://{stem}{end}")[1]
        if fs.get_file_info(name).type == pyarrow.fs.FileType.File:
            with fs.open_input_file(name) as f:
                return f.read().decode()
    return None


def read_raster(path: str) -> Raster:
    """All directories and the georeference: from tags, else from a world file beside; the reference system from its keys, else by the coordinates."""
    with open_file(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(order + "H", head[2:4])[0] if order else None
        if magic not in (42, 43):
            raise BadRaster(f"{path}: not a TIFF file")
        big = magic == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        levels, first, seen = [], None, set()
        while at and at not in seen:
            seen.add(at)
            values, at = _directory(f, at, order, big)
            if values.get(TAGS["subfile"], (0,))[0] & 4:
                continue  # a mask
            levels.append(_level(values))
            first = first or values
    if not levels:
        raise BadRaster(f"{path}: no picture")
    raster = Raster(path, order == "<", levels)
    if TAGS["pixel_scale"] in first and TAGS["tie_point"] in first:
        (sx, sy), (i, j, _, x, y) = first[TAGS["pixel_scale"]][:2], first[TAGS["tie_point"]][:5]
        raster.origin, raster.pixel = (x - i * sx, y + j * sy), (sx, sy)
    elif world := sidecar(path):
        raster.origin, raster.pixel = parse_world(world)
    raster.epsg = _epsg(first.get(TAGS["geo_keys"], ()))
    if raster.epsg is None and raster.origin:
        raster.epsg = infer_epsg(raster.box())
    raster.nodata = first[TAGS["nodata"]][0].strip() if TAGS["nodata"] in first else None
    if TAGS["metadata"] in first:
        raster.items, raster.band_items = parse_items(first[TAGS["metadata"]][0])
    return raster


# ---- blocks


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: highest bit first, 9 to 12 bits, 256 clears, 257 ends; codes widen one early. A cut stream gives what it holds."""
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    last = None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = list(fresh), 9, None
            if code == 256:
                continue
        if last is None:
            entry = table[code] if code < len(table) else b""
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise BadRaster("broken LZW data")
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def inflate(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return zlib.decompressobj(-15).decompress(data)


def undo_predictor(block: np.ndarray, raw: bytes, level: Level, little: bool, rows: int) -> np.ndarray:
    if level.predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if level.predictor == 3:  # bytes of all samples of a row, highest first, as differences
        size = level.bits // 8
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        shuffled = planes.reshape(rows, size, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(shuffled).view(f">f{size}").reshape(rows, level.block_width, level.samples).astype(level.dtype)
    return block


def read_block(f, level: Level, little: bool, col: int, row: int) -> np.ndarray | None:
    """(rows, columns, samples) of one block; None for one that isn't stored."""
    i = row * level.across + col
    if not level.sizes[i]:
        return None
    raw = bytes(f.read_at(level.sizes[i], level.offsets[i]))
    if level.compression == "deflate":
        raw = inflate(raw)
    elif level.compression == "lzw":
        raw = lzw(raw)
    elif level.compression == "jpeg":
        stream = jpeg.splice(level.tables, raw)
        if level.photometric == 2 and b"Adobe" not in raw:  # stored as red, green and blue
            return np.stack(jpeg.decode_planes(stream)[0], -1).astype(np.uint8)
        return jpeg.decode_samples(stream)
    rows = min(level.block_height, level.height - row * level.block_height) if level.strips else level.block_height
    need = rows * level.block_width * level.samples * level.bits // 8
    raw = raw[:need].ljust(need, b"\0")
    block = np.frombuffer(raw, level.dtype.newbyteorder("<" if little else ">")).reshape(rows, level.block_width, level.samples).astype(level.dtype)
    return undo_predictor(block, raw, level, little, rows)


def read_window(f, raster: Raster, level: int, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Samples [y0, y1) x [x0, x1) of a level, from the blocks that it touches; 0 where a block isn't stored."""
    lv = raster.levels[level]
    out = np.zeros((y1 - y0, x1 - x0, lv.samples), lv.dtype)
    for row in range(y0 // lv.block_height, -(-y1 // lv.block_height)):
        for col in range(x0 // lv.block_width, -(-x1 // lv.block_width)):
            block = read_block(f, lv, raster.little, col, row)
            if block is None:
                continue
            bx, by = col * lv.block_width, row * lv.block_height
            ax, ay, zx, zy = max(x0, bx), max(y0, by), min(x1, bx + block.shape[1]), min(y1, by + block.shape[0])
            if ax < zx and ay < zy:
                out[ay - y0 : zy - y0, ax - x0 : zx - x0] = block[ay - by : zy - by, ax - bx : zx - bx]
    return out


def write_tiff(path: str, pixels: np.ndarray, origin: tuple[float, float], pixel: float, epsg: int = 4326, tile: int = 256, compression: str = "none", nodata: str | None = None, xml: str | None = None) -> None:
    """A tiled, little-endian raster with one directory; for tests and small exports."""
    h, w, n = pixels.shape
    across, down = -(-w // tile), -(-h // tile)
    padded = np.zeros((down * tile, across * tile, n), pixels.dtype)
    padded[:h, :w] = pixels
    blocks = [np.ascontiguousarray(padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]).tobytes() for r in range(down) for c in range(across)]
    if compression == "deflate":
        blocks = [zlib.compress(b, 6) for b in blocks]
    bits = pixels.dtype.itemsize * 8
    entries: list[tuple[int, int, list]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * n), (259, 3, [{"none": 1, "deflate": 8}[compression]]), (262, 3, [2 if n >= 3 else 1]), (277, 3, [n]), (322, 4, [tile]), (323, 4, [tile]),
        (324, 4, [0] * len(blocks)), (325, 4, [len(b) for b in blocks]), (339, 3, [3 if pixels.dtype.kind == "f" else 1] * n), (33550, 12, [pixel, pixel, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]),
        (34735, 3, [1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]),
    ]
    for tag, words in ((42112, xml), (42113, nodata)):
        if words is not None:
            entries.append((tag, 2, [words.encode() + b"\0"]))
    at = 8 + 2 + 12 * len(entries) + 4
    places, extra = {}, bytearray()
    for tag, kind, values in entries:
        data = values[0] if kind == 2 else struct.pack("<" + KINDS[kind] * len(values), *values)
        if len(data) > 4:
            places[tag] = at + len(extra)
            extra += data
    data_at = at + len(extra)
    starts = [data_at + sum(len(b) for b in blocks[:i]) for i in range(len(blocks))]
    packed = struct.pack(f"<{len(starts)}I", *starts)
    if 324 in places:
        extra[places[324] - at : places[324] - at + len(packed)] = packed
    body = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(entries)))
    for tag, kind, values in entries:
        data = values[0] if kind == 2 else struct.pack("<" + KINDS[kind] * len(values), *values)
        if tag == 324:
            data = packed
        count = len(data) if kind == 2 else len(values)
        body += struct.pack("<HHI", tag, kind, count) + (struct.pack("<I", places[tag]) if len(data) > 4 else data.ljust(4, b"\0"))
    body += struct.pack("<I", 0) + extra + b"".join(blocks)
    with open(path, "wb") as f:
        f.write(body)
