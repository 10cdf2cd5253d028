"""The tile archive's file format: header, directories, metadata; reading by byte ranges, writing from relations.

File: header (127 bytes) | root directory | metadata | leaf directories | tile data. Directories are gzipped columns of
varints: number of entries, id deltas, runs, lengths, offsets (0: right after the entry before, else offset + 1). An entry
with run 0 names a leaf. A run is one payload that several neighbouring ids share.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hilbert import tile_id_of, zoom_ids, zxy_of
from ..operators import layout

MAGIC, VERSION, HEADER_SIZE, BUDGET, FLAT, LEAF = b"PMTiles", 3, 127, 16384 - 127, 16384, 4096
#: Fixed values of the format: tile types by name.
TYPES = {"unknown": 0, "mvt": 1, "png": 2, "jpeg": 3, "webp": 4, "avif": 5}
_LAYOUT = "<7sB11Q6B4iB2i"


@dataclass(frozen=True)
class Header:
    root_offset: int = 0
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: int = 1
    internal_compression: int = 2
    tile_compression: int = 1
    tile_type: int = 0
    min_zoom: int = 0
    max_zoom: int = 0
    min_lon: float = -180.0
    min_lat: float = -85.0
    max_lon: float = 180.0
    max_lat: float = 85.0
    center_zoom: int = 0
    center_lon: float = 0.0
    center_lat: float = 0.0

    def pack(self) -> bytes:
        d = asdict(self)
        numbers = [round(float(np.float32(v)) * 1e7) if isinstance(v, float) else v for v in d.values()]
        return struct.pack(_LAYOUT, MAGIC, VERSION, *numbers)

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        if len(raw) < HEADER_SIZE or raw[:7] != MAGIC:
            raise ValueError("not a tile archive")
        if raw[7] != VERSION:
            raise ValueError(f"version {raw[7]} isn't supported")
        values = struct.unpack(_LAYOUT, raw[:HEADER_SIZE])[2:]
        kinds = [type(v) for v in asdict(cls()).values()]
        return cls(*(v / 1e7 if k is float else v for v, k in zip(values, kinds, strict=True)))


# ---- directories


def varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def read_varints(raw: bytes) -> np.ndarray:
    """All varints of a buffer at once."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    start = np.flatnonzero(np.append(True, last[:-1]))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), start)


Entry = tuple[int, int, int, int]  # tile id, offset, length, run


def pack_directory(entries: list[Entry]) -> bytes:
    ids, offsets, lengths, runs = (list(c) for c in zip(*entries, strict=True)) if entries else ([], [], [], [])
    deltas = [b - a for a, b in zip([0, *ids], ids, strict=False)]
    codes = [0 if i and offsets[i] == offsets[i - 1] + lengths[i - 1] else offsets[i] + 1 for i in range(len(ids))]
    return gzip.compress(varints([len(ids), *deltas, *runs, *lengths, *codes]), 9, mtime=0)


def unpack_directory(raw: bytes) -> np.ndarray:
    """Rows (id, offset, length, run)."""
    v = read_varints(gzip.decompress(raw))
    n = int(v[0])
    out = np.zeros((n, 4), np.int64)
    out[:, 0] = np.cumsum(v[1 : n + 1])
    out[:, 3], out[:, 2] = v[n + 1 : 2 * n + 1], v[2 * n + 1 : 3 * n + 1]
    codes = v[3 * n + 1 : 4 * n + 1]
    for i in range(n):
        out[i, 1] = out[i - 1, 1] + out[i - 1, 2] if i and codes[i] == 0 else codes[i] - 1
    return out


# ---- reading


def locate(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Archive:
    """An archive by byte ranges; nothing but the root directory is held."""

    def __init__(self, path: str):
        fs, name = locate(path)
        self.file = fs.open_input_file(name)
        self.header = Header.parse(self.file.read_at(HEADER_SIZE, 0))
        self.root = unpack_directory(self.file.read_at(self.header.root_length, self.header.root_offset))

    def metadata(self) -> dict:
        raw = self.file.read_at(self.header.metadata_length, self.header.metadata_offset)
        return json.loads(gzip.decompress(raw)) if raw else {}

    def leaf(self, offset: int, length: int) -> np.ndarray:
        return unpack_directory(self.file.read_at(length, self.header.leaf_offset + offset))

    def directories(self) -> list[tuple[int, int, np.ndarray | None, int, int]]:
        """(first id, id after the last or -1, rows of the root or None, offset, length of a leaf)."""
        flat = self.root[self.root[:, 3] > 0]
        out = [(int(flat[0, 0]), int((flat[:, 0] + flat[:, 3]).max()), flat, 0, 0)] if len(flat) else []
        leaves = self.root[self.root[:, 3] == 0]
        for i, (first, offset, length, _) in enumerate(leaves.tolist()):
            out.append((first, int(leaves[i + 1, 0]) if i + 1 < len(leaves) else -1, None, offset, length))
        return out

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        wanted, rows = tile_id_of(z, x, y), self.root
        for _ in range(4):
            i = int(np.searchsorted(rows[:, 0], wanted, "right")) - 1
            if i < 0:
                return None
            first, offset, length, run = rows[i].tolist()
            if run:
                return self.file.read_at(length, self.header.data_offset + offset) if wanted < first + run else None
            rows = self.leaf(offset, length)
        return None


# ---- writing


@dataclass(frozen=True)
class Info:
    tile_type: str = "png"
    name: str = "gridloom"
    kind: str = "baselayer"
    description: str = ""
    attribution: str = ""
    bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)
    min_zoom: int = 0
    max_zoom: int = 0

    def metadata(self) -> dict[str, str]:
        w, s, e, n = self.bounds
        out = {"name": self.name, "description": self.description, "format": self.tile_type, "type": self.kind, "minzoom": str(self.min_zoom), "maxzoom": str(self.max_zoom), "bounds": f"{w:.6f},{s:.6f},{e:.6f},{n:.6f}", "center": f"{(w + e) / 2:.6f},{(s + n) / 2:.6f},{(self.min_zoom + self.max_zoom) // 2}"}
        return out | ({"attribution": self.attribution} if self.attribution else {})


def write_archive(tiles: DataFrame, path: str, info: Info, scratch: str) -> Header:
    """Writes tiles (tile_id, data) as one file. Payloads are deduplicated, placed in id order and written in ranges by the
    tasks; the driver copies the ranges behind the directories, piece by piece. scratch: a folder that all machines share."""
    spark = tiles.sparkSession
    folder = f"{scratch.rstrip('/')}/archive-{uuid.uuid4().hex}"
    tiles.filter(F.length("data") > 0).select("tile_id", "data").write.parquet(f"{folder}/tiles")
    tiles = spark.read.parquet(f"{folder}/tiles")
    placed = layout.offsets(layout.payloads(tiles))
    placed.write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    addressed = tiles.count()
    contents, size = placed.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    runs = layout.runs(tiles.select("tile_id", F.sha2("data", 256).alias("sha")).join(placed.select("sha", "off", "len"), "sha").select("tile_id", "off", "len"))
    runs.write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    n = runs.count()

    payload = tiles.join(placed.select(F.col("first").alias("tile_id"), "off", "len"), "tile_id").select("off", "data")
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size >> 20) + 1))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = locate(folder)
        out = name = first = None
        written = 0
        for batch in batches:
            for off, data in zip(batch.column("off").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if out is None:
                    first, name = off, f"part-{off:020d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/{name}")
                out.write(data)
                written += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"off": [first], "size": [written], "name": [name]})

    fs, base = locate(folder)
    parts = payload.repartitionByRange(tasks, "off").sortWithinPartitions("off").mapInArrow(save, "off long, size long, name string").collect() if addressed else []
    parts = sorted(parts)

    if n <= FLAT:
        flat = [tuple(r) for r in runs.select("tile_id", "off", "len", "run").orderBy("tile_id").collect()]
        root, leaves = pack_directory(flat), []
    if n > FLAT or len(root) > BUDGET:
        root, leaves = _leaves(runs, n)
    metadata = gzip.compress(json.dumps(info.metadata()).encode(), 9, mtime=0)
    w, s, e, north = info.bounds
    at = HEADER_SIZE + len(root)
    leaf_size = sum(len(x) for x in leaves)
    header = Header(
        HEADER_SIZE, len(root), at, len(metadata), at + len(metadata), leaf_size, at + len(metadata) + leaf_size, int(size), addressed, n, int(contents), 1, 2, 1,
        TYPES.get({"terrarium": "png", "jpg": "jpeg"}.get(info.tile_type, info.tile_type), 0), info.min_zoom, info.max_zoom, float(w), float(s), float(e), float(north),
        (info.min_zoom + info.max_zoom) // 2, float((w + e) / 2), float((s + north) / 2),
    )
    to_fs, name = locate(path)
    draft = f"{name}.{uuid.uuid4().hex}"
    with to_fs.open_output_stream(draft) as out:
        for piece in (header.pack(), root, metadata, *leaves):
            out.write(piece)
        for part in parts:
            with fs.open_input_stream(f"{base}/{part.name}") as f:
                while piece := f.read(1 << 22):
                    out.write(piece)
    to_fs.move(draft, name)
    fs.delete_dir(base)
    return header


def _leaves(runs: DataFrame, n: int) -> tuple[bytes, list[bytes]]:
    """Root and leaves; leaves grow by a fifth until the root fits its budget. Leaves are packed by the tasks."""
    size = LEAF
    while True:

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                for leaf, *entry in zip(*(batch.column(c).to_pylist() for c in ("leaf", "tile_id", "off", "len", "run")), strict=True):
                    if leaf != now and held:
                        yield pa.RecordBatch.from_pydict({"leaf": [now], "first": [held[0][0]], "raw": [pack_directory(held)]})
                        held = []
                    now = leaf
                    held.append(tuple(entry))
            if held:
                yield pa.RecordBatch.from_pydict({"leaf": [now], "first": [held[0][0]], "raw": [pack_directory(held)]})

        tasks = max(1, min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // size + 1))
        packed = layout.leaves(runs, size).repartition(tasks, "leaf").sortWithinPartitions("leaf", "tile_id").select("leaf", "tile_id", "off", "len", "run").mapInArrow(pack, "leaf long, first long, raw binary")
        rows = sorted(packed.collect())  # directories only: n / size rows
        root, at = [], 0
        for _, first, raw in rows:
            root.append((first, at, len(raw), 0))
            at += len(raw)
        data = pack_directory(root)
        if len(data) <= BUDGET:
            return data, [bytes(raw) for _, _, raw in rows]
        size = size * 6 // 5


# ---- changes to an archive's head


def patch_archive(path: str, out: str | None = None, put: dict | None = None, remove: list[str] | None = None, metadata: dict | None = None, rebuild: bool = False, **fields) -> Header:
    """Overlays header fields, and changes metadata (replace, then put, then remove). Without changes to metadata or
    directories, and without `out`, only the header's bytes are written; tile bytes are copied as they are. rebuild packs the
    directories anew, runs and all."""
    a = Archive(path)
    header = replace(a.header, **fields)
    fs, name = locate(path)
    if not (out or put or remove or metadata is not None or rebuild):
        local = open(name, "r+b")  # noqa: SIM115
        with local:
            local.write(header.pack())
        return header
    words = dict(a.metadata() if metadata is None else metadata) | {k: _typed(v) for k, v in (put or {}).items()}
    for key in remove or []:
        words.pop(key, None)
    packed = gzip.compress(json.dumps(words).encode(), 9, mtime=0)
    root = a.file.read_at(header.root_length, header.root_offset)
    leaves = a.file.read_at(header.leaf_length, header.leaf_offset)
    if rebuild:
        rows = np.concatenate([rows if rows is not None else a.leaf(off, length) for _, _, rows, off, length in a.directories()] or [np.zeros((0, 4), np.int64)])
        entries = [tuple(r) for r in rows[np.argsort(rows[:, 0])].tolist()]
        root, leaves, size = pack_directory(entries), b"", LEAF
        while len(entries) > FLAT or len(root) > BUDGET:
            own = [pack_directory(entries[i : i + size]) for i in range(0, len(entries), size)]
            starts = np.cumsum([0, *map(len, own)]).tolist()
            root, leaves = pack_directory([(entries[i * size][0], starts[i], len(x), 0) for i, x in enumerate(own)]), b"".join(own)
            if len(root) <= BUDGET:
                break
            size = size * 6 // 5
        header = replace(header, entries=len(entries))
    at = HEADER_SIZE + len(root)
    header = replace(header, root_offset=HEADER_SIZE, root_length=len(root), metadata_offset=at, metadata_length=len(packed), leaf_offset=at + len(packed), leaf_length=len(leaves), data_offset=at + len(packed) + len(leaves))
    to_fs, target = locate(out or path)
    draft = f"{target}.{uuid.uuid4().hex}"
    with to_fs.open_output_stream(draft) as f:
        for piece in (header.pack(), root, packed, leaves):
            f.write(piece)
        for i in range(0, a.header.data_length, 1 << 22):
            f.write(a.file.read_at(min(1 << 22, a.header.data_length - i), a.header.data_offset + i))
    to_fs.move(draft, target)
    return header


def _typed(v):
    if not isinstance(v, str):
        return v
    try:
        return json.loads(v)
    except ValueError:
        return v


def check_archive(spark: SparkSession, path: str) -> DataFrame:
    """check, ok, detail: sections follow each other, sizes fit, the root keeps its budget, entries are in order and inside the data."""
    a = Archive(path)
    h, rows = a.header, []
    size = a.file.size()

    def add(name: str, ok: bool, detail: str) -> None:
        rows.append((name, bool(ok), detail))

    add("root_after_header", h.root_offset == HEADER_SIZE, f"{h.root_offset}")
    add("metadata_after_root", h.metadata_offset == h.root_offset + h.root_length, f"{h.metadata_offset}")
    add("leaves_after_metadata", h.leaf_offset == h.metadata_offset + h.metadata_length, f"{h.leaf_offset}")
    add("data_after_leaves", h.data_offset == h.leaf_offset + h.leaf_length, f"{h.data_offset}")
    add("file_ends_with_data", size == h.data_offset + h.data_length, f"{size - h.data_offset - h.data_length} bytes more")
    add("root_within_16_kib", h.root_offset + h.root_length <= 16384, f"{h.root_offset + h.root_length}")
    seen, last, inside, total = 0, -1, True, 0
    for _, _, flat, off, length in a.directories():
        part = flat if flat is not None else a.leaf(off, length)
        inside &= bool((part[:, 1] + part[:, 2] <= h.data_length).all() and (np.diff(part[:, 0]) >= part[:-1, 3]).all() and (not len(part) or part[0, 0] > last))
        last = int((part[:, 0] + part[:, 3]).max()) - 1 if len(part) else last
        seen, total = seen + len(part), total + int(part[:, 3].sum())
    add("entries_in_order_and_inside", inside, f"{seen} entries")
    add("entry_count", seen == h.entries, f"{seen} of {h.entries}")
    add("addressed_count", total == h.addressed, f"{total} of {h.addressed}")
    add("zooms", h.min_zoom <= h.max_zoom and (last < 0 or zxy_of(last)[0] <= h.max_zoom), f"{h.min_zoom}..{h.max_zoom}")
    add("bounds", h.min_lon <= h.max_lon and h.min_lat <= h.max_lat, f"{h.min_lon},{h.min_lat},{h.max_lon},{h.max_lat}")
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


__all__ = ["Archive", "Header", "Info", "check_archive", "pack_directory", "patch_archive", "read_varints", "unpack_directory", "varints", "write_archive", "zoom_ids"]
