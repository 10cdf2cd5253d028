"""Token-id output: one zstandard dictionary for all shards, one frame per document.

Shard file, little endian:
    magic "GLTK" | version u32 | dictionary hash u64 | id width u32 | frames, one per document, in ascending doc_id |
    footer (zstandard): doc_id i64[n], has_id u8[n], frame end u64[n], ids u32[n] | footer size u64 | documents u64 | magic
A document's ids can be read alone: footer, then one frame. The dictionary lies beside the shards in `dictionary`;
the manifest (Parquet) names each shard, its place in the order, its documents and ids and the ids before it.

Steps: fit the dictionary on a bounded sample (`sample_documents` and `stretches`, by hash; it affects size only); encode and
compress in a narrow pass; deal the frames by ranges of doc_id, found from the id column alone, so that no text is
shuffled; each task streams its range into a file of its own name; the manifest takes only the files of tasks that
succeeded, so a lost executor or a second attempt leaves at most a file that no reader knows.

Edge cases: null text counts as empty; an empty text has the end id alone; equal doc_ids are ordered by the crc32 of
their ids; a null doc_id sorts first; other columns aren't read; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, VERSION = b"GLTK", 1
HEAD, TAIL = "<4sIQI", "<QQ4s"
HEAD_SIZE, TAIL_SIZE = struct.calcsize(HEAD), struct.calcsize(TAIL)


@dataclass(frozen=True)
class Format:
    end_id: int = 2
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_documents: int = 1000
    stretches: int = 8  # of a sampled document
    stretch_ids: int = 256


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _fit(documents: DataFrame, path: str, form: Format) -> bytes:
    """A dictionary trained on ids of about `sample_documents` documents, taken by hash: `stretches` of each, evenly spread
    over all of its ids. Where that is too little for zstandard's training, the ids themselves are the dictionary."""
    sample = common.hash_sample(documents, "doc_id", form.sample_documents).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            raw, at = common.utf8(batch.column("text"))
            for lo, hi in common.slices(at, 1 << 21):
                ids, before = enc.encode(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                parts = []
                for i in range(hi - lo):
                    own = ids[before[i] : before[i + 1]]
                    last = max(0, len(own) - form.stretch_ids)
                    n = min(form.stretches, -(-len(own) // form.stretch_ids))
                    parts += [own[x : x + form.stretch_ids].tobytes() for x in np.linspace(0, last, n).astype(int).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["ids"])

    parts = sorted(bytes(r[0]) for r in sample.mapInArrow(cut, "ids binary").collect())
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(form.dictionary_bytes, total // 8), parts, level=form.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[: form.dictionary_bytes]


def _bounds(documents: DataFrame, n: int) -> list[int]:
    """Ids that split the documents into n ranges of about equal number; one pass over the id column."""
    if n < 2:
        return []
    got = documents.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in got or []})


def write(documents: DataFrame, root: str, path: str, form: Format = Format(), shards: int | None = None) -> DataFrame:
    """Writes all documents under root and returns the manifest: shard, path, n_documents, n_tokens, start."""
    spark = documents.sparkSession
    common.tune(spark)
    documents = documents.select("doc_id", "text")
    n = shards or common.partitions(spark)
    dictionary = _fit(documents, path, form)
    digest = xxhash.xxh64_intdigest(dictionary)
    fs, folder = store(root)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary") as f:
        f.write(dictionary)
    bounds = _bounds(documents, n)
    shared = spark.sparkContext.broadcast(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        pack = zstandard.ZstdCompressor(level=form.level, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_dict_id=False)
        for batch in batches:
            raw, at = common.utf8(batch.column("text"))
            doc = batch.column("doc_id")
            for lo, hi in common.slices(at, 1 << 21):
                ids, before = enc.encode(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                frames, count, crc = [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[before[i] : before[i + 1]], np.array(form.end_id, enc.dtype))
                    frames.append(pack.compress(own.tobytes()))
                    count.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                own_ids = doc.slice(lo, hi - lo)
                shard = np.searchsorted(bounds, np.asarray(own_ids.fill_null(np.iinfo(np.int64).min)), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([own_ids, pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary()), pa.array(shard)], ["doc_id", "n_tokens", "crc", "frame", "shard"])

    width = tokens.encoder(path).dtype.itemsize
    frames = documents.mapInArrow(compress, "doc_id long, n_tokens long, crc long, frame binary, shard int")
    dealt = frames.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(F.asc_nulls_first("doc_id"), "crc", "n_tokens")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(root)
        out = name = None
        ids, ends, counts, shard, size = [], [], [], 0, HEAD_SIZE
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column("shard")[0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{folder}/{name}")
                out.write(struct.pack(HEAD, MAGIC, VERSION, digest, width))
            blobs = batch.column("frame").to_pylist()
            out.write(b"".join(blobs))
            lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
            ends.append(size + np.cumsum(lengths))
            size += int(lengths.sum())
            ids.append(batch.column("doc_id"))
            counts.append(batch.column("n_tokens").to_numpy())
        if out is None:
            return
        doc = pa.chunked_array(ids).combine_chunks()
        n_tokens = np.concatenate(counts)
        footer = zstandard.compress(np.asarray(doc.fill_null(0)).astype("<i8").tobytes() + np.asarray(doc.is_valid()).astype("u1").tobytes() + np.concatenate(ends).astype("<u8").tobytes() + n_tokens.astype("<u4").tobytes())
        out.write(footer + struct.pack(TAIL, len(footer), len(doc), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_documents": [len(doc)], "n_tokens": [int(n_tokens.sum())]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64())]))

    files = dealt.select("shard", "doc_id", "n_tokens", "frame").mapInArrow(save, "shard int, path string, n_documents long, n_tokens long")
    files.write.mode("overwrite").parquet(f"{root}/files")
    found = sorted(spark.read.parquet(f"{root}/files").collect())  # one row per shard file
    start, rows = 0, []
    for r in found:
        rows.append((r.shard, r.path, r.n_documents, r.n_tokens, start))
        start += r.n_tokens
    kind = "shard int, path string, n_documents long, n_tokens long, start long"
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(kind).parquet(f"{root}/manifest")


class ShardReader:
    """One shard, by position or by doc_id; reads the footer and the frames asked for."""

    def __init__(self, root: str, name: str, dictionary: bytes):
        fs, folder = store(root)
        self.file = fs.open_input_file(f"{folder}/{name}")
        magic, version, digest, width = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{name}: not a token shard")
        if digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{name}: written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        end = self.file.size()
        size, n, magic = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, end - TAIL_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{name}: cut short")
        raw = zstandard.decompress(self.file.read_at(size, end - TAIL_SIZE - size))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.valid = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.ends = np.concatenate([[HEAD_SIZE], np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)])
        self.counts = np.frombuffer(raw, "<u4", n, 17 * n).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int, j: int | None = None) -> Iterator[np.ndarray]:
        """Ids of the documents at positions i to j (i alone where j isn't given), with one read."""
        j = i + 1 if j is None else j
        raw = self.file.read_at(int(self.ends[j] - self.ends[i]), int(self.ends[i]))
        for k in range(i, j):
            frame = raw[self.ends[k] - self.ends[i] : self.ends[k + 1] - self.ends[i]]
            yield np.frombuffer(self.unpack.decompress(frame, max_output_size=int(self.counts[k]) * self.dtype.itemsize), self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        at = np.flatnonzero(self.valid & (self.doc_ids == doc_id))
        return [next(self.ids(int(i))) for i in at]


def read_index(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    fs, folder = store(root)
    with fs.open_input_file(f"{folder}/dictionary") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(root, row["path"], shared.value)
                before = row["start"] + np.cumsum(shard.counts) - shard.counts
                for lo in range(0, len(shard.counts), 256):
                    hi = min(lo + 256, len(shard.counts))
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in shard.ids(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[lo:hi], mask=~shard.valid[lo:hi]), pa.array(before[lo:hi]), pa.array(shard.counts[lo:hi]), pa.array(crc, pa.int64()), pa.array([row["shard"]] * (hi - lo), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write(common.read(spark, sf_dir, "documents"), root, tokens.byte_bpe_path())
    return read_index(spark, root, manifest)
