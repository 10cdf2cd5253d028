"""Packing documents into sequences: cutting-stock patterns over a histogram of piece lengths.

Each document's ids are cut into full sequences and one rest. The histogram of lengths, in classes of `grain` ids, is
all that reaches the driver (2048 / grain + 1 counts at most, whatever the corpus); there a linear program chooses
patterns of classes that fill a sequence, and its rounded solution says how many copies of each pattern to make. Every
piece gets its rank within its class; class and rank name a pattern, a copy and a slot by arithmetic, and a running
sum of lengths within each sequence gives the offset. Ranks are counted within salted parts of a class and shifted by
the parts before, so a length that a third of all pieces share is spread over all tasks.

Edge cases: a null text counts as empty; an empty one has the end id alone; repeated rows are packed each for itself;
other columns are left out of the result of `pack` and kept by `pack_documents` where their names don't clash; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, cutting_stock, tokens

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Shape:
    tokens: int = 2048
    grain: int = 8
    end_id: int = 1


def pieces(documents: DataFrame, path: str, shape: Shape = Shape(), with_ids: bool = False) -> DataFrame:
    """Full pieces and the rest of each document; one narrow pass. with_ids: the ids too, as little-endian u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            raw, at = common.utf8(batch.column("text"))
            doc = batch.column("doc_id")
            for lo, hi in common.slices(at, 1 << 21):
                ids, before = enc.encode(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows, start, length, crc, total, blobs = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[before[i] : before[i + 1]], np.array(shape.end_id, enc.dtype)).astype("<u4")
                    for s in range(0, len(own), shape.tokens):
                        part = own[s : s + shape.tokens].tobytes()
                        rows.append(lo + i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(own))
                        blobs.append(part)
                columns = [doc.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids)

    common.tune(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)


def assign(cut: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = cut.sparkSession
    parts = common.partitions(spark)
    cut = cut.withColumn("cls", F.ceil(F.col("length") / shape.grain).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("cls", "salt").agg(F.count("*").alias("n"))
    histogram = dict(cut.groupBy("cls").agg(F.count("*").alias("n")).collect())  # at most tokens / grain rows
    sizes = np.array(sorted(histogram), np.int64)
    capacity = shape.tokens // shape.grain
    patterns, uses = cutting_stock.plan(sizes, np.array([histogram[int(s)] for s in sizes], np.int64), capacity)
    first = np.concatenate([[0], np.cumsum(uses)])  # sequence of a pattern's first copy
    slot0 = np.cumsum(patterns, axis=1) - patterns if len(patterns) else patterns
    table: dict[int, tuple] = {}
    for i, s in enumerate(sizes.tolist()):
        rows = np.flatnonzero(patterns[:, i])
        each = patterns[rows, i]
        ends = np.cumsum(each * uses[rows])
        table[s] = (ends, ends - each * uses[rows], each, first[rows], slot0[rows, i])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls).tolist():
                mine = np.flatnonzero(cls == c)
                ends, starts, each, base, slots = table[c]
                p = np.searchsorted(ends, rank[mine], "right")
                r = rank[mine] - starts[p]
                sequence[mine], slot[mine] = base[p] + r // each[p], slots[p] + r % each[p]
            keep = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    names = [c for c in cut.columns if c not in ("cls", "salt")]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("cls").orderBy("salt")) - F.col("n")).drop("n")
    ranked = cut.withColumn("own", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32"))).join(before, ["cls", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    placed = ranked.select(*names, "cls", "rank").mapInArrow(place, f"{kind}, sequence_id long, slot long")
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long")).drop("slot")


def pack(documents: DataFrame, path: str, shape: Shape = Shape(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset. The ids (little-endian u32)
    join the placed pieces at the end, by the piece's number, so that only one shuffle carries them."""
    work = common.Workspace(documents.sparkSession, "packing")
    if not with_ids:
        return assign(work.keep(pieces(documents, path, shape), "pieces"), shape)
    cut = work.keep(pieces(documents, path, shape, True).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = assign(cut.drop("ids"), shape)
    return placed.join(cut.select("piece", "ids"), "piece").select(*(c.split()[0] for c in PIECE.split(", ")), "ids", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), tokens.byte_bpe_path())
