"""Shared plumbing: table reading, intermediate tables in the cluster's shared folder, Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches passed to Python hold at most this many rows, so that a batch of very long texts still fits a worker.
ROWS_PER_BATCH = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches (texts can be very long); shuffle files go when the query that wrote them ends."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    for key in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled"):
        try:
            spark.conf.set(key, "true")
        except Exception:  # noqa: BLE001  a Spark version without this setting keeps the files a little longer
            continue


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where the setting is absent, as in tests."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """Intermediate Parquet tables of one run of an operator, in the shared folder.

    A written table cuts the lineage: a lost executor costs only the stage that was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows; where there are more, those whose key's hash lies below a cut that leaves somewhat fewer than
    that, so that the same rows come each time and tasks send on nothing else."""
    n = df.count()
    if n > rows:
        df = df.filter(F.xxhash64(key) < F.lit(int(max(0.5, rows - 4 * rows**0.5) / n * 2**64) - 2**63))
    return df.limit(rows)


def attach(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, how: str, least: int = 64, most: int = 1 << 16) -> DataFrame:
    """Joins `right`, unique in `on`, to left's `rows` rows; its column `weight` says how many rows of left share each key.
    Those with many are broadcast (fewer than `most`, as their weights add up to `rows`), so that no task gets all rows of one
    key; the others meet by shuffle."""
    heavy = F.col(weight) > max(least, rows // most)
    hot = F.broadcast(right.filter(heavy).drop(weight))
    cold = left.join(F.broadcast(right.filter(heavy).select(*on)), on, "left_anti").join(right.filter(~heavy).drop(weight), on, how)
    return left.join(hot, on).unionByName(cold)


def apart(documents: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose doc_id names one text. Where ids of the table are shared by different texts, doc_id becomes the number of
    the pair (doc_id, text) in order; then the second result (number, own_id) tells the ids behind them. Null ids stay null."""
    text = F.coalesce("text", F.lit(""))
    both = {"text_hash": F.xxhash64(text), "text_crc": F.crc32(text.cast("binary"))}
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", *(c.alias(n) for n, c in both.items()))
    if known.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low <> high").isEmpty():
        return documents, None
    keys = ["doc_id", *both]
    pairs = known.groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = work.keep(pairs.repartitionByRange(partitions(documents.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()), "numbers")
    columns = documents.columns
    clean = documents.select(F.struct(*columns).alias("whole"), "doc_id", *(c.alias(n) for n, c in both.items()))
    numbered = attach(clean, pairs, keys, "n", pairs.agg(F.sum("n")).first()[0], "left")
    return numbered.select(*(F.col("number").alias(c) if c == "doc_id" else F.col(f"whole.{c}").alias(c) for c in columns)), pairs.select("number", F.col("doc_id").alias("own_id"))


def own_ids(documents: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """Puts the ids back in the place of apart()'s numbers."""
    if ids is None:
        return documents
    names = documents.columns
    for c in columns:
        whole = documents.select(F.struct(*names).alias("whole"), F.col(c).alias("number"))
        documents = whole.join(ids, "number", "left").select(*(F.col("own_id").alias(n) if n == c else F.col(f"whole.{n}").alias(n) for n in names))
    return documents


def lean(run):
    """A pass over Arrow batches that gives Arrow's free memory back at its end: idle workers stay for the next stages."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return own


def crc_remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# ---- Arrow strings as bytes -------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, and where each begins (one entry more than rows). Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) with about `most` bytes each; a longer text stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... for each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
