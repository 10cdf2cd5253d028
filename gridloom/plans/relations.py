"""Rasters, points, sources, band vectors and payloads derived from the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 512
ZOOM = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, gx, gy, r, g, b, a, cls, elev: one pixel an event."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return e.select(
        F.lit(ZOOM).alias("z"),
        (F.col("event_id") % WIDTH).alias("gx"),
        F.floor(F.col("event_id") / WIDTH).alias("gy"),
        (F.floor("value") % 256).cast("int").alias("r"),
        (F.col("user_id") * 7 % 256).cast("int").alias("g"),
        (F.col("event_id") * 13 % 256).cast("int").alias("b"),
        F.when(error, 0).otherwise(255).alias("a"),
        (F.col("user_id") % 5).cast("int").alias("cls"),
        F.when(~error, F.col("value")).alias("elev"),
    )


RASTER = """raster AS (
  SELECT 10 AS z, event_id % 512 AS gx, event_id // 512 AS gy, CAST(floor(value) AS INTEGER) % 256 AS r,
    CAST(user_id * 7 % 256 AS INTEGER) AS g, CAST(event_id * 13 % 256 AS INTEGER) AS b,
    CASE WHEN event_type = 'error' THEN 0 ELSE 255 END AS a, CAST(user_id % 5 AS INTEGER) AS cls,
    CASE WHEN event_type <> 'error' THEN value END AS elev
  FROM events)"""


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("z", "gx", "gy", "r", "g", "b", "a")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", ((F.col("event_id") * 7919 % 360000) / 1000.0 - 180).alias("lon"), ((F.col("event_id") * 104729 + F.col("user_id")) % 170000 / 1000.0 - 85).alias("lat"))


POINTS = """points AS (
  SELECT event_id, event_type, CAST(event_id * 7919 % 360000 AS DOUBLE) / 1000 - 180 AS lon,
    CAST((event_id * 104729 + user_id) % 170000 AS DOUBLE) / 1000 - 85 AS lat FROM events)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x, y = (k * 37 % 3200) / 10.0 - 170, (k * 53 % 1400) / 10.0 - 70
    return s.select(k.alias("source_id"), F.lit(4326).alias("epsg"), x.alias("min_x"), y.alias("min_y"), (x + 4 + k % 7).alias("max_x"), (y + 3 + k % 5).alias("max_y"))


SOURCES = """sources AS (
  SELECT s_suppkey AS source_id, 4326 AS epsg, x AS min_x, y AS min_y, x + 4 + s_suppkey % 7 AS max_x, y + 3 + s_suppkey % 5 AS max_y
  FROM (SELECT s_suppkey, CAST(s_suppkey * 37 % 3200 AS DOUBLE) / 10 - 170 AS x, CAST(s_suppkey * 53 % 1400 AS DOUBLE) / 10 - 70 AS y FROM supplier))"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and four 16-bit bands; every seventh row holds nothing but 0."""
    v = table(spark, sf_dir, "embeddings")
    each = F.transform(F.slice("embedding", 1, 4), lambda c: F.floor((c.cast("double") + 1) * 32767).cast("int"))
    return v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.array_repeat(F.lit(0), 4)).otherwise(each).alias("bands"))


BANDS = """bands AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN [0, 0, 0, 0]
    ELSE list_transform(embedding[1:4], lambda c: CAST(floor((CAST(c AS DOUBLE) + 1) * 32767) AS INTEGER)) END AS bands FROM embeddings)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id and data: a document's bytes as a tile; gaps in the ids, and neighbours with the same bytes."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 < 4, F.concat(F.lit("tile "), F.floor(F.col("doc_id") / 10).cast("string"))).otherwise(F.col("text"))
    return d.select((F.col("doc_id") + F.floor(F.col("doc_id") / 50) * 3).alias("tile_id"), text.cast("binary").alias("data"))


PAYLOADS = """payloads AS (
  SELECT doc_id + doc_id // 50 * 3 AS tile_id,
    encode(CASE WHEN doc_id % 10 < 4 THEN 'tile ' || CAST(doc_id // 10 AS VARCHAR) ELSE text END) AS data FROM documents)"""
