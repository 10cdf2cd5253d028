"""Small reports over tiles and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elevation_summary(samples: DataFrame, value: str = "elev") -> DataFrame:
    """n, missing (null or NaN), least and greatest of the rest."""
    v = F.col(value).cast("double")
    sound = v.isNotNull() & ~F.isnan(v)
    return samples.agg(F.count("*").alias("n"), F.count_if(~sound).alias("missing"), F.min(F.when(sound, v)).alias("least"), F.max(F.when(sound, v)).alias("greatest"))


def tile_statistics(tiles: DataFrame) -> DataFrame:
    """Tiles, those that are uniform, and payload bytes by level; tiles: z, form, data."""
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), F.count_if(F.col("form") == "uniform").alias("uniform"), F.sum(F.length("data")).alias("bytes"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields (field, value) that differ between two headers or metadata tables; null where one has none."""
    key, value = a.columns
    left, right = a.withColumnRenamed(value, "before"), b.toDF(key, "after")
    return left.join(right, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after")
