"""Incremental ingest, an extension: new raster files of a folder as rows, once each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import connectors


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, size and time of the .tif and .tiff files that arrive below a folder; contents aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.lower("path").rlike(r"\.tiff?$")).select("path", "length", "modificationTime")


def describe_batches(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Appends what each new raster is (a row of "georaster") to a Parquet table; a batch that is tried again is written again
    under the same number."""
    connectors.register(spark)

    def batch(df: DataFrame, number: int) -> None:
        paths = [re.sub("^file:/+", "/", r.path) for r in df.select("path").collect()]  # names of one batch
        if paths:
            about = spark.read.format("georaster").option("path", ",".join(paths)).load()
            about.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
