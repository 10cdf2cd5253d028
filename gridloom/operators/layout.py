"""Layout of a tile archive as relations: distinct payloads, offsets in id order, runs, leaves, deltas.

Running sums over all entries are done in two steps, within ranges of ids and over the ranges' totals, so no task sees
all entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: str, value: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds the sum of `value` over all rows before this one by `order` (a unique number)."""
    df = df.withColumn("_part", F.floor(F.col(order) / width).cast("long")).withColumn("_v", value)
    inner = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = df.groupBy("_part").agg(F.sum("_v").alias("_t"))
    # totals: a row for each range; split once more where ranges are many
    totals = totals.withColumn("_block", F.floor(F.col("_part") / width).cast("long"))
    blocks = totals.groupBy("_block").agg(F.sum("_t").alias("_b"))
    blocks = blocks.withColumn("_before_block", F.coalesce(F.sum("_b").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_b")
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_before", before).join(blocks, "_block").select("_part", (F.col("_before") + F.col("_before_block")).alias("_before"))
    return df.withColumn("_inner", inner).join(totals, "_part").withColumn(name, (F.col("_inner") + F.col("_before")).cast("long")).drop("_part", "_v", "_inner", "_before")


def payloads(tiles: DataFrame) -> DataFrame:
    """Distinct payloads: sha (of the bytes), len, first (the lowest tile id that has it), n (tiles that have it)."""
    data = tiles.filter(F.length("data") > 0)
    return data.groupBy(F.sha2("data", 256).alias("sha")).agg(F.max(F.length("data")).cast("long").alias("len"), F.min("tile_id").alias("first"), F.count("*").alias("n"))


def offsets(distinct: DataFrame) -> DataFrame:
    """Adds off: payloads lie one after the other in the order of their first ids."""
    return running(distinct, "first", F.col("len"), "off")


def entries(tiles: DataFrame) -> DataFrame:
    """tile_id, off, len of every tile with a payload."""
    placed = offsets(payloads(tiles)).select("sha", "off", "len")
    return tiles.filter(F.length("data") > 0).select("tile_id", F.sha2("data", 256).alias("sha")).join(placed, "sha").select("tile_id", "off", "len")


def runs(rows: DataFrame) -> DataFrame:
    """tile_id, off, len, run: neighbouring ids with the same payload as one entry. An entry is compared with the one before it
    within ranges of ids, the first of a range with the last of the range before, so that a payload that most tiles share
    is spread over all ranges."""
    width = 1 << 16
    entry = F.struct("tile_id", "off", "len")
    rows = rows.withColumn("_range", F.floor(F.col("tile_id") / width).cast("long"))
    edges = rows.groupBy((F.col("_range") + 1).alias("_range")).agg(F.max(entry).alias("_edge"))
    rows = rows.withColumn("_before", F.lag(entry).over(Window.partitionBy("_range").orderBy("tile_id"))).join(edges, "_range", "left")
    before = F.coalesce("_before", "_edge")
    goes_on = (before["tile_id"] == F.col("tile_id") - 1) & (before["off"] == F.col("off")) & (before["len"] == F.col("len"))
    begins = F.when(goes_on, 0).otherwise(1)
    island = running(rows.select("tile_id", "off", "len", begins.alias("_begins")), "tile_id", F.col("_begins"), "_n", width)
    return island.groupBy((F.col("_n") + F.col("_begins")).alias("_island")).agg(F.min("tile_id").alias("tile_id"), F.min("off").alias("off"), F.min("len").alias("len"), F.count("*").alias("run")).drop("_island")


def expand(rows: DataFrame) -> DataFrame:
    """One row for each tile of a run."""
    return rows.select(F.explode(F.sequence(F.col("tile_id"), F.col("tile_id") + F.col("run") - 1)).alias("tile_id"), "off", "len")


def leaves(rows: DataFrame, size: int = 4096) -> DataFrame:
    """Adds leaf: which leaf directory an entry goes to, `size` entries each in id order."""
    return running(rows, "tile_id", F.lit(1), "_n").withColumn("leaf", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def deltas(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """The columns a directory stores: id_delta, run, len and off (0 if it follows the entry before, else off + 1); one leaf at a time."""
    own = Window.partitionBy(leaf).orderBy("tile_id")
    end = F.lag(F.col("off") + F.col("len")).over(own)
    return rows.select(leaf, "tile_id", (F.col("tile_id") - F.coalesce(F.lag("tile_id").over(own), F.lit(0))).alias("id_delta"), "run", "len", F.when(F.col("off") == end, 0).otherwise(F.col("off") + 1).cast("long").alias("off_code"))
