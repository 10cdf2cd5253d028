"""Grids of tiles against data: missing and real positions, fill, bounds, holes between sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

POSITION = ["z", "x", "y"]


def grid(spark: SparkSession, z: int, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """All positions of a level from x0 to x1 and y0 to y1; made on the executors."""
    width = x1 - x0 + 1
    n = spark.range(width * (y1 - y0 + 1))
    return n.select(F.lit(z).alias("z"), (F.col("id") % width + x0).alias("x"), (F.floor(F.col("id") / width) + y0).alias("y"))


def missing(positions: DataFrame, tiles: DataFrame) -> DataFrame:
    """Positions without a tile."""
    return positions.join(tiles.select(*POSITION).distinct(), POSITION, "left_anti")


def inside(tiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Tiles at the positions."""
    return tiles.join(positions.select(*POSITION).distinct(), POSITION, "left_semi")


def parents(tiles: DataFrame) -> DataFrame:
    """Distinct positions one level up."""
    return tiles.select((F.col("z") - 1).alias("z"), F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y")).distinct()


def real_positions(tiles: DataFrame, levels: int) -> DataFrame:
    """Positions with data, on the tiles' level and `levels` above; all others hold nothing but fill."""
    now = tiles.select(*POSITION).distinct()
    out = now
    for _ in range(levels):
        now = parents(now)
        out = out.unionByName(now)
    return out


def with_fill(positions: DataFrame, tiles: DataFrame, **fill) -> DataFrame:
    """Every position, with the tile's columns or the fill's."""
    values = [c for c in tiles.columns if c not in POSITION]
    joined = positions.join(tiles.withColumn("_real", F.lit(True)), POSITION, "left")
    return joined.select(*POSITION, *(F.when(F.col("_real"), F.col(c)).otherwise(F.lit(fill.get(c))).alias(c) for c in values), F.coalesce("_real", F.lit(False)).alias("is_real"))


def merged_bounds(sources: DataFrame) -> DataFrame:
    """West, south, east and north of all sources, from their corners in their own reference systems."""
    corners = sources.select("epsg", F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("min_x", "max_x") for y in ("min_y", "max_y")))).alias("c"))
    lon, lat = geo.to_wgs84(F.col("epsg"), F.col("c.x"), F.col("c.y"))
    return corners.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def label_holes(free: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of 4-connected free cells; 0 where covered. Row runs are joined by union-find."""
    h, w = free.shape
    labels, up = np.zeros((h, w), np.int64), [0]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.diff(np.concatenate([[0], free[y].astype(np.int8), [0]]))
        runs = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            own = 0
            for pa, pb, pl in before:
                if pa < b and a < pb:
                    if own:
                        up[max(root(own), root(pl))] = min(root(own), root(pl))
                    own = own or pl
            if not own:
                own = len(up)
                up.append(own)
            labels[y, a:b] = own
            runs.append((a, b, own))
        before = runs
    return np.array([root(i) for i in range(len(up))])[labels]


def coverage_cells(sources: DataFrame, most: int = 2000) -> tuple[DataFrame, float, float]:
    """Covered cells (cx, cy) of a grid over all sources; a cell is half a mean source wide and high, with at most `most`
    an axis, and is covered if its centre lies in a closed box."""
    low_x, low_y, high_x, high_y, mean_x, mean_y = sources.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.avg(F.col("max_x") - F.col("min_x")), F.avg(F.col("max_y") - F.col("min_y"))).first()
    nx = min(most, max(1, int(np.ceil((high_x - low_x) / (mean_x / 2)))))
    ny = min(most, max(1, int(np.ceil((high_y - low_y) / (mean_y / 2)))))
    step_x, step_y = (high_x - low_x) / nx, (high_y - low_y) / ny

    def span(a: str, b: str, low: float, step: float, n: int):
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(a) - low) / step - 0.5).cast("long"))
        last = F.least(F.lit(n - 1).cast("long"), F.floor((F.col(b) - low) / step - 0.5).cast("long"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    xs, ys = span("min_x", "max_x", low_x, step_x, nx), span("min_y", "max_y", low_y, step_y, ny)
    covered = sources.select(F.explode(xs).alias("cx"), ys.alias("ys")).select("cx", F.explode("ys").alias("cy")).distinct()
    return covered, (low_x, low_y, step_x, step_y), (nx, ny)


def coverage_gaps(sources: DataFrame, most: int = 2000) -> DataFrame:
    """Boxes of the holes that no source covers, in the sources' reference system. The grid has at most most^2 cells, so its
    bits fit the driver."""
    spark = sources.sparkSession
    covered, (low_x, low_y, step_x, step_y), (nx, ny) = coverage_cells(sources, most)
    cells = covered.toArrow()
    free = np.ones((ny, nx), bool)
    free[cells.column("cy").to_numpy(), cells.column("cx").to_numpy()] = False
    labels = label_holes(free)
    y, x = np.nonzero(labels)
    _, hole, cells = np.unique(labels[y, x], return_inverse=True, return_counts=True)
    first, last = np.full((2, len(cells)), most), np.zeros((2, len(cells)), np.int64)
    for axis, at in enumerate((x, y)):
        np.minimum.at(first[axis], hole, at)
        np.maximum.at(last[axis], hole, at + 1)
    edges = (low_x + first[0] * step_x, low_y + first[1] * step_y, low_x + last[0] * step_x, low_y + last[1] * step_y, cells)
    rows = list(zip(*(e.tolist() for e in edges), strict=True))
    return spark.createDataFrame(rows, "min_x double, min_y double, max_x double, max_y double, cells long")
