"""Sources on tiles and pixels: overlap join, choice of level, sampling, first source that has something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.bands import clamp_byte

BOX = ("min_x", "min_y", "max_x", "max_y")


def _meet(a: str, b: str) -> Column:
    return (F.col(f"{a}.max_x") >= F.col(f"{b}.min_x")) & (F.col(f"{a}.min_x") <= F.col(f"{b}.max_x")) & (F.col(f"{a}.max_y") >= F.col(f"{b}.min_y")) & (F.col(f"{a}.min_y") <= F.col(f"{b}.max_y"))


def overlap_join(tiles: DataFrame, sources: DataFrame, levels: int = 12) -> DataFrame:
    """Every pair of a tile and a source whose closed boxes meet. Grids of cells, each level's twice as wide as those of the
    level below, cover all sources. A box belongs to the first level whose cells are as large as it, where it touches a few cells;
    boxes meet in the cells of the higher of their levels, by equality, and a pair counts in the cell of the overlap's
    lower left corner only. Catalyst sends a side to all tasks where it is small by its own measure."""
    t_cols, s_cols = tiles.columns, [c for c in sources.columns if c not in BOX]
    low_x, low_y, high_x, high_y = sources.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    if low_x is None:
        return tiles.crossJoin(sources.select(*s_cols).limit(0))
    step_x, step_y = max((high_x - low_x) / (1 << levels), 1e-12), max((high_y - low_y) / (1 << levels), 1e-12)

    def cell(v: Column, low: float, step: float, level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        return F.least(F.greatest(F.floor((v - low) / (step * size)), F.lit(0).cast("long")), F.floor(((1 << levels) - 1) / size))

    def own_level(df: DataFrame) -> DataFrame:
        wide = F.greatest((F.col("max_x") - F.col("min_x")) / step_x, (F.col("max_y") - F.col("min_y")) / step_y, F.lit(1.0))
        return df.withColumn("_own", F.least(F.ceil(F.log2(wide)), F.lit(levels)).cast("int"))

    def touched(df: DataFrame, others: list[int]) -> DataFrame:
        at = F.array_distinct(F.concat(F.array("_own"), F.filter(F.lit(others).cast("array<int>"), lambda k: k > F.col("_own"))))
        df = df.withColumn("_level", F.explode(at))
        k = F.col("_level")
        xs = F.sequence(cell(F.col("min_x"), low_x, step_x, k), cell(F.col("max_x"), low_x, step_x, k))
        ys = F.sequence(cell(F.col("min_y"), low_y, step_y, k), cell(F.col("max_y"), low_y, step_y, k))
        return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))

    tiles, sources = own_level(tiles), own_level(sources)
    used = [sorted(r[0] for r in df.select("_own").distinct().collect()) for df in (tiles, sources)]  # levels + 1 at most
    both = touched(tiles, used[1]).alias("t").join(touched(sources, used[0]).alias("s"), ["_level", "_cx", "_cy"])
    both = both.where((F.col("_level") == F.greatest("t._own", "s._own")) & _meet("t", "s"))
    k = F.col("_level")
    corner = (F.col("_cx") == cell(F.greatest("t.min_x", "s.min_x"), low_x, step_x, k)) & (F.col("_cy") == cell(F.greatest("t.min_y", "s.min_y"), low_y, step_y, k))
    return both.where(corner).select(*(F.col(f"t.{c}") for c in t_cols), *(F.col(f"s.{c}") for c in s_cols))


def select_level(pairs: DataFrame, levels: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Adds level: the one whose pixel size is nearest in proportion to out_px; of equals the lowest. levels: source_id, level, px."""
    best = F.min_by("level", F.struct(F.abs(F.col("px") / F.col("out_px") - 1), F.col("level"))).alias("level")
    keys = [c for c in pairs.columns]
    return pairs.join(levels, list(by)).groupBy(*keys).agg(best)


def first_opaque(samples: DataFrame, keys: tuple[str, ...], order: str = "source_id") -> DataFrame:
    """Per pixel, the colour of the first source that isn't transparent there."""
    return samples.filter(F.col("a") > 0).groupBy(*keys).agg(F.min_by(F.struct("r", "g", "b", "a"), order).alias("p"), F.min(order).alias(order)).select(*keys, order, "p.r", "p.g", "p.b", "p.a")


def first_valid(samples: DataFrame, keys: tuple[str, ...], nodata: float | None = None, order: str = "source_id") -> DataFrame:
    """The same for elevations: neither null, NaN nor the nodata value."""
    sound = F.col("elev").isNotNull() & ~F.isnan("elev")
    if nodata is not None:
        sound = sound & (F.col("elev") != nodata)
    return samples.filter(sound).groupBy(*keys).agg(F.min_by("elev", order).alias("elev"), F.min(order).alias(order))


def neighbourhood(points: DataFrame, raster: DataFrame, mode: str, width: int, height: int) -> DataFrame:
    """points (point, fx, fy) joined with the raster's pixels (gx, gy, ...) under the kernel, with weight w. Coordinates
    beyond the edge take the edge pixel. An equi-join that shuffles by pixel however many points there are; the raster is never
    broadcast, as its size in a compressed file says little of what it takes in the driver."""
    taps = kernels.TAPS[mode]
    x0, y0 = kernels.anchor(mode, F.col("fx")), kernels.anchor(mode, F.col("fy"))
    near = points.withColumn("_x", F.explode(F.sequence(x0, x0 + (taps - 1)))).withColumn("_y", F.explode(F.sequence(y0, y0 + (taps - 1))))
    w = kernels.weight(mode, F.col("fx") - F.col("_x")) * kernels.weight(mode, F.col("fy") - F.col("_y"))
    at = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    near = near.withColumn("w", w).withColumn("gx", at("_x", width)).withColumn("gy", at("_y", height)).drop("_x", "_y")
    return near.join(raster.hint("merge"), ["gx", "gy"])


def sample_rgba(points: DataFrame, raster: DataFrame, mode: str, width: int, height: int) -> DataFrame:
    """Colour at each point: colours over pixels that aren't transparent, alpha over all."""
    near = neighbourhood(points, raster, mode, width, height)
    if mode == "nearest":
        return near.select("point", "r", "g", "b", "a")
    seen = F.col("a") > 0
    total = F.sum(F.when(seen, F.col("w")).otherwise(0.0))
    none = F.abs(total) < 1e-12
    colours = [F.when(none, 0).otherwise(clamp_byte(F.round(F.sum(F.when(seen, F.col("w") * F.col(c)).otherwise(0.0)) / total, 9))).alias(c) for c in "rgb"]
    alpha = F.when(none, 0).otherwise(clamp_byte(F.round(F.sum(F.col("w") * F.col("a")) / F.sum("w"), 9))).alias("a")
    return near.groupBy("point").agg(*colours, alpha)


def sample_elevation(points: DataFrame, raster: DataFrame, mode: str, width: int, height: int) -> DataFrame:
    """Elevation at each point. Missing neighbours (null) are left out and the weights made whole; with bilinear any missing
    one, and elsewhere all of them, give the nearest pixel."""
    nearest = neighbourhood(points, raster, "nearest", width, height).select("point", F.col("elev").alias("near"))
    if mode == "nearest":
        return nearest.withColumnRenamed("near", "elev")
    near = neighbourhood(points, raster, mode, width, height)
    valid = F.col("elev").isNotNull()
    mean = F.try_divide(F.sum(F.when(valid, F.col("w") * F.col("elev"))), F.sum(F.when(valid, F.col("w"))))
    missing = F.count_if(~valid)
    value = F.when(missing == 0, mean) if mode == "bilinear" else F.when(F.count_if(valid) > 0, mean)
    return near.groupBy("point").agg(value.alias("elev"), missing.alias("missing")).join(nearest, "point").select("point", F.when(F.col("elev").isNotNull(), F.col("elev")).otherwise(F.col("near")).alias("elev"))
