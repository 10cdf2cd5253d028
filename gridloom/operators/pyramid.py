"""Halving a raster: one level of the pyramid from the one below, as group-bys on the parent's key.

Pixels are rows (z, gx, gy) with global coordinates at their level and either v (gray), r, g, b, a, or elev. Each
operator keeps further key columns given in `keys`. One level is one shuffle with partial aggregation on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.bands import clamp_byte


def _half(c: str) -> Column:
    return F.floor(F.col(c) / 2).cast("long").alias(c)


def _parents(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    return [*(F.col(k) for k in keys), (F.col("z") - 1).alias("z"), _half("gx"), _half("gy")]


def _place() -> Column:
    """Order of a pixel among its siblings: top left, top right, bottom left, bottom right."""
    return (F.col("gy") % 2) * 2 + F.col("gx") % 2


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("int")


def average_gray(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*_parents(df, keys)).agg(_div(F.sum("v") + 2, 4).alias("v"))


def average_rgba(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Colours over pixels that aren't transparent, half up; alpha over all four."""
    seen = F.col("a") != 0
    n = F.count_if(seen)
    colours = [F.when(n == 0, 0).otherwise(_div(F.sum(F.when(seen, F.col(c)).otherwise(0)) + F.floor(n / 2), n)).alias(c) for c in "rgb"]
    alpha = F.when(n == 0, 0).otherwise(_div(F.sum("a") + 2, 4)).alias("a")
    return df.groupBy(*_parents(df, keys)).agg(*colours, alpha)


def nearest(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The top-left pixel; no shuffle."""
    values = [c for c in df.columns if c not in ("z", "gx", "gy", *keys)]
    return df.filter((F.col("gx") % 2 == 0) & (F.col("gy") % 2 == 0)).select(*_parents(df, keys), *values)


def _mode(df: DataFrame, values: list[str], keys: tuple[str, ...], counts: Column) -> DataFrame:
    names = [*keys, "z", "gx", "gy"]
    each = df.select(*_parents(df, keys), *values, _place().alias("p"), counts.alias("w")).groupBy(*names, *values).agg(F.sum("w").alias("n"), F.min("p").alias("p"))
    best = F.max_by(F.struct(*values), F.struct(F.col("n"), -F.col("p"))).alias("best")
    return each.groupBy(*names).agg(best).select(*names, *(F.col(f"best.{c}").alias(c) for c in values))


def mode_gray(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent value, of equals the one that comes first."""
    return _mode(df, ["v"], keys, F.lit(1))


def mode_rgba(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent colour that isn't transparent; transparent where there is none."""
    seen = df.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)) for c in "rgb"})
    return _mode(seen, ["r", "g", "b", "a"], keys, F.when(F.col("a") == 0, 0).otherwise(1))


def _spread(df: DataFrame, mode: str, size: int) -> DataFrame:
    """A row for each parent a pixel adds to, with its weight. The kernel stays inside the pixel's tile."""
    taps = kernels.TAPS[mode]
    shift, w = taps // 2 - 1, kernels.half_weights(mode)
    table = F.array(*(F.lit(x) for x in w))
    for c in ("gx", "gy"):
        local = F.col(c) % size
        low = F.greatest(F.lit(0).cast("long"), F.ceil((local + (shift - taps + 1)) / 2).cast("long"))
        high = F.least(F.lit(size // 2 - 1).cast("long"), F.floor((local + shift) / 2).cast("long"))
        df = df.withColumn("_d", F.explode(F.sequence(low, high))).withColumn(f"_w{c}", F.get(table, (local - 2 * F.col("_d") + shift).cast("int"))).withColumn(f"_p{c}", F.floor(F.col(c) / size).cast("long") * (size // 2) + F.col("_d")).drop("_d")
    return df.withColumn("w", F.col("_wgx") * F.col("_wgy"))


def kernel_gray(df: DataFrame, mode: str, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lanczos or bicubic; weights beyond the tile's edge are left out and the rest made whole."""
    spread = _spread(df, mode, size)
    value = clamp_byte(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 9))
    return spread.groupBy(*keys, (F.col("z") - 1).alias("z"), F.col("_pgx").alias("gx"), F.col("_pgy").alias("gy")).agg(value.alias("v"))


def kernel_rgba(df: DataFrame, mode: str, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """Colours over pixels that aren't transparent; alpha over the whole kernel, with nothing beyond the tile's edge."""
    spread = _spread(df, mode, size)
    seen = F.col("a") > 0
    total = F.sum(F.when(seen, F.col("w")).otherwise(0.0))
    none = F.abs(total) < 1e-12
    colours = [F.when(none, 0).otherwise(clamp_byte(F.round(F.sum(F.when(seen, F.col("w") * F.col(c)).otherwise(0.0)) / total, 9))).alias(c) for c in "rgb"]
    alpha = F.when(none, 0).otherwise(clamp_byte(F.round(F.sum(F.col("w") * F.col("a")), 9))).alias("a")
    return spread.groupBy(*keys, (F.col("z") - 1).alias("z"), F.col("_pgx").alias("gx"), F.col("_pgy").alias("gy")).agg(*colours, alpha)


def average_elevation(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the valid neighbours; null where there is none."""
    return df.groupBy(*_parents(df, keys)).agg(F.avg("elev").alias("elev"))


def kernel_elevation(df: DataFrame, mode: str, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    spread = _spread(df.filter(F.col("elev").isNotNull()), mode, size)
    return spread.groupBy(*keys, (F.col("z") - 1).alias("z"), F.col("_pgx").alias("gx"), F.col("_pgy").alias("gy")).agg(F.try_divide(F.sum(F.col("w") * F.col("elev")), F.sum("w")).alias("elev"))


def halve(df: DataFrame, mode: str, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """One level up, by the columns that the pixels have."""
    kind = "elev" if "elev" in df.columns else "v" if "v" in df.columns else "rgba"
    if mode == "nearest" or mode == "mode" and kind == "elev":
        return nearest(df, keys)
    if mode == "mode":
        return (mode_gray if kind == "v" else mode_rgba)(df, keys)
    if mode in ("bicubic", "lanczos"):
        return {"v": kernel_gray, "rgba": kernel_rgba, "elev": kernel_elevation}[kind](df, mode, size, keys)
    return {"v": average_gray, "rgba": average_rgba, "elev": average_elevation}[kind](df, keys)


def pyramid(df: DataFrame, levels: int, mode: str = "bilinear", size: int = 256, cut=None) -> DataFrame:
    """The level and `levels` above it. cut(df, step): writes a level and reads it again, so that lineage stays short."""
    out, now = df, df
    for step in range(levels):
        now = halve(now, mode, size)
        if cut is not None:
            now = cut(now, step)
        out = out.unionByName(now)
    return out


def tile_forms(df: DataFrame, size: int = 256) -> DataFrame:
    """Per tile: pixels, kind (uniform, gray, rgba), pixels that aren't transparent."""
    from ..functions.bands import tile_kind

    return df.groupBy("z", F.floor(F.col("gx") / size).cast("long").alias("x"), F.floor(F.col("gy") / size).cast("long").alias("y")).agg(F.count("*").alias("n"), tile_kind().alias("kind"), F.count_if(F.col("a") != 0).alias("opaque"))
