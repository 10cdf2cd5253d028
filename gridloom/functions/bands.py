"""Bands, alpha, nodata, rescaling, gamma, fill and elevation as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import BandConfig, Colour
from .geo import clamp


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def clamp_byte(v: Column) -> Column:
    return half_up(clamp(v.cast("double"), 0.0, 255.0)).cast("int")


def band(samples: Column, i: int) -> Column:
    """The i-th band (from 1); 0 where there are fewer."""
    return F.when(F.size(samples) >= i, F.get(samples, F.lit(i - 1))).otherwise(0)


def rescale(v: Column, mode: str, limits: tuple[float, float] | None = None) -> Column:
    """To 0..255. none: the low byte; linear and log: from the limits, half up; equal limits give 0."""
    if mode == "none":
        return v.cast("int").bitwiseAND(F.lit(255))
    low, high = limits
    if low == high:
        return F.lit(0)
    x = v.cast("double")
    if mode == "linear":
        inner = (x - low) * (255.0 / (high - low))
    elif mode == "log":
        inner = F.ln(F.lit(1.0) + clamp(x, low, high) - low) / F.ln(F.lit(1.0 + high - low)) * 255.0
    else:
        raise ValueError(f"rescale {mode!r}")
    return F.when(x < low, 0).when(x > high, 255).otherwise(half_up(inner)).cast("int")


def is_nodata(samples: Column, nodata: float) -> Column:
    """Every band holds the nodata value."""
    return F.forall(samples, lambda b: b.cast("double") == nodata)


TRANSPARENT = (0, 0, 0, 0)


def rgba(r, g, b, a) -> Column:
    return F.struct(*(c.cast("int").alias(n) if isinstance(c, Column) else F.lit(c).alias(n) for c, n in zip((r, g, b, a), "rgba", strict=True)))


def to_rgba(samples: Column, bits: int, n_samples: int, config: BandConfig = BandConfig()) -> Column:
    """Struct (r, g, b, a) of one pixel's bands."""
    mode, limits = config.resolved(bits)
    alpha = config.alpha_band(bits, n_samples)

    def scaled(i: int) -> Column:
        return rescale(band(samples, i), mode, limits)

    if n_samples <= 2 and config.alpha is None:  # gray, gray and alpha
        grey = scaled(1)
        a = scaled(2) if n_samples == 2 else F.lit(255)
        out = rgba(grey, grey, grey, a)
    else:
        bands = (*config.bands, *(0,) * (3 - len(config.bands)))
        colours = [scaled(i) if i else F.lit(0) for i in bands]
        if alpha > 0:
            raw = band(samples, alpha)
            return F.when(raw == 0, rgba(*TRANSPARENT)).otherwise(rgba(*colours, F.greatest(rescale(raw, mode, limits), F.lit(1))))
        out = rgba(*colours, 255)
    if config.nodata is not None:
        out = F.when(is_nodata(samples, config.nodata), rgba(*TRANSPARENT)).otherwise(out)
    return out


def fill_transparent(pixel: Column, fill: Colour | None) -> Column:
    return pixel if fill is None else F.when(pixel["a"] == 0, rgba(*fill)).otherwise(pixel)


def gamma_table(gamma: float, size: int = 4096) -> list[int]:
    """Byte for each of `size` steps of linear light."""
    return [min(255, int((i / (size - 1)) ** (1 / gamma) * 255 + 0.5)) for i in range(size)]


def gamma_encode(v: Column, gamma: float, size: int = 4096) -> Column:
    """Of a linear value 0..255, by steps; a gamma of 1, or none, changes nothing."""
    if gamma <= 0 or gamma == 1:
        return clamp_byte(v)
    step = F.floor(clamp(v.cast("double") / 255, 0.0, 1.0) * (size - 1)) / (size - 1)
    return half_up(F.pow(step, F.lit(1 / gamma)) * 255).cast("int")


def elevation_encode(metres: Column) -> Column:
    """Struct (r, g, b, a): metres + 32768 in units of 1/256; transparent where there is no number."""
    v = clamp(metres.cast("double") + 32768, 0.0, 65535.99609375)
    whole = F.floor(v)
    sound = metres.isNotNull() & ~F.isnan(metres.cast("double")) & (F.abs(metres.cast("double")) != float("inf"))
    return F.when(sound, rgba(F.floor(whole / 256), whole % 256, F.floor((v - whole) * 256), 255)).otherwise(rgba(*TRANSPARENT))


def elevation_decode(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Metres; null where transparent."""
    return F.when(a != 0, r * 256.0 + g + b / 256.0 - 32768)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Fixed-point conversion with 16 fractional bits."""
    yy = y.cast("long") * 65536 + 32768
    u, v = cb.cast("long") - 128, cr.cast("long") - 128

    def byte(x: Column) -> Column:
        return clamp(F.floor(x / 65536.0), F.lit(0).cast("long"), F.lit(255).cast("long"))

    return rgba(byte(yy + 91881 * v), byte(yy - 22554 * u - 46802 * v), byte(yy + 116130 * u), 255)


def tile_kind(pixels: list[Column] | None = None):
    """Aggregates over a tile's r, g, b, a that name its form: uniform, gray or rgba."""
    pixel = F.struct("r", "g", "b", "a")
    return F.when(F.min(pixel) == F.max(pixel), "uniform").when(F.min((F.col("r") == F.col("g")) & (F.col("g") == F.col("b")) & (F.col("a") == 255)), "gray").otherwise("rgba")
