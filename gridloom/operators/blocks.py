"""Whole tiles as arrays: rendering from sources, halving. The long forms in `mosaic` and `pyramid` say the same in rows."""

from __future__ import annotations

import math

import numpy as np

from ..functions import kernels
from ..options import BandConfig
from ..sources import tiff

CIRCUMFERENCE = 40075016.685578488
SHIFT = CIRCUMFERENCE / 2


# ---- projections on arrays


def from_wgs84(epsg: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return lon / 180 * SHIFT, np.log(np.tan((lat + 90) * np.pi / 360)) / np.pi * SHIFT
    if epsg == 2056:
        p, q = (lat * 3600 - 169028.66) / 1e4, (lon * 3600 - 26782.5) / 1e4
        e = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p**2 - 44.54 * q**3
        n = 1200147.07 + 308807.95 * p + 3745.25 * q**2 + 76.63 * p**2 - 194.56 * q**2 * p + 119.79 * p**3
        return e, n
    raise ValueError(f"EPSG:{epsg} isn't supported")


def to_wgs84(epsg: int, x: float, y: float) -> tuple[float, float]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return x / SHIFT * 180, math.degrees(2 * math.atan(math.exp(y / SHIFT * math.pi)) - math.pi / 2)
    if epsg == 2056:
        u, v = (x - 2.6e6) / 1e6, (y - 1.2e6) / 1e6
        lon = 2.6779094 + 4.728982 * u + 0.791484 * u * v + 0.1306 * u * v**2 - 0.0436 * u**3
        lat = 16.9023892 + 3.238272 * v - 0.270978 * u**2 - 0.002528 * v**2 - 0.0447 * u**2 * v - 0.0140 * v**3
        return lon * 100 / 36, lat * 100 / 36
    raise ValueError(f"EPSG:{epsg} isn't supported")


def tile_lonlat(z: int, x: int, y: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude of each column's and latitude of each row's pixel centre."""
    n = 2.0**z
    step = (np.arange(size) + 0.5) / size
    return (x + step) / n * 360 - 180, np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + step) / n))))


# ---- colours


def rescale(v: np.ndarray, mode: str, limits) -> np.ndarray:
    if mode == "none":
        return (v.astype(np.int64) & 255).astype(float)
    low, high = limits
    if low == high:
        return np.zeros(v.shape)
    x = v.astype(float)
    inner = (x - low) * (255 / (high - low)) if mode == "linear" else np.log1p(np.clip(x, low, high) - low) / np.log1p(high - low) * 255
    return np.where(x < low, 0, np.where(x > high, 255, np.floor(inner + 0.5)))


def to_rgba(samples: np.ndarray, bits: int, config: BandConfig) -> np.ndarray:
    """(h, w, samples) to (h, w, 4), as floats 0..255."""
    n = samples.shape[-1]
    mode, limits = config.resolved(bits)
    alpha = config.alpha_band(bits, n)

    def scaled(i: int) -> np.ndarray:
        return rescale(samples[..., i - 1], mode, limits) if 1 <= i <= n else np.zeros(samples.shape[:2])

    if n <= 2 and config.alpha is None:
        out = np.stack([scaled(1)] * 3 + [scaled(2) if n == 2 else np.full(samples.shape[:2], 255.0)], -1)
    else:
        bands = (*config.bands, *(0,) * (3 - len(config.bands)))
        out = np.stack([scaled(i) for i in bands] + [np.full(samples.shape[:2], 255.0)], -1)
        if alpha > 0:
            raw = samples[..., alpha - 1] if alpha <= n else np.zeros(samples.shape[:2])
            out[..., 3] = np.maximum(rescale(raw, mode, limits), 1)
            out[raw == 0] = 0
            return out
    if config.nodata is not None:
        out[(samples.astype(float) == config.nodata).all(-1)] = 0
    return out


# ---- rendering


def _taps(mode: str, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sample and weights (taps, ...) at coordinates f."""
    n = kernels.TAPS[mode]
    first = np.floor(f + 0.5) if mode == "nearest" else np.floor(f) - (n // 2 - 1)
    ks = np.arange(n).reshape((n, *(1,) * f.ndim))
    return first.astype(np.int64), kernels.weights(mode, f[None] - (first[None] + ks)) if mode != "nearest" else np.ones((1, *f.shape))


def resample(mode: str, window: np.ndarray, x0: int, y0: int, width: int, height: int, fx: np.ndarray, fy: np.ndarray, floating: bool) -> np.ndarray:
    """Values at (fx, fy); window holds the samples from (x0, y0) on. Colours count where they aren't transparent."""
    ix, wx = _taps(mode, fx)
    iy, wy = _taps(mode, fy)
    value, total, alpha, every = 0.0, 0.0, 0.0, 0.0
    missing = np.zeros(fx.shape, bool)
    for j in range(len(wy)):
        for i in range(len(wx)):
            px = window[np.clip(iy + j, 0, height - 1) - y0, np.clip(ix + i, 0, width - 1) - x0]
            w = wx[i] * wy[j]
            if floating:
                ok = np.isfinite(px)
                missing |= ~ok
                value, total = value + np.where(ok, w * px, 0), total + np.where(ok, w, 0)
            else:
                ok = px[..., 3] > 0
                value, total = value + np.where(ok, w, 0)[..., None] * px[..., :3], total + np.where(ok, w, 0)
                alpha, every = alpha + w * px[..., 3], every + w
    if floating:
        near = window[np.clip(np.floor(fy + 0.5).astype(int), 0, height - 1) - y0, np.clip(np.floor(fx + 0.5).astype(int), 0, width - 1) - x0]
        bad = missing if mode == "bilinear" else np.abs(total) < 1e-12
        return np.where(bad, near, value / np.where(np.abs(total) < 1e-12, 1, total))
    none = np.abs(total) < 1e-12
    colour = value / np.where(none, 1, total)[..., None]
    out = np.concatenate([colour, (alpha / every)[..., None]], -1)
    out[none] = 0
    return out


def pick_level(raster: tiff.Raster, wanted: float) -> int:
    """The level whose pixels are nearest in proportion to the wanted size; of equals the lowest."""
    top = raster.levels[0]
    sizes = [raster.pixel[0] * top.width / lv.width for lv in raster.levels]
    return min(range(len(sizes)), key=lambda i: (abs(sizes[i] / wanted - 1), i))


def render(z: int, x: int, y: int, size: int, rasters: list[tiff.Raster], mode: str, config: BandConfig, gamma: float = 1.0, floating: bool = False) -> np.ndarray | None:
    """RGBA (or elevations) of a tile: at each pixel the first source that has something there. None if none has."""
    lon, lat = tile_lonlat(z, x, y, size)
    lon2, lat2 = np.meshgrid(lon, lat)
    out = np.full((size, size), np.nan) if floating else np.zeros((size, size, 4))
    done = np.zeros((size, size), bool)
    for raster in rasters:
        if done.all():
            break
        cx, cy = from_wgs84(raster.epsg, lon2, lat2)
        bx0, by0, bx1, by1 = raster.box()
        use = ~done & (cx >= bx0) & (cx <= bx1) & (cy >= by0) & (cy <= by1)
        if not use.any():
            continue
        wanted = abs(float(cx[0, 1] - cx[0, 0]))
        level = pick_level(raster, wanted)
        lv = raster.levels[level]
        px, py = raster.pixel[0] * raster.levels[0].width / lv.width, raster.pixel[1] * raster.levels[0].height / lv.height
        fx, fy = (cx[use] - raster.origin[0]) / px, (raster.origin[1] - cy[use]) / py
        inside = (fx >= 0) & (fx < lv.width) & (fy >= 0) & (fy < lv.height)
        if not inside.any():
            continue
        fx, fy = fx[inside], fy[inside]
        kernel = mode if mode != "mode" else "nearest"
        pad = kernels.TAPS[kernel]
        x0, x1 = max(0, min(lv.width - 1, int(fx.min()) - pad)), min(lv.width, int(fx.max()) + pad + 2)
        y0, y1 = max(0, min(lv.height - 1, int(fy.min()) - pad)), min(lv.height, int(fy.max()) + pad + 2)
        with tiff.open_file(raster.path) as f:
            window = tiff.read_window(f, raster, level, x0, y0, x1, y1)
        if floating:
            data = window[..., 0].astype(float)
            if raster.nodata not in (None, "") and raster.nodata.lower() != "nan":
                data = np.where(data == float(raster.nodata), np.nan, data)
            got = resample(kernel, data, x0, y0, lv.width, lv.height, fx, fy, True)
            ok = np.isfinite(got)
        else:
            own = config if config.nodata is not None or not raster.nodata else BandConfig(config.bands, config.alpha, config.rescale, config.range, float(raster.nodata))
            got = resample(kernel, to_rgba(window, lv.bits, own), x0, y0, lv.width, lv.height, fx, fy, False)
            ok = got[..., 3] > 0
        at = np.flatnonzero(use.ravel())[inside][ok]
        out.reshape(size * size, -1)[at] = got[ok].reshape(ok.sum(), -1)
        done.ravel()[at] = True
    if not done.any():
        return None
    if floating:
        return out
    if gamma > 0 and gamma != 1 and mode in ("bilinear", "bicubic", "lanczos"):
        steps = np.floor(np.clip(out[..., :3] / 255, 0, 1) * 4095) / 4095
        out[..., :3] = steps ** (1 / gamma) * 255
    return np.floor(np.clip(np.round(out, 9), 0, 255) + 0.5).astype(np.uint8)


# ---- halving


def _kernel_matrix(mode: str, size: int) -> np.ndarray:
    """(size / 2, size): weights of a halving, nothing beyond the edge."""
    w = kernels.half_weights(mode)
    out = np.zeros((size // 2, size))
    for d in range(size // 2):
        for k, x in enumerate(w):
            s = 2 * d - (len(w) // 2 - 1) + k
            if 0 <= s < size:
                out[d, s] = x
    return out


def halve(tile: np.ndarray, mode: str) -> np.ndarray:
    """A tile (size, size, 4) or elevations (size, size) to half the size."""
    size = tile.shape[0]
    floating = tile.ndim == 2
    if mode == "nearest" or mode == "mode" and floating:
        return tile[::2, ::2]
    if mode in ("bicubic", "lanczos"):
        m = _kernel_matrix(mode, size)
        weigh = lambda p: m @ p @ m.T
        if floating:
            ok = np.isfinite(tile)
            total = weigh(ok.astype(float))
            none = np.abs(total) < 1e-12
            return np.where(none, np.nan, weigh(np.where(ok, tile, 0)) / np.where(none, 1, total))
        p = tile.astype(float)
        seen = (p[..., 3] > 0).astype(float)
        total = weigh(seen)
        none = np.abs(total) < 1e-12
        out = np.stack([weigh(p[..., c] * seen) / np.where(none, 1, total) for c in range(3)] + [weigh(p[..., 3])], -1)
        out[none] = 0
        return np.floor(np.clip(np.round(out, 9), 0, 255) + 0.5).astype(np.uint8)
    parts = np.stack([tile[::2, ::2], tile[::2, 1::2], tile[1::2, ::2], tile[1::2, 1::2]])
    if floating:
        n = np.isfinite(parts).sum(0)
        return np.where(n > 0, np.nansum(parts, 0) / np.maximum(n, 1), np.nan)
    p = parts.astype(np.int64)
    seen = p[..., 3] > 0
    if mode == "mode":
        code = np.where(seen, p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3], -1)
        votes = np.stack([(code == code[i]).sum(0) * seen[i] for i in range(4)])
        best = votes.argmax(0)
        out = np.take_along_axis(p, best[None, ..., None], 0)[0]
        out[~seen.any(0)] = 0
        return out.astype(np.uint8)
    n = seen.sum(0)
    colour = ((p[..., :3] * seen[..., None]).sum(0) + (n // 2)[..., None]) // np.maximum(n, 1)[..., None]
    alpha = (p[..., 3].sum(0) + 2) // 4
    out = np.concatenate([colour, alpha[..., None]], -1)
    out[n == 0] = 0
    return out.astype(np.uint8)


def combine(children: dict[tuple[int, int], np.ndarray], size: int, mode: str) -> np.ndarray | None:
    """The parent of up to four tiles, by their places (column, row)."""
    if not children:
        return None
    one = next(iter(children.values()))
    out = np.full((size, size), np.nan) if one.ndim == 2 else np.zeros((size, size, 4), np.uint8)
    half = size // 2
    for (i, j), tile in children.items():
        out[j * half : (j + 1) * half, i * half : (i + 1) * half] = halve(tile, mode)
    return out
