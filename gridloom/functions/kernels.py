"""Resampling kernels: closed forms for expressions, weights for arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TAPS = {"nearest": 1, "bilinear": 2, "bicubic": 4, "lanczos": 6}


def lanczos3(x: Column) -> Column:
    a = F.abs(x)
    inner = F.lit(3.0) * F.sin(F.pi() * a) * F.sin(F.pi() * a / 3) / (F.pi() * a * F.pi() * a)
    return F.when(a == 0, 1.0).when(a < 3, inner).otherwise(0.0)


def catmull_rom(x: Column) -> Column:
    a = F.abs(x)
    near = F.lit(1.5) * a * a * a - F.lit(2.5) * a * a + 1
    far = F.lit(-0.5) * a * a * a + F.lit(2.5) * a * a - F.lit(4.0) * a + 2
    return F.when(a <= 1, near).when(a < 2, far).otherwise(0.0)


def weight(mode: str, x: Column) -> Column:
    """Weight of a sample at distance x."""
    return {"nearest": lambda: F.lit(1.0), "bilinear": lambda: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x)), "bicubic": lambda: catmull_rom(x), "lanczos": lambda: lanczos3(x)}[mode]()


def anchor(mode: str, f: Column) -> Column:
    """First sample under the kernel at coordinate f."""
    if mode == "nearest":
        return F.floor(f + 0.5)
    return F.floor(f) - (TAPS[mode] // 2 - 1)


def weights(mode: str, x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    if mode == "lanczos":
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = 3 * np.sin(np.pi * a) * np.sin(np.pi * a / 3) / (np.pi * a) ** 2
        return np.where(a == 0, 1.0, np.where(a < 3, inner, 0.0))
    if mode == "bicubic":
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))
    if mode == "bilinear":
        return np.maximum(0.0, 1 - a)
    return np.ones_like(a)


def half_weights(mode: str) -> list[float]:
    """Normalised weights that halve a picture along one axis: distances 0.5, 1.5, ... to either side."""
    n = TAPS[mode]
    w = weights(mode, np.arange(n) - (n - 1) / 2)
    return [float(v) for v in w / w.sum()]


def lut(mode: str, size: int = 1024) -> np.ndarray:
    """Kernel values at `size` steps across half the support, for table lookup with linear steps between."""
    support = TAPS[mode] / 2
    return weights(mode, np.linspace(0, support, size))


def lut_weight(table: np.ndarray, mode: str, x: np.ndarray) -> np.ndarray:
    support = TAPS[mode] / 2
    at = np.minimum(np.abs(x) / support * (len(table) - 1), len(table) - 1)
    low = np.minimum(at.astype(int), len(table) - 2)
    return table[low] + (table[low + 1] - table[low]) * (at - low)
