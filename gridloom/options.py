"""Validated options of runs: bands, rescaling, colours, pyramids and archive transforms."""

from __future__ import annotations

import re
from dataclasses import dataclass

RESAMPLING = ("nearest", "bilinear", "bicubic", "lanczos", "mode")
FORMATS = ("png", "jpeg", "webp", "terrarium")
Colour = tuple[int, int, int, int]


def parse_colour(text: str | None) -> Colour | None:
    """"R,G,B", "R,G,B,A", "#RRGGBB" or "#RRGGBBAA"; None or blank: no colour."""
    if text is None or not text.strip():
        return None
    text = text.strip()
    if text.startswith("#"):
        if not re.fullmatch(r"#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{8})", text):
            raise ValueError(f"colour {text!r}: six or eight hex digits after #")
        parts = [int(text[i : i + 2], 16) for i in range(1, len(text), 2)]
    else:
        parts = [int(p) for p in text.split(",")]
        if len(parts) not in (3, 4) or any(not 0 <= p <= 255 for p in parts):
            raise ValueError(f"colour {text!r}: three or four numbers from 0 to 255")
    return (*parts, 255)[:4] if len(parts) == 3 else tuple(parts)


def parse_range(text: str | None) -> tuple[float, float] | None:
    """"min,max" with min < max."""
    if not text:
        return None
    low, high = (float(p) for p in text.split(","))
    if not low < high:
        raise ValueError(f"range {text!r}: the first must be below the second")
    return low, high


def parse_bands(text: str) -> tuple[int, ...]:
    """One to three 1-based band numbers."""
    bands = tuple(int(p) for p in text.split(","))
    if not 1 <= len(bands) <= 3 or any(b < 1 for b in bands):
        raise ValueError(f"bands {text!r}: one to three numbers from 1 on")
    return bands


@dataclass(frozen=True)
class BandConfig:
    """Which bands become red, green and blue, which one is alpha (None: band 4 of four 8-bit bands; 0: none), and the rescaling."""

    bands: tuple[int, ...] = (1, 2, 3)
    alpha: int | None = None
    rescale: str = "auto"
    range: tuple[float, float] | None = None
    nodata: float | None = None

    def __post_init__(self) -> None:
        if self.rescale not in ("auto", "none", "linear", "log"):
            raise ValueError(f"rescale {self.rescale!r}")
        if self.rescale in ("linear", "log") and self.range is None:
            raise ValueError("linear and log rescaling need a range")

    def resolved(self, bits: int) -> tuple[str, tuple[float, float] | None]:
        """Mode and range for this many bits: 16-bit samples without a mode are scaled from 0..65535."""
        if self.rescale in ("linear", "log"):
            return self.rescale, self.range
        if bits > 8:
            return "linear", self.range or (0.0, 65535.0)
        return "none", None

    def alpha_band(self, bits: int, samples: int) -> int:
        if self.alpha is None:
            return 4 if bits == 8 and samples >= 4 else 0
        return self.alpha


@dataclass(frozen=True)
class PyramidOptions:
    format: str = "png"
    quality: int = 85
    min_zoom: int | None = None
    max_zoom: int | None = None
    tile_size: int = 256
    resampling: str = "bicubic"
    gamma: float = 1.0
    fill: Colour | None = None
    bands: BandConfig = BandConfig()
    attribution: str = ""
    kind: str = "baselayer"
    name: str = "gridloom"

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format!r}")
        if self.resampling not in RESAMPLING:
            raise ValueError(f"resampling {self.resampling!r}")
        if self.tile_size not in (256, 512):
            raise ValueError("tile_size is 256 or 512")
        if self.min_zoom is not None and self.max_zoom is not None and self.min_zoom > self.max_zoom:
            raise ValueError("min_zoom is above max_zoom")


@dataclass(frozen=True)
class TransformOptions:
    format: str | None = None
    quality: int = 85
    min_zoom: int | None = None
    max_zoom: int | None = None
    resampling: str = "bicubic"
    rebuild: bool = False
    fill: Colour | None = None


def transform_mode(source_format: str, source_min_zoom: int, options: TransformOptions) -> str:
    """The cheapest way that gives what is asked for: passthrough, re-encode or rebuild."""
    if options.rebuild or options.min_zoom is not None and options.min_zoom < source_min_zoom:
        return "rebuild"
    if options.format is not None and options.format != source_format or options.fill is not None:
        return "reencode"
    return "passthrough"
