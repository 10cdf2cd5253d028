"""Tile payloads: PNG by zlib, elevations as PNG, JPEG in NumPy, others by registration."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from . import jpeg

Encode = Callable[[np.ndarray, int], bytes]
Decode = Callable[[bytes], np.ndarray]
_codecs: dict[str, tuple[Encode, Decode]] = {}


def register_codec(name: str, encode: Encode, decode: Decode) -> None:
    """encode(rgba array, quality) -> bytes; decode(bytes) -> rgba array."""
    _codecs[name] = encode, decode


def codec(name: str) -> tuple[Encode, Decode]:
    name = {"jpg": "jpeg"}.get(name.lower(), name.lower())
    if name not in _codecs:
        raise ValueError(f"no codec for {name!r}; register one with register_codec. Known: {sorted(_codecs)}")
    return _codecs[name]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_encode(rgba: np.ndarray, quality: int = 0) -> bytes:
    """Gray where all pixels are gray and opaque, RGB where opaque, else RGBA; each row as differences to the one above."""
    h, w, _ = rgba.shape
    if (rgba[..., 3] == 255).all():
        gray = (rgba[..., 0] == rgba[..., 1]).all() and (rgba[..., 1] == rgba[..., 2]).all()
        kind, pixels = (0, rgba[..., :1]) if gray else (2, rgba[..., :3])
    else:
        kind, pixels = 6, rgba
    rows = np.ascontiguousarray(pixels).reshape(h, -1)
    rows = np.concatenate([rows[:1], rows[1:] - rows[:-1]])
    lines = np.concatenate([np.full((h, 1), 2, np.uint8), rows], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """8-bit pictures without interlacing."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG picture")
    at, body, palette, alpha = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        at += n + 12
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG pictures without interlacing")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, row = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + above
        elif kind == 1:
            out[y] = np.cumsum(row.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        else:
            line = out[y]
            for i in range(w * n):
                a, b, c = int(line[i - n]) if i >= n else 0, int(above[i]), int(above[i - n]) if i >= n else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[i] = (int(row[i]) + guess) & 255
        above = out[y]
    pixels = out.reshape(h, w, n)
    full = np.full((h, w, 1), 255, np.uint8)
    if colour == 0:
        return np.concatenate([np.repeat(pixels, 3, 2), full], 2)
    if colour == 2:
        return np.concatenate([pixels, full], 2)
    if colour == 4:
        return np.concatenate([np.repeat(pixels[..., :1], 3, 2), pixels[..., 1:]], 2)
    if colour == 3:
        a = np.full(256, 255, np.uint8)
        if alpha is not None:
            a[: len(alpha)] = alpha
        return np.concatenate([palette[pixels[..., 0]], a[pixels]], 2)
    return pixels


def elevation_pixels(metres: np.ndarray) -> np.ndarray:
    """RGBA of elevations; transparent where there is no number."""
    sound = np.isfinite(metres)
    v = np.clip(np.where(sound, metres, 0) + 32768, 0, 65535.99609375)
    whole = np.floor(v).astype(np.int64)
    out = np.stack([whole // 256, whole % 256, np.floor((v - whole) * 256).astype(np.int64), np.full(v.shape, 255)], -1).astype(np.uint8)
    out[~sound] = 0
    return out


def pixel_elevations(rgba: np.ndarray) -> np.ndarray:
    p = rgba.astype(float)
    return np.where(p[..., 3] > 0, p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768, np.nan)


register_codec("png", png_encode, png_decode)
register_codec("terrarium", png_encode, png_decode)
register_codec("jpeg", jpeg.encode, jpeg.decode)
