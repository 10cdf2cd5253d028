"""Vectorised words, word hashes and shingles over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: White space that ends a word: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def drawn(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number drawn for each byte value at each place of a segment: not linear in either, so that no arrangement of few
    bytes makes sums of them equal, as it would with powers of a base."""
    return mix(mix((place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)) ^ (byte.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F))


#: drawn() for the first places, which nearly all bytes have.
_NEAR = 64
_TABLE = drawn(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def segment_hashes(raw: np.ndarray, starts: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each segment [starts[i], starts[i+1]) of raw, from the numbers drawn for its bytes; the first segment
    starts at 0. Bytes that aren't counted are left out."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(raw)
    sizes = np.diff(np.append(starts, n))
    local = np.arange(n, dtype=np.int64) - np.repeat(starts, sizes)
    value = _TABLE[np.minimum(local, _NEAR - 1) * 256 + raw]
    far = np.flatnonzero(local >= _NEAR)
    if len(far):
        value[far] = drawn(raw[far], local[far])
    length = sizes
    if counted is not None:
        value[~counted] = 0
        length = np.add.reduceat(counted, starts, dtype=np.int64)
    return mix(np.add.reduceat(value, starts) + length.astype(U) * U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word; and, for each text, the number of words before it (one entry more than texts)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][np.diff(at) > 0]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), starts, starts, np.zeros(len(at), np.int64)
    body = LOWER[raw] if lower else raw
    hashes = segment_hashes(body[starts[0] :], starts - starts[0], inside[starts[0] :])
    ends = starts + np.add.reduceat(inside[starts[0] :], starts - starts[0], dtype=np.int64)
    return hashes, starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those lie in one text. first: words before each text."""
    n = len(hashes)
    if n < k:
        return np.zeros(n, U), np.zeros(n, bool)
    out = np.zeros(n, U)
    m = n - k + 1
    for i in range(k):
        out[:m] = mix(out[:m] * U(3) + hashes[i : i + m] + U(i))
    whole = np.zeros(n, bool)
    whole[:m] = True
    for back in range(1, k):
        last = first[1:] - back
        whole[last[(last >= 0) & (last < n) & (np.diff(first) >= back)]] = False
    return out, whole
