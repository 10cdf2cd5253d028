"""Baseline JPEG in NumPy: blocks and entropy-coded bits are handled as arrays; only decoding the bits is a loop over symbols.

Written pictures hold one component (gray) or three (YCbCr) at full resolution, with Huffman tables made for the picture.
Read are baseline and extended sequential pictures of 8 bits, with any sampling, restarts, and tables given apart.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the standard's annex: quantisers of quality 50, row by row, for brightness and colour.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)
#: Places of a block in the order of its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class BadPicture(ValueError):
    pass


def quantiser(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).reshape(8, 8)


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits; a symbol that never occurs takes the code of all ones."""
    heap = [(n, [s]) for s, n in counts.items()] + [(0, [-1])]
    size = dict.fromkeys([*counts, -1], 0)
    heap = [(n, i, s) for i, (n, s) in enumerate(heap)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        (n, _, s), (m, _, t) = heapq.heappop(heap), heapq.heappop(heap)
        for x in s + t:
            size[x] += 1
        heapq.heappush(heap, (n + m, tick, s + t))
        tick += 1
    # too long codes: shorten by Kraft's sum, longest first
    order = sorted(size, key=lambda s: (size[s], s != -1, -counts.get(s, 0)))
    held = [min(16, size[s]) for s in order]
    room = (1 << 16) - sum(1 << (16 - n) for n in held)
    i = len(held) - 1
    while room < 0:
        while held[i] >= 16:
            i -= 1
        room += (1 << (16 - held[i])) - (1 << (15 - held[i]))
        held[i] += 1
        i = len(held) - 1 if i == 0 else i
    ranked = sorted(held)
    by_use = sorted(counts, key=lambda s: (-counts[s], s))
    return dict(zip(by_use, ranked, strict=False))  # the longest stays with the symbol that never occurs


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Number of codes of each length, symbols in order, and the codes."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
        bits[last - 1] += 1
    return bits, symbols, codes


def _category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """For blocks of one component in zigzag order (differences in place 0): block, place, is-DC, symbol, extra value, extra bits."""
    n = len(blocks)
    dc = blocks[:, 0]
    out = [(np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), _category(dc), dc, _category(dc))]
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    first = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
    before = np.where(first, 0, np.append(0, k[:-1]) if len(k) else 0)
    run = k - before - 1
    v = blocks[b, k]
    size = _category(v)
    out.append((b, 2 * k, np.zeros(len(b), bool), run % 16 * 16 + size, v, size))
    zrl = np.repeat(np.arange(len(b)), run // 16)
    out.append((b[zrl], 2 * k[zrl] - 1, np.zeros(len(zrl), bool), np.full(len(zrl), 0xF0), np.zeros(len(zrl), np.int64), np.zeros(len(zrl), np.int64)))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    end = np.flatnonzero(last < 63)
    zero = np.zeros(len(end), np.int64)
    out.append((end, np.full(len(end), 200), np.zeros(len(end), bool), zero, zero, zero))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    place = np.arange(total) - np.repeat(ends - sizes, sizes)
    return (np.repeat(values, sizes) >> (np.repeat(sizes, sizes) - 1 - place) & 1).astype(np.uint8)


def _segment(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data


def encode(rgba: np.ndarray, quality: int = 85) -> bytes:
    """Alpha is dropped; a quality of 0 or less means 85."""
    quality = min(100, quality) if quality > 0 else 85
    h, w = rgba.shape[:2]
    p = rgba[..., :3].astype(float)
    gray = bool((rgba[..., 0] == rgba[..., 1]).all() and (rgba[..., 1] == rgba[..., 2]).all())
    if gray:
        planes = [p[..., 0]]
    else:
        r, g, b = p[..., 0], p[..., 1], p[..., 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) * 0.5 / 0.886 + 128, (r - y) * 0.5 / 0.701 + 128]
    tables = [quantiser(LUMINANCE, quality), quantiser(CHROMINANCE, quality)][: 1 if gray else 2]
    parts = []
    for c, plane in enumerate(planes):
        padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        b = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        q = np.rint(_DCT @ b @ _DCT.T / tables[min(c, 1)]).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
        q[:, 0] = np.diff(q[:, 0], prepend=0)
        block, place, dc, symbol, v, size = _symbols(q)
        parts.append((block, np.full(len(block), c), place, dc, symbol, v, size))
    block, comp, place, dc, symbol, v, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, comp, block))
    dc, symbol, v, size = dc[order], symbol[order], v[order], size[order]
    heads, code, length = [], np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for number, mine in ((0, dc), (1, ~dc)):
        names, n = np.unique(symbol[mine], return_counts=True)
        lengths = _lengths(dict(zip(names.tolist(), n.tolist(), strict=True)) or {0: 1})
        bits, ranked, codes = _codes(lengths)
        heads.append(_segment(0xC4, bytes([number << 4, *bits, *ranked])))
        at = np.searchsorted(names, symbol[mine])
        code[mine] = np.array([codes[s] for s in names.tolist()] or [0])[at]
        length[mine] = np.array([lengths[s] for s in names.tolist()] or [0])[at]
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    stream = _bits((code << size) | extra, length + size)
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    body = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(len(planes)))
    scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + b"\x00\x3f\x00"
    quants = b"".join(_segment(0xDB, bytes([i, *t.reshape(-1)[ZIGZAG].tolist()])) for i, t in enumerate(tables))
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    return head + quants + _segment(0xC0, frame) + b"".join(heads) + _segment(0xDA, scan) + body + b"\xff\xd9"


# ---- reading


def _lookup(bits: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol for every 16 bits that may come next; length 0 where no code fits."""
    length, found = [0] * 65536, [0] * 65536
    code = i = 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            lo = code << (16 - n)
            for k in range(lo, min(lo + (1 << (16 - n)), 65536)):
                length[k], found[k] = n, symbols[i]
            code += 1
            i += 1
        code <<= 1
    return length, found


def splice(tables: bytes, data: bytes) -> bytes:
    """A picture whose tables stand apart, as one stream."""
    return tables[:-2] + data[2:] if tables else data


def decode_planes(data: bytes) -> tuple[list[np.ndarray], int | None]:
    """Components at full size, as floats, and the colour transform that the file names, if any."""
    if data[:2] != b"\xff\xd8":
        raise BadPicture("not a JPEG picture")
    quant, huff, restart, at, transform, frame = {}, {}, 0, 2, None, None
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        kind = data[at + 1]
        if kind in (0xD8, 0x01):
            at += 2
            continue
        if kind == 0xD9:
            raise BadPicture("no picture in the stream")
        size = struct.unpack_from(">H", data, at + 2)[0]
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while part:
                wide, n = part[0] >> 4, part[0] & 15
                values = np.frombuffer(part[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(float)
                table = np.zeros(64)
                table[ZIGZAG] = values
                quant[n] = table.reshape(8, 8)
                part = part[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                huff[part[0]] = _lookup(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif kind in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", part)
            if depth != 8:
                raise BadPicture("only 8 bits a sample")
            frame = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise BadPicture("only baseline pictures")
        elif kind == 0xDD:
            restart = struct.unpack(">H", part)[0]
        elif kind == 0xEE and part[:5] == b"Adobe":
            transform = part[11]
        elif kind == 0xDA:
            if frame is None:
                raise BadPicture("a scan before its frame")
            chosen = {part[1 + 2 * i]: part[2 + 2 * i] for i in range(part[0])}
            if len(chosen) != len(frame):
                raise BadPicture("only pictures with one scan")
            break
    wide, tall = max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-w // (8 * wide)), -(-h // (8 * tall))
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        wide = tall = 1
        across, down = -(-w // 8), -(-h // 8)
    coefficients = [np.zeros((down * f[2], across * f[1], 64)) for f in frame]
    plan = [(i, v, u, huff[chosen[f[0]] >> 4], huff[16 | chosen[f[0]] & 15]) for i, f in enumerate(frame) for v in range(f[2]) for u in range(f[1])]
    zig = ZIGZAG.tolist()
    end = at
    pieces = []
    while True:  # stretches between restarts
        stop = data.find(b"\xff", end)
        while stop >= 0 and data[stop + 1] == 0:
            stop = data.find(b"\xff", stop + 2)
        pieces.append(data[at : stop if stop >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
        if stop < 0 or not 0xD0 <= data[stop + 1] <= 0xD7:
            break
        at = end = stop + 2
    mcu, total = 0, across * down
    for piece in pieces:
        raw = np.frombuffer(piece + b"\0" * 8, np.uint8).astype(np.int64)
        window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
        p, limit, last = 0, 8 * len(piece) + 32, [0] * len(frame)
        for mcu in range(mcu, min(total, mcu + restart) if restart else total):  # noqa: B020
            my, mx = divmod(mcu, across)
            for i, v, u, (dc_len, dc_sym), (ac_len, ac_sym) in plan:
                block = coefficients[i][my * frame[i][2] + v, mx * frame[i][1] + u]
                k = window[p >> 3] >> (16 - (p & 7)) & 0xFFFF
                if not dc_len[k] or p > limit:
                    raise BadPicture("broken picture data")
                p += dc_len[k]
                s = dc_sym[k]
                if s:
                    x = window[p >> 3] >> (32 - s - (p & 7)) & (1 << s) - 1
                    p += s
                    last[i] += x if x >> (s - 1) else x - (1 << s) + 1
                block[0] = last[i]
                n = 1
                while n < 64:
                    k = window[p >> 3] >> (16 - (p & 7)) & 0xFFFF
                    if not ac_len[k]:
                        raise BadPicture("broken picture data")
                    p += ac_len[k]
                    rs = ac_sym[k]
                    s = rs & 15
                    if s == 0:
                        if rs != 0xF0:
                            break
                        n += 16
                        continue
                    n += rs >> 4
                    if n > 63 or p > limit:
                        raise BadPicture("broken picture data")
                    x = window[p >> 3] >> (32 - s - (p & 7)) & (1 << s) - 1
                    p += s
                    block[zig[n]] = x if x >> (s - 1) else x - (1 << s) + 1
                    n += 1
        mcu += 1
    out = []
    for f, c in zip(frame, coefficients, strict=True):
        pixels = _DCT.T @ (c.reshape(-1, 8, 8) * quant[f[3]]) @ _DCT + 128
        plane = pixels.reshape(c.shape[0], c.shape[1], 8, 8).swapaxes(1, 2).reshape(c.shape[0] * 8, -1)
        plane = plane.repeat(tall // f[2], 0).repeat(wide // f[1], 1)
        out.append(np.clip(np.floor(plane[:h, :w] + 0.5), 0, 255))
    return out, transform


def decode_samples(data: bytes) -> np.ndarray:
    """(h, w, 1 or 3)."""
    planes, transform = decode_planes(data)
    if len(planes) == 1:
        return planes[0][..., None].astype(np.uint8)
    if len(planes) != 3:
        raise BadPicture(f"{len(planes)} components aren't supported")
    if transform == 0:
        return np.stack(planes, -1).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """RGBA."""
    s = decode_samples(data)
    rgb = np.repeat(s, 3, 2) if s.shape[2] == 1 else s
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], 2)
