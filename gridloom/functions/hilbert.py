"""Hilbert order of tiles, as expressions: the tile id counts all tiles of the levels above, then the place along the curve.

The curve's frame has four states: whether x and y are swapped, and whether both are mirrored. A quadrant with y = 0
swaps, and mirrors too if x = 1. Four bits of x and y are taken at a time through a table made from that rule, so an
address takes seven steps at most, each a lookup on whole numbers.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 28
STEP = 4
_SIDE = 1 << STEP


def _walk(state: int, x: int, y: int) -> tuple[int, int]:
    """Place of (x, y) in a square of _SIDE whose frame is in the state, and the state inside its cell."""
    place = 0
    for i in range(STEP - 1, -1, -1):
        a, b = x >> i & 1, y >> i & 1
        if state & 2:
            a, b = 1 - a, 1 - b
        if state & 1:
            a, b = b, a
        place = place * 4 + (b + 3 * a * (1 - b) + a * b)
        if b == 0:
            state ^= 1 | a << 1
    return place, state


@lru_cache(maxsize=1)
def _tables() -> tuple[list[int], list[int]]:
    """forward[state, x, y] = place * 4 + next state; back[state, place] = (x, y) * 4 + next state."""
    forward, back = [0] * (4 * _SIDE * _SIDE), [0] * (4 * _SIDE * _SIDE)
    for state in range(4):
        for x in range(_SIDE):
            for y in range(_SIDE):
                place, after = _walk(state, x, y)
                xy = x * _SIDE + y
                forward[state * _SIDE * _SIDE + xy] = place * 4 + after
                back[state * _SIDE * _SIDE + place] = xy * 4 + after
    return forward, back


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long(v) -> Column:
    return v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long")


def _right(v: Column, bits: Column) -> Column:
    return F.call_function("shiftright", v, bits.cast("int"))


def _power_of_four(z: Column) -> Column:
    return F.call_function("shiftleft", _long(1), (z * 2).cast("int"))


def _steps(z: Column) -> Column:
    """Numbers of the groups of four bits, from the highest down; none at level 0."""
    n = F.floor((z + (STEP - 1)) / STEP).cast("int")
    return F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))


def _start(z: Column) -> Column:
    """The first group may begin with bits above the level's; each swaps the frame, so that the level begins unswapped."""
    return (F.pmod(-z, F.lit(STEP)) % 2).cast("long")


def xy_to_hilbert(z: Column, x: Column, y: Column) -> Column:
    table = F.lit(_tables()[0])

    def step(acc: Column, i: Column) -> Column:
        nibbles = _right(_long(x), i * STEP) % _SIDE * _SIDE + _right(_long(y), i * STEP) % _SIDE
        at = acc % 4 * (_SIDE * _SIDE) + nibbles
        return _long(_right(acc, F.lit(2)) * (4 * _SIDE * _SIDE) + F.get(table, at.cast("int")))

    return F.aggregate(_steps(z), _start(z), step, lambda acc: _right(acc, F.lit(2)))


def hilbert_to_xy(z: Column, d: Column) -> Column:
    """Struct (x, y)."""
    table = F.lit(_tables()[1])

    def step(acc: Column, i: Column) -> Column:
        at = acc["s"] * (_SIDE * _SIDE) + _right(_long(d), i * (2 * STEP)) % (_SIDE * _SIDE)
        return bind(
            _long(F.get(table, at.cast("int"))),
            lambda e: F.struct((acc["x"] * _SIDE + _right(e, F.lit(2 + STEP))).alias("x"), (acc["y"] * _SIDE + _right(e, F.lit(2)) % _SIDE).alias("y"), (e % 4).alias("s")),
        )

    zero = F.struct(_long(0).alias("x"), _long(0).alias("y"), _start(z).alias("s"))
    return F.aggregate(_steps(z), zero, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def zoom_base(z: Column) -> Column:
    """Tiles of all levels above z."""
    return F.call_function("div", _power_of_four(z) - 1, _long(3)).cast("long")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    return zoom_base(z) + xy_to_hilbert(z, x, y)


def id_to_zoom(tile: Column) -> Column:
    """From the number of binary digits of 3 * id + 1, which a level's first id takes to a power of four."""
    return F.floor((F.length(F.bin(tile * 3 + 1)) - 1) / 2).cast("int")


def id_to_zxy(tile: Column) -> Column:
    """Struct (z, x, y)."""

    def placed(p: Column) -> Column:
        xy = hilbert_to_xy(p["z"], p["tile"] - zoom_base(p["z"]))
        return bind(xy, lambda q: F.struct(p["z"].alias("z"), q["x"].alias("x"), q["y"].alias("y")))

    return bind(tile, lambda t: bind(F.struct(t.alias("tile"), id_to_zoom(t).alias("z")), placed))


def zoom_ids(z: int) -> tuple[int, int]:
    """Ids of a level: from, up to but without."""
    return (4**z - 1) // 3, (4 ** (z + 1) - 1) // 3


def tile_id_of(z: int, x: int, y: int) -> int:
    """The same for one tile, in Python."""
    n = -(-z // STEP)
    state, d = (-z % STEP) % 2, 0
    for i in range(n - 1, -1, -1):
        e = _tables()[0][state * _SIDE * _SIDE + (x >> i * STEP) % _SIDE * _SIDE + (y >> i * STEP) % _SIDE]
        d, state = d * _SIDE * _SIDE + (e >> 2), e & 3
    return (4**z - 1) // 3 + d


def zxy_of(tile: int) -> tuple[int, int, int]:
    z = ((tile * 3 + 1).bit_length() - 1) // 2
    d, x, y, state = tile - (4**z - 1) // 3, 0, 0, (-z % STEP) % 2
    for i in range(-(-z // STEP) - 1, -1, -1):
        e = _tables()[1][state * _SIDE * _SIDE + (d >> 2 * STEP * i) % (_SIDE * _SIDE)]
        x, y, state = x * _SIDE + (e >> 2 + STEP), y * _SIDE + (e >> 2) % _SIDE, e & 3
    return z, x, y
