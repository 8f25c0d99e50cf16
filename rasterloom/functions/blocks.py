"""Block transforms, quantisation, intra and inter prediction on small planes held as arrays of int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as tb
from .channels import clamp, wrap16


def let(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.transform(F.array(value), of)[0]


def _items(a: Column, n: int = 16) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in range(n)]


def _two_passes(a: Column, first, second) -> Column:
    """first() turns four numbers of each row into four, second() those of each column."""

    def rows(x: Column) -> Column:
        v = _items(x)
        return F.array(*[c for i in range(4) for c in first(*v[4 * i : 4 * i + 4])])

    def columns(x: Column) -> Column:
        v = _items(x)
        done = [second(*v[i::4]) for i in range(4)]
        return F.array(*[done[i][j] for j in range(4) for i in range(4)])

    return let(let(a, rows), columns)


def forward_dct(residual: Column) -> Column:
    """16 coefficients of a 4x4 block of differences."""

    def first(d0, d1, d2, d3):
        a0, a1, a2, a3 = d0 + d3, d1 + d2, d1 - d2, d0 - d3
        return (a0 + a1) * 8, F.shiftright(a2 * 2217 + a3 * 5352 + 1812, 9), (a0 - a1) * 8, F.shiftright(a3 * 2217 - a2 * 5352 + 937, 9)

    def second(t0, t1, t2, t3):
        a0, a1, a2, a3 = t0 + t3, t1 + t2, t1 - t2, t0 - t3
        odd = F.shiftright(a2 * 2217 + a3 * 5352 + 12000, 16) + F.when(a3 != 0, 1).otherwise(0)
        return F.shiftright(a0 + a1 + 7, 4), odd, F.shiftright(a0 - a1 + 7, 4), F.shiftright(a3 * 2217 - a2 * 5352 + 51000, 16)

    return _two_passes(residual, first, second)


def _by_sin(v: Column) -> Column:
    """v * sqrt(2) sin(pi/8) in 16-bit fixed point; the constant is stored less 65536."""
    return wrap16(F.shiftright(v * (35468 - 65536), 16) + v)


def _by_cos(v: Column) -> Column:
    return wrap16(F.shiftright(v * 20091, 16) + v)


def inverse_dct(coefficients: Column) -> Column:
    """16 differences, rounded, of a 4x4 block of coefficients; sums wrap at 16 bits.

    Columns of coefficients go first, so each row of what comes between is a column of the block.
    """

    def turn(i0, i1, i2, i3):
        a, d = wrap16(i0 + i2), wrap16(i0 - i2)
        e, f = wrap16(_by_sin(i1) - _by_cos(i3)), wrap16(_by_cos(i1) + _by_sin(i3))
        return wrap16(a + f), wrap16(d + e), wrap16(d - e), wrap16(a - f)

    def columns(x: Column) -> Column:
        v = _items(x)
        return F.array(*[c for i in range(4) for c in turn(*v[i::4])])

    def rows(x: Column) -> Column:
        v = _items(x)
        out = []
        for i in range(4):
            w = v[i::4]
            out += [F.shiftright(c, 3) for c in turn(w[0] + 4, *w[1:])]
        return F.array(*out)

    return let(let(coefficients, columns), rows)


def forward_wht(dc: Column) -> Column:
    """Walsh-Hadamard transform of the 16 luma DCs."""

    def turn(b0, b1, b2, b3):
        a0, a1, a2, a3 = b0 + b2, b1 + b3, b1 - b3, b0 - b2
        return a0 + a1, a3 + a2, a3 - a2, a0 - a1

    return _two_passes(dc, turn, lambda *v: [F.shiftright(c, 1) for c in turn(*v)])


def inverse_wht(coefficients: Column) -> Column:
    """The 16 luma DCs again."""

    def turn(i0, i1, i2, i3):
        a0, a1, a2, a3 = i0 + i3, i1 + i2, i1 - i2, i0 - i3
        return a0 + a1, a3 + a2, a0 - a1, a3 - a2

    def columns(x: Column) -> Column:
        v = _items(x)
        done = [turn(*v[i::4]) for i in range(4)]
        return F.array(*[done[i][j] for j in range(4) for i in range(4)])

    def rows(x: Column) -> Column:
        v = _items(x)
        return F.array(*[F.shiftright(c, 3) for i in range(4) for c in turn(v[4 * i] + 3, *v[4 * i + 1 : 4 * i + 4])])

    return let(let(coefficients, columns), rows)


def quantize(coefficients: Column, dc: int, ac: int, kind: int, first: int = 0) -> Column:
    """Levels in scan order: sharpened, zero below a threshold, else divided by a reciprocal; 2047 at most."""
    out = [F.lit(0)] * first
    for n in range(first, 16):
        j = tb.ZIGZAG[n]
        q = dc if j == 0 else ac
        reciprocal, bias = (1 << 17) // q, tb.ROUNDING[kind][0 if j == 0 else 1] << 9
        zero = ((1 << 17) - 1 - bias) // reciprocal
        sharpen = tb.SHARPENING[j] * q >> 11 if kind == 0 else 0
        v = F.get(coefficients, F.lit(j)).cast("long")
        size = F.abs(v) + sharpen
        level = F.when(size <= zero, F.lit(0)).otherwise(F.least(F.shiftright(size * reciprocal + bias, 17), F.lit(2047)))
        out.append((F.when(v < 0, -level).otherwise(level)).cast("int"))
    return F.array(*out)


def used_levels(levels: Column) -> Column:
    """One more than the place of the last level that isn't zero."""
    return F.coalesce(F.array_max(F.transform(levels, lambda v, i: F.when(v != 0, i + 1))), F.lit(0))


def block_prediction(mode: int, top: Column, left: Column, corner: Column, size: int) -> Column:
    """A size x size block from the row above and the column to the left: 0 mean, 1 motion, 2 down, 3 across."""
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    y, x = (lambda p: F.floor(p / size).cast("int")), (lambda p: p % size)
    if mode == 0:
        total = F.aggregate(F.concat(top, left), F.lit(size), lambda s, v: s + v)
        return F.array_repeat(F.shiftright(total, size.bit_length()), size * size)
    if mode == 1:
        return F.transform(at, lambda p: clamp(F.get(left, y(p)) + F.get(top, x(p)) - corner))
    if mode == 2:
        return F.transform(at, lambda p: F.get(top, x(p)))
    return F.transform(at, lambda p: F.get(left, y(p)))


def _a2(a, b):
    return F.shiftright(a + b + 1, 1)


def _a3(a, b, c):
    return F.shiftright(a + 2 * b + c + 2, 2)


def small_prediction(mode: str, edge: Column) -> Column:
    """A 4x4 block from 13 neighbours in a line: the left column from the bottom, the corner, then eight above.

    Directional modes are means of two or three neighbours along the line; each rule gives where on
    the line a place looks.
    """
    e = _items(edge, 13)
    left, corner, top = e[3::-1], e[4], e[5:13]
    three = lambda i: _a3(e[max(i - 1, 0)], e[i], e[min(i + 1, 12)])
    two = lambda i: _a2(e[i], e[i + 1])
    places = [(y, x) for y in range(4) for x in range(4)]
    if mode == "dc":
        mean = F.shiftright(sum(top[:4] + left, F.lit(4)), 3)
        return F.array_repeat(let(mean, lambda m: m), 16)
    if mode == "tm":
        return F.array(*[clamp(left[y] + top[x] - corner) for y, x in places])
    if mode == "ve":
        return F.array(*[three(5 + x) for y, x in places])
    if mode == "he":
        return F.array(*[three(3 - y) for y, x in places])
    if mode == "rd":
        return F.array(*[three(4 + x - y) for y, x in places])
    if mode == "ld":
        return F.array(*[three(min(6 + x + y, 12)) for y, x in places])
    if mode == "vr":  # steep: even diagonals are means of two, odd ones and those off the end of three
        return F.array(*[two(4 + x - y // 2) if 2 * x >= y and y % 2 == 0 else three(4 + x - y // 2) if 2 * x >= y else three(4 + 2 * x - y + 1) if 2 * x - y == -1 else three(5 + 2 * x - y) for y, x in places])
    if mode == "vl":
        # the last column's two lower places lie further along than their diagonal
        odd = {(2, 3): 10, (3, 3): 11}
        return F.array(*[three(odd[y, x]) if (y, x) in odd else two(5 + x + y // 2) if y % 2 == 0 else three(6 + x + y // 2) for y, x in places])
    if mode == "hd":
        return F.array(*[two(3 - (y - x // 2)) if 2 * y >= x and x % 2 == 0 else three(4 - (y - x // 2)) if 2 * y >= x else three(3 - 2 * y + x) for y, x in places])
    # across and up: beyond the last left neighbour it alone counts
    reach = lambda y, x: 2 * y + x
    up = lambda k: left[3] if k > 5 else _a2(left[k // 2], left[k // 2 + 1]) if k % 2 == 0 else _a3(left[k // 2], left[k // 2 + 1], left[min(k // 2 + 2, 3)])
    return F.array(*[up(reach(y, x)) for y, x in places])


SMALL_MODES = ("dc", "tm", "ve", "he", "rd", "vr", "ld", "vl", "hd", "hu")


def filtered_row(px: Column, at, taps: tuple[int, ...], step: int, before: int) -> Column:
    """A weighted sum of neighbours `step` apart around a place, of 128, within a byte's range."""
    total = F.lit(64)
    for k, t in enumerate(taps):
        if t:
            total = total + F.get(px, at + (k - before) * step) * t
    return clamp(F.shiftright(total, 7))


def edge_filter_simple(p1, p0, q0, q1) -> list[Column]:
    """p0 and q0 of an edge, moved towards each other."""
    a = 3 * (q0 - p0) + clamp(p1 - q1, -128, 127)
    return [clamp(p0 + clamp(F.shiftright(a + 3, 3), -16, 15)), clamp(q0 - clamp(F.shiftright(a + 4, 3), -16, 15))]


def edge_filter_inner(p1, p0, q0, q1) -> list[Column]:
    """p1, p0, q0, q1 where the edge is smooth on both sides."""
    a = 3 * (q0 - p0)
    a1, a2 = clamp(F.shiftright(a + 4, 3), -16, 15), clamp(F.shiftright(a + 3, 3), -16, 15)
    a3 = F.shiftright(a1 + 1, 1)
    return [clamp(p1 + a3), clamp(p0 + a2), clamp(q0 - a1), clamp(q1 - a3)]


def edge_filter_wide(p2, p1, p0, q0, q1, q2) -> list[Column]:
    """Three pixels on each side, by 27, 18 and 9 of 128 of the step."""
    a = clamp(3 * (q0 - p0) + clamp(p1 - q1, -128, 127), -128, 127)
    a1, a2, a3 = (F.shiftright(k * a + 63, 7) for k in (27, 18, 9))
    return [clamp(p2 + a3), clamp(p1 + a2), clamp(p0 + a1), clamp(q0 - a1), clamp(q1 - a2), clamp(q2 - a3)]


def steep(p1, p0, q0, q1, threshold: int) -> Column:
    """High edge variance on either side."""
    return (F.abs(p1 - p0) > threshold) | (F.abs(q1 - q0) > threshold)


def needs_simple(p1, p0, q0, q1, limit: int) -> Column:
    return 4 * F.abs(p0 - q0) + F.abs(p1 - q1) <= limit


def needs_normal(p: list[Column], q: list[Column], limit: int, inner: int) -> Column:
    """p and q hold four pixels each, from the edge outwards."""
    flat = needs_simple(p[1], p[0], q[0], q[1], limit)
    for side in (p, q):
        for a, b in zip(side[1:], side[:-1]):
            flat = flat & (F.abs(a - b) <= inner)
    return flat
