"""The lossy codec's key frames: planes of 4:2:0 to and from bytes.

A frame is a row-major grid of 16x16 macroblocks. Each is predicted from the pixels above and to the
left, and adds coded differences; a loop filter then smooths block edges of the whole frame.

Default probabilities are a parameter: `Tables()` builds flat ones by rule, for streams that stay within this
module. Files need the published ones (RFC 6386 sections 11.5, 13.4 and 13.5): `Tables.read(path)` takes them from a text
that lists them as the RFC does, the RFC itself among them; `sources.media` refuses lossy pictures without them.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from ..functions import tables as tb
from .bits import Invalid, Unsupported
from .boolcoder import BoolReader, BoolWriter

DC, TM, VE, HE, RD, VR, LD, VL, HD, HU = range(10)
SMALL = ("dc", "tm", "ve", "he", "rd", "vr", "ld", "vl", "hd", "hu")
# Band of each coefficient in scan order; one more stands after the last.
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7, 0)
# Probabilities of the extra bits of each class of large values.
CLASS_BITS = ((173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
# Probabilities of a key frame's whole-block and chroma modes, and of the choice between block sizes.
SMALL_BLOCKS, LUMA_MODES, CHROMA_MODES = 145, (156, 163, 128), (142, 114, 183)
MOST_SIDE, MOST_AREA, MOST_FIRST = (1 << 14) - 1, 1 << 28, 1 << 19
FIRST_LUMA, SECOND, CHROMA, WHOLE_LUMA = 0, 1, 2, 3


@dataclass(frozen=True)
class Tables:
    """Default probabilities: of coefficients, of their updates, and of 4x4 modes by the modes above and to the left."""

    coefficients: np.ndarray = field(default_factory=lambda: np.full((4, 8, 3, 11), 128))
    updates: np.ndarray = field(default_factory=lambda: np.full((4, 8, 3, 11), 250))
    small_modes: np.ndarray = field(default_factory=lambda: np.full((10, 10, 9), 128))

    @classmethod
    def of_text(cls, text: str) -> Tables:
        """Tables from C declarations named as in the RFC, wherever they stand in a text; page breaks and comments don't count."""
        text = re.sub(r"(?m)^.*\[Page \d+\]\s*$|^RFC 6386\b.*$", "", text)
        text = re.sub(r"(?s)/\*.*?\*/|//[^\n]*", "", text)

        def listed(name: str, shape: tuple[int, ...]) -> np.ndarray:
            for m in re.finditer(rf"\b{name}\b[^;={{}}]*=\s*(\{{[^;]*\}})\s*;", text):
                values = [int(v) for v in re.findall(r"\d+", m[1])]
                if len(values) == int(np.prod(shape)) and all(0 <= v < 256 for v in values):
                    return np.array(values).reshape(shape)
            raise ValueError(f"no table {name} of {shape}")

        # the RFC's order of 4x4 modes, in this module's names
        order = [DC, TM, VE, HE, LD, RD, VR, VL, HD, HU]
        modes = np.zeros((10, 10, 9), np.int64)
        modes[np.ix_(order, order)] = listed("kf_bmode_probs?", (10, 10, 9))
        return cls(listed("default_coeff_probs", (4, 8, 3, 11)), listed("coeff_update_probs", (4, 8, 3, 11)), modes)

    @classmethod
    def read(cls, path: str) -> Tables:
        return cls.of_text(Path(path).read_text(errors="replace"))


def clamp_index(v: int, most: int = 127) -> int:
    return min(max(v, 0), most)


def steps(base: int, y1_dc: int = 0, y2_dc: int = 0, y2_ac: int = 0, uv_dc: int = 0, uv_ac: int = 0) -> dict[int, tuple[int, int]]:
    """DC and AC step of each kind of block."""
    at = lambda table, i, most=127: table[clamp_index(i, most)]
    luma = (at(tb.DC_STEP, base + y1_dc), at(tb.AC_STEP, base))
    second = (at(tb.DC_STEP, base + y2_dc) * 2, max(at(tb.AC_STEP, base + y2_ac) * 101581 >> 16, 8))
    return {FIRST_LUMA: luma, WHOLE_LUMA: luma, SECOND: second, CHROMA: (at(tb.DC_STEP, base + uv_dc, 117), at(tb.AC_STEP, base + uv_ac))}


def quality_index(quality: int) -> int:
    c = quality / 100
    linear = 2 * c - 1 if c >= 0.75 else c * 2 / 3
    return clamp_index(int(127 * (1 - linear ** (1 / 3)) + 1e-9))


# transforms of one block or of many (last two axes 4x4)


def _wrap(v: np.ndarray) -> np.ndarray:
    return (v + 32768 & 65535) - 32768


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """Differences of coefficients, both n x 4 x 4; sums wrap at 16 bits."""
    sin = lambda v: _wrap((v * (35468 - 65536) >> 16) + v)
    cos = lambda v: _wrap((v * 20091 >> 16) + v)

    def turn(i0, i1, i2, i3):
        a, d = i0 + i2, i0 - i2
        e, f = sin(i1) - cos(i3), cos(i1) + sin(i3)
        return [_wrap(v) for v in (a + f, d + e, d - e, a - f)]

    v = c.astype(np.int64)
    between = np.stack(turn(*(v[:, k] for k in range(4))), 2)  # [block, column, row]
    out = turn(between[:, 0] + 4, *(between[:, k] for k in (1, 2, 3)))
    return np.stack(out, 2) >> 3


def forward_dct(d: np.ndarray) -> np.ndarray:
    v = d.astype(np.int64)
    d0, d1, d2, d3 = (v[:, :, k] for k in range(4))
    a0, a1, a2, a3 = d0 + d3, d1 + d2, d1 - d2, d0 - d3
    t = [(a0 + a1) * 8, a2 * 2217 + a3 * 5352 + 1812 >> 9, (a0 - a1) * 8, a3 * 2217 - a2 * 5352 + 937 >> 9]
    t = np.stack(t, 2)
    t0, t1, t2, t3 = (t[:, k] for k in range(4))
    a0, a1, a2, a3 = t0 + t3, t1 + t2, t1 - t2, t0 - t3
    out = [a0 + a1 + 7 >> 4, (a2 * 2217 + a3 * 5352 + 12000 >> 16) + (a3 != 0), a0 - a1 + 7 >> 4, a3 * 2217 - a2 * 5352 + 51000 >> 16]
    return np.stack(out, 1)


def inverse_wht(c: np.ndarray) -> np.ndarray:
    """16 luma DCs of a 4x4 block of second-order coefficients."""

    def turn(i0, i1, i2, i3):
        a0, a1, a2, a3 = i0 + i3, i1 + i2, i1 - i2, i0 - i3
        return a0 + a1, a3 + a2, a0 - a1, a3 - a2

    v = c.astype(np.int64)
    t = np.stack(turn(*v))
    return np.stack(turn(t[:, 0] + 3, t[:, 1], t[:, 2], t[:, 3]), 1) >> 3


def forward_wht(dc: np.ndarray) -> np.ndarray:
    def turn(b0, b1, b2, b3):
        a0, a1, a2, a3 = b0 + b2, b1 + b3, b1 - b3, b0 - b2
        return a0 + a1, a3 + a2, a3 - a2, a0 - a1

    v = dc.astype(np.int64)
    t = np.stack(turn(*(v[:, k] for k in range(4))), 1)
    return np.stack(turn(*t)) >> 1


def quantize(c: np.ndarray, step: tuple[int, int], kind: int) -> np.ndarray:
    """Levels of n x 16 coefficients in raster order; kind of rounding: 0 luma (sharpened), 1 second order, 2 chroma."""
    q = np.array([step[0]] + [step[1]] * 15, np.int64)
    reciprocal, bias = (1 << 17) // q, np.array([tb.ROUNDING[kind][0]] + [tb.ROUNDING[kind][1]] * 15, np.int64) << 9
    sharpen = np.array(tb.SHARPENING, np.int64) * q >> 11 if kind == 0 else 0
    size = np.abs(c) + sharpen
    level = np.minimum(size * reciprocal + bias >> 17, 2047)
    return np.where(size <= ((1 << 17) - 1 - bias) // reciprocal, 0, np.sign(c) * level)


# prediction


def whole_block(mode: int, top: np.ndarray, left: np.ndarray, corner: int, has_top: bool, has_left: bool) -> np.ndarray:
    """A 16x16 or 8x8 prediction; a missing side counts neither for the mean, and stands as 127 above and 129 left for the rest."""
    n = len(top)
    if mode == DC:
        parts = [p for p, ok in ((top, has_top), (left, has_left)) if ok]
        count = n * len(parts)
        return np.full((n, n), (int(sum(p.sum() for p in parts)) + count // 2) // count if parts else 128, np.int64)
    if mode == TM:
        return np.clip(left[:, None] + top[None, :] - corner, 0, 255)
    return np.tile(top, (n, 1)) if mode == VE else np.tile(left[:, None], (1, n))


def _small_places() -> dict[int, list[list[tuple[int, ...]]]]:
    """For each directional mode and place the neighbours on the line that it weighs: two, or three with the middle twice."""
    two = lambda i: (i, i + 1)
    three = lambda i: (max(i - 1, 0), i, min(i + 1, 12))
    up = lambda k: (0,) if k > 5 else (3 - k // 2, 2 - k // 2) if k % 2 == 0 else (3 - k // 2, 2 - k // 2, max(1 - k // 2, 0))

    def vr(y, x):
        d = 2 * x - y
        return (two if y % 2 == 0 else three)(4 + x - y // 2) if d >= 0 else three(4) if d == -1 else three(5 + d)

    def hd(y, x):
        d = 2 * y - x
        return (two(3 - (y - x // 2)) if x % 2 == 0 else three(4 - (y - x // 2))) if d >= 0 else three(3 - d)

    def vl(y, x):
        return three(8 + y) if x == 3 and y > 1 else two(5 + x + y // 2) if y % 2 == 0 else three(6 + x + y // 2)

    rules = {VE: lambda y, x: three(5 + x), HE: lambda y, x: three(3 - y), RD: lambda y, x: three(4 + x - y), LD: lambda y, x: three(6 + x + y), VR: vr, VL: vl, HD: hd, HU: lambda y, x: up(2 * y + x)}
    return {m: [[rule(y, x) for x in range(4)] for y in range(4)] for m, rule in rules.items()}


_SMALL_PLACES = _small_places()


def small_block(mode: int, line: np.ndarray) -> np.ndarray:
    """A 4x4 prediction from 13 neighbours: the left column from the bottom, the corner, eight above."""
    e = line.astype(np.int64)
    left, top = e[3::-1], e[5:9]
    if mode == DC:
        return np.full((4, 4), int(left.sum() + top.sum()) + 4 >> 3, np.int64)
    if mode == TM:
        return np.clip(left[:, None] + top[None, :] - e[4], 0, 255)
    v = e.tolist()
    one = lambda p: v[p[0]] if len(p) == 1 else v[p[0]] + v[p[1]] + 1 >> 1 if len(p) == 2 else v[p[0]] + 2 * v[p[1]] + v[p[2]] + 2 >> 2
    return np.array([[one(p) for p in row] for row in _SMALL_PLACES[mode]], np.int64)


def best_small(block: np.ndarray, line: np.ndarray, weight: int) -> tuple[int, int, np.ndarray]:
    """The 4x4 mode of least squared error and price (a mean is cheaper than the others), the first of equal ones; its score and guess."""
    guesses = [small_block(m, line) for m in range(10)]
    scores = [256 * int(((block - g) ** 2).sum()) + weight * (250 if m == DC else 700) for m, g in enumerate(guesses)]
    m = int(np.argmin(scores))
    return m, scores[m], guesses[m]


# coefficients


def read_block(r: BoolReader, probabilities: list, context: int, first: int) -> tuple[list[int], int]:
    """Levels in scan order, and one more than the place of the last one coded."""
    out, n, p = [0] * 16, first, probabilities[BANDS[first]][context]
    while n < 16:
        if not r.bit(p[0]):
            return out, n
        while not r.bit(p[1]):
            n += 1
            if n == 16:
                return out, 16
            p = probabilities[BANDS[n]][0]
        if not r.bit(p[2]):
            v, following = 1, 1
        else:
            v, following = _large(r, p), 2
        out[n] = -v if r.bit(128) else v
        n += 1
        p = probabilities[BANDS[n]][following]
    return out, 16


def _large(r: BoolReader, p: list[int]) -> int:
    if not r.bit(p[3]):
        return 2 if not r.bit(p[4]) else 3 + r.bit(p[5])
    if not r.bit(p[6]):
        return 5 + r.bit(159) if not r.bit(p[7]) else 7 + 2 * r.bit(165) + r.bit(145)
    high = r.bit(p[8])
    kind = 2 * high + r.bit(p[9 + high])
    v = 0
    for q in CLASS_BITS[kind]:
        v = 2 * v + r.bit(q)
    return v + 3 + (8 << kind)


def write_block(put, levels: list[int], context: int, first: int) -> int:
    """Tokens of levels in scan order: put(band, context, slot, bit), or put(None, None, probability, bit) for fixed ones. Returns what read_block gives."""
    last = max((n for n in range(first, 16) if levels[n]), default=first - 1)
    n, band, after_zero = first, BANDS[first], False
    while n <= last:
        if not after_zero:
            put(band, context, 0, 1)
        v = abs(levels[n])
        put(band, context, 1, int(v > 0))
        if v:
            put(band, context, 2, int(v > 1))
            if v > 1:
                _put_large(put, band, context, v)
            put(None, None, 128, int(levels[n] < 0))
        after_zero = not v
        n += 1
        band, context = BANDS[n], min(v, 2)
    if n < 16:
        put(band, context, 0, 0)
    return n if last >= first else first


def _put_large(put, band: int, context: int, v: int) -> None:
    slot = lambda k, b: put(band, context, k, b)
    fixed = lambda p, b: put(None, None, p, b)
    slot(3, int(v > 4))
    if v <= 4:
        slot(4, int(v > 2))
        if v > 2:
            slot(5, v - 3)
        return
    slot(6, int(v > 10))
    if v <= 10:
        slot(7, int(v > 6))
        if v <= 6:
            fixed(159, v - 5)
        else:
            fixed(165, v - 7 >> 1)
            fixed(145, v - 7 & 1)
        return
    kind = max(k for k in range(4) if v >= 3 + (8 << k))
    slot(8, kind >> 1)
    slot(9 + (kind >> 1), kind & 1)
    rest, listed = v - 3 - (8 << kind), CLASS_BITS[kind]
    for i, p in enumerate(listed):
        fixed(p, rest >> len(listed) - 1 - i & 1)


def block_price(probabilities: list, context: int, first: int, levels: list[int]) -> float:
    """Bits of a block's tokens."""
    total = 0.0

    def put(band, c, slot, bit) -> None:
        nonlocal total
        p = slot if band is None else probabilities[band][c][slot]
        total -= np.log2((256 - p if bit else p) / 256)

    write_block(put, levels, context, first)
    return total


def trellis(c: np.ndarray, step: tuple[int, int], probabilities: list, context: int, first: int, weight: float) -> list[int]:
    """Levels of 16 coefficients (in scan order) of least squared error plus weight times bits.

    At each place the level may be the quotient rounded down or up; the path to each size class (0, 1, more), which decides
    the next place's context, is kept, and the block may end after any place.
    """

    def bits_of(band: int, c_: int, v: int, after_zero: bool) -> float:
        total = 0.0

        def put(b, k, slot, bit) -> None:
            nonlocal total
            p = slot if b is None else probabilities[b][k][slot]
            total -= np.log2((256 - p if bit else p) / 256)

        if not after_zero:
            put(band, c_, 0, 1)
        put(band, c_, 1, int(v > 0))
        if v:
            put(band, c_, 2, int(v > 1))
            if v > 1:
                _put_large(put, band, c_, v)
            put(None, None, 128, 0)
        return total

    size = np.abs(c).tolist()
    sign = [-1 if v < 0 else 1 for v in c.tolist()]
    q = [step[0] if n == 0 else step[1] for n in range(16)]
    rest = np.cumsum([0] + [v * v for v in size[::-1]])[::-1]  # error of zeros from each place on
    # class of the last level, whether it was zero -> (cost, levels)
    paths: dict[tuple[int, bool], tuple[float, list[int]]] = {(context, False): (0.0, [0] * first)}
    end = -np.log2(probabilities[BANDS[first]][context][0] / 256)
    best = (rest[first] + weight * end, [0] * first)
    for n in range(first, 16):
        following: dict[tuple[int, bool], tuple[float, list[int]]] = {}
        low = min(int(size[n] // q[n]), 2047)
        for (k, zero), (cost, levels) in paths.items():
            for v in {low, min(low + 1, 2047)} if size[n] else {0}:
                now = cost + (size[n] - v * q[n]) ** 2 + weight * bits_of(BANDS[n], k, v, zero)
                key = (min(v, 2), v == 0)
                if key not in following or now < following[key][0]:
                    following[key] = (now, levels + [v * sign[n]])
        for (k, zero), (cost, levels) in following.items():
            if not zero:
                over = -np.log2(probabilities[BANDS[n + 1]][k][0] / 256) if n < 15 else 0.0
                if cost + rest[n + 1] + weight * over < best[0]:
                    best = (cost + rest[n + 1] + weight * over, levels)
        paths = following
    return best[1] + [0] * (16 - len(best[1]))


# the loop filter


def _edge(px: np.ndarray, axis: int, at: int, lines: slice, wide: bool, limit: int, inner: int, steep: int, simple: bool) -> None:
    """Filters an edge before place `at` along an axis, for a range of lines across it."""
    take = lambda k: (lines, at + k) if axis else (at + k, lines)
    get = lambda k: px[take(k)].astype(np.int64)
    p1, p0, q0, q1 = (get(k) for k in (-2, -1, 0, 1))
    ok = 4 * np.abs(p0 - q0) + np.abs(p1 - q1) <= 2 * limit + 1
    signed, small = (lambda v: np.clip(v, -128, 127)), (lambda v: np.clip(v, -16, 15))

    def put(k: int, v: np.ndarray, where: np.ndarray) -> None:
        px[take(k)] = np.where(where, np.clip(v, 0, 255), px[take(k)])

    if simple:
        a = 3 * (q0 - p0) + signed(p1 - q1)
        put(-1, p0 + small(a + 3 >> 3), ok)
        put(0, q0 - small(a + 4 >> 3), ok)
        return
    p3, p2, q2, q3 = (get(k) for k in (-4, -3, 2, 3))
    for a, b in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0)):
        ok = ok & (np.abs(a - b) <= inner)
    rough = (np.abs(p1 - p0) > steep) | (np.abs(q1 - q0) > steep)
    a = 3 * (q0 - p0) + signed(p1 - q1)
    put(-1, p0 + small(a + 3 >> 3), ok & rough)
    put(0, q0 - small(a + 4 >> 3), ok & rough)
    flat = ok & ~rough
    if wide:
        w = signed(a)
        for k, p, q, m in ((0, p0, q0, 27), (1, p1, q1, 18), (2, p2, q2, 9)):
            put(-1 - k, p + (m * w + 63 >> 7), flat)
            put(k, q - (m * w + 63 >> 7), flat)
    else:
        b = 3 * (q0 - p0)
        a1, a2 = small(b + 4 >> 3), small(b + 3 >> 3)
        a3 = a1 + 1 >> 1
        for k, v in ((-2, p1 + a3), (-1, p0 + a2), (0, q0 - a1), (1, q1 - a3)):
            put(k, v, flat)


def strength(level: int, sharpness: int, key: bool = True) -> tuple[int, int, int]:
    """Edge limit, inner limit and steepness threshold of a level over 0."""
    inner = level
    if sharpness:
        inner = min(level >> (2 if sharpness > 4 else 1), 9 - sharpness)
    inner = max(inner, 1)
    return 2 * level + inner, inner, sum(level >= a for a in ((15, 40) if key else (15, 20, 40)))


def filter_frame(planes: list[np.ndarray], blocks: np.ndarray, simple: bool) -> None:
    """All macroblocks in raster order: left edge, inner vertical ones, top edge, inner horizontal ones.

    blocks[y, x] is (edge limit, inner limit, steepness, whether inner edges are filtered); a limit of 0 leaves a block out.
    """
    for my, row in enumerate(blocks):
        for mx, (limit, inner, steep, whole) in enumerate(row.tolist()):
            if not limit:
                continue
            for px, size in zip(planes, (16, 8, 8)):
                if simple and size == 8:
                    continue
                y, x = my * size, mx * size
                for axis, at, lines, first in ((1, x, slice(y, y + size), mx == 0), (0, y, slice(x, x + size), my == 0)):
                    if not first:
                        _edge(px, axis, at, lines, True, limit + 4, inner, steep, simple)
                    if whole:
                        for k in range(4, size, 4):
                            _edge(px, axis, at + k, lines, False, limit, inner, steep, simple)


# frames


@dataclass
class Header:
    """What the coded part of a frame's header says of segments, the filter and quantizers."""

    segmented: bool = False
    update_map: bool = False
    absolute: bool = False
    quantizers: tuple[int, ...] = (0, 0, 0, 0)
    strengths: tuple[int, ...] = (0, 0, 0, 0)
    segment_probabilities: tuple[int, ...] = (255, 255, 255)
    simple: bool = False
    level: int = 0
    sharpness: int = 0
    use_delta: bool = False
    ref_delta: tuple[int, ...] = (0, 0, 0, 0)
    mode_delta: tuple[int, ...] = (0, 0, 0, 0)
    base: int = 0
    deltas: tuple[int, ...] = (0, 0, 0, 0, 0)

    def of_segment(self, listed: tuple[int, ...], base: int, s: int) -> int:
        if not self.segmented:
            return base
        return listed[s] + (0 if self.absolute else base)

    def filter_level(self, s: int, small: bool) -> int:
        level = self.of_segment(self.strengths, self.level, s)
        if self.use_delta:
            level += self.ref_delta[0] + (self.mode_delta[0] if small else 0)
        return clamp_index(level, 63)


def frame_tag(data: bytes) -> tuple[bool, int, bool, int]:
    """Whether it is a key frame, profile, whether it is shown, size of the first partition."""
    if len(data) < 3:
        raise Invalid("a short frame")
    v = int.from_bytes(data[:3], "little")
    if v >> 1 & 7 > 3:
        raise Unsupported("a profile over 3")
    return not v & 1, v >> 1 & 7, bool(v >> 4 & 1), v >> 5


class Decoder:
    """Decodes key frames. `limit` is the most pixels of a frame, 0 or less for none."""

    def __init__(self, tables: Tables | None = None, limit: int = MOST_AREA):
        self.tables, self.limit = tables or Tables(), limit

    def decode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, _, _, first = frame_tag(data)
        if not key:
            raise Invalid("not a key frame")
        if len(data) < 10 or data[3:6] != b"\x9d\x01\x2a":
            raise Invalid("a bad start code")
        width, height = (v & 0x3FFF for v in struct.unpack("<HH", data[6:10]))
        if not width or not height:
            raise Invalid("a picture without pixels")
        if 0 < self.limit < width * height:
            raise Unsupported("a picture over the size limit")
        if first > len(data) - 10:
            raise Invalid("a first partition past the end")
        r, rest = BoolReader(data[10 : 10 + first]), data[10 + first :]
        r.bits(2)  # colour space and clamping
        h = self._header(r)
        parts = self._partitions(r, rest)
        h.base = r.bits(7)
        h.deltas = tuple(r.optional(4) for _ in range(5))
        r.flag()  # whether probabilities stay for later frames
        probabilities = self.tables.coefficients.copy()
        for i in np.ndindex(probabilities.shape):
            if r.bit(int(self.tables.updates[i])):
                probabilities[i] = r.bits(8)
        skip = r.bits(8) if r.flag() else None
        if r.past_end:
            raise Invalid("the header ends early")
        return self._pixels(r, parts, h, probabilities.tolist(), skip, width, height)

    def _header(self, r: BoolReader) -> Header:
        h = Header()
        h.segmented = r.flag()
        if h.segmented:
            h.update_map = r.flag()
            if r.flag():
                h.absolute = r.flag()
                h.quantizers = tuple(r.optional(7) for _ in range(4))
                h.strengths = tuple(r.optional(6) for _ in range(4))
            if h.update_map:
                h.segment_probabilities = tuple(r.bits(8) if r.flag() else 255 for _ in range(3))
        h.simple, h.level, h.sharpness = r.flag(), r.bits(6), r.bits(3)
        h.use_delta = r.flag()
        if h.use_delta and r.flag():
            h.ref_delta, h.mode_delta = (tuple(r.optional(6) for _ in range(4)) for _ in range(2))
        if r.past_end:
            raise Invalid("the header ends early")
        return h

    @staticmethod
    def _partitions(r: BoolReader, rest: bytes) -> list[BoolReader]:
        n = 1 << r.bits(2)
        sizes, rest = rest[: 3 * (n - 1)], rest[3 * (n - 1) :]
        if len(sizes) < 3 * (n - 1):
            raise Invalid("partition sizes end early")
        out = []
        for k in range(n - 1):
            size = int.from_bytes(sizes[3 * k : 3 * k + 3], "little")
            out.append(BoolReader(rest[:size]))
            rest = rest[size:]
        if not rest:
            raise Invalid("no last partition")
        return [*out, BoolReader(rest)]

    def _modes(self, r: BoolReader, top: list[int], left: list[int]) -> tuple[bool, list[int], int]:
        """Whether the block is of 4x4 ones, its modes, the chroma mode; top and left get the modes for neighbours."""
        small = not r.bit(SMALL_BLOCKS)
        if small:
            modes = []
            for y in range(4):
                for x in range(4):
                    top[x] = left[y] = self._small_mode(r, self.tables.small_modes[top[x], left[y]].tolist())
                    modes.append(top[x])
        else:
            mode = (TM if r.bit(LUMA_MODES[2]) else HE) if r.bit(LUMA_MODES[0]) else VE if r.bit(LUMA_MODES[1]) else DC
            modes = [mode]
            top[:], left[:] = [mode] * 4, [mode] * 4
        chroma = DC if not r.bit(CHROMA_MODES[0]) else VE if not r.bit(CHROMA_MODES[1]) else TM if r.bit(CHROMA_MODES[2]) else HE
        return small, modes, chroma

    @staticmethod
    def _small_mode(r: BoolReader, p: list[int]) -> int:
        for k, mode in enumerate((DC, TM, VE)):
            if not r.bit(p[k]):
                return mode
        if not r.bit(p[3]):
            return HE if not r.bit(p[4]) else RD if not r.bit(p[5]) else VR
        for k, mode in ((6, LD), (7, VL), (8, HD)):
            if not r.bit(p[k]):
                return mode
        return HU

    def _pixels(self, r: BoolReader, parts: list[BoolReader], h: Header, probabilities: list, skip: int | None, width: int, height: int):
        across, down = -(-width // 16), -(-height // 16)
        frame = Frame(across, down)
        quant = [steps(h.of_segment(h.quantizers, h.base, s), *h.deltas) for s in range(4)]
        top_modes, top_used = [[DC] * 4 for _ in range(across)], [[0] * 9 for _ in range(across)]
        for my in range(down):
            left_modes, left_used, part = [DC] * 4, [0] * 9, parts[my % len(parts)]
            for mx in range(across):
                s = 0
                if h.update_map:
                    p = h.segment_probabilities
                    s = 2 + r.bit(p[2]) if r.bit(p[0]) else r.bit(p[1])
                skipped = skip is not None and bool(r.bit(skip))
                small, modes, chroma = self._modes(r, top_modes[mx], left_modes)
                if skipped:
                    for used in (top_used[mx], left_used):
                        used[:8] = [0] * 8
                        if not small:
                            used[8] = 0
                    levels = None
                else:
                    levels = read_macroblock(part, probabilities, top_used[mx], left_used, small)
                    if part.past_end:
                        raise Invalid("coefficients end early")
                frame.add(mx, my, small, modes, chroma, levels, quant[s])
                level = h.filter_level(s, small)
                if level:
                    frame.filters[my, mx] = (*strength(level, h.sharpness), small or touched(levels, quant[s], small))
            if r.past_end:
                raise Invalid("modes end early")
        frame.smooth(h.simple)
        return frame.planes(width, height)


def contexts(kind: str, k: int) -> tuple[int, int]:
    """Places in the used-flags of the block above and of the one to the left, for block k of a kind."""
    if kind == "y":
        return k % 4, k // 4
    base = 4 if kind == "u" else 6
    return base + k % 2, base + k // 2


def read_macroblock(r: BoolReader, probabilities: list, top: list[int], left: list[int], small: bool) -> dict[tuple[str, int], list[int]]:
    """Levels by block; the flags of which neighbours have any are kept up to date."""
    out, first, kind = {}, 0, WHOLE_LUMA
    if not small:
        levels, n = read_block(r, probabilities[SECOND], top[8] + left[8], 0)
        top[8] = left[8] = int(n > 0)
        out["y2", 0] = levels
        first, kind = 1, FIRST_LUMA
    for name, count, type_, start in (("y", 16, kind, first), ("u", 4, CHROMA, 0), ("v", 4, CHROMA, 0)):
        for k in range(count):
            a, b = contexts(name, k)
            levels, n = read_block(r, probabilities[type_], top[a] + left[b], start)
            top[a] = left[b] = int(n > start)
            out[name, k] = levels
            if n > 1 and not any(levels[1:]):
                out["coded", 0] = [1]  # zeros to the end count as coefficients
    return out


def touched(levels: dict[tuple[str, int], list[int]] | None, quant: dict[int, tuple[int, int]], small: bool) -> bool:
    """Whether any block has coefficients, so that its inner edges are filtered."""
    if levels is None:
        return False
    if any(any(v[not small and name == "y" :]) for (name, _), v in levels.items() if name != "y2"):
        return True
    if small or not any(levels["y2", 0]):
        return False
    # second-order coefficients may still leave every block's DC zero
    c = np.array(levels["y2", 0], np.int64)[np.argsort(tb.ZIGZAG)] * np.array([quant[SECOND][0]] + [quant[SECOND][1]] * 15)
    return bool(inverse_wht(c.reshape(4, 4)).any())


def residual(levels: dict[tuple[str, int], list[int]] | None, quant: dict[int, tuple[int, int]], small: bool) -> dict[str, np.ndarray] | None:
    """Differences of all blocks: y 16 x 4 x 4, u and v 4 x 4 x 4; None if there are none."""
    if levels is None:
        return None
    raster = np.argsort(tb.ZIGZAG)

    def blocks(name: str, n: int, kind: int) -> np.ndarray:
        v = np.array([levels[name, k] for k in range(n)], np.int64)[:, raster]
        dc, ac = quant[kind]
        v[:, 0] *= dc
        v[:, 1:] *= ac
        return v.reshape(n, 4, 4)

    y = blocks("y", 16, FIRST_LUMA)
    if not small:
        y[:, 0, 0] = inverse_wht(blocks("y2", 1, SECOND)[0]).reshape(-1)
    return {"y": inverse_dct(y), "u": inverse_dct(blocks("u", 4, CHROMA)), "v": inverse_dct(blocks("v", 4, CHROMA))}


class Frame:
    """Planes being rebuilt, with a border of 127 above and 129 to the left."""

    def __init__(self, across: int, down: int):
        self.across, self.down = across, down
        self.px = []
        for size in (16, 8, 8):
            p = np.zeros((down * size + 1, across * size + 1 + 4), np.int64)
            p[1:, 0] = 129
            p[0, :] = 127
            self.px.append(p)
        self.filters = np.zeros((down, across, 4), np.int64)

    def around(self, plane: int, mx: int, my: int) -> tuple[np.ndarray, np.ndarray, int]:
        size, p = (16, 8, 8)[plane], self.px[plane]
        y, x = my * size + 1, mx * size + 1
        # above the frame all is 127, to its left 129 down to the first row
        corner = 127 if my == 0 else 129 if mx == 0 else int(p[y - 1, x - 1])
        return p[y - 1, x : x + size], p[y : y + size, x - 1], corner

    def line(self, mx: int, my: int, k: int) -> np.ndarray:
        """The 13 neighbours of a 4x4 block; beyond the macroblock's right edge those above the macroblock stand for all its rows."""
        p, by, bx = self.px[0], k // 4, k % 4
        y, x = my * 16 + 1 + 4 * by, mx * 16 + 1 + 4 * bx
        corner = 127 if my == 0 and by == 0 else 129 if mx == 0 and bx == 0 else p[y - 1, x - 1]
        top = p[y - 1, x : x + 4]
        if bx < 3:
            more = p[y - 1, x + 4 : x + 8]
        elif my == 0:
            more = np.full(4, 127)
        elif mx == self.across - 1:
            more = np.full(4, p[my * 16, mx * 16 + 16])
        else:
            more = p[my * 16, x + 4 : x + 8]
        return np.concatenate([p[y : y + 4, x - 1][::-1], [corner], top, more])

    def predicted(self, plane: int, mx: int, my: int, mode: int) -> np.ndarray:
        return whole_block(mode, *self.around(plane, mx, my), my > 0, mx > 0)

    def add(self, mx: int, my: int, small: bool, modes: list[int], chroma: int, levels, quant) -> None:
        d = residual(levels, quant, small)
        y, x, p = my * 16 + 1, mx * 16 + 1, self.px[0]
        if small:
            for k, mode in enumerate(modes):
                by, bx = y + 4 * (k // 4), x + 4 * (k % 4)
                p[by : by + 4, bx : bx + 4] = np.clip(small_block(mode, self.line(mx, my, k)) + (d["y"][k] if d else 0), 0, 255)
        else:
            whole = d["y"].reshape(4, 4, 4, 4).transpose(0, 2, 1, 3).reshape(16, 16) if d else 0
            p[y : y + 16, x : x + 16] = np.clip(self.predicted(0, mx, my, modes[0]) + whole, 0, 255)
        for plane, name in ((1, "u"), (2, "v")):
            part = d[name].reshape(2, 2, 4, 4).transpose(0, 2, 1, 3).reshape(8, 8) if d else 0
            y, x = my * 8 + 1, mx * 8 + 1
            self.px[plane][y : y + 8, x : x + 8] = np.clip(self.predicted(plane, mx, my, chroma) + part, 0, 255)

    def smooth(self, simple: bool) -> None:
        filter_frame(self.whole(), self.filters, simple)

    def whole(self) -> list[np.ndarray]:
        """Planes of whole macroblocks."""
        return [p[1:, 1 : 1 + self.across * s] for p, s in zip(self.px, (16, 8, 8))]

    def planes(self, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, h = width + 1 >> 1, height + 1 >> 1
        y, u, v = self.px
        return y[1 : height + 1, 1 : width + 1].astype(np.uint8), u[1 : h + 1, 1 : w + 1].astype(np.uint8), v[1 : h + 1, 1 : w + 1].astype(np.uint8)


def _padded(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(plane, ((0, rows - plane.shape[0]), (0, columns - plane.shape[1])), "edge").astype(np.int64)


def encode(y: np.ndarray, u: np.ndarray, v: np.ndarray, quality: int = 75, tables: Tables | None = None, small_blocks: bool = True) -> bytes:
    """A key frame: one segment and partition; per macroblock the cheapest whole-block mode, or 4x4 modes where they fit better."""
    return Encoder(quality, tables, small_blocks).encode(y, u, v)[0]


class Encoder:
    def __init__(self, quality: int = 75, tables: Tables | None = None, small_blocks: bool = True, by_trellis: bool = False):
        self.tables, self.small_blocks, self.base, self.by_trellis = tables or Tables(), small_blocks, quality_index(quality), by_trellis
        self.quant = steps(self.base)
        #: Weight of mode bits against squared error.
        self.weight = self.quant[FIRST_LUMA][1] ** 2 >> 7

    def _levels(self, d: np.ndarray, kind: int, rounding: int) -> np.ndarray:
        """Levels in scan order of n x 4 x 4 differences."""
        c = forward_dct(d).reshape(-1, 16)
        if self.by_trellis:
            odds, weight = self.tables.coefficients[kind].tolist(), self.quant[kind][1] ** 2 / 8
            return np.array([trellis(row[list(tb.ZIGZAG)], self.quant[kind], odds, 0, 0, weight) for row in c])
        return quantize(c, self.quant[kind], rounding)[:, list(tb.ZIGZAG)]

    def _whole(self, source: np.ndarray, guess: np.ndarray) -> dict[tuple[str, int], list[int]]:
        blocks = (source - guess).reshape(4, 4, 4, 4).transpose(0, 2, 1, 3).reshape(16, 4, 4)
        c = forward_dct(blocks)
        second = quantize(forward_wht(c[:, 0, 0].reshape(4, 4)).reshape(1, 16), self.quant[SECOND], 1)[:, list(tb.ZIGZAG)]
        flat = c.reshape(16, 16).copy()
        flat[:, 0] = 0
        levels = quantize(flat, self.quant[FIRST_LUMA], 0)[:, list(tb.ZIGZAG)]
        levels[:, 0] = 0
        return {("y2", 0): second[0].tolist(), **{("y", k): row.tolist() for k, row in enumerate(levels)}}

    def _small(self, frame: Frame, source: np.ndarray, mx: int, my: int) -> tuple[list[int], dict, int]:
        """4x4 modes one after the other, each on what the ones before rebuilt; the squared error of the whole."""
        p, modes, levels, error = frame.px[0], [], {}, 0
        y0, x0 = my * 16 + 1, mx * 16 + 1
        raster = np.argsort(tb.ZIGZAG)
        dc, ac = self.quant[WHOLE_LUMA]
        scale = np.array([dc] + [ac] * 15)
        for k in range(16):
            y, x = 4 * (k // 4), 4 * (k % 4)
            block, line = source[y : y + 4, x : x + 4], frame.line(mx, my, k)
            m, _, guess = best_small(block, line, self.weight)
            lv = self._levels((block - guess)[None], WHOLE_LUMA, 0)[0]
            back = inverse_dct((lv[raster] * scale).reshape(1, 4, 4))[0]
            rebuilt = np.clip(guess + back, 0, 255)
            p[y0 + y : y0 + y + 4, x0 + x : x0 + x + 4] = rebuilt
            error += int(((block - rebuilt) ** 2).sum())
            modes.append(m)
            levels["y", k] = lv.tolist()
        return modes, levels, error

    def encode(self, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The frame's bytes, and the planes that a decoder will give."""
        height, width = y.shape
        if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
            raise ValueError("a picture must have 1 to 16383 pixels a side")
        across, down = -(-width // 16), -(-height // 16)
        planes = [_padded(p, down * s, across * s) for p, s in ((y, 16), (u, 8), (v, 8))]
        frame, tokens, modes = Frame(across, down), [], BoolWriter()
        level = min(63, self.quant[FIRST_LUMA][1] >> 3)
        level = level if level >= 2 else 0
        top_modes, top_used = [[DC] * 4 for _ in range(across)], [[0] * 9 for _ in range(across)]
        decided = []
        for my in range(down):
            left_used = [0] * 9
            for mx in range(across):
                one = self._macroblock(frame, planes, mx, my)
                small, chosen, chroma, levels = one
                empty = not any(any(b) for b in levels.values())
                if empty:
                    for used in (top_used[mx], left_used):
                        used[:8] = [0] * 8
                        if not small:
                            used[8] = 0
                else:
                    self._tokens(tokens, levels, top_used[mx], left_used, small)
                frame.add(mx, my, small, chosen, chroma, None if empty else levels, self.quant)
                if level:
                    frame.filters[my, mx] = (*strength(level, 0), small or touched(None if empty else levels, self.quant, small))
                decided.append((empty, small, chosen, chroma))
        skips = sum(d[0] for d in decided)
        skip = max(1, (len(decided) - skips) * 255 // len(decided))
        fresh = self.current = self._probabilities(tokens, self.tables.coefficients)
        self._head(modes, level, fresh, skip)
        for k, (empty, small, chosen, chroma) in enumerate(decided):
            if k % across == 0:
                left_modes = [DC] * 4
            modes.bit(int(empty), skip)
            self._put_modes(modes, small, chosen, chroma, top_modes[k % across], left_modes)
        part = BoolWriter()
        for band, bit in tokens:
            part.bit(bit, band if isinstance(band, int) else int(fresh[band]))
        first, second = modes.bytes(), part.bytes()
        if len(first) >= MOST_FIRST:
            if self.small_blocks:
                self.small_blocks = False
                return self.encode(y, u, v)
            raise Unsupported("modes take more than 512 KB")
        tag = len(first) << 5 | 1 << 4
        frame.smooth(False)
        self.rebuilt = frame.whole()
        head = tag.to_bytes(3, "little") + b"\x9d\x01\x2a" + struct.pack("<HH", width, height)
        return head + first + second, frame.planes(width, height)

    def _macroblock(self, frame: Frame, planes: list[np.ndarray], mx: int, my: int):
        source = planes[0][my * 16 : my * 16 + 16, mx * 16 : mx * 16 + 16]
        guesses = [frame.predicted(0, mx, my, m) for m in range(4)]
        scores = [256 * int(((source - g) ** 2).sum()) + self.weight * c for g, c in zip(guesses, tb.LUMA_MODE_COST)]
        best = int(np.argmin(scores))
        levels, small, chosen = self._whole(source, guesses[best]), False, [best]
        if self.small_blocks:
            frame.add(mx, my, False, chosen, DC, {**levels, **{(n, k): [0] * 16 for n in "uv" for k in range(4)}}, self.quant)
            y, x = my * 16 + 1, mx * 16 + 1
            error = int(((frame.px[0][y : y + 16, x : x + 16] - source) ** 2).sum())
            modes, fine, small_error = self._small(frame, source, mx, my)
            bits = lambda lv: sum(2 * int(v).bit_length() + 1 for b in lv.values() for v in map(abs, b) if v)
            cost = lambda e, lv, header: 256 * e + self.weight * (256 * bits(lv) + header)
            if cost(small_error, fine, 16 * 600 + 211) < cost(error, levels, tb.LUMA_MODE_COST[best]):
                levels, small, chosen = fine, True, modes
        area = (slice(my * 8, my * 8 + 8), slice(mx * 8, mx * 8 + 8))
        chroma_guess = [[frame.predicted(p, mx, my, m) for p in (1, 2)] for m in range(4)]
        errors = [sum(int(((planes[p][area] - g[p - 1]) ** 2).sum()) for p in (1, 2)) * 256 + self.weight * c for g, c in zip(chroma_guess, tb.CHROMA_MODE_COST)]
        chroma = int(np.argmin(errors))
        for p, name in ((1, "u"), (2, "v")):
            blocks = (planes[p][area] - chroma_guess[chroma][p - 1]).reshape(2, 4, 2, 4).transpose(0, 2, 1, 3).reshape(4, 4, 4)
            levels |= {(name, k): row.tolist() for k, row in enumerate(self._levels(blocks, CHROMA, 2))}
        return small, chosen, chroma, levels

    @staticmethod
    def _tokens(out: list, levels: dict, top: list[int], left: list[int], small: bool) -> None:
        def block(kind: int, lv: list[int], context: int, first: int) -> int:
            return write_block(lambda band, c, slot, bit: out.append((slot if band is None else (kind, band, c, slot), bit)), lv, context, first)

        first, kind = 0, WHOLE_LUMA
        if not small:
            top[8] = left[8] = int(block(SECOND, levels["y2", 0], top[8] + left[8], 0) > 0)
            first, kind = 1, FIRST_LUMA
        for name, count, type_, start in (("y", 16, kind, first), ("u", 4, CHROMA, 0), ("v", 4, CHROMA, 0)):
            for k in range(count):
                a, b = contexts(name, k)
                top[a] = left[b] = int(block(type_, levels[name, k], top[a] + left[b], start) > start)

    def _probabilities(self, tokens: list, old: np.ndarray) -> np.ndarray:
        """The old ones, replaced where the frame's own shares save more than an update costs."""
        counts = np.zeros((4, 8, 3, 11, 2), np.int64)
        for slot, bit in tokens:
            if not isinstance(slot, int):
                counts[(*slot, bit)] += 1
        n0, n1 = counts[..., 0], counts[..., 1]
        fresh = np.clip(n0 * 256 // np.maximum(n0 + n1, 1), 1, 254)
        cost = lambda p: np.floor(-np.log2(p / 256) * 256)
        price = lambda p: n0 * cost(p) + n1 * cost(256 - p)
        up = self.tables.updates
        better = price(fresh) + cost(256 - up) + 8 * 256 < price(old) + cost(up)
        return np.where(better & (n0 + n1 > 0), fresh, old)

    def _head(self, w: BoolWriter, level: int, fresh: np.ndarray, skip: int) -> None:
        w.bits(0, 2)
        w.flag(False)  # no segments
        w.flag(False)  # the normal filter
        w.bits(level, 6)
        w.bits(0, 3)
        w.flag(False)  # no deltas
        w.bits(0, 2)  # one partition
        w.bits(self.base, 7)
        for _ in range(5):
            w.flag(False)
        w.flag(True)
        for i in np.ndindex(fresh.shape):
            changed = fresh[i] != self.tables.coefficients[i]
            w.bit(int(changed), int(self.tables.updates[i]))
            if changed:
                w.bits(int(fresh[i]), 8)
        w.flag(True)
        w.bits(skip, 8)

    def _put_modes(self, w: BoolWriter, small: bool, modes: list[int], chroma: int, top: list[int], left: list[int]) -> None:
        w.bit(int(not small), SMALL_BLOCKS)
        if small:
            for k, mode in enumerate(modes):
                y, x = divmod(k, 4)
                self._put_small(w, mode, self.tables.small_modes[top[x], left[y]].tolist())
                top[x] = left[y] = mode
        else:
            mode = modes[0]
            w.bit(int(mode in (TM, HE)), LUMA_MODES[0])
            if mode in (TM, HE):
                w.bit(int(mode == TM), LUMA_MODES[2])
            else:
                w.bit(int(mode == VE), LUMA_MODES[1])
            top[:], left[:] = [mode] * 4, [mode] * 4
        w.bit(int(chroma != DC), CHROMA_MODES[0])
        if chroma != DC:
            w.bit(int(chroma != VE), CHROMA_MODES[1])
            if chroma != VE:
                w.bit(int(chroma == TM), CHROMA_MODES[2])

    @staticmethod
    def _put_small(w: BoolWriter, mode: int, p: list[int]) -> None:
        for k, m in enumerate((DC, TM, VE)):
            w.bit(int(mode != m), p[k])
            if mode == m:
                return
        late = mode in (LD, VL, HD, HU)
        w.bit(int(late), p[3])
        if not late:
            w.bit(int(mode != HE), p[4])
            if mode != HE:
                w.bit(int(mode == VR), p[5])
            return
        for k, m in ((6, LD), (7, VL), (8, HD)):
            w.bit(int(mode != m), p[k])
            if mode == m:
                return
