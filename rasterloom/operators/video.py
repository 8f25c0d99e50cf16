"""Lossy video: frames that predict from three kept ones (last, golden, alternate), beside key frames.

Vectors are in eighths of a luma pixel. What a decoder carries from frame to frame (references, probabilities,
segments, filter deltas, sign biases) is the state of one object; a frame that fails leaves it unusable until
the next key frame.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions import tables as tb
from . import lossy
from .bits import Invalid, Unsupported
from .boolcoder import BoolReader, BoolWriter
from .lossy import DC, HE, TM, VE, Frame, Header, Tables, steps, strength, touched

INTRA, LAST, GOLDEN, ALTERNATE = range(4)
NEAREST, NEAR, ZERO, NEW, SPLIT = range(5)
IS_SHORT, SIGN, SHORT, LONG, LONG_BITS = 0, 1, 2, 9, 10

# Probabilities that a vector's are replaced, and those it starts from, for rows and columns.
VECTOR_UPDATES = (
    (237, 246, 253, 253, 254, 254, 254, 254, 254, 254, 254, 254, 254, 254, 250, 250, 252, 254, 254),
    (231, 243, 245, 253, 254, 254, 254, 254, 254, 254, 254, 254, 254, 254, 251, 251, 254, 254, 254),
)
VECTOR_DEFAULTS = (
    (162, 128, 225, 146, 172, 147, 214, 39, 156, 128, 129, 132, 75, 145, 178, 206, 239, 254, 254),
    (164, 128, 204, 170, 119, 235, 140, 230, 228, 128, 130, 130, 74, 148, 180, 203, 236, 254, 254),
)
# Probabilities of inter modes by how much neighbours agree; of a part's vector by its neighbours'.
MODE_CONTEXTS = ((7, 1, 1, 143), (14, 18, 14, 107), (135, 64, 57, 68), (60, 56, 128, 65), (159, 134, 128, 34), (234, 188, 128, 28))
PART_CONTEXTS = ((147, 136, 18), (223, 1, 34), (106, 145, 1), (208, 1, 1), (179, 121, 1), (223, 1, 34), (179, 121, 1), (208, 1, 1))
# Intra mode probabilities that inter frames start from.
LUMA_START, CHROMA_START, SMALL_START = (112, 86, 140, 37), (162, 101, 204), (120, 90, 79, 133, 87, 85, 80, 111, 151)
#: Which part of a split each of the 16 blocks belongs to: halves, halves, quarters, sixteenths.
SPLITS = (tuple(k // 8 for k in range(16)), tuple(k % 4 // 2 for k in range(16)), tuple(k // 8 * 2 + k % 4 // 2 for k in range(16)), tuple(range(16)))

Vector = tuple[int, int]
NONE: Vector = (0, 0)


@dataclass
class Block:
    """What neighbours need to know of a macroblock: its reference, its vector, and its parts' vectors if it is split."""

    reference: int = INTRA
    vector: Vector = NONE
    parts: list[Vector] | None = None

    def part(self, k: int) -> Vector:
        return self.parts[k] if self.parts else self.vector


@dataclass(frozen=True)
class Bounds:
    """How far a macroblock's vectors may reach."""

    left: int
    right: int
    top: int
    bottom: int

    @classmethod
    def of(cls, mx: int, my: int, across: int, down: int) -> Bounds:
        return cls(-mx * 128, (across - 1 - mx) * 128, -my * 128, (down - 1 - my) * 128)

    def clamp(self, v: Vector) -> Vector:
        """At most 16 pixels beyond the frame."""
        return min(max(v[0], self.top - 128), self.bottom + 128), min(max(v[1], self.left - 128), self.right + 128)

    def outside(self, v: Vector) -> bool:
        return self.clamp(v) != v

    def to_border(self, v: Vector, shift: int) -> Vector:
        """A vector far outside goes back to a margin of 16 pixels; shift 1 for chroma's."""

        def one(c: int, low: int, high: int) -> int:
            return low - 128 >> shift if c << shift < low - 152 else high + 128 >> shift if c << shift > high + 144 else c

        return one(v[0], self.top, self.bottom), one(v[1], self.left, self.right)


def near_vectors(above: Block, left: Block, corner: Block, reference: int, bias: list[bool]) -> tuple[list[Vector], list[int]]:
    """Candidates (best, nearest, near) before clamping, and the four counts that choose mode probabilities."""
    found, counts = [NONE], [0, 0, 0, 0]
    for block, weight in ((above, 2), (left, 2), (corner, 1)):
        if block.reference == INTRA:
            continue
        if block.vector == NONE:
            counts[0] += weight
            continue
        v = block.vector
        if bias[block.reference] != bias[reference]:
            v = (-v[0], -v[1])
        if v != found[-1]:
            found.append(v)
        counts[len(found) - 1] += weight
    found += [NONE] * (4 - len(found))
    if counts[3] and found[3] == found[1]:
        counts[1] += 1
    if counts[2] > counts[1]:
        counts[1], counts[2] = counts[2], counts[1]
        found[1], found[2] = found[2], found[1]
    best = found[0] if counts[1] < counts[0] else found[1]
    counts[3] = 2 * bool(above.parts) + 2 * bool(left.parts) + bool(corner.parts)
    return [best, found[1], found[2]], counts


def read_component(r: BoolReader, p: list[int]) -> int:
    if r.bit(p[IS_SHORT]):
        v = sum(r.bit(p[LONG + k]) << k for k in range(3))
        v += sum(r.bit(p[LONG + k]) << k for k in range(LONG_BITS - 1, 3, -1))
        if not v & 0xFFF0 or r.bit(p[LONG + 3]):
            v += 8
    else:
        v = at = 0
        for level in range(3):  # a full tree of three levels, its nodes in preorder
            b = r.bit(p[SHORT + at])
            v = v << 1 | b
            at = at + 1 if not b else at + (4, 2, 1)[level]
    return -v if v and r.bit(p[SIGN]) else v


def write_component(w: BoolWriter, p: list[int], v: int) -> None:
    size = abs(v)
    w.bit(int(size > 7), p[IS_SHORT])
    if size > 7:
        for k in (*range(3), *range(LONG_BITS - 1, 3, -1)):
            w.bit(size >> k & 1, p[LONG + k])
        if size & 0xFFF0:
            w.bit(size >> 3 & 1, p[LONG + 3])
    else:
        at = 0
        for level in range(3):
            b = size >> 2 - level & 1
            w.bit(b, p[SHORT + at])
            at = at + 1 if not b else at + (4, 2, 1)[level]
    if size:
        w.bit(int(v < 0), p[SIGN])


def _taps(px: np.ndarray, taps: tuple[int, ...], axis: int) -> np.ndarray:
    n = len(taps)
    size = px.shape[axis] - n + 1
    total = sum(np.take(px, range(k, k + size), axis) * t for k, t in enumerate(taps) if t)
    return total + 64 >> 7


def predicted(plane: np.ndarray, y: int, x: int, h: int, w: int, v: Vector, six: bool) -> np.ndarray:
    """A block moved by a vector; pixels outside the plane repeat its edge."""
    y, x, fy, fx = y + (v[0] >> 3), x + (v[1] >> 3), v[0] & 7, v[1] & 7
    before, after = (2, 3) if six else (0, 1)
    rows = np.clip(np.arange(y - before, y + h + after), 0, plane.shape[0] - 1)
    columns = np.clip(np.arange(x - before, x + w + after), 0, plane.shape[1] - 1)
    px = plane[rows][:, columns].astype(np.int64)
    if not fy and not fx:
        return px[before : before + h, before : before + w]
    if six:
        wide = np.clip(_taps(px, tb.SIX_TAP[fx], 1), 0, 255) if fx else px[:, 2:-3]
        return np.clip(_taps(wide, tb.SIX_TAP[fy], 0), 0, 255) if fy else wide[2:-3]
    return np.clip(_taps(_taps(px, tb.TWO_TAP[fx], 1), tb.TWO_TAP[fy], 0), 0, 255)


def _halved(c: int, mask: int) -> int:
    return (-(1 - c >> 1) if c < 0 else c + 1 >> 1) & mask


def chroma_vector(v: Vector, mask: int = -1) -> Vector:
    """Half a luma vector, rounded away from zero."""
    return _halved(v[0], mask), _halved(v[1], mask)


def mean_vector(parts: list[Vector], mask: int = -1) -> Vector:
    """An eighth of the sum of four, rounded half away from zero."""
    one = lambda s: (-(4 - s >> 3) if s < 0 else s + 4 >> 3) & mask
    return one(sum(v[0] for v in parts)), one(sum(v[1] for v in parts))


@dataclass
class State:
    """All that lasts from one frame to the next."""

    across: int = 0
    down: int = 0
    width: int = 0
    height: int = 0
    references: dict[int, list[np.ndarray]] = field(default_factory=dict)
    coefficients: np.ndarray | None = None
    vectors: list[list[int]] = field(default_factory=list)
    luma: list[int] = field(default_factory=list)
    chroma: list[int] = field(default_factory=list)
    bias: list[bool] = field(default_factory=lambda: [False] * 4)
    header: Header = field(default_factory=Header)
    segments: np.ndarray | None = None

    def entropy(self) -> tuple:
        return self.coefficients.copy(), [list(p) for p in self.vectors], list(self.luma), list(self.chroma)

    def rotate(self, planes: list[np.ndarray], copy_alt: int, copy_golden: int, golden: bool, alt: bool, last: bool) -> None:
        """The copy into the alternate reference first, then into golden, then refreshes."""
        r = self.references
        if copy_alt:
            r[ALTERNATE] = r[LAST if copy_alt == 1 else GOLDEN]
        if copy_golden:
            r[GOLDEN] = r[LAST if copy_golden == 1 else ALTERNATE]
        for name, take in ((GOLDEN, golden), (ALTERNATE, alt), (LAST, last)):
            if take:
                r[name] = planes


def compensated(references: list[np.ndarray], block: Block, mx: int, my: int, bounds: Bounds, clamp: bool, six: bool, mask: int = -1) -> list[np.ndarray]:
    """Predictions of a macroblock's three planes."""
    y, u, v = references
    if not block.parts:
        vector = bounds.to_border(block.vector, 0) if clamp else block.vector
        c = chroma_vector(vector, mask)
        return [predicted(y, my * 16, mx * 16, 16, 16, vector, six), predicted(u, my * 8, mx * 8, 8, 8, c, six), predicted(v, my * 8, mx * 8, 8, 8, c, six)]
    out = [np.zeros((16, 16), np.int64), np.zeros((8, 8), np.int64), np.zeros((8, 8), np.int64)]
    for k, part in enumerate(block.parts):
        by, bx = 4 * (k // 4), 4 * (k % 4)
        part = bounds.to_border(part, 0) if clamp else part
        out[0][by : by + 4, bx : bx + 4] = predicted(y, my * 16 + by, mx * 16 + bx, 4, 4, part, six)
    for k in range(4):
        n = k // 2 * 8 + k % 2 * 2
        c = mean_vector([block.parts[i] for i in (n, n + 1, n + 4, n + 5)], mask)
        c = bounds.to_border(c, 1) if clamp else c
        by, bx = 4 * (k // 2), 4 * (k % 2)
        for plane, to in ((u, out[1]), (v, out[2])):
            to[by : by + 4, bx : bx + 4] = predicted(plane, my * 8 + by, mx * 8 + bx, 4, 4, c, six)
    return out


def add_moved(frame: Frame, mx: int, my: int, guess: list[np.ndarray], levels, quant, split: bool) -> None:
    d = lossy.residual(levels, quant, split)
    for plane, (name, size, n) in enumerate((("y", 16, 4), ("u", 8, 2), ("v", 8, 2))):
        y, x = my * size + 1, mx * size + 1
        part = d[name].reshape(n, n, 4, 4).transpose(0, 2, 1, 3).reshape(size, size) if d else 0
        frame.px[plane][y : y + size, x : x + size] = np.clip(guess[plane] + part, 0, 255)


def filter_level(h: Header, segment: int, reference: int, kind: int) -> int:
    """kind: 0 intra 4x4, 1 other intra or zero vector, 2 one vector, 3 split."""
    level = h.of_segment(h.strengths, h.level, segment)
    if h.use_delta:
        level += h.ref_delta[reference]
        if reference != INTRA or kind == 0:
            level += h.mode_delta[kind]
    return lossy.clamp_index(level, 63)


class VideoDecoder(lossy.Decoder):
    """decode() takes frames in order and gives planes, or None for a frame that isn't shown."""

    def __init__(self, tables: Tables | None = None, limit: int = lossy.MOST_AREA):
        super().__init__(tables, limit)
        self.state = State()

    def decode(self, data: bytes):
        key, profile, show, first = lossy.frame_tag(data)
        s, at = self.state, 3
        if key:
            if len(data) < 10 or data[3:6] != b"\x9d\x01\x2a":
                raise Invalid("a bad start code")
            width, height = (v & 0x3FFF for v in struct.unpack("<HH", data[6:10]))
            if not width or not height:
                raise Invalid("a picture without pixels")
            if 0 < self.limit < width * height:
                raise Unsupported("a picture over the size limit")
            at = 10
            s = self.state = State(-(-width // 16), -(-height // 16), width, height, s.references)
            s.coefficients, s.vectors = self.tables.coefficients.copy(), [list(p) for p in VECTOR_DEFAULTS]
            s.luma, s.chroma, s.segments = list(LUMA_START), list(CHROMA_START), np.zeros((s.down, s.across), np.int64)
        elif LAST not in s.references or not s.across:
            raise Invalid("no key frame yet")
        if first > len(data) - at:
            raise Invalid("a first partition past the end")
        r, rest = BoolReader(data[at : at + first]), data[at + first :]
        if key:
            r.bits(2)
        self._update_header(r, s.header)
        parts = self._partitions(r, rest)
        h = s.header
        h.base, h.deltas = r.bits(7), tuple(r.optional(4) for _ in range(5))
        golden = alt = last = True
        copy_golden = copy_alt = 0
        if not key:
            golden, alt = r.flag(), r.flag()
            copy_golden = 0 if golden else r.bits(2)
            copy_alt = 0 if alt else r.bits(2)
            s.bias[GOLDEN], s.bias[ALTERNATE] = r.flag(), r.flag()
        keep = r.flag()
        saved = None if keep else s.entropy()
        last = key or r.flag()
        for i in np.ndindex(s.coefficients.shape):
            if r.bit(int(self.tables.updates[i])):
                s.coefficients[i] = r.bits(8)
        skip = r.bits(8) if r.flag() else None
        odds = (0, 0, 0)
        if not key:
            odds = (r.bits(8), r.bits(8), r.bits(8))
            if r.flag():
                s.luma = [r.bits(8) for _ in range(4)]
            if r.flag():
                s.chroma = [r.bits(8) for _ in range(3)]
            for p, updates in zip(s.vectors, VECTOR_UPDATES):
                for k, u in enumerate(updates):
                    if r.bit(u):
                        p[k] = r.bits(7) * 2 or 1
        if r.past_end:
            raise Invalid("the header ends early")
        frame = self._macroblocks(r, parts, key, profile, skip, odds)
        frame.smooth(h.simple)
        planes = frame.whole()
        if saved:
            s.coefficients, s.vectors, s.luma, s.chroma = saved
        s.rotate(planes, copy_alt, copy_golden, golden, alt, last)
        return frame.planes(s.width, s.height) if show else None

    def _update_header(self, r: BoolReader, h: Header) -> None:
        """What a frame's header doesn't say of segments and deltas stays as it was."""
        new = self._header_parts(r)
        h.segmented, h.update_map = new["segmented"], new["update_map"]
        for name in ("absolute", "quantizers", "strengths"):
            setattr(h, name, new.get(name, getattr(h, name)))
        for name in ("ref_delta", "mode_delta"):
            old = getattr(h, name)
            setattr(h, name, tuple(b if a is None else a for a, b in zip(new.get(name, (None,) * 4), old)))
        h.segment_probabilities = new["segment_probabilities"]
        h.simple, h.level, h.sharpness, h.use_delta = new["simple"], new["level"], new["sharpness"], new["use_delta"]

    @staticmethod
    def _header_parts(r: BoolReader) -> dict:
        out = {"segmented": r.flag(), "update_map": False, "segment_probabilities": (255, 255, 255)}
        if out["segmented"]:
            out["update_map"] = r.flag()
            if r.flag():
                out["absolute"] = r.flag()
                out["quantizers"] = tuple(r.optional(7) for _ in range(4))
                out["strengths"] = tuple(r.optional(6) for _ in range(4))
            if out["update_map"]:
                out["segment_probabilities"] = tuple(r.bits(8) if r.flag() else 255 for _ in range(3))
        out |= {"simple": r.flag(), "level": r.bits(6), "sharpness": r.bits(3), "use_delta": r.flag()}
        if out["use_delta"] and r.flag():
            for name in ("ref_delta", "mode_delta"):
                out[name] = tuple(r.signed(6) if r.flag() else None for _ in range(4))
        if r.past_end:
            raise Invalid("the header ends early")
        return out

    def _macroblocks(self, r: BoolReader, parts: list[BoolReader], key: bool, profile: int, skip: int | None, odds: tuple[int, int, int]) -> Frame:
        s, h = self.state, self.state.header
        frame, probabilities = Frame(s.across, s.down), s.coefficients.tolist()
        quant = [steps(h.of_segment(h.quantizers, h.base, k), *h.deltas) for k in range(4)]
        blocks = [[Block() for _ in range(s.across + 1)] for _ in range(s.down + 1)]
        top_modes, top_used = [[DC] * 4 for _ in range(s.across)], [[0] * 9 for _ in range(s.across)]
        six, mask = profile == 0, ~7 if profile == 3 else -1
        for my in range(s.down):
            left_modes, left_used, part = [DC] * 4, [0] * 9, parts[my % len(parts)]
            for mx in range(s.across):
                if h.update_map:
                    p = h.segment_probabilities
                    s.segments[my, mx] = 2 + r.bit(p[2]) if r.bit(p[0]) else r.bit(p[1])
                elif key:
                    s.segments[my, mx] = 0
                segment = int(s.segments[my, mx])
                skipped = skip is not None and bool(r.bit(skip))
                block, clamp, bounds = Block(), False, Bounds.of(mx, my, s.across, s.down)
                if key:
                    small, modes, chroma = self._modes(r, top_modes[mx], left_modes)
                elif r.bit(odds[0]):
                    block, clamp = self._vectors(r, blocks, mx, my, odds, bounds)
                    small = block.parts is not None
                else:
                    small, modes, chroma = self._intra(r)
                blocks[my + 1][mx + 1] = block
                levels = None
                if skipped:
                    for used in (top_used[mx], left_used):
                        used[:8] = [0] * 8
                        if not small:
                            used[8] = 0
                else:
                    levels = lossy.read_macroblock(part, probabilities, top_used[mx], left_used, small)
                    if part.past_end:
                        raise Invalid("coefficients end early")
                if block.reference:
                    add_moved(frame, mx, my, compensated(s.references[block.reference], block, mx, my, bounds, clamp, six, mask), levels, quant[segment], small)
                    kind = 3 if small else 1 if self.mode == ZERO else 2
                else:
                    frame.add(mx, my, small, modes, chroma, levels, quant[segment])
                    kind = 0 if small else 1
                level = filter_level(h, segment, block.reference, kind)
                if level:
                    frame.filters[my, mx] = (*strength(level, h.sharpness, key), small or touched(levels, quant[segment], small))
            if r.past_end:
                raise Invalid("modes end early")
        return frame

    def _intra(self, r: BoolReader) -> tuple[bool, list[int], int]:
        """An intra macroblock of an inter frame: modes by the frame's own probabilities, without contexts."""
        p, q = self.state.luma, self.state.chroma
        if not r.bit(p[0]):
            mode = DC
        elif not r.bit(p[1]):
            mode = HE if r.bit(p[2]) else VE
        else:
            mode = -1 if r.bit(p[3]) else TM
        modes = [self._small_mode(r, list(SMALL_START)) for _ in range(16)] if mode < 0 else [mode]
        chroma = DC if not r.bit(q[0]) else VE if not r.bit(q[1]) else TM if r.bit(q[2]) else HE
        return mode < 0, modes, chroma

    def _vectors(self, r: BoolReader, blocks: list[list[Block]], mx: int, my: int, odds: tuple[int, int, int], bounds: Bounds) -> tuple[Block, bool]:
        s = self.state
        reference = LAST if not r.bit(odds[1]) else GOLDEN + r.bit(odds[2])
        above, left, corner = blocks[my][mx + 1], blocks[my + 1][mx], blocks[my][mx]
        found, counts = near_vectors(above, left, corner, reference, s.bias)
        best, nearest, near = (bounds.clamp(v) for v in found)
        p = [MODE_CONTEXTS[c][k] for k, c in enumerate(counts)]
        block = Block(reference)
        self.mode = ZERO
        if not r.bit(p[0]):
            return block, False
        if not r.bit(p[1]):
            self.mode, block.vector = NEAREST, nearest
            return block, False
        if not r.bit(p[2]):
            self.mode, block.vector = NEAR, near
            return block, False
        if not r.bit(p[3]):
            self.mode, block.vector = NEW, self._new(r, best)
            return block, bounds.outside(block.vector)
        self.mode = SPLIT
        return block, self._split(r, block, above, left, best, bounds)

    def _new(self, r: BoolReader, best: Vector) -> Vector:
        row = read_component(r, self.state.vectors[0]) * 2
        return best[0] + row, best[1] + read_component(r, self.state.vectors[1]) * 2

    def _split(self, r: BoolReader, block: Block, above: Block, left: Block, best: Vector, bounds: Bounds) -> bool:
        kind = 3 if not r.bit(110) else 2 if not r.bit(111) else r.bit(150)
        parts: list[Vector] = [NONE] * 16
        far = False
        for j in range(max(SPLITS[kind]) + 1):
            k = SPLITS[kind].index(j)
            beside = parts[k - 1] if k % 4 else left.part(k + 3)
            over = parts[k - 4] if k > 3 else above.part(k + 12)
            p = PART_CONTEXTS[4 * (over == NONE) + 2 * (beside == NONE) + (beside == over)]
            v = beside if not r.bit(p[0]) else over if not r.bit(p[1]) else self._new(r, best) if r.bit(p[2]) else NONE
            far = far or bounds.outside(v)
            parts = [v if SPLITS[kind][i] == j else old for i, old in enumerate(parts)]
        block.parts, block.vector = parts, parts[15]
        return far


class VideoEncoder(lossy.Encoder):
    """Frames one after the other: key frames, and frames that predict from the last one only, without splits."""

    def __init__(self, quality: int = 75, tables: Tables | None = None, small_blocks: bool = True, reach: int = 4):
        super().__init__(quality, tables, small_blocks)
        #: Whole pixels that the vector search goes from the best candidate at once.
        self.reach = reach
        self.last: list[np.ndarray] | None = None
        #: Macroblocks of the last frame that predict from the one before.
        self.moved = 0

    def encode_key(self, y: np.ndarray, u: np.ndarray, v: np.ndarray):
        data, planes = self.encode(y, u, v)
        self.size, self.last = y.shape, self.rebuilt
        return data, planes

    def encode_inter(self, y: np.ndarray, u: np.ndarray, v: np.ndarray):
        if self.last is None or y.shape != self.size:
            raise ValueError("a frame of another size than the key frame's, or no key frame")
        height, width = y.shape
        across, down = -(-width // 16), -(-height // 16)
        planes = [lossy._padded(p, down * s, across * s) for p, s in ((y, 16), (u, 8), (v, 8))]
        frame, tokens, decided = Frame(across, down), [], []
        blocks = [[Block() for _ in range(across + 1)] for _ in range(down + 1)]
        top_used = [[0] * 9 for _ in range(across)]
        level = min(63, self.quant[0][1] >> 3)
        level = level if level >= 2 else 0
        for my in range(down):
            left_used = [0] * 9
            for mx in range(across):
                block, mode, best, counts, intra = self._choose(frame, planes, blocks, mx, my, across, down)
                bounds = Bounds.of(mx, my, across, down)
                if block.reference:
                    guess = compensated(self.last, block, mx, my, bounds, False, True)
                    levels = self._whole(planes[0][my * 16 : my * 16 + 16, mx * 16 : mx * 16 + 16], guess[0])
                    area = (slice(my * 8, my * 8 + 8), slice(mx * 8, mx * 8 + 8))
                    for p, name in ((1, "u"), (2, "v")):
                        d = (planes[p][area] - guess[p]).reshape(2, 4, 2, 4).transpose(0, 2, 1, 3).reshape(4, 4, 4)
                        levels |= {(name, k): row.tolist() for k, row in enumerate(self._levels(d, lossy.CHROMA, 2))}
                    small, chosen, chroma = False, [DC], DC
                else:
                    small, chosen, chroma, levels = intra
                empty = not any(any(b) for b in levels.values())
                if empty:
                    for used in (top_used[mx], left_used):
                        used[:8] = [0] * 8
                        if not small:
                            used[8] = 0
                else:
                    self._tokens(tokens, levels, top_used[mx], left_used, small)
                real = None if empty else levels
                if block.reference:
                    add_moved(frame, mx, my, guess, real, self.quant, False)
                else:
                    frame.add(mx, my, small, chosen, chroma, real, self.quant)
                if level:
                    frame.filters[my, mx] = (*strength(level, 0, False), small or touched(real, self.quant, small))
                blocks[my + 1][mx + 1] = block
                decided.append((empty, block, mode, best, counts, small, chosen, chroma))
        return self._written(frame, tokens, decided, level, width, height)

    def _choose(self, frame: Frame, planes, blocks, mx: int, my: int, across: int, down: int):
        """Zero, nearest, near or a searched vector, or an intra macroblock if that is cheaper."""
        bounds = Bounds.of(mx, my, across, down)
        found, counts = near_vectors(blocks[my][mx + 1], blocks[my + 1][mx], blocks[my][mx], LAST, [False] * 4)
        best, nearest, near = (bounds.clamp(v) for v in found)
        source = planes[0][my * 16 : my * 16 + 16, mx * 16 : mx * 16 + 16]
        error = lambda v: 256 * int(((source - predicted(self.last[0], my * 16, mx * 16, 16, 16, v, True)) ** 2).sum())
        p = [MODE_CONTEXTS[c][k] for k, c in enumerate(counts)]
        cost = lambda q, bit: -256 * np.log2((q if not bit else 256 - q) / 256)
        price = {ZERO: cost(p[0], 0), NEAREST: cost(p[0], 1) + cost(p[1], 0), NEAR: cost(p[0], 1) + cost(p[1], 1) + cost(p[2], 0)}
        price[NEW] = cost(p[0], 1) + cost(p[1], 1) + cost(p[2], 1) + cost(p[3], 0)
        vector_price = lambda v: 256 * sum(2 + 2 * (abs(a - b) // 2).bit_length() for a, b in zip(v, best))
        options = [(error(v) + self.weight * price[m], m, v) for m, v in ((ZERO, NONE), (NEAREST, nearest), (NEAR, near))]
        here, step = (best[0] & ~7, best[1] & ~7), 8 * self.reach
        score = lambda v: error(v) + self.weight * (price[NEW] + vector_price(v))
        low = score(here)
        while step >= 2:
            around = [(here[0] + a, here[1] + b) for a in (-step, 0, step) for b in (-step, 0, step) if (a or b)]
            around = [v for v in around if not bounds.outside(v)]
            better = min(((score(v), v) for v in around), default=(low, here))
            if better[0] < low:
                low, here = better
            else:
                step //= 2
        if not bounds.outside(here):
            options.append((low, NEW, here))
        top = min(options, key=lambda o: (o[0], o[1]))
        intra = self._macroblock(frame, planes, mx, my)
        mode_cost = tb.LUMA_MODE_COST[intra[1][0]] if not intra[0] else 16 * 600
        guess = frame.predicted(0, mx, my, intra[1][0]) if not intra[0] else None
        intra_score = (256 * int(((source - guess) ** 2).sum()) if guess is not None else top[0]) + self.weight * (mode_cost + 512)
        if intra_score < top[0]:
            return Block(), None, best, counts, intra
        return Block(LAST, top[2]), top[1], best, counts, None

    def _written(self, frame: Frame, tokens, decided, level: int, width: int, height: int):
        n = len(decided)
        skip = max(1, (n - sum(d[0] for d in decided)) * 255 // n)
        inter = self.moved = sum(bool(d[1].reference) for d in decided)
        odds = max(1, min(255, 255 * (n - inter) // n))
        fresh = self._probabilities(tokens, self.current)
        w = BoolWriter()
        w.flag(False)
        w.flag(False)
        w.bits(level, 6)
        w.bits(0, 3)
        w.flag(False)
        w.bits(0, 2)
        w.bits(self.base, 7)
        for _ in range(5):
            w.flag(False)
        w.flag(True)  # golden and alternate take this frame
        w.flag(True)
        w.flag(False)  # no sign biases
        w.flag(False)
        w.flag(False)  # probabilities go back afterwards, so each frame starts from the key frame's
        w.flag(True)
        for i in np.ndindex(fresh.shape):
            changed = fresh[i] != self.current[i]
            w.bit(int(changed), int(self.tables.updates[i]))
            if changed:
                w.bits(int(fresh[i]), 8)
        w.flag(True)
        w.bits(skip, 8)
        w.bits(odds, 8)
        w.bits(255, 8)  # the last frame only
        w.bits(128, 8)
        w.flag(False)
        w.flag(False)
        for updates in VECTOR_UPDATES:
            for u in updates:
                w.bit(0, u)
        for empty, block, mode, best, counts, small, chosen, chroma in decided:
            w.bit(int(empty), skip)
            w.bit(int(bool(block.reference)), odds)
            if not block.reference:
                self._put_intra(w, small, chosen, chroma)
                continue
            w.bit(0, 255)
            p = [MODE_CONTEXTS[c][k] for k, c in enumerate(counts)]
            for k, m in enumerate((ZERO, NEAREST, NEAR)):
                w.bit(int(mode != m), p[k])
                if mode == m:
                    break
            else:
                w.bit(0, p[3])
                for k in range(2):
                    write_component(w, list(VECTOR_DEFAULTS[k]), (block.vector[k] - best[k]) // 2)
        part = BoolWriter()
        for slot, bit in tokens:
            part.bit(bit, slot if isinstance(slot, int) else int(fresh[slot]))
        first, second = w.bytes(), part.bytes()
        if len(first) >= lossy.MOST_FIRST:
            raise Unsupported("modes take more than 512 KB")
        frame.smooth(False)
        self.last = frame.whole()
        return (len(first) << 5 | 1 << 4 | 1).to_bytes(3, "little") + first + second, frame.planes(width, height)

    @staticmethod
    def _put_intra(w: BoolWriter, small: bool, modes: list[int], chroma: int) -> None:
        p, q = LUMA_START, CHROMA_START
        mode = -1 if small else modes[0]
        w.bit(int(mode != DC), p[0])
        if mode in (VE, HE):
            w.bit(0, p[1])
            w.bit(int(mode == HE), p[2])
        elif mode != DC:
            w.bit(1, p[1])
            w.bit(int(small), p[3])
        if small:
            for m in modes:
                lossy.Encoder._put_small(w, m, list(SMALL_START))
        w.bit(int(chroma != DC), q[0])
        if chroma != DC:
            w.bit(int(chroma != VE), q[1])
            if chroma != VE:
                w.bit(int(chroma == TM), q[2])
