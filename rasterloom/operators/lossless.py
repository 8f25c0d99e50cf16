"""The lossless codec: pictures as rows of 32-bit ARGB words, to and from bytes.

A stream holds transforms, each of one kind at most, and then prefix-coded symbols: literals,
copies of earlier pixels, and hits in a cache of recent colours. Decoding undoes the transforms
in reverse order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bits import BitReader, BitWriter, Invalid, Unsupported
from .near import NEAR
from .prefix import Decoder, code_lengths, read_code, write_code

SIGNATURE = 0x2F
BLACK = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Symbols of green (with lengths), red, blue, alpha and distance.
ALPHABETS = (256 + 24, 256, 256, 256, 40)
CACHE_MULTIPLIER = 0x1E35A7BD
MOST_LENGTH = 4095
MOST_AREA = 1 << 28


def tiles_along(size: int, bits: int) -> int:
    return -(-size // (1 << bits))


# words


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, mod 256."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF).astype(np.uint32)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return add(a, add(~b, np.uint32(0x01010101)))


def _split(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(of, *words: int) -> int:
    v = 0
    for c in zip(*map(_split, words)):
        v = v << 8 | min(max(of(*c), 0), 255)
    return v


def _nearer(left: int, top: int, corner: int) -> int:
    far = sum(abs(a - c) - abs(b - c) for a, b, c in zip(_split(left), _split(top), _split(corner)))
    return top if far <= 0 else left


def _towards(m: int, c: int) -> int:
    d = m - c
    return m + (d >> 1 if d >= 0 else -(-d >> 1))


def predict(mode: int, left: int, corner: int, top: int, right: int) -> int:
    """What a mode foretells from the neighbours to the left, above left, above, above right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _half(_half(left, right), top)
        case 6:
            return _half(left, corner)
        case 7:
            return _half(left, top)
        case 8:
            return _half(corner, top)
        case 9:
            return _half(top, right)
        case 10:
            return _half(_half(left, corner), _half(top, right))
        case 11:
            return _nearer(left, top, corner)
        case 12:
            return _each(lambda a, b, c: a + b - c, left, top, corner)
        case 13:
            return _each(_towards, _half(left, top), corner)
    return BLACK


def _plus(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def unpredict(px: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Residuals become pixels, in raster order: each needs its neighbours done."""
    out, across = px.tolist(), tiles_along(width, bits)
    for i, v in enumerate(out):
        y, x = divmod(i, width)
        if not i:
            p = BLACK
        elif not y:
            p = out[i - 1]
        elif not x:
            p = out[i - width]
        else:
            p = predict(int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15, out[i - 1], out[i - width - 1], out[i - width], out[i - width + 1])
        out[i] = _plus(v, p)
    return np.array(out, np.uint32)


def _neighbours(px: np.ndarray, width: int) -> list[np.ndarray]:
    n = len(px)
    at = np.arange(n)
    return [px[np.maximum(at - d, 0)] for d in (1, width + 1, width, width - 1)]


def predictions(px: np.ndarray, width: int) -> np.ndarray:
    """For each of the 14 modes what it foretells of every pixel, from original neighbours."""
    left, corner, top, right = (v.astype(np.int64) for v in _neighbours(px, width))
    split = lambda v: np.stack([v >> s & 255 for s in (24, 16, 8, 0)])
    join = lambda c: np.clip(c, 0, 255)[0] << 24 | np.clip(c, 0, 255)[1] << 16 | np.clip(c, 0, 255)[2] << 8 | np.clip(c, 0, 255)[3]
    le, co, to, ri = map(split, (left, corner, top, right))
    far = (np.abs(le - co) - np.abs(to - co)).sum(0)
    half = lambda a, b: a + b >> 1
    mean = half(le, to)
    step = mean - co
    rows = [
        np.full(len(px), BLACK), left, top, right, corner, join(half(half(le, ri), to)), join(half(le, co)), join(half(le, to)), join(half(co, to)), join(half(to, ri)),
        join(half(half(le, co), half(to, ri))), np.where(far <= 0, top, left), join(le + to - co), join(mean + np.where(step >= 0, step >> 1, -(-step >> 1))),
    ]
    out = np.stack(rows).astype(np.uint32)
    out[:, :width] = left[:width].astype(np.uint32)
    out[:, width::width] = top[width::width].astype(np.uint32)
    out[:, 0] = BLACK
    return out


def _magnitude(residual: np.ndarray) -> np.ndarray:
    v = residual.astype(np.int64)
    return sum(np.minimum(v >> s & 255, 256 - (v >> s & 255)) for s in (24, 16, 8, 0))


def choose_predictors(px: np.ndarray, width: int, height: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's mode, as words, and the residuals: the least sum of residual sizes, the first of equal ones."""
    left = subtract(px[None, :], predictions(px, width))
    y, x = np.divmod(np.arange(len(px)), width)
    across, down = tiles_along(width, bits), tiles_along(height, bits)
    tile = (y >> bits) * across + (x >> bits)
    cost = np.stack([np.bincount(tile, _magnitude(r), minlength=across * down) for r in left])
    best = cost.argmin(0)
    return (BLACK | best << 8).astype(np.uint32), left[best[tile], np.arange(len(px))]


def _signed(v: np.ndarray) -> np.ndarray:
    return np.where(v > 127, v - 256, v)


def cross_colour(px: np.ndarray, codes: np.ndarray, inverse: bool) -> np.ndarray:
    """Red and blue with (inverse) or without what each pixel's code tells from green and red."""
    v, c = px.astype(np.int64), codes.astype(np.int64)
    red, green, blue = v >> 16 & 255, _signed(v >> 8 & 255), v & 255
    g2r, g2b, r2b = (_signed(c >> s & 255) for s in (0, 8, 16))
    sign = 1 if inverse else -1
    new_red = red + sign * (g2r * green >> 5) & 255
    base = new_red if inverse else red
    new_blue = blue + sign * ((g2b * green >> 5) + (r2b * _signed(base) >> 5)) & 255
    return (v & 0xFF00FF00 | new_red << 16 | new_blue).astype(np.uint32)


def choose_cross_colour(px: np.ndarray, width: int, height: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's multipliers on a coarse grid, one after the other, and the pixels without what they tell."""
    y, x = np.divmod(np.arange(len(px)), width)
    across, down = tiles_along(width, bits), tiles_along(height, bits)
    tile, n = (y >> bits) * across + (x >> bits), across * down
    codes = np.zeros(n, np.int64)
    for shift, channel in ((0, 16), (8, 0), (16, 0)):
        trials = [codes | (m & 255) << shift for m in (0, 4, -4, 8, -8, 16, -16, 24, -24, 32, -32)]
        costs = []
        for t in trials:
            d = cross_colour(px, t[tile], False).astype(np.int64) >> channel & 255
            costs.append(np.bincount(tile, np.minimum(d, 256 - d), minlength=n))
        codes = np.stack(trials)[np.stack(costs).argmin(0), np.arange(n)]
    words = (BLACK | codes).astype(np.uint32)
    return words, cross_colour(px, words[tile], False)


def green_in(px: np.ndarray, inverse: bool) -> np.ndarray:
    """Red and blue with or without green."""
    v = px.astype(np.int64)
    g = (v >> 8 & 255) * (1 if inverse else -1)
    return (v & 0xFF00FF00 | ((v >> 16) + g & 255) << 16 | (v + g & 255)).astype(np.uint32)


def palette_bits(n: int) -> int:
    """How many indices share a word, as a shift."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def pack_indices(index: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    if not bits:
        return (BLACK | index << 8).astype(np.uint32)
    per, each = 1 << bits, 8 >> bits
    wide = tiles_along(width, bits)
    padded = np.zeros((height, wide * per), np.int64)
    padded[:, :width] = index.reshape(height, width)
    green = (padded.reshape(height, wide, per) << each * np.arange(per)).sum(2)
    return (BLACK | green.reshape(-1) << 8).astype(np.uint32)


def unpack_indices(px: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    """Indices past the table are transparent black."""
    per, each = 1 << bits, 8 >> bits
    green = (px.astype(np.int64) >> 8 & 255).reshape(height, -1)
    index = (green[:, :, None] >> each * np.arange(per) & (1 << each) - 1).reshape(height, -1)[:, :width].reshape(-1)
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index]


# symbols


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits, and extra bits of a length or distance from 1."""
    d = value - 1
    if d < 2:
        return d, 0, 0
    high = d.bit_length() - 1
    return 2 * high + (d >> high - 1 & 1), high - 1, d & (1 << high - 1) - 1


def prefix_value(symbol: int, r: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + r.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(y * width + x, 1)


_CODE_AT = {place: k + 1 for k, place in enumerate(NEAR)}


def code_of(distance: int, width: int) -> int:
    """The short code of a place near by, if there is one; codes for places to the right need a row above."""
    y, x = divmod(distance, width)
    code = _CODE_AT.get((x, y)) or _CODE_AT.get((x - width, y + 1))
    return code if code and distance_of(code, width) == distance else distance + len(NEAR)


@dataclass
class Header:
    width: int
    height: int
    has_alpha: bool


def read_header(r: BitReader) -> Header:
    width, height, alpha = r.read(14) + 1, r.read(14) + 1, r.read(1)
    if r.read(3):
        raise Unsupported("a version other than 0")
    return Header(width, height, bool(alpha))


def _read_codes(r: BitReader, cache_bits: int, groups: int) -> list[list[Decoder]]:
    out = []
    for _ in range(groups):
        out.append([read_code(r, size + (1 << cache_bits if k == 0 and cache_bits else 0)) for k, size in enumerate(ALPHABETS)])
        if r.overrun:
            raise Invalid("codes end early")
    return out


def _read_pixels(r: BitReader, width: int, height: int, whole: bool) -> np.ndarray:
    """One entropy-coded picture; only the main one may choose codes by tile."""
    cache_bits = 0
    if r.read(1):
        cache_bits = r.read(4)
        if not 1 <= cache_bits <= 11:
            raise Invalid("a colour cache of an odd size")
    bits, chosen, groups = 0, None, 1
    if whole and r.read(1):
        bits = r.read(3) + 2
        chosen = (_read_pixels(r, tiles_along(width, bits), tiles_along(height, bits), False) >> 8 & 0xFFFF).tolist()
        groups = max(chosen) + 1
    codes = _read_codes(r, cache_bits, groups)
    across = tiles_along(width, bits)
    cache, out, n = [0] * (1 << cache_bits), [], width * height
    keep = (lambda v: cache.__setitem__((v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits, v)) if cache_bits else (lambda v: None)
    while len(out) < n:
        if r.overrun:
            raise Invalid("pixels end early")
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = codes[chosen[(y >> bits) * across + (x >> bits)] if chosen else 0]
        s = green.read(r)
        if s < 256:
            re = red.read(r)
            bl = blue.read(r)
            v = alpha.read(r) << 24 | re << 16 | s << 8 | bl
            out.append(v)
            keep(v)
        elif s < 280:
            length = prefix_value(s - 256, r)
            d = distance_of(prefix_value(far.read(r), r), width)
            if d > len(out) or len(out) + length > n:
                raise Invalid("a copy from outside the picture")
            for _ in range(length):
                v = out[-d]
                out.append(v)
                keep(v)
        else:
            v = cache[s - 280]
            out.append(v)
            keep(v)
    return np.array(out, np.uint32)


def read_stream(r: BitReader, width: int, height: int, most: int = MOST_AREA) -> np.ndarray:
    """Transforms and pixels of a picture whose size is known."""
    if most > 0 and width * height > most:
        raise Unsupported("a picture over the size limit")
    wide, undo, seen = width, [], set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen or r.overrun:
            raise Invalid("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, bits, _read_pixels(r, tiles_along(wide, bits), tiles_along(height, bits), False), wide))
        elif kind == PALETTE:
            size = r.read(8) + 1
            deltas = _read_pixels(r, size, 1, False)
            table = np.zeros(size, np.uint32)
            last = np.uint32(0)
            for i, d in enumerate(deltas):
                last = table[i] = add(d, last)
            bits = palette_bits(size)
            undo.append((kind, bits, table[: 1 << (8 >> bits)], wide))
            wide = tiles_along(wide, bits)
        else:
            undo.append((kind, 0, None, wide))
    px = _read_pixels(r, wide, height, True)
    for kind, bits, data, wide in reversed(undo):
        if kind == PREDICTOR:
            px = unpredict(px, wide, bits, data)
        elif kind == CROSS_COLOUR:
            y, x = np.divmod(np.arange(len(px)), wide)
            px = cross_colour(px, data[(y >> bits) * tiles_along(wide, bits) + (x >> bits)], True)
        elif kind == SUBTRACT_GREEN:
            px = green_in(px, True)
        else:
            px = unpack_indices(px, wide, height, bits, data)
    if r.overrun:
        raise Invalid("the stream ends early")
    return px


def decode(data: bytes, most: int = MOST_AREA) -> tuple[Header, np.ndarray]:
    """A lossless payload's header and pixels."""
    if not data or data[0] != SIGNATURE:
        raise Invalid("not a lossless picture")
    r = BitReader(data[1:])
    h = read_header(r)
    return h, read_stream(r, h.width, h.height, most)


def matches(px: list[int], width: int, window: int = 1 << 16, tries: int = 16) -> list[tuple]:
    """Literals ("v", word) and copies ("c", distance, length): the longest of a few earlier places, one step ahead."""
    n, at, out, i = len(px), {}, [], 0

    def length(a: int, b: int) -> int:
        k, most = 0, min(n - b, MOST_LENGTH)
        while k < most and px[a + k] == px[b + k]:
            k += 1
        return k

    def best(i: int) -> tuple[int, int]:
        top = (0, 0)
        places = [i - 1, i - width, *at.get(tuple(px[i : i + 3]), ())[-tries:]]
        for a in places:
            if 0 <= a < i and i - a <= window:
                top = max(top, (length(a, i), a - i))
        return top

    def note(i: int) -> None:
        at.setdefault(tuple(px[i : i + 3]), []).append(i)

    while i < n:
        found = best(i) if i else (0, 0)
        note(i)
        if found[0] >= 4 and i + 1 < n and found[0] < 64 and best(i + 1)[0] > found[0] + 1:
            found = (0, 0)
        if found[0] >= 4:
            out.append(("c", -found[1], found[0]))
            for j in range(i + 1, i + found[0]):
                note(j)
            i += found[0]
        else:
            out.append(("v", px[i]))
            i += 1
    return out


def cheapest_parse(refs: list[tuple], px: list[int], width: int) -> list[tuple]:
    """A parse of least estimated bits: each place is a literal or any shorter form of a copy that begins there.

    Prices come from the histograms of a first parse; a shortest path from the first pixel to the last decides.
    """
    counts, _ = _counted(refs, width, 0)
    price = []
    for c in counts:
        total = sum(c) or 1
        price.append([np.log2(total) - np.log2(n) if n else np.log2(total) + 1 for n in c])
    found: dict[int, tuple[int, int]] = {}
    at = 0
    for ref in refs:
        if ref[0] == "c":
            found[at] = (ref[1], ref[2])
        at += ref[2] if ref[0] == "c" else 1
    n = len(px)
    best, came = [0.0] + [np.inf] * n, [("v", 0)] * (n + 1)
    open_copy: tuple[int, int] | None = None  # distance and where a copy that runs here ends
    for i in range(n):
        if i in found:
            open_copy = (found[i][0], i + found[i][1])
        a, r, g, b = _split(px[i])
        # literals are a little dearer than they seem, as copies leave fewer of them
        one = best[i] + 1.0386 * (price[0][g] + price[1][r] + price[2][b] + price[3][a])
        if one < best[i + 1]:
            best[i + 1], came[i + 1] = one, ("v", px[i])
        if open_copy and open_copy[1] - i >= 2:
            distance, end = open_copy
            s, extra, _ = prefix_of(code_of(distance, width))
            far = price[4][s] + extra
            for length in range(2, min(end - i, 256) + 1):
                t, more, _ = prefix_of(length)
                whole = best[i] + far + price[0][256 + t] + more
                if whole < best[i + length]:
                    best[i + length], came[i + length] = whole, ("c", distance, length)
            if end - i > 256:
                t, more, _ = prefix_of(end - i)
                whole = best[i] + far + price[0][256 + t] + more
                if whole < best[end]:
                    best[end], came[end] = whole, ("c", distance, end - i)
    out, i = [], n
    while i:
        out.append(came[i])
        i -= came[i][2] if came[i][0] == "c" else 1
    return out[::-1]


def _cost(h: np.ndarray, bounds: list[int]) -> float:
    """Bits of histograms side by side, with 5 for each used symbol and 40 for each code."""
    total = 0.0
    for a, b in zip(bounds, bounds[1:]):
        v = h[a:b][h[a:b] > 0].astype(float)
        total += (v.sum() * np.log2(v.sum()) - (v * np.log2(v)).sum() + 5 * len(v) if len(v) else 0) + 40
    return total


def code_groups(refs: list[tuple], width: int, height: int, cache_bits: int, bits: int) -> tuple[np.ndarray, float]:
    """A group of codes for each tile, and the groups' cost: tiles go to 64 bins by cost, then bins merge while that saves most.

    A reference counts to the tile of its first pixel.
    """
    sizes = [size + (1 << cache_bits if k == 0 and cache_bits else 0) for k, size in enumerate(ALPHABETS)]
    bounds = [0, *np.cumsum(sizes).tolist()]
    across, down = tiles_along(width, bits), tiles_along(height, bits)
    tiles = np.zeros((across * down, bounds[-1]), np.int64)
    at = 0
    for ref in refs:
        y, x = divmod(at, width)
        for tree, s, _, _ in _symbols(ref, width):
            tiles[(y >> bits) * across + (x >> bits), bounds[tree] + s] += 1
        at += ref[2] if ref[0] == "c" else 1
    cost = np.array([_cost(t, bounds) for t in tiles])
    low, high = cost.min(), cost.max()
    bins = np.minimum((cost - low) * 64 / max(high - low, 1e-9), 63).astype(np.int64)
    groups = {int(b): tiles[bins == b].sum(0) for b in np.unique(bins)}
    price = {g: _cost(h, bounds) for g, h in groups.items()}
    gain = {(a, b): price[a] + price[b] - _cost(groups[a] + groups[b], bounds) for a in groups for b in groups if a < b}
    while gain:
        (a, b), saved = max(gain.items(), key=lambda e: (e[1], -e[0][0], -e[0][1]))
        if saved <= 0:
            break
        groups[a] = groups[a] + groups.pop(b)
        bins[bins == b] = a
        price[a] = _cost(groups[a], bounds)
        price.pop(b)
        gain = {p: v for p, v in gain.items() if a not in p and b not in p}
        gain |= {(min(a, c), max(a, c)): price[a] + price[c] - _cost(groups[a] + groups[c], bounds) for c in groups if c != a}
    names = {g: k for k, g in enumerate(sorted(groups))}
    return np.array([names[int(b)] for b in bins]), sum(price.values())


def with_cache(refs: list[tuple], px: list[int], bits: int) -> list[tuple]:
    """Literals that the cache holds become hits ("h", slot)."""
    if not bits:
        return refs
    cache, i, out = [0] * (1 << bits), 0, []
    slot = lambda v: (v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - bits
    for ref in refs:
        n = ref[2] if ref[0] == "c" else 1
        k = slot(px[i])
        out.append(("h", k) if ref[0] == "v" and cache[k] == px[i] else ref)
        for v in px[i : i + n]:
            cache[slot(v)] = v
        i += n
    return out


def _symbols(ref: tuple, width: int) -> list[tuple[int, int, int, int]]:
    """(tree, symbol, extra bits, extra) of a reference."""
    if ref[0] == "v":
        a, r, g, b = _split(ref[1])
        return [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
    if ref[0] == "h":
        return [(0, 280 + ref[1], 0, 0)]
    s, n, extra = prefix_of(ref[2])
    t, m, more = prefix_of(code_of(ref[1], width))
    return [(0, 256 + s, n, extra), (4, t, m, more)]


def _counted(refs: list[tuple], width: int, cache_bits: int) -> tuple[list[list[int]], float]:
    """Histograms of the five trees, and their cost in bits."""
    counts = [[0] * (size + (1 << cache_bits if k == 0 and cache_bits else 0)) for k, size in enumerate(ALPHABETS)]
    extra = 0
    for ref in refs:
        for tree, s, n, _ in _symbols(ref, width):
            counts[tree][s] += 1
            extra += n
    cost = float(extra)
    for c in counts:
        h = np.array([v for v in c if v], float)
        if len(h):
            cost += h.sum() * np.log2(h.sum()) - (h * np.log2(h)).sum() + 5 * len(h)
    return counts, cost


def _write_pixels(w: BitWriter, px: np.ndarray, width: int, whole: bool, most_cache: int = 6, effort: int = 4) -> None:
    """The cheapest of a few parses and cache sizes; the main picture's codes by tile where that is cheaper still."""
    words = px.tolist()
    plain = [[("v", v) for v in words], matches(words, width)]
    if effort >= 5 and len(plain[1]) < len(words):
        plain.append(cheapest_parse(plain[1], words, width))
    trials = [(with_cache(refs, words, b), b) for refs in plain for b in range(0, most_cache + 1, 2)]
    costs = [_counted(refs, width, b)[1] for refs, b in trials]
    refs, cache_bits = trials[int(np.argmin(costs))]
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    height, tile_bits, group = len(words) // width, 0, np.zeros(1, np.int64)
    if whole:
        tile_bits = 3
        while tile_bits < 9 and tiles_along(width, tile_bits) * tiles_along(height, tile_bits) > 256:
            tile_bits += 1
        group, grouped = code_groups(refs, width, height, cache_bits, tile_bits)
        several = group.max() > 0 and grouped + 3 * len(group) < min(costs) + 200
        w.write(int(several), 1)
        if several:
            w.write(tile_bits - 2, 3)
            _write_pixels(w, (np.uint32(BLACK) | group.astype(np.uint32) << np.uint32(8)).astype(np.uint32), tiles_along(width, tile_bits), False, 0)
        else:
            group = np.zeros(1, np.int64)
    across, at, by_group = tiles_along(width, tile_bits), 0, []
    for ref in refs:
        y, x = divmod(at, width)
        by_group.append(int(group[(y >> tile_bits) * across + (x >> tile_bits)]) if len(group) > 1 else 0)
        at += ref[2] if ref[0] == "c" else 1
    codes = []
    for g in range(int(group.max()) + 1):
        own = [ref for ref, k in zip(refs, by_group) if k == g]
        codes.append([write_code(w, code_lengths(c)) for c in _counted(own, width, cache_bits)[0]])
    for ref, g in zip(refs, by_group):
        for tree, s, n, extra in _symbols(ref, width):
            w.write(*codes[g][tree][s])
            w.write(extra, n)


def write_stream(w: BitWriter, px: np.ndarray, width: int, height: int, effort: int = 4) -> None:
    """A palette for at most 256 colours, else green taken off and predictors by tile, with cross colour at most effort where it is shorter."""
    colours = np.unique(px)
    if len(colours) <= 256:
        bits = palette_bits(len(colours))
        deltas = colours.copy()
        deltas[1:] = subtract(colours[1:], colours[:-1])
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        _write_pixels(w, deltas, len(colours), False, 0)
        px = pack_indices(np.searchsorted(colours, px), width, height, bits)
        w.write(0, 1)
        _write_pixels(w, px, tiles_along(width, bits), True, effort=effort)
        return
    w.write(1, 1)
    w.write(SUBTRACT_GREEN, 2)
    px = green_in(px, False)
    bits = 4 if effort < 4 else 3
    modes, px = choose_predictors(px, width, height, bits)
    w.write(1, 1)
    w.write(PREDICTOR, 2)
    w.write(bits - 2, 3)
    _write_pixels(w, modes, tiles_along(width, bits), False, 0)
    plain = w.copy()
    plain.write(0, 1)
    _write_pixels(plain, px, width, True, effort=effort)
    if effort >= 6 and (px & np.uint32(0x00FF00FF)).any():
        codes, left = choose_cross_colour(px, width, height, bits)
        crossed = w.copy()
        crossed.write(1, 1)
        crossed.write(CROSS_COLOUR, 2)
        crossed.write(bits - 2, 3)
        _write_pixels(crossed, codes, tiles_along(width, bits), False, 0)
        crossed.write(0, 1)
        _write_pixels(crossed, left, width, True, effort=effort)
        plain = min(plain, crossed, key=len)
    w.take(plain)


def encode(px: np.ndarray, width: int, height: int, effort: int = 4) -> bytes:
    """A lossless payload; pixels are kept exactly, those under full transparency too."""
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14) or len(px) != width * height:
        raise ValueError("a picture must have 1 to 16384 pixels a side")
    w = BitWriter()
    w.write(SIGNATURE, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int((px >> np.uint32(24) != 255).any()), 1)
    w.write(0, 3)
    write_stream(w, px.astype(np.uint32), width, height, effort)
    return w.bytes()
