"""Column functions on 8-bit channels and on packed ARGB words (as long)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK = 0xFF000000


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def wrap8(v: Column) -> Column:
    """v mod 256."""
    return F.pmod(v, F.lit(256))


def wrap16(v: Column) -> Column:
    """v as a signed 16-bit number."""
    return F.pmod(v + 32768, F.lit(65536)) - 32768


def signed8(v: Column) -> Column:
    """A byte read as a signed one."""
    return F.when(v > 127, v - 256).otherwise(v)


def truncated_half(v: Column) -> Column:
    """v / 2 towards zero."""
    return F.when(v < 0, -F.shiftright(-v, 1)).otherwise(F.shiftright(v, 1))


def channel(argb: Column, shift: int) -> Column:
    return F.shiftright(argb, shift).bitwiseAND(255)


def channels(argb: Column) -> tuple[Column, Column, Column, Column]:
    """a, r, g, b."""
    return channel(argb, 24), channel(argb, 16), channel(argb, 8), channel(argb, 0)


def word(a: Column, r: Column, g: Column, b: Column) -> Column:
    return a.cast("long") * (1 << 24) + r.cast("long") * (1 << 16) + g.cast("long") * (1 << 8) + b.cast("long")


def per_channel(of, *words: Column) -> Column:
    """of() applied to each channel of words, put together again."""
    return word(*[of(*c) for c in zip(*[channels(w) for w in words])])


def add_words(a: Column, b: Column) -> Column:
    return per_channel(lambda x, y: wrap8(x + y), a, b)


def subtract_words(a: Column, b: Column) -> Column:
    return per_channel(lambda x, y: wrap8(x - y), a, b)


def average(a: Column, b: Column) -> Column:
    """Floor of the mean of each channel."""
    return per_channel(lambda x, y: F.shiftright(x + y, 1), a, b)


def gradient(a: Column, b: Column, c: Column) -> Column:
    """a + b - c within a byte's range."""
    return clamp(a + b - c)


def gradient_words(left: Column, top: Column, corner: Column) -> Column:
    return per_channel(gradient, left, top, corner)


def half_gradient_words(left: Column, top: Column, corner: Column) -> Column:
    """The mean of left and top, moved away from the corner by half their difference."""
    return per_channel(lambda m, c: clamp(m + truncated_half(m - c)), average(left, top), corner)


def nearer(left: Column, top: Column, corner: Column) -> Column:
    """Top if it predicts at least as well as left, by the sum of channel distances."""
    far = F.lit(0)
    for t, l, c in zip(channels(top), channels(left), channels(corner)):
        far = far + F.abs(l - c) - F.abs(t - c)
    return F.when(far <= 0, top).otherwise(left)


def subtract_green(argb: Column) -> Column:
    a, r, g, b = channels(argb)
    return word(a, wrap8(r - g), g, wrap8(b - g))


def add_green(argb: Column) -> Column:
    a, r, g, b = channels(argb)
    return word(a, wrap8(r + g), g, wrap8(b + g))


def _delta(multiplier: Column, c: Column) -> Column:
    """A signed 3.5 fixed-point multiple of a signed channel."""
    return F.shiftright(signed8(multiplier) * signed8(c), 5)


def cross_colour(argb: Column, code: Column) -> Column:
    """Red and blue without what green, and red, foretell; code holds the tile's three multipliers."""
    a, r, g, b = channels(argb)
    g2r, g2b, r2b = channel(code, 0), channel(code, 8), channel(code, 16)
    return word(a, wrap8(r - _delta(g2r, g)), g, wrap8(b - _delta(g2b, g) - _delta(r2b, r)))


def cross_colour_back(argb: Column, code: Column) -> Column:
    a, r, g, b = channels(argb)
    g2r, g2b, r2b = channel(code, 0), channel(code, 8), channel(code, 16)
    red = wrap8(r + _delta(g2r, g))
    return word(a, red, g, wrap8(b + _delta(g2b, g) + _delta(r2b, red)))


# BT.601 in fixed point.
Y_SCALE, V_TO_R, U_TO_G, V_TO_G, U_TO_B = 19077, 26149, 6419, 13320, 33050
R_BIAS, G_BIAS, B_BIAS = -14234, 8708, -17685
Y_OF_R, Y_OF_G, Y_OF_B = 16839, 33059, 6420
U_OF_R, U_OF_G, U_OF_B = -9719, -19081, 28800
V_OF_R, V_OF_G, V_OF_B = 28800, -24116, -4684


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    part = lambda c, k: F.shiftright(c * k, 8)
    end = lambda s: clamp(F.shiftright(s, 6))
    luma = part(y, Y_SCALE)
    return end(luma + part(v, V_TO_R) + R_BIAS), end(luma - part(u, U_TO_G) - part(v, V_TO_G) + G_BIAS), end(luma + part(u, U_TO_B) + B_BIAS)


def rgb_to_y(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(Y_OF_R * r + Y_OF_G * g + Y_OF_B * b + (1 << 15) + (16 << 16), 16)


def rgb4_to_uv(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """From four times a channel's value, as a sum of four samples or two doubled ones."""
    end = lambda s: clamp(F.shiftright(s.cast("long") + (1 << 17) + (128 << 18), 18).cast("int"))
    return end(U_OF_R * r + U_OF_G * g + U_OF_B * b), end(V_OF_R * r + V_OF_G * g + V_OF_B * b)


def premultiply(c: Column, a: Column) -> Column:
    return F.when(a == 255, c.cast("long")).otherwise(F.shiftright(c.cast("long") * (a.cast("long") * 32897), 23)).cast("int")


def unpremultiply(c: Column, a: Column) -> Column:
    return F.when(a == 0, 0).otherwise(F.least(F.lit(255), F.floor(c * 255 / F.nullif(a, F.lit(0))).cast("int")))


def over(src: Column, dst: Column) -> Column:
    """Source-over of premultiplied words: src + dst * (256 - alpha) / 256."""
    a = channel(src, 24)
    return F.when(a == 255, src).otherwise(per_channel(lambda s, d: wrap8(s + F.shiftright(d * (256 - a), 8)), src, dst))


CACHE_MULTIPLIER = 0x1E35A7BD


def cache_slot(argb: Column, bits: int) -> Column:
    """The colour cache's slot of a word: the top bits of a 32-bit product."""
    return F.shiftright((argb * CACHE_MULTIPLIER).bitwiseAND(0xFFFFFFFF), 32 - bits)


def ceil_shift(size: Column, bits: Column | int) -> Column:
    b = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1), b) - 1, b)


def orient(orientation: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Where a pixel goes under an EXIF orientation."""
    right, below = w - 1 - x, h - 1 - y
    new_x = F.when(orientation.isin(2, 3), right).when(orientation.isin(5, 8), y).when(orientation.isin(6, 7), below).otherwise(x)
    new_y = F.when(orientation.isin(3, 4), below).when(orientation.isin(5, 6), x).when(orientation.isin(7, 8), right).otherwise(y)
    return new_x, new_y
