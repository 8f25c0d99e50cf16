"""Column functions over header bytes: an array of int, from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little(bytes_: Column, at: int, n: int) -> Column:
    """n bytes from a place as an unsigned little-endian number."""
    return sum((F.get(bytes_, F.lit(at + k)).cast("long") * (1 << (8 * k)) for k in range(1, n)), F.get(bytes_, F.lit(at)).cast("long"))


def bits(v: Column, shift: int, n: int) -> Column:
    return F.shiftright(v, shift).bitwiseAND((1 << n) - 1)


def chunk_step(size: Column) -> Column:
    """Bytes that a chunk takes: its header, its payload and the pad byte of an odd size."""
    return 8 + size + size % 2


def lossy_header(b: Column) -> dict[str, Column]:
    """The uncompressed part of a lossy frame's header: a 3-byte tag, and 7 bytes more in key frames."""
    tag = little(b, 0, 3)
    key = bits(tag, 0, 1) == 0
    only = lambda c: F.when(key, c)
    return {
        "key_frame": key, "profile": bits(tag, 1, 3), "show": bits(tag, 4, 1) == 1, "first_size": bits(tag, 5, 19),
        "start_code_ok": only((F.get(b, F.lit(3)) == 0x9D) & (F.get(b, F.lit(4)) == 0x01) & (F.get(b, F.lit(5)) == 0x2A)),
        "width": only(bits(little(b, 6, 2), 0, 14)), "x_scale": only(bits(little(b, 6, 2), 14, 2)), "height": only(bits(little(b, 8, 2), 0, 14)), "y_scale": only(bits(little(b, 8, 2), 14, 2)),
    }


def lossless_header(b: Column) -> dict[str, Column]:
    """Signature byte and 32 bits, least significant first: two sizes less one, alpha, version."""
    v = little(b, 1, 4)
    return {"signature_ok": F.get(b, F.lit(0)) == 0x2F, "width": bits(v, 0, 14) + 1, "height": bits(v, 14, 14) + 1, "has_alpha": bits(v, 28, 1) == 1, "version": bits(v, 29, 3)}


def alpha_header(b: Column) -> dict[str, Column]:
    v = F.get(b, F.lit(0))
    method, filter_, pre = bits(v, 0, 2), bits(v, 2, 2), bits(v, 4, 2)
    return {"method": method, "filter": filter_, "preprocessing": pre, "valid": (bits(v, 6, 2) == 0) & (method < 2) & (pre < 2)}


def frame_header(b: Column) -> dict[str, Column]:
    """An animation frame's 16 bytes."""
    flags = F.get(b, F.lit(15))
    return {"x": little(b, 0, 3) * 2, "y": little(b, 3, 3) * 2, "w": little(b, 6, 3) + 1, "h": little(b, 9, 3) + 1, "duration_ms": little(b, 12, 3), "blend": bits(flags, 1, 1) == 0, "dispose": bits(flags, 0, 1) == 1}


def le_hex(v: Column, n: int) -> Column:
    """A number's low n bytes, least significant first, as hex digits."""
    h = F.lpad(F.hex(v.cast("long").bitwiseAND((1 << (8 * n)) - 1)), 2 * n, "0")
    return F.concat(*[F.substring(h, 2 * (n - k) - 1, 2) for k in range(n)])


def frame_header_hex(x, y, w, h, duration_ms, blend, dispose) -> Column:
    flags = F.when(blend, 0).otherwise(2) + F.when(dispose, 1).otherwise(0)
    return F.concat(le_hex(F.shiftright(x, 1), 3), le_hex(F.shiftright(y, 1), 3), le_hex(w - 1, 3), le_hex(h - 1, 3), le_hex(duration_ms, 3), le_hex(flags, 1))


def orientation(v: Column) -> Column:
    """1 to 8; anything else reads as 1."""
    return F.coalesce(F.when(v.between(1, 8), v), F.lit(1))
