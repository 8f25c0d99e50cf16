"""Alpha planes: a header byte, raw or losslessly coded bytes, a row filter, and smoothing of few levels."""

from __future__ import annotations

import numpy as np

from . import lossless
from .bits import BitReader, BitWriter, Invalid

RAW, CODED = 0, 1
NONE, HORIZONTAL, VERTICAL, GRADIENT = range(4)


def unfilter(plane: np.ndarray, kind: int) -> np.ndarray:
    """Residuals to bytes; rows refer to the one above, the first row only along itself."""
    if kind == NONE:
        return plane
    out = plane.astype(np.int64)
    out[0] = np.cumsum(out[0])
    if kind == HORIZONTAL:
        out[1:, 0] = out[0, 0] + np.cumsum(out[1:, 0])
        out[1:] = np.cumsum(out[1:], 1)
    elif kind == VERTICAL:
        out = np.cumsum(out, 0)
    else:
        for y in range(1, len(out)):
            above, row = (out[y - 1] & 255).tolist(), out[y].tolist()
            left = corner = above[0]
            for x, top in enumerate(above):
                left = row[x] = row[x] + min(max(left + top - corner, 0), 255) & 255
                corner = top
            out[y] = row
    return (out & 255).astype(np.uint8)


def filtered(plane: np.ndarray, kind: int) -> np.ndarray:
    """Bytes to residuals."""
    v = plane.astype(np.int64)
    guess = np.zeros_like(v)
    guess[0, 1:] = v[0, :-1]
    if kind == HORIZONTAL:
        guess[1:, 1:], guess[1:, 0] = v[1:, :-1], v[:-1, 0]
    elif kind == VERTICAL:
        guess[1:] = v[:-1]
    elif kind == GRADIENT:
        guess[1:, 0] = v[:-1, 0]
        guess[1:, 1:] = np.clip(v[1:, :-1] + v[:-1, 1:] - v[:-1, :-1], 0, 255)
    else:
        return plane
    return (v - guess & 255).astype(np.uint8)


def smooth(plane: np.ndarray, strength: int) -> np.ndarray:
    """Levels moved towards the mean of a box around them, by less than their least gap; see rows.smoothed_levels."""
    h, w = plane.shape
    radius = min(4 * strength // 100, (w - 1) >> 1, (h - 1) >> 1)
    levels = np.unique(plane).astype(np.int64)
    if not 0 < strength <= 100 or radius <= 0 or len(levels) <= 2:
        return plane
    box, v = 2 * radius + 1, plane.astype(np.int64)
    rows = np.clip(np.arange(-radius, h + radius), 0, h - 1)
    at = np.arange(-radius, w + radius)
    columns = np.where(at < 0, -at - 1, np.where(at >= w, 2 * w - 2 - at, at))
    wide = np.pad(np.cumsum(np.cumsum(v[rows][:, columns], 0), 1), ((1, 0), (1, 0)))
    total = wide[box:, box:] - wide[:-box, box:] - wide[box:, :-box] + wide[:-box, :-box]
    mean = (total & 65535) * ((1 << 18) // (box * box)) >> 16
    difference = mean - v * 4
    edge = int(np.diff(levels).min()) * 4
    knee, size = 3 * edge >> 2, np.abs(difference)
    move = np.where(size <= knee, size, np.where(size < edge, knee * (edge - size) // max(edge - knee, 1), 0)) >> 2
    moved = np.clip(v + np.sign(difference) * move, 0, 255)
    return np.where((v <= levels[0]) | (v >= levels[-1]), v, moved).astype(np.uint8)


def decode(data: bytes | None, width: int, height: int, dither: int = 0) -> np.ndarray:
    """The plane of an alpha chunk; opaque without one."""
    if data is None:
        return np.full((height, width), 255, np.uint8)
    if len(data) < 2 or data[0] >> 6 or data[0] & 3 > CODED or data[0] >> 4 & 3 > 1:
        raise Invalid("an odd alpha header")
    method, kind, smoothed = data[0] & 3, data[0] >> 2 & 3, data[0] >> 4 & 3
    if method == CODED:
        plane = (lossless.read_stream(BitReader(data[1:]), width, height) >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
    else:
        if len(data) - 1 < width * height:
            raise Invalid("too few alpha bytes")
        plane = np.frombuffer(data, np.uint8, width * height, 1)
    plane = unfilter(plane.reshape(height, width), kind)
    return smooth(plane, dither) if smoothed else plane


def encode(plane: np.ndarray, kind: int = NONE, coded: bool = True) -> bytes:
    """The plane as the green of opaque words, coded, or as raw bytes."""
    left = filtered(plane, kind).reshape(-1)
    head = bytes([(CODED if coded else RAW) | kind << 2])
    if not coded:
        return head + left.tobytes()
    w = BitWriter()
    lossless.write_stream(w, np.uint32(lossless.BLACK) | left.astype(np.uint32) << np.uint32(8), plane.shape[1], plane.shape[0])
    return head + w.bytes()
