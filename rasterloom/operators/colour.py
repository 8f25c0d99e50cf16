"""Colour conversion and composition of whole pictures; the column forms are in functions.channels."""

from __future__ import annotations

import numpy as np

from ..functions import channels as k


def _clip(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, 255)


def doubled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A chroma plane at twice its size: nearest sample 9, neighbours 3, 3 and 1; columns on the rim use two rows only."""
    v = plane.astype(np.int64)
    rows, columns = v.shape
    y, x = np.arange(height), np.arange(width)
    cy, cx = y >> 1, x >> 1
    fy, fx = np.clip(cy + np.where(y % 2, 1, -1), 0, rows - 1), np.clip(cx + np.where(x % 2, 1, -1), 0, columns - 1)
    near, beside, above, across = v[cy][:, cx], v[cy][:, fx], v[fy][:, cx], v[fy][:, fx]
    inner = (near + 3 * beside + 3 * above + across + 8 >> 3) + near >> 1
    rim = 3 * near + above + 2 >> 2
    edge = (x == 0) | ((x == width - 1) & (width % 2 == 0))
    return np.where(edge[None, :], rim, inner)


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Planes of 4:2:0 to height x width x 3."""
    h, w = y.shape
    luma, up, vp = y.astype(np.int64) * k.Y_SCALE >> 8, doubled(u, w, h), doubled(v, w, h)
    red = luma + (vp * k.V_TO_R >> 8) + k.R_BIAS
    green = luma - (up * k.U_TO_G >> 8) - (vp * k.V_TO_G >> 8) + k.G_BIAS
    blue = luma + (up * k.U_TO_B >> 8) + k.B_BIAS
    return _clip(np.stack([red, green, blue], 2) >> 6).astype(np.uint8)


def to_yuv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4:2:0 planes of height x width x 3; each row's pairs first, then the mean of two rows' results."""
    h, w = rgb.shape[:2]
    c = rgb.astype(np.int64)
    luma = k.Y_OF_R * c[..., 0] + k.Y_OF_G * c[..., 1] + k.Y_OF_B * c[..., 2] + (1 << 15) + (16 << 16) >> 16
    wide = np.concatenate([c, c[:, -1:]], 1) if w % 2 else c
    pairs = 2 * (wide[:, ::2] + wide[:, 1::2])
    end = lambda r, g, b: _clip(r * pairs[..., 0] + g * pairs[..., 1] + b * pairs[..., 2] + (1 << 17) + (128 << 18) >> 18)
    out = []
    for part in (end(k.U_OF_R, k.U_OF_G, k.U_OF_B), end(k.V_OF_R, k.V_OF_G, k.V_OF_B)):
        even = part[::2].copy()
        even[: h // 2] = even[: h // 2] + part[1::2] + 1 >> 1
        out.append(even.astype(np.uint8))
    return luma.astype(np.uint8), out[0], out[1]


def argb_to_rgba(px: np.ndarray, width: int) -> np.ndarray:
    v = px.reshape(-1, width)
    return np.stack([v >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0, 24)], 2).astype(np.uint8)


def rgba_to_argb(rgba: np.ndarray) -> np.ndarray:
    v = rgba.astype(np.uint32)
    return (v[..., 3] << 24 | v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]).reshape(-1)


def premultiplied(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(np.int64)
    colour = np.where(a == 255, rgba[..., :3], rgba[..., :3] * (a * 32897) >> 23)
    return np.concatenate([colour, a], 2).astype(np.uint8)


def over(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Premultiplied source over destination."""
    s, d = src.astype(np.int64), dst.astype(np.int64)
    a = s[..., 3:]
    return np.where(a == 255, s, s + (d * (256 - a) >> 8) & 255).astype(np.uint8)


def drawn(old: np.ndarray, px: np.ndarray, x: int, y: int, blend: bool, cleared: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """A canvas with a premultiplied picture at a place: over what is there if it blends, but for a rectangle (x, y, w, h) that was cleared."""
    h, w = px.shape[:2]
    part = (slice(y, y + h), slice(x, x + w))
    canvas = old.copy()
    if blend:
        mixed = over(px, old[part])
        if cleared:
            at_y, at_x = np.mgrid[y : y + h, x : x + w]
            inside = (at_x >= cleared[0]) & (at_x < cleared[0] + cleared[2]) & (at_y >= cleared[1]) & (at_y < cleared[1] + cleared[3])
            mixed = np.where(inside[..., None], px, mixed)
        px = mixed
    canvas[part] = px
    return canvas


def oriented(rgba: np.ndarray, orientation: int) -> np.ndarray:
    """A picture turned by an EXIF orientation."""
    if orientation >= 5:
        rgba = rgba.transpose(1, 0, 2)
    flip_x, flip_y = orientation in (2, 3, 6, 7), orientation in (3, 4, 7, 8)
    return rgba[:: -1 if flip_y else 1, :: -1 if flip_x else 1]
