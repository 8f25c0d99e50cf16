"""The media container: chunks, features, frames and metadata of a file's bytes; and writing it.

A file is RIFF with the form WEBP. Its first chunk is one picture, or an extended header that is
followed by metadata, a picture with alpha, or the frames of an animation.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..operators.bits import BitReader, Invalid
from ..operators.lossless import SIGNATURE, read_header

LOSSY, LOSSLESS, EXTENDED, ALPHA, ANIMATION, FRAME, PROFILE, EXIF, XMP = b"VP8 ", b"VP8L", b"VP8X", b"ALPH", b"ANIM", b"ANMF", b"ICCP", b"EXIF", b"XMP "
ANIMATED_FLAG, ALPHA_FLAG = 2, 16
MOST_PAYLOAD = (1 << 32) - 10
MOST_SIDE, MOST_AREA = 1 << 24, 1 << 32


@dataclass(frozen=True)
class Chunk:
    fourcc: bytes
    off: int
    size: int


@dataclass(frozen=True)
class Frame:
    x: int
    y: int
    w: int
    h: int
    duration_ms: int
    blend: bool
    dispose: bool
    image: Chunk
    alpha: Chunk | None = None


@dataclass
class Container:
    extended: bool = False
    flags: int = 0
    width: int = 0
    height: int = 0
    loop_count: int = 1
    image: Chunk | None = None
    alpha: Chunk | None = None
    metadata: dict[bytes, Chunk] = field(default_factory=dict)
    frames: list[Frame] = field(default_factory=list)

    @property
    def animated(self) -> bool:
        return bool(self.flags & ANIMATED_FLAG)


class Bytes:
    """A byte source by ranges: read(at, n) gives at most n bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size

    @classmethod
    def of(cls, data: bytes) -> Bytes:
        return cls(lambda at, n: data[at : at + n], len(data))

    def exactly(self, at: int, n: int) -> bytes:
        got = self.read(at, n)
        if len(got) < n:
            raise Invalid("the file ends early")
        return got


def chunks(src: Bytes, at: int, end: int) -> Iterator[Chunk]:
    """Chunks between two places, each followed by a pad byte if its size is odd; the last one's may be missing."""
    while at < end:
        if at + 8 > end:
            raise Invalid("part of a chunk header")
        head = src.exactly(at, 8)
        size = struct.unpack("<I", head[4:])[0]
        if at + 8 + size > end:
            raise Invalid("a chunk past its parent's end")
        yield Chunk(head[:4], at + 8, size)
        at += 8 + size + size % 2


def _u24(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 3], "little")


def _frame(src: Bytes, c: Chunk) -> Frame:
    if c.size < 16:
        raise Invalid("a short frame header")
    b = src.exactly(c.off, 16)
    w, h = _u24(b, 6) + 1, _u24(b, 9) + 1
    if w * h >= MOST_AREA:
        raise Invalid("a frame too large")
    parts: dict[bytes, Chunk] = {}
    for sub in chunks(src, c.off + 16, c.off + c.size):
        parts.setdefault(b"image" if sub.fourcc in (LOSSY, LOSSLESS) else sub.fourcc, sub)
    if b"image" not in parts:
        raise Invalid("a frame without a picture")
    return Frame(2 * _u24(b, 0), 2 * _u24(b, 3), w, h, _u24(b, 12), not b[15] & 2, bool(b[15] & 1), parts[b"image"], parts.get(ALPHA))


def parse(src: Bytes) -> Container:
    """The container; of metadata, alpha and picture the first counts, and alpha only if it comes before the picture."""
    head = src.read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WEBP":
        raise Invalid("not a media container")
    size = struct.unpack("<I", head[4:8])[0]
    if not 4 <= size <= MOST_PAYLOAD:
        raise Invalid("an odd file size")
    end = min(src.size, 8 + size)
    listed = chunks(src, 12, end)
    first = next(listed, None)
    if first is None:
        raise Invalid("no chunk")
    if first.fourcc in (LOSSY, LOSSLESS):
        return Container(image=first)
    if first.fourcc != EXTENDED or first.size < 10:
        raise Invalid("neither a picture nor an extended header first")
    b = src.exactly(first.off, 10)
    out = Container(True, b[0], _u24(b, 4) + 1, _u24(b, 7) + 1)
    if out.width > MOST_SIDE or out.height > MOST_SIDE or out.width * out.height >= MOST_AREA:
        raise Invalid("a canvas too large")
    alpha = None
    for c in listed:
        if c.fourcc in (PROFILE, EXIF, XMP):
            out.metadata.setdefault(c.fourcc, c)
        elif c.fourcc == ANIMATION:
            if c.size < 6:
                raise Invalid("a short animation header")
            out.loop_count = struct.unpack("<H", src.exactly(c.off, 6)[4:])[0]
        elif c.fourcc == FRAME:
            f = _frame(src, c)
            if out.animated:
                out.frames.append(f)
        elif c.fourcc == ALPHA:
            alpha = alpha or c
        elif c.fourcc in (LOSSY, LOSSLESS) and out.image is None:
            out.image, out.alpha = c, alpha
    if out.image is None and not out.frames:
        raise Invalid("no picture")
    return out


@dataclass(frozen=True)
class Features:
    width: int
    height: int
    has_alpha: bool
    animated: bool
    n_frames: int
    codec: str


def lossy_size(b: bytes) -> tuple[int, int]:
    """Size from a lossy key frame's first ten bytes."""
    if len(b) < 10 or b[0] & 1 or b[3:6] != b"\x9d\x01\x2a":
        raise Invalid("not a lossy key frame")
    w, h = struct.unpack("<HH", b[6:10])
    if not w & 0x3FFF or not h & 0x3FFF:
        raise Invalid("a picture without pixels")
    return w & 0x3FFF, h & 0x3FFF


def features(src: Bytes, c: Container | None = None) -> Features:
    """Size and kind from header bytes only."""
    c = c or parse(src)
    n = len(c.frames)
    if c.image is None or c.animated and c.frames:
        return Features(c.width, c.height, bool(c.flags & ALPHA_FLAG), True, n, "animation")
    if c.image.fourcc == LOSSLESS:
        b = src.read(c.image.off, min(c.image.size, 5))
        if len(b) < 5 or b[0] != SIGNATURE:
            raise Invalid("not a lossless picture")
        h = read_header(BitReader(b[1:]))
        w, hh, alpha = h.width, h.height, h.has_alpha
    else:
        w, hh = lossy_size(src.read(c.image.off, min(c.image.size, 10)))
        alpha = c.alpha is not None
    return Features(c.width or w, c.height or hh, alpha or bool(c.flags & ALPHA_FLAG), False, 1, "lossless" if c.image.fourcc == LOSSLESS else "lossy")


def metadata(src: Bytes, kind: bytes) -> bytes | None:
    """A metadata chunk's payload, without the six-byte prefix some writers put before EXIF; None where there is none."""
    try:
        c = parse(src).metadata.get(kind)
        payload = src.exactly(c.off, c.size) if c else None
    except Invalid:
        return None
    return payload.removeprefix(b"Exif\x00\x00") if payload and kind == EXIF else payload


# writing


def chunk(fourcc: bytes, payload: bytes) -> bytes:
    if len(payload) > MOST_PAYLOAD:
        raise ValueError("a payload over 4 GB")
    return fourcc + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def container(parts: list[tuple[bytes, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(chunk(*p) for p in parts)
    if len(body) > MOST_PAYLOAD:
        raise ValueError("a file over 4 GB")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def extended_header(width: int, height: int, flags: int) -> bytes:
    return bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def animation_header(loop_count: int) -> bytes:
    return bytes(4) + (loop_count & 0xFFFF).to_bytes(2, "little")


def frame(x: int, y: int, w: int, h: int, duration_ms: int, blend: bool, dispose: bool, parts: list[tuple[bytes, bytes]]) -> bytes:
    """A frame's payload; places are halved, the duration keeps its low 24 bits."""
    head = b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, w - 1, h - 1, duration_ms & 0xFFFFFF))
    return head + bytes([(0 if blend else 2) | int(dispose)]) + b"".join(chunk(*p) for p in parts)
