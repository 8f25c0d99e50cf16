"""Media files as DataFrames: containers, chunks, frames, EXIF records and pixels of a column of bytes.

Each function maps rows of (file_id, content) by Arrow batches, one file at a time: files are decoded
side by side, never in one task together. A file that doesn't follow the format gives a row whose
error_class tells so, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alpha, colour, lossless
from ..operators.bits import Invalid, Unsupported
from . import container as box
from . import exif

#: Bytes of planes or pixels after which rows are handed on.
BATCH_BYTES = 8 << 20
STILL_AREA, CANVAS_AREA = 1 << 28, 1 << 26
#: The class of what a file does wrong.
CLASSES = ((Unsupported, "UNSUPPORTED"), (Invalid, "INVALID"), (ValueError, "INVALID"), (IndexError, "INVALID"), (OverflowError, "INVALID"))


@dataclass(frozen=True)
class DecodeOptions:
    """auto_rotate turns pictures by their EXIF orientation; alpha_dither smooths reduced alpha by 0 to 100; size_limit is the most
    pixels of a canvas (0: the default, negative: none); first_only stops after an animation's first frame; premultiplied gives stills
    as animations are, with colour multiplied by alpha."""

    auto_rotate: bool = False
    alpha_dither: int = 0
    size_limit: int = 0
    first_only: bool = False
    premultiplied: bool = False


@dataclass(frozen=True)
class EncodeOptions:
    """quality 0 or less is 75, over 100 is 100; method (effort) below 0 is 4, over 6 is 6: lossy pictures choose 4x4 modes from 3 on and
    levels by trellis from 5 on; exact keeps colour under full transparency, which is cleared otherwise. Lossy pictures need the
    format's published tables, so lossless is the default."""

    quality: int = 75
    method: int = 4
    lossless: bool = True
    loop_count: int = 0
    exact: bool = False

    @property
    def effort(self) -> int:
        return 4 if self.method < 0 else min(self.method, 6)

    @property
    def level(self) -> int:
        return 75 if self.quality <= 0 else min(self.quality, 100)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file_id (of the path), path, content of the files below a path, by Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "path", "content")


def error_class(e: Exception) -> str:
    return next(name for kind, name in CLASSES if isinstance(e, kind))


def _rows(files: DataFrame, schema: str, of: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """of() of each file's bytes, with file_id and error_class before what it gives."""
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"file_id long, error_class string, {schema}")
    names = full.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for b in batches:
            rows, size = [], 0
            for i, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    if content.as_py() is None:
                        raise Invalid("no bytes")
                    found, error = list(of(content.as_py())), None
                except tuple(k for k, _ in CLASSES) as e:
                    found, error = [{}], error_class(e)
                for r in found:
                    rows.append(r | {"file_id": i, "error_class": error})
                    size += sum(len(v) for v in r.values() if isinstance(v, bytes))
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("file_id", "content").mapInArrow(run, full)


def containers(files: DataFrame) -> DataFrame:
    """One row a file: its kind, canvas, loop count, and the places of its parts."""

    def of(data: bytes) -> Iterator[dict]:
        src = box.Bytes.of(data)
        c = box.parse(src)
        f = box.features(src, c)
        yield {
            "extended": c.extended, "flags": c.flags, "width": f.width, "height": f.height, "has_alpha": f.has_alpha, "animated": f.animated, "n_frames": f.n_frames, "codec": f.codec,
            "loop_count": c.loop_count, "image_off": c.image and c.image.off, "image_size": c.image and c.image.size, "alpha_off": c.alpha and c.alpha.off, "orientation": exif.orientation(box.metadata(src, box.EXIF)),
        }

    return _rows(files, "extended boolean, flags int, width int, height int, has_alpha boolean, animated boolean, n_frames int, codec string, loop_count int, image_off long, image_size long, alpha_off long, orientation int", of)


def chunk_rows(files: DataFrame) -> DataFrame:
    """Every chunk of the first level, and those inside frames with their parent's ordinal."""

    def of(data: bytes) -> Iterator[dict]:
        src = box.Bytes.of(data)
        box.parse(src)
        end = min(len(data), 8 + int.from_bytes(data[4:8], "little"))
        for k, c in enumerate(box.chunks(src, 12, end)):
            yield {"parent": None, "ordinal": k, "fourcc": c.fourcc.decode("latin-1"), "off": c.off, "size": c.size}
            if c.fourcc == box.FRAME:
                for j, sub in enumerate(box.chunks(src, c.off + 16, c.off + c.size)):
                    yield {"parent": k, "ordinal": j, "fourcc": sub.fourcc.decode("latin-1"), "off": sub.off, "size": sub.size}

    return _rows(files, "parent int, ordinal int, fourcc string, off long, size long", of)


def frames(files: DataFrame) -> DataFrame:
    """Frame headers of animations."""

    def of(data: bytes) -> Iterator[dict]:
        for k, f in enumerate(box.parse(box.Bytes.of(data)).frames):
            yield {"frame_no": k, "x": f.x, "y": f.y, "w": f.w, "h": f.h, "duration_ms": f.duration_ms, "blend": f.blend, "dispose": f.dispose, "codec": f.image.fourcc.decode("latin-1").strip()}

    return _rows(files, "frame_no int, x int, y int, w int, h int, duration_ms int, blend boolean, dispose boolean, codec string", of)


def exif_records(files: DataFrame) -> DataFrame:
    """EXIF fields; files without a record give none, with a broken one NO_EXIF."""

    def of(data: bytes) -> Iterator[dict]:
        payload = box.metadata(box.Bytes.of(data), box.EXIF)
        if payload is not None:
            yield exif.parse(payload)

    return _rows(files, exif.SCHEMA, of).withColumn("error_class", F.when(F.col("error_class").isNotNull(), "NO_EXIF"))


def lossy_decoder(tables, most: int):
    """A decoder of key frames; without the published tables pixels would be wrong, so there is none."""
    from ..operators import lossy

    if tables is None:
        raise Unsupported("a lossy picture, as the format's tables weren't given")
    return lossy.Decoder(tables, most)


def picture(src: box.Bytes, image: box.Chunk, alpha_chunk: box.Chunk | None, options: DecodeOptions, tables=None) -> np.ndarray:
    """A still or a frame as height x width x RGBA, not premultiplied."""
    data = src.exactly(image.off, image.size)
    most = options.size_limit or STILL_AREA
    if image.fourcc == box.LOSSLESS:
        h, px = lossless.decode(data, most)
        return colour.argb_to_rgba(px, h.width)
    y, u, v = lossy_decoder(tables, most).decode(data)
    rgb = colour.to_rgb(y, u, v)
    a = alpha.decode(src.exactly(alpha_chunk.off, alpha_chunk.size) if alpha_chunk else None, y.shape[1], y.shape[0], options.alpha_dither)
    return np.concatenate([rgb, a[..., None]], 2)


def key_frame(k: int, f: box.Frame, opaque: bool, before: box.Frame | None, before_key: bool, width: int, height: int) -> bool:
    full = lambda g: g.w == width and g.h == height
    return k == 0 or (opaque or not f.blend) and full(f) or before.dispose and (full(before) or before_key)


def composed(src: box.Bytes, c: box.Container, options: DecodeOptions, tables=None) -> Iterator[tuple[int, np.ndarray]]:
    """(delay, canvas of premultiplied RGBA) of an animation's frames in order."""
    canvas, before, before_key = np.zeros((c.height, c.width, 4), np.uint8), None, False
    for k, f in enumerate(c.frames):
        if f.x + f.w > c.width or f.y + f.h > c.height:
            raise Invalid("a frame past the canvas")
        opaque = f.alpha is None and not (f.image.fourcc == box.LOSSLESS and box.read_header(box.BitReader(src.exactly(f.image.off, 5)[1:])).has_alpha)
        key = key_frame(k, f, opaque, before, before_key, c.width, c.height)
        old = np.zeros_like(canvas) if key else canvas
        px = colour.premultiplied(picture(src, f.image, f.alpha, options, tables))
        if px.shape[:2] != (f.h, f.w):
            raise Invalid("a frame of another size than its header's")
        canvas = colour.drawn(old, px, f.x, f.y, f.blend and not key, (before.x, before.y, before.w, before.h) if before and before.dispose else None)
        yield f.duration_ms, canvas
        if options.first_only:
            return
        canvas = canvas.copy()
        if f.dispose:
            canvas[f.y : f.y + f.h, f.x : f.x + f.w] = 0
        before, before_key = f, key


def decode(data: bytes, options: DecodeOptions = DecodeOptions(), tables=None) -> Iterator[tuple[int, np.ndarray]]:
    """(delay, RGBA) of each image of a file: a still's one has delay 0; those of an animation are premultiplied."""
    src = box.Bytes.of(data)
    c = box.parse(src)
    most = options.size_limit or (CANVAS_AREA if c.animated else STILL_AREA)
    if most > 0 and c.width * c.height > most:
        raise Unsupported("a canvas over the size limit")
    turn = exif.orientation(box.metadata(src, box.EXIF)) if options.auto_rotate else 1
    shown = composed(src, c, options, tables) if c.animated else iter([(0, picture(src, c.image, c.alpha, options, tables))])
    if c.animated and not c.frames:
        raise Invalid("an animation without frames")
    for delay, rgba in shown:
        flat = not c.animated and (options.premultiplied or turn > 1)
        yield delay, colour.oriented(colour.premultiplied(rgba) if flat else rgba, turn) if turn > 1 or flat else rgba


def still_planes(data: bytes, options: DecodeOptions = DecodeOptions(), tables=None) -> dict[str, np.ndarray]:
    """Planes y, u, v and a of a still: a lossy one's own, a lossless one's by conversion."""
    src = box.Bytes.of(data)
    c = box.parse(src)
    if c.animated or c.image is None:
        raise Unsupported("planes of an animation")
    if c.image.fourcc == box.LOSSLESS:
        rgba = picture(src, c.image, None, options)
        return dict(zip("yuva", (*colour.to_yuv(rgba[..., :3]), rgba[..., 3])))
    y, u, v = lossy_decoder(tables, options.size_limit or STILL_AREA).decode(src.exactly(c.image.off, c.image.size))
    a = alpha.decode(src.exactly(c.alpha.off, c.alpha.size) if c.alpha else None, y.shape[1], y.shape[0], options.alpha_dither)
    return {"y": y, "u": u, "v": v, "a": a}


def planes(files: DataFrame, options: DecodeOptions = DecodeOptions(), tables=None) -> DataFrame:
    """Planes of stills, one row each: plane, width, height, data (bytes in raster order)."""

    def of(data: bytes) -> Iterator[dict]:
        for name, p in still_planes(data, options, tables).items():
            yield {"plane": name, "width": p.shape[1], "height": p.shape[0], "data": np.ascontiguousarray(p).tobytes()}

    return _rows(files, "plane string, width int, height int, data binary", of)


def pixels(files: DataFrame, options: DecodeOptions = DecodeOptions(), tables=None) -> DataFrame:
    """Decoded images, one row each: frame_no, delay_ms, width, height, rgba (bytes in raster order)."""

    def of(data: bytes) -> Iterator[dict]:
        for k, (delay, rgba) in enumerate(decode(data, options, tables)):
            yield {"frame_no": k, "delay_ms": delay, "width": rgba.shape[1], "height": rgba.shape[0], "rgba": rgba.tobytes()}

    return _rows(files, "frame_no int, delay_ms int, width int, height int, rgba binary", of)


def encode(rgba: np.ndarray, options: EncodeOptions = EncodeOptions(), tables=None) -> bytes:
    """A still: one lossless picture, or a lossy one with its alpha beside it if it isn't opaque."""
    h, w = rgba.shape[:2]
    if options.lossless:
        px = colour.rgba_to_argb(rgba)
        return box.container([(box.LOSSLESS, lossless.encode(px if options.exact else np.where(px >> np.uint32(24) == 0, np.uint32(0), px), w, h, options.effort))])
    from ..operators import lossy

    if tables is None:
        raise ValueError("a lossy picture needs the format's tables: operators.lossy.Tables.read")
    coded = lossy.Encoder(options.level, tables, options.effort >= 3, options.effort >= 5).encode(*colour.to_yuv(rgba[..., :3]))[0]
    if (rgba[..., 3] == 255).all():
        return box.container([(box.LOSSY, coded)])
    return box.container([(box.EXTENDED, box.extended_header(w, h, box.ALPHA_FLAG)), (box.ALPHA, alpha.encode(rgba[..., 3])), (box.LOSSY, coded)])


def encode_animation(images: list[np.ndarray], delays: list[int], options: EncodeOptions = EncodeOptions(), tables=None) -> bytes:
    """Frames that cover the canvas, without blending or disposal; missing delays are 0."""
    h, w = images[0].shape[:2]
    if any(i.shape[:2] != (h, w) for i in images):
        raise ValueError("frames must be of one size")
    see_through = any((i[..., 3] != 255).any() for i in images)
    parts = [(box.EXTENDED, box.extended_header(w, h, box.ANIMATED_FLAG | (box.ALPHA_FLAG if see_through else 0))), (box.ANIMATION, box.animation_header(options.loop_count))]
    for k, image in enumerate(images):
        still = box.parse(src := box.Bytes.of(encode(image, options, tables)))
        inner = [(c.fourcc, src.exactly(c.off, c.size)) for c in (still.alpha, still.image) if c]
        parts.append((box.FRAME, box.frame(0, 0, w, h, delays[k] if k < len(delays) else 0, False, False, inner)))
    return box.container(parts)
