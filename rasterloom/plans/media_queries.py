"""Queries that go through the codec: pictures of the driver's tables are encoded, parsed and decoded again."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import alpha, colour
from ..sources import container as box
from ..sources import exif, media
from . import grids
from .grids import ARGB, PIXELS, PLACED, TILES, with_
from .registry import register

AR, TL = with_(TILES, PLACED, PIXELS, ARGB), with_(TILES)


def _files(spark: SparkSession, sf: str, options: media.EncodeOptions = media.EncodeOptions(exact=True)) -> DataFrame:
    """Each tile as a lossless file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [media.encode(colour.argb_to_rgba(np.array(px, np.uint32), 8), options) for px in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["file_id", "content"])

    return grids.argb_tiles(spark, sf).select("vec_id", "argb").mapInArrow(run, "file_id long, content binary")


def _unpacked(decoded: DataFrame, key: str = "file_id") -> DataFrame:
    """file_id, frame_no, y, x, argb of decoded images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, k, w, h, data in zip(*(c.to_pylist() for c in b.columns)):
                px = colour.rgba_to_argb(np.frombuffer(data, np.uint8).reshape(h, w, 4))
                y, x = np.divmod(np.arange(w * h), w)
                parts.append((np.full(w * h, i), np.full(w * h, k), y, x, px.astype(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=[key, "frame_no", "y", "x", "argb"])

    return decoded.filter("error_class IS NULL").select("file_id", "frame_no", "width", "height", "rgba").mapInArrow(run, f"{key} long, frame_no long, y long, x long, argb long")


@register("k08_lossless_round_trip", AR + "SELECT vec_id, y, x, v AS argb FROM argb")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded and decoded again: every pixel is what it was."""
    return _unpacked(media.pixels(_files(spark, sf)), "vec_id").select("vec_id", "y", "x", "argb")


@register("k08_effort_round_trip", AR + "SELECT vec_id, CAST(sum(v * (p + 1)) AS BIGINT) AS checksum FROM argb GROUP BY vec_id")
def k08_effort(spark: SparkSession, sf: str) -> DataFrame:
    """The same at the highest effort, with cross colour."""
    px = _unpacked(media.pixels(_files(spark, sf, media.EncodeOptions(method=6, exact=True))), "vec_id")
    return px.groupBy("vec_id").agg(F.sum(F.col("argb") * (F.col("y") * 8 + F.col("x") + 1)).alias("checksum"))


@register("a03_containers", AR + "SELECT vec_id, false AS extended, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, bool_or((v >> 24) <> 255) AS has_alpha, 'lossless' AS codec, CAST(20 AS BIGINT) AS image_off FROM argb GROUP BY vec_id")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    c = media.containers(_files(spark, sf))
    return c.select(F.col("file_id").alias("vec_id"), "extended", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "has_alpha", "codec", "image_off")


@register("a01_corruption", TL + "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'INVALID' WHEN vec_id % 5 = 1 THEN 'INVALID' WHEN vec_id % 5 = 2 THEN 'UNSUPPORTED' END AS error_class FROM t")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """Truncated files, files with a bad magic, files of another version, and sound ones: a row each, never a failed task."""
    f = _files(spark, sf)
    kind = F.col("file_id") % 5
    head = lambda n: F.substring("content", 1, n)
    cut = F.when(kind == 0, F.substring("content", 1, 24)).when(kind == 1, F.concat(F.unhex(F.lit("00")), F.expr("substring(content, 2)"))).when(kind == 2, F.concat(head(24), F.unhex(F.lit("F0")), F.expr("substring(content, 26)"))).otherwise(F.col("content"))
    return media.containers(f.withColumn("content", cut)).select(F.col("file_id").alias("vec_id"), "error_class")


@register("a11_exif", "SELECT p_partkey, CAST(1 + p_size % 8 AS INTEGER) AS orientation, p_size * 7 AS width, substring(p_brand, 1, 20) AS make, p_type AS model, round(p_retailprice / 100, 4) AS exposure, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(p_size AS DOUBLE) AS gps_lat FROM part")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """Records written in both byte orders, put into files, and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                key, size = r["p_partkey"], r["p_size"]
                fields = {"orientation": 1 + size % 8, "width": size * 7, "make": r["p_brand"][:20], "model": r["p_type"], "exposure": r["p_retailprice"] / 100, "gps_lat": float(-size if key % 2 == 0 else size)}
                payload = (b"Exif\0\0" if key % 3 == 0 else b"") + exif.build(fields, "<" if key % 2 else ">")
                out.append(box.container([(box.EXTENDED, box.extended_header(1, 1, 8)), (box.EXIF, payload), (box.LOSSLESS, b"\x2f" + bytes(4))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["file_id", "content"])

    files = grids.table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice").mapInArrow(run, "file_id long, content binary")
    return media.exif_records(files).select(F.col("file_id").alias("p_partkey"), "orientation", "width", "make", "model", F.round("exposure", 4).alias("exposure"), "gps_lat")


@register("k09_alpha_round_trip", with_(TILES, PLACED) + "SELECT vec_id, k AS filter, y, x, CAST(v AS BIGINT) AS alpha FROM pl, (SELECT unnest(range(4)) AS k)")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha planes through each filter, raw for odd ids and coded for even ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.divmod(np.arange(64), 8)
        for b in batches:
            parts = []
            for i, px in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                plane = np.array(px, np.uint8).reshape(8, 8)
                for kind in range(4):
                    got = alpha.decode(alpha.encode(plane, kind, i % 2 == 0), 8, 8).reshape(-1)
                    parts.append((np.full(64, i), np.full(64, kind), y, x, got.astype(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["vec_id", "filter", "y", "x", "alpha"])

    return grids.tiles(spark, sf).select("vec_id", "px").mapInArrow(run, "vec_id long, filter long, y long, x long, alpha long")


def _clips(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's tiles, in blocks of ten by id, as an animation of loop count 3; delays go by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for listed in b.column(1).to_pylist():
                images = [colour.argb_to_rgba(np.array(f["argb"], np.uint32), 8) for f in listed]
                made.append(media.encode_animation(images, [40 + f["vec_id"] % 7 for f in listed], media.EncodeOptions(loop_count=3, exact=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["file_id", "content"])

    t = grids.argb_tiles(spark, sf).withColumn("file_id", F.expr("vec_id div 10"))
    clips = t.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "argb"))).alias("frames"))  # ten frames at most
    return clips.mapInArrow(run, "file_id long, content binary")


_FRAMES = "fr AS (SELECT vec_id, vec_id // 10 AS file_id, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS frame_no, 40 + vec_id % 7 AS delay FROM t)"


@register("a05_animation_frames", with_(TILES, _FRAMES) + "SELECT file_id, frame_no, CAST(8 AS BIGINT) AS w, CAST(8 AS BIGINT) AS h, delay AS duration_ms, false AS blend, false AS dispose FROM fr")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    f = media.frames(_clips(spark, sf))
    return f.select("file_id", *[F.col(c).cast("long").alias(c) for c in ("frame_no", "w", "h", "duration_ms")], "blend", "dispose")


@register("k12_animation_round_trip", with_(TILES, PLACED, PIXELS, _FRAMES) + "SELECT file_id, frame_no, y, x, CAST(a AS BIGINT) * 16777216 + " + " + ".join(f"(CASE WHEN a = 255 THEN CAST({c} AS BIGINT) ELSE (CAST({c} AS BIGINT) * a * 32897) >> 23 END) * {m}" for c, m in (("r", 65536), ("g", 256), ("b", 1))) + " AS argb FROM px JOIN fr USING (vec_id)")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    """All frames of the animations, as canvases of premultiplied colour."""
    return _unpacked(media.pixels(_clips(spark, sf)))


@register("k10_first_frame", with_(TILES, PLACED, PIXELS, _FRAMES) + "SELECT file_id, CAST(sum(a) AS BIGINT) AS alpha_sum FROM px JOIN fr USING (vec_id) WHERE frame_no = 0 GROUP BY 1")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """Decoding that stops after the first frame."""
    px = _unpacked(media.pixels(_clips(spark, sf), media.DecodeOptions(first_only=True)))
    return px.groupBy("file_id").agg(F.sum(F.shiftright("argb", 24)).alias("alpha_sum"))


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Four tiles beside each other, two by two, as the luma of a 16x16 picture; chroma from the first and last. The last of fewer tiles is repeated."""
    t = grids.tiles(spark, sf).withColumn("picture_id", F.expr("vec_id div 4"))
    return t.groupBy("picture_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "px"))).alias("tiles"))  # four tiles at most


def _planes(tiles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = [np.array(t["px"], np.uint8).reshape(8, 8) for t in tiles]
    p += [p[-1]] * (4 - len(p))
    return np.block([[p[0], p[1]], [p[2], p[3]]]), p[0], p[3]


_PICTURES = "pc AS (SELECT vec_id // 4 AS picture_id FROM t GROUP BY 1)"


#: Quantizer index of each quality that k11 tries.
_QUALITIES = {20: None, 75: None, 95: None}


def _flat_sql() -> str:
    """What a decoder rebuilds of a 16x16 picture of one colour: guesses of 127, 128 and 129, one coefficient a plane, rounded twice."""
    from ..operators import lossy

    kinds = []
    for quality in _QUALITIES:
        base = lossy.quality_index(quality)
        steps = lossy.steps(base)
        kinds.append(f"({quality}, {steps[lossy.FIRST_LUMA][1] ** 2 >> 7}, {steps[lossy.SECOND][0]}, {steps[lossy.CHROMA][0]})")
    # modes in order: mean, gradient, above, left
    guess = "[128, 129, 127, 129]"
    level = lambda r, q, round_: f"CASE WHEN abs({r}) <= (131071 - {round_ * 512}) // (131072 // {q}) THEN 0 ELSE sign({r}) * least(2047, (abs({r}) * (131072 // {q}) + {round_ * 512}) >> 17) END"
    clip = lambda e: f"CAST(least(255, greatest(0, {e})) AS BIGINT)"
    return f"""k(quality, weight, qy, qc) AS (VALUES {', '.join(kinds)}), f AS (SELECT vec_id, quality, weight, qy, qc, bs[1] AS y, bs[2] AS u, bs[3] AS v FROM t, k),
g AS (SELECT *, list_min([(256 * 256 * pow(y - {guess}[m], 2) + weight * {list(tb.LUMA_MODE_COST)}[m]) * 8 + m FOR m IN range(1, 5)]) AS ym, list_min([(256 * 64 * (pow(u - {guess}[m], 2) + pow(v - {guess}[m], 2)) + weight * {list(tb.CHROMA_MODE_COST)}[m]) * 8 + m FOR m IN range(1, 5)]) AS cm FROM f),
h AS (SELECT *, {guess}[CAST(ym AS BIGINT) % 8] AS yp, {guess}[CAST(cm AS BIGINT) % 8] AS cp FROM g),
l AS (SELECT *, CAST({level('(64 * (y - yp))', 'qy', 96)} AS BIGINT) * qy AS yl, CAST({level('(8 * (u - cp))', 'qc', 110)} AS BIGINT) * qc AS ul, CAST({level('(8 * (v - cp))', 'qc', 110)} AS BIGINT) * qc AS vl FROM h)
SELECT vec_id, CAST(quality AS BIGINT) AS quality, {clip('yp + ((((yl + 3) >> 3) + 4) >> 3)')} AS y_low, {clip('yp + ((((yl + 3) >> 3) + 4) >> 3)')} AS y_high, {clip('cp + ((ul + 4) >> 3)')} AS u, {clip('cp + ((vl + 4) >> 3)')} AS v FROM l"""


@register("k11_lossy_decode", with_(TILES)[:-1] + ", " + _flat_sql())
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of one colour as key frames at three qualities: what the decoder gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import lossy

        for b in batches:
            out = []
            for i, px in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                planes = [np.full((n, n), v, np.uint8) for n, v in zip((16, 8, 8), px)]
                for quality in _QUALITIES:
                    y, u, v = lossy.Decoder().decode(lossy.Encoder(quality, small_blocks=False).encode(*planes)[0])
                    out.append((i, quality, int(y.min()), int(y.max()), int(u[4, 4]), int(v[4, 4])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["vec_id", "quality", "y_low", "y_high", "u", "v"])

    return grids.tiles(spark, sf).select("vec_id", "px").mapInArrow(run, "vec_id long, quality long, y_low long, y_high long, u long, v long")


@register("k11_lossy_rebuild")
def k11_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Key frames of four tiles at three qualities: whether the decoder gives what the encoder rebuilt, and the squared error to the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import lossy

        for b in batches:
            out = []
            for i, tiles in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                planes = _planes(tiles)
                for quality in _QUALITIES:
                    data, rebuilt = lossy.Encoder(quality).encode(*planes)
                    got = lossy.Decoder().decode(data)
                    out.append((i, quality, all((a == c).all() for a, c in zip(got, rebuilt)), sum(int(((a.astype(np.int64) - c) ** 2).sum()) for a, c in zip(got, planes)), len(data)))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["picture_id", "quality", "exact", "sse", "size"])

    return _pictures(spark, sf).mapInArrow(run, "picture_id long, quality long, exact boolean, sse long, size long")


@register("k02_coded_headers", with_(TILES, _PICTURES) + "SELECT picture_id, CAST(quality AS BIGINT) AS quality, CAST(greatest(0, least(127, trunc(127 * (1 - pow(CASE WHEN quality >= 75 THEN 2 * (quality / 100.0) - 1 ELSE (quality / 100.0) * 2 / 3 END, 1.0 / 3)) + 1e-9))) AS BIGINT) AS base FROM (SELECT picture_id, 20 + (picture_id * 7) % 80 AS quality FROM pc)")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """The quantizer index read from the arithmetic-coded part of a frame's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import lossy
        from ..operators.boolcoder import BoolReader

        for b in batches:
            found = []
            for i, tiles in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                quality = 20 + i * 7 % 80
                data = lossy.Encoder(quality, small_blocks=False).encode(*_planes(tiles))[0]
                first = lossy.frame_tag(data)[3]
                r = BoolReader(data[10 : 10 + first])
                r.bits(2)
                lossy.Decoder()._header(r)
                r.bits(2)
                found.append((i, quality, r.bits(7)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["picture_id", "quality", "base"])

    return _pictures(spark, sf).mapInArrow(run, "picture_id long, quality long, base long")


def _per_text(spark: SparkSession, sf: str, of) -> DataFrame:
    def numbered(v: np.ndarray) -> list:
        got = np.array(of(v.tolist()), np.int64)
        return [np.arange(1, len(got) + 1), got]

    return grids.per_text(spark, sf, numbered, "i long, b long")


_TX = with_(grids.TEXT_BYTES) + "SELECT doc_id, i, CAST(b AS BIGINT) AS b FROM tx"


@register("k01_bool_round_trip", _TX)
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes through the arithmetic coder, bit by bit, at probabilities that go by the place."""

    def of(listed: list[int]) -> list[int]:
        from ..operators.boolcoder import BoolReader, BoolWriter

        odds = [1 + (37 * k) % 255 for k in range(8)]
        w = BoolWriter()
        bits = np.unpackbits(np.array(listed, np.uint8), bitorder="little")
        w.many(zip(bits.tolist(), itertools.cycle(odds)))
        got = BoolReader(w.bytes()).many(odds * len(listed))
        return np.packbits(np.frombuffer(got, np.uint8), bitorder="little").tolist()

    return _per_text(spark, sf, of)


@register("g08_lazy_parse", _TX)
def g08(spark: SparkSession, sf: str) -> DataFrame:
    """Back references of a text taken as a picture 8 wide, expanded again."""

    def of(listed: list[int]) -> list[int]:
        from ..operators.lossless import matches

        out: list[int] = []
        for ref in matches(listed, 8):
            if ref[0] == "v":
                out.append(ref[1])
            else:
                for _ in range(ref[2]):
                    out.append(out[-ref[1]])
        return out

    return _per_text(spark, sf, of)


@register("k07_prefix_round_trip", _TX)
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes through their own optimal prefix code, which is stored before them."""

    def of(listed: list[int]) -> list[int]:
        from ..operators.bits import BitReader, BitWriter
        from ..operators.prefix import code_lengths, read_code, write_code

        counts = [0] * 256
        for v in listed:
            counts[v] += 1
        w = BitWriter()
        codes = write_code(w, code_lengths(counts))
        for v in listed:
            w.write(*codes[v])
        r = BitReader(w.bytes())
        d = read_code(r, 256)
        return [d.read(r) for _ in listed]

    return _per_text(spark, sf, of)


@register("i08_code_cost", None)
def i08(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each text under its optimal prefix code, as the mean of a byte times the bytes."""

    def of(listed: list[int]) -> list[int]:
        from ..operators.prefix import code_lengths

        counts = [0] * 256
        for v in listed:
            counts[v] += 1
        return [sum(n * c for n, c in zip(code_lengths(counts), counts))]

    return _per_text(spark, sf, of).select("doc_id", F.col("b").alias("bits"))


@register("k04_video_round_trip")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of up to five 16x16 frames, a key frame and then frames that predict from the last: the decoder rebuilds what the encoder did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import lossy, video

        for b in batches:
            out = []
            for i, frames in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                enc, dec = video.VideoEncoder(70), video.VideoDecoder()
                for k, f in enumerate(frames):
                    data, rebuilt = (enc.encode_inter if k else enc.encode_key)(*_planes(f["tiles"]))
                    got = dec.decode(data)
                    planes = _planes(f["tiles"])
                    sse = sum(int(((a.astype(np.int64) - c) ** 2).sum()) for a, c in zip(got, planes))
                    out.append((i, f["frame_no"], lossy.frame_tag(data)[0], all((a == c).all() for a, c in zip(got, rebuilt)), sse))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()))], names=["clip_id", "frame_no", "key_frame", "exact", "sse"])

    p = _pictures(spark, sf).select(F.expr("picture_id div 5").alias("clip_id"), (F.col("picture_id") % 5).alias("frame_no"), "tiles")
    clips = p.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "tiles"))).alias("frames"))  # five frames at most
    return clips.mapInArrow(run, "clip_id long, frame_no long, key_frame boolean, exact boolean, sse long")


@register("k10_planes", with_(TILES, PLACED, PIXELS) + """SELECT vec_id, CAST(sum(((16839 * r + 33059 * g + 6420 * b + 32768 + 1048576) >> 16) * (p + 1)) AS BIGINT) AS luma, CAST(sum(a * (p + 1)) AS BIGINT) AS alpha FROM px GROUP BY vec_id""")
def k10_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Luma and alpha of lossless files converted to planes, as sums weighted by place."""
    p = media.planes(_files(spark, sf)).filter("plane IN ('y', 'a')")
    at = p.select("file_id", "plane", F.explode(F.sequence(F.lit(1), F.length("data"))).alias("i"), "data")
    byte = F.conv(F.hex(F.call_function("substring", F.col("data"), F.col("i"), F.lit(1))), 16, 10).cast("long")
    sums = at.groupBy(F.col("file_id").alias("vec_id")).agg(*[F.sum(F.when(F.col("plane") == c, byte * F.col("i"))).alias(n) for c, n in (("y", "luma"), ("a", "alpha"))])
    return sums
