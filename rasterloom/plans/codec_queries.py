"""Queries of the codec's own steps: chunks and headers written and read, coders, parses, choices, and options."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import alpha, bits, boolcoder, colour, lossless, lossy, video
from ..session import shared
from ..sources import container as box
from ..sources import datasource, media
from . import block_queries, grids
from .grids import ARGB, PIXELS, PLACED, TEXT_BYTES, TILES, with_
from .media_queries import _FRAMES, _clips, _files, _pictures, _planes, _unpacked
from .registry import register
from .structure_queries import _hx

TL, PL, PX, AR = with_(TILES), with_(TILES, PLACED), with_(TILES, PLACED, PIXELS), with_(TILES, PLACED, PIXELS, ARGB)
_ARGB_ROWS = AR + "SELECT vec_id, y, x, v AS argb FROM argb"


def per_tile(tiles: DataFrame, of: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The rows that of(vec_id, values) gives of each tile; tiles has vec_id and an array."""
    full = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [row for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for row in of(i, np.array(v, np.int64))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return tiles.mapInArrow(run, full)


def _px(spark: SparkSession, sf: str) -> DataFrame:
    return grids.tiles(spark, sf).select("vec_id", "px")


def _argb(spark: SparkSession, sf: str) -> DataFrame:
    return grids.argb_tiles(spark, sf).select("vec_id", "argb")


def _rows(i: int, words: np.ndarray) -> list[tuple]:
    return [(i, p // 8, p % 8, int(v)) for p, v in enumerate(words)]


_ARGB_SCHEMA = "vec_id long, y long, x long, argb long"


@register("a07_features", with_(TILES, PLACED, PIXELS, _FRAMES) + "SELECT file_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, bool_or(a <> 255) AS has_alpha, true AS animated, count(DISTINCT vec_id) AS n_frames, 'animation' AS codec FROM px JOIN fr USING (vec_id) GROUP BY 1")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    """Size, alpha, frames and kind of animations, from header bytes."""
    c = media.containers(_clips(spark, sf))
    return c.select("file_id", *[F.col(k).cast("long").alias(k) for k in ("width", "height")], "has_alpha", "animated", F.col("n_frames").cast("long").alias("n_frames"), "codec")


@register("a14_header_source", AR + "SELECT vec_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, bool_or((v >> 24) <> 255) AS has_alpha, 'lossless' AS codec, CAST(NULL AS VARCHAR) AS error_class, true AS few_bytes FROM argb GROUP BY vec_id")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    """Files written by the sink and read by the header format, which takes at most 64 bytes of each."""
    spark.dataSource.register(datasource.Files)
    spark.dataSource.register(datasource.Headers)
    folder = shared(spark, "headers")
    _files(spark, sf).select(F.concat(F.lit("t"), F.col("file_id").cast("string"), F.lit(".webp")).alias("name"), "content").write.format("media_files").mode("append").save(folder)
    h = spark.read.format("media_headers").load(folder)
    return h.select(F.regexp_extract("path", r"t(\d+)\.webp$", 1).cast("long").alias("vec_id"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "has_alpha", "codec", "error_class", (F.col("bytes_read") <= 64).alias("few_bytes"))


@register("b01_chunks", f"SELECT p_partkey, '45584946' || {_hx('CAST(strlen(p_type) AS BIGINT)', 4)} || hex(encode(p_type)) || CASE WHEN strlen(p_type) % 2 = 1 THEN '00' ELSE '' END AS chunk FROM part")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk's bytes: kind, size, payload, and a zero where the payload is odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [box.chunk(box.EXIF, t.encode()).hex().upper() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["p_partkey", "chunk"])

    return grids.table(spark, sf, "part").select("p_partkey", "p_type").mapInArrow(run, "p_partkey long, chunk string")


@register("b03_still_layout", TL + "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'VP8 ' ELSE 'VP8X ALPH VP8 ' END AS kinds, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 16 END AS flags, CAST(0 AS BIGINT) AS left_over FROM t")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    """Lossy stills, every third opaque: their chunks in order, flags, and what the file's size says beyond them."""

    def of(i: int, argb: np.ndarray) -> list[tuple]:
        rgba = colour.argb_to_rgba(argb.astype(np.uint32), 8)
        rgba[..., 3] = 255 if i % 3 == 0 else np.minimum(rgba[..., 3], 254)
        data = media.encode(rgba, media.EncodeOptions(lossless=False, method=0), lossy.Tables())
        src = box.Bytes.of(data)
        parts = list(box.chunks(src, 12, len(data)))
        return [(i, " ".join(c.fourcc.decode() for c in parts), box.parse(src).flags, int.from_bytes(data[4:8], "little") - 4 - sum(8 + c.size + c.size % 2 for c in parts))]

    return per_tile(_argb(spark, sf), of, "vec_id long, kinds string, flags int, left_over long")


@register("b04_animation_layout", with_(TILES, _FRAMES) + "SELECT file_id, 'VP8X ANIM' || repeat(' ANMF', CAST(count(*) AS INTEGER)) AS kinds, CAST(sum(delay) AS BIGINT) AS duration_ms, CAST(3 AS BIGINT) AS loop_count FROM fr GROUP BY 1")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    """Animations: their chunks in order, their duration, how often they run."""
    clips = _clips(spark, sf)
    outer = media.chunk_rows(clips).filter("parent IS NULL").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fourcc"))), lambda c: c["fourcc"]), " ").alias("kinds"))  # twelve chunks at most
    time = media.frames(clips).groupBy("file_id").agg(F.sum("duration_ms").cast("long").alias("duration_ms"))
    loops = media.containers(clips).select("file_id", F.col("loop_count").cast("long").alias("loop_count"))
    return outer.join(time, "file_id").join(loops, "file_id")


@register("b05_frame_tags", with_(TILES) + "SELECT DISTINCT vec_id // 4 AS picture_id, k = 0 AS key_frame, k AS place, CAST(0 AS BIGINT) AS profile, true AS show, true AS fits FROM t, (SELECT unnest(range(2)) AS k)")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    """A key frame and a frame that predicts from it: their tags, and whether the first partition lies within the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, tiles in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                planes, enc = _planes(tiles), video.VideoEncoder(60, small_blocks=False)
                for k, data in enumerate((enc.encode_key(*planes)[0], enc.encode_inter(*(255 - p for p in planes))[0])):
                    key, profile, show, first = lossy.frame_tag(data)
                    out.append((i, key, k, profile, show, first <= len(data) - (10 if key else 3)))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["picture_id", "key_frame", "place", "profile", "show", "fits"])

    return _pictures(spark, sf).mapInArrow(run, "picture_id long, key_frame boolean, place long, profile long, show boolean, fits boolean")


#: Bits that b06 codes, before the 32 that end a stream.
_CODED = 6


@register("b06_bool_coder", TL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", r AS (SELECT vec_id, bs, 0 AS k, CAST(0 AS BIGINT) AS low, CAST(255 AS BIGINT) AS size, 0 AS n FROM t
UNION ALL SELECT vec_id, bs, k + 1, CASE WHEN bit = 1 THEN low + split ELSE low END << CAST(s AS INTEGER), part << CAST(s AS INTEGER), n + s FROM (
  SELECT *, CASE WHEN part >= 128 THEN 0 ELSE 8 - length(bin(part)) END AS s FROM (SELECT *, CASE WHEN bit = 1 THEN size - split ELSE split END AS part FROM (
    SELECT *, 1 + (((size - 1) * p) >> 8) AS split FROM (SELECT *, CASE WHEN k < {_CODED} THEN bs[k + 1] % 2 ELSE 0 END AS bit, CASE WHEN k < {_CODED} THEN 64 + bs[k + 9] // 2 ELSE 128 END AS p FROM r WHERE k < {_CODED} + 32)))))
SELECT vec_id, substring(lpad(hex(low >> (8 + n - 8 * ((n - 16) // 8))), 64, '0'), 65 - 2 * ((n - 16) // 8)) AS coded FROM r WHERE k = {_CODED} + 32""")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    """Six bits with chances from the tile, and the 32 bits that end a stream, as bytes."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        w = boolcoder.BoolWriter()
        w.many((int(px[k]) % 2, 64 + int(px[k + 8]) // 2) for k in range(_CODED))
        return [(i, w.bytes().hex().upper())]

    return per_tile(_px(spark, sf), of, "vec_id long, coded string")


@register("b09_frame_headers", TL + f"SELECT vec_id, '9D012A' || {_hx('CAST(1 + bs[1] % 40 AS BIGINT)', 2)} || {_hx('CAST(1 + bs[2] % 40 AS BIGINT)', 2)} AS header, CAST(16 AS BIGINT) AS low_bits FROM t")
def b09(spark: SparkSession, sf: str) -> DataFrame:
    """Start code and size of key frames of 1 to 40 pixels a side, and the tag's bits below the first partition's size."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        w, h = 1 + int(px[0]) % 40, 1 + int(px[1]) % 40
        half = ((h + 1) // 2, (w + 1) // 2)
        data = lossy.encode(np.full((h, w), px[2], np.uint8), np.full(half, px[3], np.uint8), np.full(half, px[4], np.uint8), 50, small_blocks=False)
        return [(i, data[3:10].hex().upper(), data[0] & 31)]

    return per_tile(_px(spark, sf), of, "vec_id long, header string, low_bits long")


@register("b10_token_replay", TL + "SELECT vec_id, i, bs[i + 1] // 32 - 3 AS level FROM t, (SELECT unnest(range(16)) AS i)")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    """Levels recorded as tokens, replayed into the coder once their probabilities are known, and read again."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        levels, tokens = (px[:16] // 32 - 3).tolist(), []
        lossy.write_block(lambda band, c, slot, bit: tokens.append((slot if band is None else (band, c, slot), bit)), levels, 1, 0)
        odds = (1 + px[16 + np.arange(8 * 3 * 11) % 48]).clip(1, 255).reshape(8, 3, 11).tolist()
        w = boolcoder.BoolWriter()
        w.many((bit, slot if isinstance(slot, int) else odds[slot[0]][slot[1]][slot[2]]) for slot, bit in tokens)
        got = lossy.read_block(boolcoder.BoolReader(w.bytes()), odds, 1, 0)[0]
        return [(i, k, v) for k, v in enumerate(got)]

    return per_tile(_px(spark, sf), of, "vec_id long, i long, level long")


_BLOCKS = [("y2", k) for k in range(1)] + [("y", k) for k in range(16)] + [("u", k) for k in range(4)] + [("v", k) for k in range(4)]


@register("k05_coefficients", TL + "SELECT vec_id, b AS block, CAST(sum(CASE WHEN b BETWEEN 1 AND 16 AND n = 0 THEN 0 ELSE bs[(b * 16 + n) % 64 + 1] // 64 - 1 END * (n + 1)) AS BIGINT) AS weighed FROM t, (SELECT unnest(range(25)) AS b), (SELECT unnest(range(16)) AS n) GROUP BY 1, 2")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 blocks of a macroblock written and read with contexts from its neighbours, as sums weighted by place."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        levels = {b: (px[(k * 16 + np.arange(16)) % 64] // 64 - 1).tolist() for k, b in enumerate(_BLOCKS)}
        for k in range(16):
            levels["y", k][0] = 0
        odds, tokens, w = lossy.Tables().coefficients, [], boolcoder.BoolWriter()
        lossy.Encoder._tokens(tokens, levels, [0] * 9, [0] * 9, False)
        w.many((bit, slot if isinstance(slot, int) else int(odds[slot])) for slot, bit in tokens)
        got = lossy.read_macroblock(boolcoder.BoolReader(w.bytes()), odds.tolist(), [0] * 9, [0] * 9, False)
        return [(i, k, sum(v * (n + 1) for n, v in enumerate(got[b]))) for k, b in enumerate(_BLOCKS)]

    return per_tile(_px(spark, sf), of, "vec_id long, block long, weighed long")


@register("g03_gradient_round_trip", PL + "SELECT vec_id, y, x, CAST(v AS BIGINT) AS v FROM pl")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of the gradient filter, summed again in order."""
    back = lambda i, px: _rows(i, alpha.unfilter(alpha.filtered(px.reshape(8, 8).astype(np.uint8), alpha.GRADIENT), alpha.GRADIENT).reshape(-1))
    return per_tile(_px(spark, sf), back, "vec_id long, y long, x long, v long")


@register("g04_predictor_inverse", _ARGB_ROWS)
def g04(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of one of the 14 modes, by the tile's id, undone pixel by pixel."""

    def of(i: int, argb: np.ndarray) -> list[tuple]:
        px, mode = argb.astype(np.uint32), i % 14
        left = lossless.subtract(px, lossless.predictions(px, 8)[mode])
        return _rows(i, lossless.unpredict(left, 8, 3, np.array([mode << 8])))

    return per_tile(_argb(spark, sf), of, _ARGB_SCHEMA)


@register("g09_cheapest_parse", PL + "SELECT vec_id, p AS i, CAST(v // 64 AS BIGINT) AS v FROM pl")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    """The parse of least estimated bits of a tile's four levels, expanded again."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        values = (px // 64).tolist()
        out: list[int] = []
        for ref in lossless.cheapest_parse(lossless.matches(values, 8), values, 8):
            for _ in range(ref[2] if ref[0] == "c" else 1):
                out.append(out[-ref[1]] if ref[0] == "c" else ref[1])
        return [(i, k, v) for k, v in enumerate(out)]

    return per_tile(_px(spark, sf), of, "vec_id long, i long, v long")


@register("h05_trellis")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of least squared error and bits of a tile's first 16 bytes as coefficients in scan order."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        c = (px[:16] - 128) >> (np.arange(16) // 3)
        return [(i, k, v) for k, v in enumerate(lossy.trellis(c, (20, 24), lossy.Tables().coefficients[lossy.WHOLE_LUMA].tolist(), 0, 0, 24**2 / 8))]

    return per_tile(_px(spark, sf), of, "vec_id long, i long, level long")


_WEIGHT = lossy.Encoder(75).weight


@register("i02_small_modes", TL[:-1] + block_queries._small_sql().split(" SELECT vec_id, mode, i")[0] + f""", c AS (SELECT s.vec_id, mode, list_sum([pow(bs[49 + i] - o[i + 1], 2) FOR i IN range(16)]) * 256 + {_WEIGHT} * CASE mode WHEN 'dc' THEN 250 ELSE 700 END AS score FROM s JOIN t USING (vec_id))
SELECT vec_id, arg_min(mode, score * 16 + list_position({list(lossy.SMALL)}, mode)) AS mode, CAST(min(score) AS BIGINT) AS score FROM c GROUP BY vec_id""")
def i02(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest of the ten 4x4 modes for the tile's last 16 bytes, from its first 13 as neighbours; the first of equal ones."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        mode, score = lossy.best_small(px[48:].reshape(4, 4), px[:13], _WEIGHT)[:2]
        return [(i, lossy.SMALL[mode], score)]

    return per_tile(_px(spark, sf), of, "vec_id long, mode string, score long")


@register("i03_inter_choice")
def i03(spark: SparkSession, sf: str) -> DataFrame:
    """Of a picture, the same again and its negative: how many macroblocks each later frame takes from the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, tiles in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                planes, enc = _planes(tiles), video.VideoEncoder(60, small_blocks=False)
                enc.encode_key(*planes)
                for k, now in enumerate((planes, [255 - p for p in planes])):
                    enc.encode_inter(*now)
                    out.append((i, k + 1, enc.moved))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["picture_id", "place", "moved"])

    return _pictures(spark, sf).mapInArrow(run, "picture_id long, place long, moved long")


@register("i07_stream_choice")
def i07(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of a clip's tiles below each other, without and with a try of cross colour; the shorter stream is taken."""

    def of(i: int, argb: np.ndarray) -> list[tuple]:
        px = argb.astype(np.uint32)
        return [(i, *(len(lossless.encode(px, 8, len(px) // 8, effort)) for effort in (5, 6)))]

    tiles = grids.argb_tiles(spark, sf).groupBy(grids.clip().alias("clip_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "argb"))), lambda t: t["argb"])).alias("argb"))  # twenty tiles at most
    return per_tile(tiles, of, "clip_id long, plain long, tried long")


@register("k03_intra_modes", TL + "SELECT vec_id, i, bs[i + 1] % 10 AS mode, bs[17] % 4 AS chroma FROM t, (SELECT unnest(range(16)) AS i)")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen 4x4 modes and a chroma mode, written by their neighbours' odds and read again."""

    def of(i: int, px: np.ndarray) -> list[tuple]:
        enc, dec, w = lossy.Encoder(), lossy.Decoder(), boolcoder.BoolWriter()
        enc._put_modes(w, True, (px[:16] % 10).tolist(), int(px[16]) % 4, [lossy.DC] * 4, [lossy.DC] * 4)
        _, modes, chroma = dec._modes(boolcoder.BoolReader(w.bytes()), [lossy.DC] * 4, [lossy.DC] * 4)
        return [(i, k, m, chroma) for k, m in enumerate(modes)]

    return per_tile(_px(spark, sf), of, "vec_id long, i long, mode long, chroma long")


@register("k06_bit_fields", with_(TEXT_BYTES) + "SELECT doc_id, i, CAST(b & ((1 << CAST(1 + b % 8 AS INTEGER)) - 1) AS BIGINT) AS v FROM tx")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of 1 to 8 bits of whole texts, written and read."""

    def of(v: np.ndarray) -> list:
        w, n = bits.BitWriter(), (1 + v % 8).tolist()
        for value, width in zip((v & ((1 << (1 + v % 8)) - 1)).tolist(), n):
            w.write(value, width)
        r = bits.BitReader(w.bytes())
        return [np.arange(1, len(v) + 1), np.array([r.read(width) for width in n], np.int64)]

    return grids.per_text(spark, sf, of, "i long, v long")


_TIMES = " + ".join(f"(CASE WHEN a = 255 THEN CAST({c} AS BIGINT) ELSE (CAST({c} AS BIGINT) * a * 32897) >> 23 END) * {m}" for c, m in (("r", 65536), ("g", 256), ("b", 1)))


@register("m01_premultiplied", PX + f"SELECT vec_id, y, x, CAST(a AS BIGINT) * 16777216 + {_TIMES} AS argb FROM px")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Stills with their colour multiplied by alpha, as animations have it."""
    return _unpacked(media.pixels(_files(spark, sf), media.DecodeOptions(premultiplied=True)), "vec_id").select("vec_id", "y", "x", "argb")


@register("m01_size_limit", TL + "SELECT vec_id, k AS size_limit, CASE WHEN k = 63 THEN 'UNSUPPORTED' END AS error_class FROM t, (SELECT unnest([63, 64]) AS k)")
def m01_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of 64 pixels under limits of 63 and 64."""
    files = _files(spark, sf)
    one = lambda n: media.pixels(files, media.DecodeOptions(size_limit=n)).select(F.col("file_id").alias("vec_id"), F.lit(n).alias("size_limit"), "error_class")
    return one(63).unionByName(one(64))


@register("m02_hidden_colour", AR + "SELECT vec_id, y, x, CASE WHEN (v >> 24) < 128 THEN 0 ELSE v END AS argb FROM argb")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded without `exact`: pixels of no alpha (here of less than half) lose their colour, others keep it."""

    def of(i: int, argb: np.ndarray) -> list[tuple]:
        px = np.where(argb >> 24 < 128, argb & 0xFFFFFF, argb).astype(np.uint32)
        got = next(iter(media.decode(media.encode(colour.argb_to_rgba(px, 8)))))[1]
        return _rows(i, colour.rgba_to_argb(got))

    return per_tile(_argb(spark, sf), of, _ARGB_SCHEMA)


@register("m03_stream_driver", _ARGB_ROWS)
def m03(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lossless streams, at the effort that the tile's id gives."""
    back = lambda i, argb: _rows(i, lossless.decode(lossless.encode(argb.astype(np.uint32), 8, 8, i % 7))[1])
    return per_tile(_argb(spark, sf), back, _ARGB_SCHEMA)
