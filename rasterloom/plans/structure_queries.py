"""Queries of containers, headers, predicates, lookups, and folds over ordered frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions import headers as hd
from ..operators.near import NEAR
from ..streaming import decoder_state
from . import grids
from .grids import ARGB, PIXELS, PLACED, TEXT_BYTES, TILES, with_
from .registry import register

TL, PL, PX, AR, TX = with_(TILES), with_(TILES, PLACED), with_(TILES, PLACED, PIXELS), with_(TILES, PLACED, PIXELS, ARGB), with_(TEXT_BYTES)


def _longs(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """Numbers as long, truth values as they are."""
    out = df.select(*keep, *[c.alias(k) for k, c in made.items()])
    return out.select([F.col(k).cast("long") if t in ("int", "smallint", "tinyint") else F.col(k) for k, t in out.dtypes])


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a container, its lines as chunks as long as their quantity."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    l_ = grids.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus").alias("fourcc"), F.col("l_quantity").cast("long").alias("size"))
    return l_.withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn("off", (12 + F.coalesce(F.sum(hd.chunk_step(F.col("size"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))


_LINES = """ch AS (SELECT l_orderkey, l_returnflag || l_linestatus AS fourcc, CAST(l_quantity AS BIGINT) AS size, row_number() OVER w AS ordinal,
  CAST(12 + sum(8 + CAST(l_quantity AS BIGINT) + CAST(l_quantity AS BIGINT) % 2) OVER w - (8 + CAST(l_quantity AS BIGINT) + CAST(l_quantity AS BIGINT) % 2) AS BIGINT) AS off
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus))"""


@register("a02_chunk_offsets", with_(_LINES) + "SELECT l_orderkey, ordinal, fourcc, off, size FROM ch")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("l_orderkey", "ordinal", "fourcc", "off", "size")


@register("a04_first_chunks", with_(_LINES) + "SELECT l_orderkey, fourcc, arg_min(off, ordinal) AS off, arg_min(size, ordinal) AS size FROM ch GROUP BY 1, 2")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """The first chunk of each kind wins."""
    return _lines(spark, sf).groupBy("l_orderkey", "fourcc").agg(F.min_by("off", "ordinal").alias("off"), F.min_by("size", "ordinal").alias("size"))


def _le(at: int, n: int) -> str:
    return "(" + " + ".join(f"CAST(bs[{at + k + 1}] AS BIGINT) * {1 << 8 * k}" for k in range(n)) + ")"


@register("a05_frame_headers", TL + f"SELECT vec_id, {_le(0, 3)} * 2 AS x, {_le(3, 3)} * 2 AS y, {_le(6, 3)} + 1 AS w, {_le(9, 3)} + 1 AS h, {_le(12, 3)} AS duration_ms, bs[16] & 2 = 0 AS blend, bs[16] & 1 = 1 AS dispose FROM t")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(grids.tiles(spark, sf), ["vec_id"], hd.frame_header(F.col("px")))


@register("a06_payload", "SELECT page_id, substring(hex(encode(html)), 2 * (page_id % 40) + 1, 2 * (20 + page_id % 7)) AS payload FROM pages")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of a range of a binary."""
    return grids.table(spark, sf, "pages").select("page_id", F.hex(F.expr("substring(cast(html AS binary), cast(page_id % 40 AS int) + 1, cast(20 + page_id % 7 AS int))")).alias("payload"))


@register("a08_lossy_headers", TL + f"""SELECT vec_id, {_le(0, 1)} & 1 = 0 AS key_frame, ({_le(0, 3)} >> 1) & 7 AS profile, ({_le(0, 3)} >> 4) & 1 = 1 AS show, {_le(0, 3)} >> 5 AS first_size,
  CASE WHEN bs[1] & 1 = 0 THEN bs[4] = 157 AND bs[5] = 1 AND bs[6] = 42 END AS start_code_ok, CASE WHEN bs[1] & 1 = 0 THEN {_le(6, 2)} & 16383 END AS width, CASE WHEN bs[1] & 1 = 0 THEN {_le(6, 2)} >> 14 END AS x_scale,
  CASE WHEN bs[1] & 1 = 0 THEN {_le(8, 2)} & 16383 END AS height, CASE WHEN bs[1] & 1 = 0 THEN {_le(8, 2)} >> 14 END AS y_scale FROM t""")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(grids.tiles(spark, sf), ["vec_id"], hd.lossy_header(F.col("px")))


@register("a09_lossless_headers", TL + f"SELECT vec_id, bs[1] = 47 AS signature_ok, ({_le(1, 4)} & 16383) + 1 AS width, (({_le(1, 4)} >> 14) & 16383) + 1 AS height, ({_le(1, 4)} >> 28) & 1 = 1 AS has_alpha, {_le(1, 4)} >> 29 AS version FROM t")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(grids.tiles(spark, sf), ["vec_id"], hd.lossless_header(F.col("px")))


@register("a10_alpha_headers", PL + "SELECT vec_id, p, CAST(v & 3 AS BIGINT) AS method, CAST((v >> 2) & 3 AS BIGINT) AS filter, CAST((v >> 4) & 3 AS BIGINT) AS preprocessing, v < 64 AND v & 3 < 2 AND (v >> 4) & 3 < 2 AS valid FROM pl")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    df = grids.tiles(spark, sf).select("vec_id", F.posexplode("px").alias("p", "v")).withColumn("b", F.array("v"))
    return _longs(df, ["vec_id", "p"], hd.alpha_header(F.col("b")))


@register("a12_metadata_payload", "SELECT doc_id, hex(encode(coalesce(text, ''))) AS payload FROM documents")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata without the six-byte prefix that some writers put before it; here rows of an even id have it."""
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("457869660000"))).otherwise(F.unhex(F.lit(""))), F.coalesce("text", F.lit("")).cast("binary"))
    df = grids.table(spark, sf, "documents").select("doc_id", F.hex(raw).alias("h"))
    return df.select("doc_id", F.when(F.startswith("h", F.lit("457869660000")), F.expr("substring(h, 13)")).otherwise(F.col("h")).alias("payload"))


@register("a13_orientation", "SELECT p_partkey, CASE WHEN p_size % 12 BETWEEN 1 AND 8 THEN CAST(p_size % 12 AS BIGINT) ELSE 1 END AS orientation FROM part")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(grids.table(spark, sf, "part"), ["p_partkey"], {"orientation": hd.orientation(F.col("p_size") % 12)})


def _hx(e: str, n: int) -> str:
    return " || ".join(f"printf('%02X', (({e}) >> {8 * k}) & 255)" for k in range(n))


@register("b02_frame_writer", TL + f"SELECT vec_id, {_hx('CAST(bs[1] AS BIGINT) * 7', 3)} || {_hx('CAST(bs[2] AS BIGINT) * 5', 3)} || {_hx('CAST(bs[3] AS BIGINT) * 300', 3)} || {_hx('CAST(bs[4] AS BIGINT) * 300', 3)} || {_hx('CAST(bs[5] AS BIGINT) * 70000', 3)} || printf('%02X', CASE WHEN bs[6] % 2 = 0 THEN 0 ELSE 2 END + CASE WHEN bs[7] % 2 = 0 THEN 0 ELSE 1 END) AS header FROM t")
def b02(spark: SparkSession, sf: str) -> DataFrame:
    """A frame header's bytes: halved places, sizes less one, the duration's low 24 bits."""
    b = lambda k: F.get("px", F.lit(k)).cast("long")
    return grids.tiles(spark, sf).select("vec_id", hd.frame_header_hex(b(0) * 14, b(1) * 10, b(2) * 300 + 1, b(3) * 300 + 1, b(4) * 70000, b(5) % 2 == 0, b(6) % 2 == 1).alias("header"))


@register("b07_bit_packing", TX + """, w AS (SELECT doc_id, i, b, 1 + b % 8 AS n FROM tx), o AS (SELECT doc_id, b & ((1 << n) - 1) AS v, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS off FROM w),
s AS (SELECT doc_id, off // 8 + k AS byte, CASE k WHEN 0 THEN (v << CAST(off % 8 AS INTEGER)) & 255 ELSE (v << CAST(off % 8 AS INTEGER)) >> 8 END AS part FROM o, (SELECT unnest(range(2)) AS k))
SELECT doc_id, CAST(byte AS BIGINT) AS byte, CAST(bit_or(part) AS BIGINT) AS v FROM s GROUP BY 1, 2 HAVING bit_or(part) > 0""")
def b07(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of 1 to 8 bits written least significant first: each field's place is the running sum of widths, and a byte is the OR of the parts that reach it."""

    def of(b: np.ndarray) -> list:
        n = 1 + b % 8
        off = np.cumsum(n) - n
        moved = (b & ((1 << n) - 1)) << off % 8
        # the parts of a byte have no bit in common, so their sum is their OR
        size = int(off[-1]) // 8 + 2
        v = (np.bincount(off // 8, moved & 255, size) + np.bincount(off // 8 + 1, moved >> 8, size)).astype(np.int64)
        return [held := np.flatnonzero(v), v[held]]

    return grids.per_text(spark, sf, of, "byte long, v long")


@register("b08_run_tokens", TX + """, q AS (SELECT doc_id, i, CASE WHEN b < 97 THEN 0 WHEN b > 122 THEN 2 ELSE 1 END AS v FROM tx), g AS (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM q),
r AS (SELECT doc_id, v, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), n AS (SELECT doc_id, run, v, count(*) AS len FROM r GROUP BY 1, 2, 3)
SELECT doc_id, CAST(run AS BIGINT) AS run, CAST(v AS BIGINT) AS v, len, CASE WHEN v = 0 THEN len // 138 + CASE WHEN len % 138 >= 3 THEN 1 ELSE len % 138 END ELSE 1 + (len - 1) // 6 + CASE WHEN (len - 1) % 6 >= 3 THEN 1 ELSE (len - 1) % 6 END END AS tokens FROM n""")
def b08(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal values, and how many tokens each takes: zeros in up to 138 at once, others once and then up to 6 repeats at once, with remainders under 3 written out."""

    def of(b: np.ndarray) -> list:
        v = np.where(b < 97, 0, np.where(b > 122, 2, 1))
        starts, n = grids.run_lengths(v)
        spare = lambda left: np.where(left >= 3, 1, left)
        tokens = np.where(v[starts] == 0, n // 138 + spare(n % 138), 1 + (n - 1) // 6 + spare((n - 1) % 6))
        return [np.arange(1, len(n) + 1), v[starts], n, tokens]

    return grids.per_text(spark, sf, of, "run long, v long, len long, tokens long")


def prefix_code(value: Column) -> tuple[Column, Column, Column]:
    """Symbol, number of extra bits and the bits themselves of a length or distance from 1."""
    d = value - 1
    high = F.floor(F.log2(F.greatest(d, F.lit(1)).cast("double")) + 1e-12).cast("int")
    second = F.call_function("shiftright", d, F.greatest(high - 1, F.lit(0))).bitwiseAND(1)
    small = d < 2
    n = F.when(small, 0).otherwise(high - 1)
    return F.when(small, d).otherwise(2 * high + second), n, F.when(small, 0).otherwise(d.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1))


@register("b11_prefix_symbols", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 5000 AS d FROM lineitem), h AS (SELECT *, CASE WHEN d < 2 THEN 0 ELSE length(bin(d)) - 1 END AS hi FROM v)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, d + 1 AS value, CASE WHEN d < 2 THEN d ELSE 2 * hi + ((d >> (hi - 1)) & 1) END AS symbol, CAST(CASE WHEN d < 2 THEN 0 ELSE hi - 1 END AS BIGINT) AS extra_bits, CASE WHEN d < 2 THEN 0 ELSE d & ((CAST(1 AS BIGINT) << (hi - 1)) - 1) END AS extra FROM h""")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    df = grids.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5000 + 1).alias("value"))
    symbol, n, extra = prefix_code(F.col("value"))
    return _longs(df, ["l_orderkey", "l_linenumber", "value"], {"symbol": symbol, "extra_bits": n, "extra": extra.cast("long")})


@register("d01_size_limit", "SELECT p_partkey, p_size * (p_partkey % 997) AS area, CASE WHEN p_size * (p_partkey % 997) <= 4000 THEN 'OK' ELSE 'UNSUPPORTED' END AS error_class FROM part")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures within an area, and rejects with their class."""
    area = F.col("p_size") * (F.col("p_partkey") % 997)
    df = grids.table(spark, sf, "part").select("p_partkey", area.cast("long").alias("area"))
    kept, over = df.filter("area <= 4000"), df.filter("area > 4000")
    return kept.withColumn("error_class", F.lit("OK")).unionByName(over.withColumn("error_class", F.lit("UNSUPPORTED")))


ERRORS = {"error": "INVALID", "signup": "UNSUPPORTED", "view": "NO_EXIF", "click": "NO_XMP"}


@register("d02_error_class", "SELECT event_id, CASE event_type WHEN 'error' THEN 'INVALID' WHEN 'signup' THEN 'UNSUPPORTED' WHEN 'view' THEN 'NO_EXIF' WHEN 'click' THEN 'NO_XMP' ELSE 'ENCODE' END AS error_class FROM events")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    classes = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return grids.table(spark, sf, "events").select("event_id", F.coalesce(classes[F.col("event_type")], F.lit("ENCODE")).alias("error_class"))


def key_frames(frames: DataFrame, clip: list[str], order: list[str]) -> DataFrame:
    """The frames with `key`: whether each can be drawn without the one before.

    A frame has full, opaque (has no alpha), blend, dispose. The first is a key frame; so is one that
    covers the canvas without blending over it; and one after a disposed frame that covered the
    canvas or was a key frame. A frame whose answer hangs on the one before takes the last that is settled.
    """
    w = Window.partitionBy(*clip).orderBy(*order)
    f = frames.withColumn("cleared", F.lag("dispose").over(w)).withColumn("covered", F.lag("full").over(w))
    sure = F.col("cleared").isNull() | (F.col("full") & (F.col("opaque") | ~F.col("blend"))) | (F.col("cleared") & F.col("covered"))
    f = f.withColumn("settled", F.when(sure, True).when(~F.col("cleared"), False))
    return f.withColumn("key", F.last("settled", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cleared", "covered", "settled")


_ORDERED = "fr AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 3 = 0 AS whole, event_type = 'view' AS opaque, event_id % 2 = 0 AS blend, event_id % 5 < 2 AS dispose FROM events)"


@register("d03_key_frames", f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, event_id, k, true AS key, dispose, whole FROM fr WHERE k = 1
UNION ALL SELECT f.user_id, f.event_id, f.k, (f.whole AND (f.opaque OR NOT f.blend)) OR (r.dispose AND (r.whole OR r.key)), f.dispose, f.whole FROM r JOIN fr f ON f.user_id = r.user_id AND f.k = r.k + 1)
SELECT user_id, event_id, key AS key_frame FROM r""")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as an animation: event_id gives the flags."""
    i = F.col("event_id")
    flags = [(i % 3 == 0).alias("full"), (F.col("event_type") == "view").alias("opaque"), (i % 2 == 0).alias("blend"), (i % 5 < 2).alias("dispose")]
    e = grids.table(spark, sf, "events").select("user_id", "ts", "event_id", *flags)
    return key_frames(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("key").alias("key_frame"))


@register("d05_vector_bounds", PX + """, b AS (SELECT vec_id, y, x, (r - 128) * 4 AS row_, (g - 128) * 4 AS col_, -(x * 16) * 8 AS le, (7 - x) * 128 AS ri, -(y * 16) * 8 AS tp, (7 - y) * 128 AS bo FROM px)
SELECT vec_id, y, x, CAST(least(greatest(row_, tp - 128), bo + 128) AS BIGINT) AS row_clamped, CAST(least(greatest(col_, le - 128), ri + 128) AS BIGINT) AS col_clamped, col_ < le - 128 OR col_ > ri + 128 OR row_ < tp - 128 OR row_ > bo + 128 AS outside,
  2 * col_ < le - 152 OR 2 * col_ > ri + 144 OR 2 * row_ < tp - 152 OR 2 * row_ > bo + 144 AS beyond_border FROM b""")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 8x8 macroblocks in eighths of a pixel, against the picture's rim: clamped to a margin of 16 pixels, and tested against one of 19 and 18."""
    margin, near, far = 16 * 8, 19 * 8, 18 * 8
    row, col = (F.col("r") - 128) * 4, (F.col("g") - 128) * 4
    left, right, top, bottom = -(F.col("x") * 128), (7 - F.col("x")) * 128, -(F.col("y") * 128), (7 - F.col("y")) * 128
    out = lambda k, low, high: (k * col < left - low) | (k * col > right + high) | (k * row < top - low) | (k * row > bottom + high)
    return _longs(grids.pixels(spark, sf), ["vec_id", "y", "x"], {"row_clamped": F.least(F.greatest(row, top - margin), bottom + margin), "col_clamped": F.least(F.greatest(col, left - margin), right + margin), "outside": out(1, margin, margin), "beyond_border": out(2, near, far)})


@register("d06_transform_applies", AR + "SELECT vec_id, bool_and((v >> 7) & 16711935 & 65537 = 0) AS red_blue_zero, bool_or((v >> 31) = 0) AS translucent FROM argb GROUP BY vec_id")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    """Whether red and blue (their top bits here) are zero everywhere, so that cross colour can't gain."""
    zero = F.forall("argb", lambda v: F.shiftright(v, 7).bitwiseAND(16711935).bitwiseAND(65537) == 0)
    return grids.argb_tiles(spark, sf).select("vec_id", zero.alias("red_blue_zero"), F.exists("argb", lambda v: F.shiftright(v, 31) == 0).alias("translucent"))


@register("e01_tile_lookup", PX + "SELECT vec_id, y, x, CAST(p_size % 14 AS BIGINT) AS mode FROM px JOIN part ON p_partkey = (y >> 1) * 4 + (x >> 1) + 1")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel with the mode of its 2x2 tile; a picture's tiles are one row each, here 16."""
    modes = grids.table(spark, sf, "part").filter(F.col("p_partkey") <= 16).select(F.col("p_partkey").alias("tile"), (F.col("p_size") % 14).cast("long").alias("mode"))
    px = grids.pixels(spark, sf).withColumn("tile", (F.shiftright("y", 1) * 4 + F.shiftright("x", 1) + 1).cast("long"))
    return px.join(F.broadcast(modes), "tile").select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "mode")


@register("e02_palette_lookup", PL + ", u AS (SELECT vec_id, y, x, k, (v >> (4 * k)) & 15 AS idx FROM pl, (SELECT unnest(range(2)) AS k)) SELECT vec_id, y, x * 2 + k AS x, CASE WHEN idx < 12 THEN 4278190080 + idx * 1118481 ELSE 0 END AS argb FROM u")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    """Two 4-bit indices a byte, low first; an index past the palette (12 colours) is transparent black."""
    palette = spark.range(12).select(F.col("id").cast("int").alias("idx"), (F.lit(ch.BLACK) + F.col("id") * 0x111111).alias("colour"))
    df = grids.tiles(spark, sf).select("vec_id", F.posexplode("px").alias("p", "v")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    df = df.withColumn("idx", F.call_function("shiftright", F.col("v"), 4 * F.col("k")).bitwiseAND(15))
    joined = df.join(F.broadcast(palette), "idx", "left")
    return joined.select("vec_id", F.expr("cast(p div 8 AS bigint)").alias("y"), (F.col("p") % 8 * 2 + F.col("k")).cast("long").alias("x"), F.coalesce("colour", F.lit(0).cast("long")).alias("argb"))


@register("e03_palette_encode", PL + """, c AS (SELECT vec_id, y, x, v // 64 AS q FROM pl), d AS (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY q) - 1 AS idx FROM (SELECT DISTINCT vec_id, q FROM c))
SELECT vec_id, y, x // 4 AS word, CAST(bit_or(idx << CAST(2 * (x % 4) AS INTEGER)) * 256 + 4278190080 AS BIGINT) AS packed FROM c JOIN d USING (vec_id, q) GROUP BY 1, 2, 3""")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    """Colours (four levels) as indices of a picture's own sorted palette, four to a word's green."""
    q = F.transform("px", lambda v: F.shiftright(v, 6))
    df = grids.tiles(spark, sf).select("vec_id", q.alias("q")).withColumn("palette", F.array_sort(F.array_distinct("q")))
    df = df.select("vec_id", F.transform("q", lambda v: F.array_position("palette", v) - 1).alias("idx")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(15))))
    packed = sum((F.get("idx", F.col("w") * 4 + k) * (1 << 2 * k) for k in range(4)), F.lit(0).cast("long"))
    return df.select("vec_id", F.expr("cast(w div 2 AS bigint)").alias("y"), (F.col("w") % 2).cast("long").alias("word"), (packed * 256 + ch.BLACK).alias("packed"))


@register("e04_reference_lookup", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS golden FROM events")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    """The latest earlier frame of a stream that refreshed a reference (a signup)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return grids.table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("golden"))


def plane_code_distance(code: Column, width: Column) -> Column:
    """The distance that a code from 1 on means in a picture of a width; 1 at least."""
    columns = F.array(*[F.lit(x) for x, _ in NEAR])
    rows = F.array(*[F.lit(y) for _, y in NEAR])
    i = (F.least(code, F.lit(len(NEAR))) - 1).cast("int")
    near = F.greatest(F.get(rows, i) * width + F.get(columns, i), F.lit(1))
    return F.when(code > len(NEAR), code - len(NEAR)).otherwise(near)


_NX, _NY = "[" + ", ".join(str(x) for x, _ in NEAR) + "]", "[" + ", ".join(str(y) for _, y in NEAR) + "]"


@register("e05_plane_codes", f"SELECT w AS width, c AS code, CAST(CASE WHEN c > 120 THEN c - 120 ELSE greatest(1, {_NY}[c] * w + {_NX}[c]) END AS BIGINT) AS distance FROM (SELECT unnest([3, 8, 40, 640]) AS w), (SELECT unnest(range(1, 201)) AS c)")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.range(1, 201).select(F.col("id").alias("code"), F.explode(F.array(*[F.lit(w) for w in (3, 8, 40, 640)])).alias("width"))
    return df.select(F.col("width"), "code", plane_code_distance(F.col("code"), F.col("width")).cast("long").alias("distance"))


@register("e06_near_vectors", PL + """, n AS (SELECT vec_id, y, x, v // 64 AS v FROM pl), c AS (SELECT m.vec_id, m.y, m.x, o.v, k.w, k.o FROM n m, (VALUES (-1, 0, 2, 0), (0, -1, 2, 1), (-1, -1, 1, 2)) AS k(dy, dx, w, o) JOIN n o ON o.vec_id = m.vec_id AND o.y = m.y + dy AND o.x = m.x + dx WHERE o.v <> 0),
g AS (SELECT vec_id, y, x, v, sum(w) AS weight, min(o) AS first FROM c GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, y, x ORDER BY weight DESC, first) AS rank FROM g)
SELECT vec_id, y, x, CAST(rank AS BIGINT) AS rank, CAST(v AS BIGINT) AS vector, CAST(weight AS BIGINT) AS weight FROM r""")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct vectors of the blocks above, left and above left, weighing 2, 2 and 1, heaviest first; 0 is no vector."""
    df = grids.placed(grids.tiles(spark, sf).select("vec_id", F.transform("px", lambda v: F.shiftright(v, 6)).alias("px")))
    at = lambda ok, d: F.when(ok, F.get("px", F.col("p") - d))
    seen = F.array(at(F.col("y") > 0, 8), at(F.col("x") > 0, 1), at((F.col("y") > 0) & (F.col("x") > 0), 9))
    df = df.withColumn("seen", seen).withColumn("kinds", F.array_distinct(F.filter("seen", lambda v: v.isNotNull() & (v != 0))))
    weigh = lambda v: F.aggregate(F.zip_with("seen", F.array(F.lit(2), F.lit(2), F.lit(1)), lambda s, w: F.when(s == v, w).otherwise(0)), F.lit(0), lambda a, w: a + w)
    ranked = F.array_sort(F.transform("kinds", lambda v, i: F.struct((-weigh(v)).alias("neg"), i.alias("i"), v.alias("v"))))
    out = df.select("vec_id", "y", "x", F.posexplode(ranked).alias("rank", "k"))
    return _longs(out, ["vec_id", "y", "x"], {"rank": F.col("rank") + 1, "vector": F.col("k.v"), "weight": -F.col("k.neg")})


#: Places that matches are searched for at a time; the length from which on pairs of places are compared, and how many pairs for each place of a text.
MATCH_PLACES = 1 << 17
LONG_MATCH = 16
PAIRS = 4
#: Earlier places that a place is compared with where a text has more pairs; with still more it is followed character by character.
CHAIN = 256


def longest_matches(s: str, places: list[int] | None = None, known: list[int] | None = None, least: int = 0) -> list[tuple[int, int]]:
    """(length, distance) of the longest earlier match of each place from the second on; without any, (0, 1).

    With places, in order, of those only; a match of the least length starts at each one's known place.
    """
    out, n, source, last = [], 0, 0, -1
    for k, i in enumerate(range(1, len(s)) if places is None else places):
        # what matched at the place before matches here too, less its first character
        n, source = (n - 1, source + 1) if i == last + 1 and n > least else (least, known[k] if known else 0)
        while i + n < len(s):
            if s[source + n] != s[i + n] or source >= i:
                other = s.find(s[i : i + n + 1], 0, i + n)
                if other < 0:
                    break
                source = other
            n += 1
        source = s.rfind(s[i : i + n], 0, i + n - 1)
        out.append((n, i - source))
        last = i
    return out


def _along_chains(text: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and distances at the places, in order, of a text, where LONG_MATCH characters stand earlier too: each place is compared with its chain of such earlier ones."""
    n = len(text)
    bits = np.uint64(n.bit_length())
    low, every = (np.uint64(1) << bits) - np.uint64(1), np.arange(n, dtype=np.uint64)
    names = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    #: Of 1, 2, 4, ... characters from each place on a number that only equal ones share; none past the end.
    levels, before = [], np.full(n, -1)
    while True:
        levels.append(np.concatenate([names, [np.uint64(0)]]).astype(np.int32))
        size = 1 << len(levels) - 1
        after = np.zeros(n, np.uint64)
        after[: max(n - size, 0)] = names[size:]
        key = (names << bits | after) << bits | every
        key.sort()
        at, new = (key & low).view(np.int64), np.ones(n, bool)
        new[1:] = (key[1:] ^ key[:-1]) >> bits != 0
        if 2 * size == LONG_MATCH:
            before[at[1:][~new[1:]]] = at[:-1][~new[1:]]
        if new.all():
            break
        names = np.empty(n, np.uint64)
        names[at] = np.cumsum(new).view(np.uint64)
    length, distance = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    open_, source = np.arange(len(places)), before[places]
    for _ in range(CHAIN):
        i, j = places[open_], source[open_]
        # sentinels differ past the end: no number is 0 where the earlier place is
        l_ = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            l_ += (levels[k][i + l_] == levels[k][j + l_]).astype(np.int64) << k
        better = l_ > length[open_]
        length[open_[better]], distance[open_[better]] = l_[better], (i - j)[better]
        source = before[source]
        open_ = open_[source[open_] >= 0]
        if not len(open_):
            return length, distance
    found = longest_matches(text, places[open_].tolist(), before[places[open_]].tolist(), LONG_MATCH)
    length[open_], distance[open_] = np.array(found, np.int64).T
    return length, distance


def matches_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and distances as longest_matches() gives them, of all places of the texts, the first ones too.

    Places are grouped by their text and next 1, 2, 3, ... characters, and what stands alone drops out; a place's match is
    the one before it in the last group that has one. Pairs that agree in LONG_MATCH characters are as long as pairs follow
    in turn at their distance, and one place's are compared.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = int(bounds[-1])
    length, distance = np.zeros(total, np.int64), np.ones(total, np.int64)
    bits = np.uint64(max(total, 1).bit_length())
    if 2 * int(bits) + 21 > 64:
        for t, at in zip(texts, bounds.tolist()):
            if len(t) > 1:
                length[at + 1 : at + len(t)], distance[at + 1 : at + len(t)] = np.array(longest_matches(t), np.int64).T
        return length, distance
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) << bits
    end = np.repeat(bounds[1:], sizes)
    low, wide = (np.uint64(1) << bits) - np.uint64(1), bits + np.uint64(21)
    at, group = np.arange(total), np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    for n in range(1, LONG_MATCH + 1):
        key = group << wide | code[at + (n - 1)] | at.view(np.uint64)
        key.sort()
        at, of = (key & low).view(np.int64), key >> bits
        order, same = at, of[1:] == of[:-1]
        later = np.flatnonzero(same)
        to = at[later + 1]
        length[to], distance[to] = n, to - at[later]
        shared = np.zeros(len(at), bool)
        shared[1:] = same
        shared[:-1] |= same
        shared &= at + n < end[at]
        # a group's number is that of its first place
        first = np.ones(len(at), bool)
        first[1:] = ~same
        group = np.cumsum(first)[shared].view(np.uint64)
        at = at[shared]
        if not len(at):
            break
    long = np.flatnonzero(length == LONG_MATCH)
    if not len(long):
        return length, distance
    # earlier places with the same characters of a long place: those before it in its group
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    rank = np.arange(len(order)) - begin
    text = np.searchsorted(bounds, order, side="right") - 1
    many = np.bincount(text, rank, minlength=len(texts)) > PAIRS * sizes
    few = np.flatnonzero((rank > 0) & ~many[text])
    times = rank[few]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    i = np.repeat(order[few], times)
    d = i - order[np.repeat(begin[few], times) + nth]
    by = np.lexsort((i, d))
    i, d = i[by], d[by]
    # at a distance, what follows in turn is a match one longer
    stop = np.ones(len(i), bool)
    stop[:-1] = (np.diff(d) != 0) | (np.diff(i) != 1)
    last = np.flatnonzero(stop)
    n = LONG_MATCH + last[np.searchsorted(last, np.arange(len(i)))] - np.arange(len(i))
    by = np.lexsort((d, -n, i))
    best = by[np.concatenate([[True], np.diff(i[by]) != 0])] if len(by) else by
    length[i[best]], distance[i[best]] = n[best], d[best]
    for k in np.flatnonzero(many).tolist():
        here = long[slice(*np.searchsorted(long, bounds[k : k + 2]))]
        length[here], distance[here] = _along_chains(texts[k], here - bounds[k])
    return length, distance


@register("e07_longest_match")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    """For each place of a text the longest earlier match, the nearest of equal ones; matches may overlap their source."""

    def batch(ids: list, texts: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        place = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later = place > 1
        of = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(texts)), sizes)[later]))
        return pa.RecordBatch.from_arrays([of, *(pa.array(c[later]) for c in (place, *matches_of(texts)))], names=["doc_id", "place", "len", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(text.as_py())
                n += len(texts[-1])
                if n >= MATCH_PLACES:
                    yield batch(ids, texts)
                    ids, texts, n = [], [], 0
            if texts:
                yield batch(ids, texts)

    docs = grids.table(spark, sf, "documents").filter(F.length("text") > 1).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, place long, len long, distance long")


@register("e08_motion_search", TL + """, n AS (SELECT vec_id, bs, lag(bs) OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS pb FROM t), c AS (SELECT vec_id, dy, dx, list_sum([(bs[(2 + i // 4) * 8 + 2 + i % 4 + 1] - pb[(2 + i // 4 + dy) * 8 + 2 + i % 4 + dx + 1]) ** 2 FOR i IN range(16)]) AS sse FROM n, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE pb IS NOT NULL),
s AS (SELECT vec_id, dy, dx, CAST(256 * sse AS BIGINT) + 300 * (abs(dy) + abs(dx)) AS cost FROM c)
SELECT vec_id, arg_min(dy, cost * 25 + (dy + 2) * 5 + dx + 2) AS dy, arg_min(dx, cost * 25 + (dy + 2) * 5 + dx + 2) AS dx, min(cost) AS cost FROM s GROUP BY vec_id""")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest vector within 2 of a tile's middle 4x4 block into the tile before it in its clip: squared error, and bits by the vector's size."""
    t = grids.tiles(spark, sf).select("vec_id", "px", F.lag("px").over(Window.partitionBy(grids.clip()).orderBy("vec_id")).alias("before")).filter("before IS NOT NULL")
    place = lambda i: (2 + i // 4) * 8 + 2 + i % 4
    middle = F.array(*[F.get("px", F.lit(place(i))) for i in range(16)])

    def cost(dy: int, dx: int) -> Column:
        there = F.array(*[F.get("before", F.lit(place(i) + dy * 8 + dx)) for i in range(16)])
        error = F.aggregate(F.zip_with("middle", there, lambda a, b: ((a - b) * (a - b)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        return F.struct((256 * error + 300 * (abs(dy) + abs(dx))).alias("cost"), F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx"))

    best = F.array_min(F.array(*[cost(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]))
    return t.withColumn("middle", middle).select("vec_id", best.alias("b")).select("vec_id", "b.dy", "b.dx", "b.cost")


def outside_parts(y: Column, sx: Column, sw: Column, dx: Column, dy: Column, dw: Column, dh: Column) -> dict[str, Column]:
    """The parts of a row of [sx, sx + sw) that lie outside a rectangle: two ranges, (-1, 0) for none."""
    apart = (y < dy) | (y >= dy + dh) | (sx >= dx + dw) | (sx + sw <= dx)
    before, after = sx < dx, sx + sw > dx + dw
    return {
        "left1": F.when(apart, sx).when(before, sx).otherwise(-1), "width1": F.when(apart, sw).when(before, dx - sx).otherwise(0),
        "left2": F.when(~apart & after, dx + dw).otherwise(-1), "width2": F.when(~apart & after, sx + sw - dx - dw).otherwise(0),
    }


@register("e09_blend_ranges", TL + """, f AS (SELECT vec_id, y, bs[1] % 32 AS sx, 1 + bs[2] % 32 AS sw, bs[3] % 32 AS dx, bs[4] % 16 AS dy, 1 + bs[5] % 16 AS dw, 1 + bs[6] % 16 AS dh FROM t, (SELECT unnest(range(16)) AS y)), g AS (SELECT *, y < dy OR y >= dy + dh OR sx >= dx + dw OR sx + sw <= dx AS apart FROM f)
SELECT vec_id, y, CAST(CASE WHEN apart OR sx < dx THEN sx ELSE -1 END AS BIGINT) AS left1, CAST(CASE WHEN apart THEN sw WHEN sx < dx THEN dx - sx ELSE 0 END AS BIGINT) AS width1,
  CAST(CASE WHEN NOT apart AND sx + sw > dx + dw THEN dx + dw ELSE -1 END AS BIGINT) AS left2, CAST(CASE WHEN NOT apart AND sx + sw > dx + dw THEN sx + sw - dx - dw ELSE 0 END AS BIGINT) AS width2 FROM g""")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    b = lambda k, n: F.get("px", F.lit(k)) % n
    df = grids.tiles(spark, sf).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return _longs(df, ["vec_id", "y"], outside_parts(F.col("y"), b(0, 32), 1 + b(1, 32), b(2, 32), b(3, 16), 1 + b(4, 16), 1 + b(5, 16)))


@register("i10_first_frame", f"WITH {_ORDERED} SELECT user_id, event_id, event_type FROM fr WHERE k = 1")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's first frame, without sorting the rest."""
    e = grids.table(spark, sf, "events")
    first = F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(first.alias("f")).select("user_id", "f.event_id", "f.event_type")


@register("j01_concatenation", with_(_LINES) + "SELECT l_orderkey, string_agg(fourcc || ':' || off, ' ' ORDER BY ordinal) AS layout, CAST(max(off + 8 + size + size % 2) AS BIGINT) AS total FROM ch GROUP BY 1")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    """A container's chunks appended in order, and its size."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.concat("fourcc", F.lit(":"), F.col("off").cast("string")).alias("s"))))
    return _lines(spark, sf).groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda c: c["s"]), " ").alias("layout"), F.max(F.col("off") + hd.chunk_step(F.col("size"))).alias("total"))


@register("k13_flags", "SELECT p_partkey, p_size & 2 <> 0 AS animated, p_size & 16 <> 0 AS has_alpha, p_type IS NOT NULL AS present, (p_partkey & 255) * 65536 + ((p_partkey >> 8) & 255) * 256 + ((p_partkey >> 16) & 255) AS swapped FROM part")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    bytes_ = F.array(*[F.shiftright("p_partkey", s).bitwiseAND(255) for s in (16, 8, 0)])
    return grids.table(spark, sf, "part").select("p_partkey", (F.col("p_size").bitwiseAND(2) != 0).alias("animated"), (F.col("p_size").bitwiseAND(16) != 0).alias("has_alpha"), F.col("p_type").isNotNull().alias("present"), hd.little(bytes_, 0, 3).alias("swapped"))


def frames_of(events: DataFrame) -> DataFrame:
    """A user's events as frames of a stream: copies of references (0 none, 1 last, 2 the other), refreshes, kept tables and segments."""
    kind, i = F.col("event_type"), F.col("event_id")
    copy = F.when(kind == "click", 1).when(kind == "view", 2).otherwise(0)
    return events.select(
        F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), i.alias("frame_id"), (kind == "signup").alias("key"), F.when(i % 4 == 1, copy).otherwise(0).alias("copy_alt"), F.when(i % 4 == 2, copy).otherwise(0).alias("copy_golden"),
        (i % 3 != 0).alias("new_last"), (kind == "signup").alias("new_golden"), (kind == "error").alias("new_alt"), (i % 3 == 0).alias("keep_probabilities"), F.when(kind.isin("click", "error"), i % 4).alias("segment"),
    )


def followed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    got = decoder_state.follow(frames_of(grids.table(spark, sf, "events")))
    return got.select(F.col("stream_id").alias("user_id"), F.col("frame_id").alias("event_id"), *columns)


_COPY = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END"


@register("l01_reference_rotation", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 4 = 1 THEN {_COPY} ELSE 0 END AS ca, CASE WHEN event_id % 4 = 2 THEN {_COPY} ELSE 0 END AS cg, event_type = 'signup' AS ng, event_type = 'error' AS na, event_id % 3 <> 0 AS nl FROM events),
r AS (SELECT user_id, k, event_id, CASE WHEN nl THEN event_id END AS l, CASE WHEN ng THEN event_id END AS g, CASE WHEN na THEN event_id END AS a FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN nl THEN o.event_id ELSE l END, CASE WHEN ng THEN o.event_id WHEN cg = 1 THEN l WHEN cg = 2 THEN (CASE ca WHEN 1 THEN l WHEN 2 THEN g ELSE a END) ELSE g END, CASE WHEN na THEN o.event_id WHEN ca = 1 THEN l WHEN ca = 2 THEN g ELSE a END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, l AS last, g AS golden, a AS alt FROM r""")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    """The last, golden and alternate reference after each frame: the copy into the alternate goes first, then that into golden (which may take the new alternate), then refreshes."""
    return followed(spark, sf, "last", "golden", "alt")


@register("l02_entropy_state", """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type = 'signup' AS kf, event_id % 3 = 0 AS keep FROM events),
r AS (SELECT user_id, k, event_id, event_id AS used, CASE WHEN keep THEN event_id ELSE 0 END AS saved FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN kf THEN o.event_id ELSE saved * 31 % 1000003 + o.event_id END, CASE WHEN keep THEN (CASE WHEN kf THEN o.event_id ELSE saved * 31 % 1000003 + o.event_id END) WHEN kf THEN 0 ELSE saved END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, used, saved FROM r""")
def l02(spark: SparkSession, sf: str) -> DataFrame:
    """A number stands for the probability tables: each frame changes them, only some keep the change, a key frame (a signup) starts from 0."""
    return followed(spark, sf, "used", "saved")


@register("l03_segment_map", "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 0 WHEN event_type IN ('click', 'error') THEN event_id % 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS segment FROM events")
def l03(spark: SparkSession, sf: str) -> DataFrame:
    """A macroblock's segment stays what it was unless a frame updates it (click, error); a key frame (signup) clears it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    set_to = F.when(F.col("event_type") == "signup", F.lit(0).cast("long")).when(F.col("event_type").isin("click", "error"), F.col("event_id") % 4)
    return grids.table(spark, sf, "events").select("user_id", "event_id", F.coalesce(F.last(set_to, ignorenulls=True).over(w), F.lit(0).cast("long")).alias("segment"))
