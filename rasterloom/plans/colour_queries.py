"""Queries of pixel arithmetic and of geometry, over tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import channels as ch
from . import grids
from .grids import ARGB, PIXELS, PLACED, TILES, with_
from .registry import register

_KEY = ["vec_id", "y", "x"]


def _long(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keep], *[c.cast("long").alias(k) for k, c in made.items()])


PX, AR = with_(TILES, PLACED, PIXELS), with_(TILES, PLACED, PIXELS, ARGB)
_CLIP = "least(255, greatest(0, {}))"


@register("c01_yuv_to_rgb", PX + f"""
SELECT vec_id, y, x,
  CAST({_CLIP.format("((r * 19077 >> 8) + (b * 26149 >> 8) - 14234) >> 6")} AS BIGINT) AS red,
  CAST({_CLIP.format("((r * 19077 >> 8) - (g * 6419 >> 8) - (b * 13320 >> 8) + 8708) >> 6")} AS BIGINT) AS green,
  CAST({_CLIP.format("((r * 19077 >> 8) + (g * 33050 >> 8) - 17685) >> 6")} AS BIGINT) AS blue
FROM px""")  # fmt: skip
def c01(spark: SparkSession, sf: str) -> DataFrame:
    """Channels r, g, b taken as Y, U, V."""
    red, green, blue = ch.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return _long(grids.pixels(spark, sf), *_KEY, red=red, green=green, blue=blue)


def fancy_chroma(px: str, size: int = 8) -> Column:
    """Chroma of a size x size plane, doubled both ways: at each place the nearest sample counts 9, its neighbours 3, 3 and 1.

    A place on the rim has no further sample on that side, so the nearest stands for it. Two means
    round on the way, of the diagonal pair and then with the nearest.
    """
    n = size * 2

    def at(p: Column) -> Column:
        y, x = F.floor(p / n).cast("int"), p % n
        cy, cx = F.shiftright(y, 1), F.shiftright(x, 1)
        far_y = ch.clamp(cy + F.when(y % 2 == 0, -1).otherwise(1), 0, size - 1)
        far_x = ch.clamp(cx + F.when(x % 2 == 0, -1).otherwise(1), 0, size - 1)
        get = lambda a, b: F.get(px, a * size + b)
        near, beside, above, across = get(cy, cx), get(cy, far_x), get(far_y, cx), get(far_y, far_x)
        rim = (x == 0) | (x == n - 1)
        inner = F.shiftright(F.shiftright(near + beside + above + across + 8 + 2 * (beside + above), 3) + near, 1)
        return F.when(rim, F.shiftright(3 * near + above + 2, 2)).otherwise(inner)

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), at)


@register("c02_fancy_upsample", with_(TILES) + """
, o AS (SELECT vec_id, bs, p, p // 16 AS y, p % 16 AS x, (p // 16) >> 1 AS cy, (p % 16) >> 1 AS cx FROM t, (SELECT unnest(range(256)) AS p)),
f AS (SELECT *, least(7, greatest(0, cy + CASE WHEN y % 2 = 0 THEN -1 ELSE 1 END)) AS fy, least(7, greatest(0, cx + CASE WHEN x % 2 = 0 THEN -1 ELSE 1 END)) AS fx FROM o),
g AS (SELECT *, bs[cy * 8 + cx + 1] AS n, bs[cy * 8 + fx + 1] AS h, bs[fy * 8 + cx + 1] AS v, bs[fy * 8 + fx + 1] AS d FROM f)
SELECT vec_id, y, x, CAST(CASE WHEN x IN (0, 15) THEN (3 * n + v + 2) >> 2 ELSE (((n + 3 * h + 3 * v + d + 8) >> 3) + n) >> 1 END AS BIGINT) AS u FROM g""".replace("\n, o AS", ", o AS"))
def c02(spark: SparkSession, sf: str) -> DataFrame:
    """A tile as an 8x8 chroma plane, doubled to 16x16."""
    up = grids.tiles(spark, sf).select("vec_id", F.posexplode(fancy_chroma("px")).alias("p", "u"))
    return _long(up.selectExpr("vec_id", "p div 16 AS y", "p % 16 AS x", "u"), "vec_id", y=F.col("y"), x=F.col("x"), u=F.col("u"))


@register("c03_rgb_to_y", PX + "SELECT vec_id, y, x, CAST((16839 * r + 33059 * g + 6420 * b + 32768 + 1048576) >> 16 AS BIGINT) AS luma FROM px")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    return _long(grids.pixels(spark, sf), *_KEY, luma=ch.rgb_to_y(F.col("r"), F.col("g"), F.col("b")))


@register("c04_rgb_to_uv", PX + """
, rows_ AS (SELECT vec_id, y, x // 2 AS cx, 2 * sum(r) AS r, 2 * sum(g) AS g, 2 * sum(b) AS b FROM px GROUP BY 1, 2, 3),
uv AS (SELECT vec_id, y, cx, least(255, greatest(0, CAST(-9719 * r - 19081 * g + 28800 * b + 131072 + 33554432 AS BIGINT) >> 18)) AS u,
  least(255, greatest(0, CAST(28800 * r - 24116 * g - 4684 * b + 131072 + 33554432 AS BIGINT) >> 18)) AS v FROM rows_)
SELECT vec_id, y // 2 AS cy, cx, CAST((max(CASE WHEN y % 2 = 0 THEN u END) + max(CASE WHEN y % 2 = 1 THEN u END) + 1) >> 1 AS BIGINT) AS u,
  CAST((max(CASE WHEN y % 2 = 0 THEN v END) + max(CASE WHEN y % 2 = 1 THEN v END) + 1) >> 1 AS BIGINT) AS v
FROM uv GROUP BY 1, 2, 3""".replace("\n, rows_", ", rows_"))
def c04(spark: SparkSession, sf: str) -> DataFrame:
    """Chroma of 2x2 boxes: each row's pair first, then the mean of the two rows' results."""
    n = grids.SIDE

    def row(cy: Column, cx: Column, half: int) -> tuple[Column, Column]:
        at = (2 * cy + half) * n + 2 * cx
        total = lambda k: 2 * (F.get("px", (at + k) % 64) + F.get("px", (at + 1 + k) % 64))
        return ch.rgb4_to_uv(total(1), total(2), total(3))

    boxes = grids.tiles(spark, sf).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(15)))).selectExpr("vec_id", "px", "cast(q div 4 as int) AS cy", "q % 4 AS cx")
    (u0, v0), (u1, v1) = row(F.col("cy"), F.col("cx"), 0), row(F.col("cy"), F.col("cx"), 1)
    return _long(boxes, "vec_id", cy=F.col("cy"), cx=F.col("cx"), u=F.shiftright(u0 + u1 + 1, 1), v=F.shiftright(v0 + v1 + 1, 1))


def _argb(spark: SparkSession, sf: str) -> DataFrame:
    return grids.argb_tiles(spark, sf).select("vec_id", "argb", F.posexplode("argb").alias("p", "v")).selectExpr("vec_id", "argb", "p", "cast(p div 8 as int) AS y", "p % 8 AS x", "v")


@register("c05_argb_to_rgba", AR + "SELECT vec_id, y, x, (v >> 16) & 255 AS r, (v >> 8) & 255 AS g, v & 255 AS b, (v >> 24) & 255 AS a FROM argb")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    a, r, g, b = ch.channels(F.col("v"))
    return _long(_argb(spark, sf), *_KEY, r=r, g=g, b=b, a=a)


@register("c06_premultiply", PX + "SELECT vec_id, y, x, " + ", ".join(f"CASE WHEN a = 255 THEN CAST({c} AS BIGINT) ELSE (CAST({c} AS BIGINT) * a * 32897) >> 23 END AS {c}" for c in "rgb") + " FROM px")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return _long(grids.pixels(spark, sf), *_KEY, **{c: ch.premultiply(F.col(c), F.col("a")) for c in "rgb"})


@register("c07_unpremultiply", PX + "SELECT vec_id, y, x, " + ", ".join(f"CAST(CASE WHEN a = 0 THEN 0 ELSE least(255, ({c} * 255) // a) END AS BIGINT) AS {c}" for c in "rgb") + " FROM px")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return _long(grids.pixels(spark, sf), *_KEY, **{c: ch.unpremultiply(F.col(c), F.col("a")) for c in "rgb"})


def to_argb(kind: Column, p: dict[str, Column]) -> Column:
    """A word from a pixel of one of four kinds: straight colour, premultiplied colour, grey, luma and chroma."""
    r, g, b, a = (p[c] for c in "rgba")
    red, green, blue = ch.yuv_to_rgb(r, g, b)
    opaque = F.lit(255)
    return (
        F.when(kind == "nrgba", ch.word(a, r, g, b))
        .when(kind == "rgba", ch.word(a, *[ch.unpremultiply(c, a) for c in (r, g, b)]))
        .when(kind == "gray", ch.word(opaque, r, r, r))
        .otherwise(ch.word(opaque, red, green, blue))
    )


_W = "CAST({} AS BIGINT) * 16777216 + {} * 65536 + {} * 256 + {}"
_UN = "CASE WHEN a = 0 THEN 0 ELSE least(255, ({0} * 255) // a) END"


@register("c08_to_argb", PX + "SELECT vec_id, y, x, CASE label % 4 WHEN 0 THEN " + _W.format("a", "r", "g", "b") + " WHEN 1 THEN " + _W.format("a", *[_UN.format(c) for c in "rgb"]) + " WHEN 2 THEN " + _W.format("255", "r", "r", "r") + " ELSE " + _W.format(
    "255", _CLIP.format("((r * 19077 >> 8) + (b * 26149 >> 8) - 14234) >> 6"), _CLIP.format("((r * 19077 >> 8) - (g * 6419 >> 8) - (b * 13320 >> 8) + 8708) >> 6"), _CLIP.format("((r * 19077 >> 8) + (g * 33050 >> 8) - 17685) >> 6")) + " END AS argb FROM px")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in ("nrgba", "rgba", "gray", "ycbcr")]), F.col("label") % 4)
    return _long(grids.pixels(spark, sf), *_KEY, argb=to_argb(kind, {c: F.col(c) for c in "rgba"}))


@register("c09_passthrough", with_(TILES) + """
SELECT vec_id, CASE WHEN label % 2 = 0 AND bs[1] % 2 = 0 THEN 'native' ELSE 'converted' END AS route,
  CAST(CASE WHEN label % 2 = 0 AND bs[1] % 2 = 0 THEN list_sum(bs) ELSE list_sum([(56318 * v + 32768 + 1048576) >> 16 FOR v IN bs]) END AS BIGINT) AS luma_sum FROM t""")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    """Planes that are subsampled with an even origin are used as they are, others are converted from grey."""
    t = grids.tiles(spark, sf)
    native = (F.col("label") % 2 == 0) & (F.get("px", F.lit(0)) % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    as_is = t.filter(native).select("vec_id", F.lit("native").alias("route"), total(F.col("px")).alias("luma_sum"))
    made = t.filter(~native).select("vec_id", F.lit("converted").alias("route"), total(F.transform("px", lambda v: ch.rgb_to_y(v, v, v))).alias("luma_sum"))
    return as_is.unionByName(made)


@register("c10_alpha", AR + "SELECT vec_id, CAST(sum(4278190080 + ((v >> 24) & 255) * 256) AS BIGINT) AS alpha_words, bool_or((v >> 24) & 255 <> 255) AS translucent FROM argb GROUP BY vec_id")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha as the green of opaque words, and whether any pixel isn't opaque."""
    words = F.transform("argb", lambda v: ch.BLACK + ch.channel(v, 24) * 256)
    return grids.argb_tiles(spark, sf).select("vec_id", F.aggregate(words, F.lit(0).cast("long"), lambda s, v: s + v).alias("alpha_words"), F.exists("argb", lambda v: ch.channel(v, 24) != 255).alias("translucent"))


_SUBGREEN = "(v & 4278255360) | ((((v >> 16) & 255) - ((v >> 8) & 255) + 256) % 256) * 65536 | (((v & 255) - ((v >> 8) & 255) + 256) % 256)"


@register("c11_subtract_green", AR + f"SELECT vec_id, y, x, {_SUBGREEN} AS forward, true AS inverse_ok FROM argb")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    df = _argb(spark, sf).withColumn("forward", ch.subtract_green(F.col("v")))
    return df.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("forward").cast("long").alias("forward"), (ch.add_green(F.col("forward")) == F.col("v")).alias("inverse_ok"))


_S8 = "(CASE WHEN {0} > 127 THEN {0} - 256 ELSE {0} END)"


def _cross_sql() -> str:
    d = lambda m, c: f"(({_S8.format(m)} * {_S8.format(c)}) >> 5)"
    return f"""
, tl AS (SELECT t.vec_id, q // 4 AS ty, q % 4 AS tx, bs[q + 1] AS m0, bs[q + 17] AS m1, bs[q + 33] AS m2 FROM t, (SELECT unnest(range(16)) AS q))
SELECT vec_id, y, x, CAST(a AS BIGINT) * 16777216 + (((r - {d('m0', 'g')}) % 256 + 256) % 256) * 65536 + g * 256 + (((b - {d('m1', 'g')} - {d('m2', 'r')}) % 256 + 256) % 256) AS forward, true AS inverse_ok
FROM px JOIN tl USING (vec_id) WHERE ty = y >> 1 AND tx = x >> 1""".replace("\n, tl", ", tl")


@register("c12_cross_colour", PX + _cross_sql())
def c12(spark: SparkSession, sf: str) -> DataFrame:
    """Multipliers of 2x2 tiles, looked up by place; the inverse gives the pixel back."""
    q = F.shiftright("y", 1) * 4 + F.shiftright("x", 1)
    code = F.get("px", q) + F.get("px", q + 16) * 256 + F.get("px", q + 32) * 65536
    df = grids.pixels(spark, sf).withColumn("v", ch.word(*[F.col(c) for c in "argb"])).withColumn("code", code).withColumn("forward", ch.cross_colour(F.col("v"), F.col("code")))
    return df.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("forward").cast("long").alias("forward"), (ch.cross_colour_back(F.col("forward"), F.col("code")) == F.col("v")).alias("inverse_ok"))


_NB = """, nb AS (SELECT n.vec_id, n.y, n.x, n.v, l.v AS le, o.v AS co, u.v AS tp FROM argb n
  JOIN argb l ON l.vec_id = n.vec_id AND l.p = n.p - 1 JOIN argb u ON u.vec_id = n.vec_id AND u.p = n.p - 8 JOIN argb o ON o.vec_id = n.vec_id AND o.p = n.p - 9 WHERE n.x > 0 AND n.y > 0),
cs AS (SELECT vec_id, y, x, s, (v >> s) & 255 AS v, (le >> s) & 255 AS l, (co >> s) & 255 AS c, (tp >> s) & 255 AS t FROM nb, (VALUES (0), (8), (16), (24)) AS k(s))
"""


@register("c13_word_sums", AR + _NB + "SELECT vec_id, y, x, CAST(sum(((v + l) % 256) * (1 << s)) AS BIGINT) AS added, CAST(sum(((v - l + 256) % 256) * (1 << s)) AS BIGINT) AS subtracted FROM cs GROUP BY 1, 2, 3".replace("(1 << s)", "(CAST(1 AS BIGINT) << s)"))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    """Sum and difference with the left neighbour, channel by channel."""
    df = _argb(spark, sf).filter("x > 0 AND y > 0").withColumn("le", F.get("argb", F.col("p") - 1))
    return _long(df, *_KEY, added=ch.add_words(F.col("v"), F.col("le")), subtracted=ch.subtract_words(F.col("v"), F.col("le")))


@register("c14_predictor_kernels", AR + _NB + """, ks AS (SELECT vec_id, y, x, s, (l + t) >> 1 AS m, ((((l + t) >> 1) + c) >> 1) AS m3, least(255, greatest(0, l + t - c)) AS gr,
  least(255, greatest(0, ((l + t) >> 1) + CASE WHEN ((l + t) >> 1) < c THEN -((c - ((l + t) >> 1)) // 2) ELSE (((l + t) >> 1) - c) // 2 END)) AS hg, abs(l - c) - abs(t - c) AS d, l, t FROM cs)
SELECT vec_id, y, x, CAST(sum(m * (CAST(1 AS BIGINT) << s)) AS BIGINT) AS average, CAST(sum(m3 * (CAST(1 AS BIGINT) << s)) AS BIGINT) AS average3, CAST(sum(gr * (CAST(1 AS BIGINT) << s)) AS BIGINT) AS gradient,
  CAST(sum(hg * (CAST(1 AS BIGINT) << s)) AS BIGINT) AS half_gradient, CAST(CASE WHEN sum(d) <= 0 THEN sum(t * (CAST(1 AS BIGINT) << s)) ELSE sum(l * (CAST(1 AS BIGINT) << s)) END AS BIGINT) AS nearer
FROM ks GROUP BY 1, 2, 3""")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    df = _argb(spark, sf).filter("x > 0 AND y > 0").select(*_KEY, F.get("argb", F.col("p") - 1).alias("le"), F.get("argb", F.col("p") - 9).alias("co"), F.get("argb", F.col("p") - 8).alias("tp"))
    le, co, tp = F.col("le"), F.col("co"), F.col("tp")
    return _long(df, *_KEY, average=ch.average(le, tp), average3=ch.average(ch.average(le, tp), co), gradient=ch.gradient_words(le, tp, co), half_gradient=ch.half_gradient_words(le, tp, co), nearer=ch.nearer(le, tp, co))


@register("c15_clips", PX + """SELECT vec_id, y, x, CAST(least(255, greatest(0, r + g - b - 64)) AS BIGINT) AS byte_clip, CAST(least(127, greatest(-128, r - g)) AS BIGINT) AS signed_clip,
  CAST(least(15, greatest(-16, (r - g) >> 3)) AS BIGINT) AS filter_clip, CAST(least(127, greatest(0, r - 64)) AS BIGINT) AS q_clip, CAST(abs(r - g) AS BIGINT) AS distance, CAST(least(255, greatest(0, r + g - b)) AS BIGINT) AS gradient FROM px""")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _long(grids.pixels(spark, sf), *_KEY, byte_clip=ch.clamp(r + g - b - 64), signed_clip=ch.clamp(r - g, -128, 127), filter_clip=ch.clamp(F.shiftright(r - g, 3), -16, 15), q_clip=ch.clamp(r - 64, 0, 127), distance=F.abs(r - g), gradient=ch.gradient(r, g, b))


@register("c16_orientation", with_(TILES) + """, c AS (SELECT vec_id, o, p % 5 AS x, p // 5 AS y, bs[p + 1] AS v FROM t, (SELECT unnest(range(15)) AS p), (SELECT unnest(range(1, 9)) AS o))
SELECT vec_id, o AS orientation, CAST(CASE o WHEN 1 THEN x WHEN 2 THEN 4 - x WHEN 3 THEN 4 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 2 - y WHEN 7 THEN 2 - y ELSE y END AS BIGINT) AS new_x,
  CAST(CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 2 - y WHEN 4 THEN 2 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 4 - x ELSE 4 - x END AS BIGINT) AS new_y, CAST(v AS BIGINT) AS v FROM c""")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    """The first 15 bytes as a 5x3 plane, under each orientation."""
    df = grids.placed(grids.tiles(spark, sf), 15, 5).withColumn("o", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    new_x, new_y = ch.orient(F.col("o"), F.col("x"), F.col("y"), F.lit(5), F.lit(3))
    return _long(df, "vec_id", orientation=F.col("o"), new_x=new_x, new_y=new_y, v=F.get("px", "p"))


@register("c17_subsample", "SELECT p_partkey, b AS bits, CAST(ceil(p_size / CAST(1 << b AS DOUBLE)) AS BIGINT) AS tiles FROM part, (SELECT unnest(range(2, 7)) AS b)")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles along a side, for tiles of 4 to 64 pixels."""
    df = grids.table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("bits"))
    return _long(df, "p_partkey", bits=F.col("bits"), tiles=ch.ceil_shift(F.col("p_size"), F.col("bits")))


@register("c18_crop", with_(TILES, PLACED) + "SELECT vec_id, y, x, CAST(v AS BIGINT) AS v FROM pl WHERE x < 3 + label % 5 AND y < 2 + label % 6")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    """The visible part of a plane, whose size goes by the label."""
    df = grids.placed(grids.tiles(spark, sf)).filter((F.col("x") < 3 + F.col("label") % 5) & (F.col("y") < 2 + F.col("label") % 6))
    return _long(df, *_KEY, v=F.get("px", "p"))


@register("c19_edge_load", with_(TILES) + """SELECT vec_id, q // 8 AS y, q % 8 AS x, CAST(bs[least(q // 8, 1 + label % 6) * 8 + least(q % 8, 2 + label % 5) + 1] AS BIGINT) AS v FROM t, (SELECT unnest(range(64)) AS q)""")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    """A whole block whose places beyond the visible part repeat its edge."""
    df = grids.placed(grids.tiles(spark, sf))
    at = F.least("y", 1 + F.col("label") % 6) * 8 + F.least("x", 2 + F.col("label") % 5)
    return _long(df, "vec_id", y=F.col("y"), x=F.col("x"), v=F.get("px", at))


@register("c20_border", with_(TILES) + "SELECT vec_id, y, x, CAST(bs[least(7, greatest(0, y)) * 8 + least(7, greatest(0, x)) + 1] AS BIGINT) AS v FROM t, (SELECT unnest(range(-4, 12)) AS y), (SELECT unnest(range(-4, 12)) AS x)")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    """A plane with a border of 4 that repeats its edge."""
    side = F.sequence(F.lit(-4), F.lit(11))
    df = grids.tiles(spark, sf).withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    return _long(df, "vec_id", y=F.col("y"), x=F.col("x"), v=F.get("px", ch.clamp(F.col("y"), 0, 7) * 8 + ch.clamp(F.col("x"), 0, 7)))
