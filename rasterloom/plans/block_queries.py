"""Queries of block transforms, quantisation, prediction, sub-pixel filters and edge filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as bl
from ..functions import tables as tb
from . import grids
from .grids import TILES, with_
from .registry import register

TL = with_(TILES)
#: Differences of a tile's upper left 4x4 block and the one to its right.
_DIFF = "d AS (SELECT vec_id, [bs[(i // 4) * 8 + i % 4 + 1] - bs[(i // 4) * 8 + i % 4 + 5] FOR i IN range(16)] AS v FROM t)"


def differences(spark: SparkSession, sf: str) -> DataFrame:
    t = grids.tiles(spark, sf)
    at = lambda i: (i // 4) * 8 + i % 4
    return t.select("vec_id", "label", "px", F.array(*[F.get("px", F.lit(at(i))) - F.get("px", F.lit(at(i) + 4)) for i in range(16)]).alias("d"))


def spread(df: DataFrame, block: Column, *keep: str) -> DataFrame:
    """One row for each place of a block."""
    out = df.select(*keep, F.posexplode(block).alias("i", "v"))
    return out.select(*keep, F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


def _staged(first: dict[int, str], second: dict[int, str], source: str = "d") -> str:
    """SQL of two passes; stage one reads v[1..16], stage two reads c0..c15."""
    one = ", ".join(f"{e} AS c{i}" for i, e in sorted(first.items()))
    two = ", ".join(e for _, e in sorted(second.items()))
    return f", one AS (SELECT vec_id, {one} FROM {source}), two AS (SELECT vec_id, [{two}] AS o FROM one) SELECT vec_id, i, CAST(o[i + 1] AS BIGINT) AS v FROM two, (SELECT unnest(range(16)) AS i)"


def _fdct_sql() -> str:
    first, second = {}, {}
    for i in range(4):
        d0, d1, d2, d3 = (f"v[{4 * i + k + 1}]" for k in range(4))
        first[4 * i] = f"({d0} + {d3} + {d1} + {d2}) * 8"
        first[4 * i + 1] = f"(({d1} - {d2}) * 2217 + ({d0} - {d3}) * 5352 + 1812) >> 9"
        first[4 * i + 2] = f"({d0} + {d3} - {d1} - {d2}) * 8"
        first[4 * i + 3] = f"(({d0} - {d3}) * 2217 - ({d1} - {d2}) * 5352 + 937) >> 9"
        t0, t1, t2, t3 = (f"c{i + 4 * k}" for k in range(4))
        second[i] = f"({t0} + {t1} + {t2} + {t3} + 7) >> 4"
        second[8 + i] = f"({t0} + {t3} - {t1} - {t2} + 7) >> 4"
        second[4 + i] = f"((({t1} - {t2}) * 2217 + ({t0} - {t3}) * 5352 + 12000) >> 16) + CASE WHEN {t0} <> {t3} THEN 1 ELSE 0 END"
        second[12 + i] = f"(({t0} - {t3}) * 2217 - ({t1} - {t2}) * 5352 + 51000) >> 16"
    return _staged(first, second)


@register("h01_forward_dct", with_(TILES, _DIFF)[:-1] + _fdct_sql())
def h01(spark: SparkSession, sf: str) -> DataFrame:
    return spread(differences(spark, sf), bl.forward_dct(F.col("d")), "vec_id")


def _w(e: str) -> str:
    return f"((({e}) + 32768) & 65535) - 32768"


def _idct_sql() -> str:
    cos = lambda e: _w(f"((({e}) * 20091) >> 16) + ({e})")
    sin = lambda e: _w(f"((({e}) * -30068) >> 16) + ({e})")
    first, second = {}, {}
    for i in range(4):
        for src, dst, lead, shift in ((lambda k: f"v[{i + 4 * k + 1}]", first, "", 0), (lambda k: f"c{i + 4 * k}", second, " + 4", 3)):
            a, b, c, d = (src(k) for k in range(4))
            e, f = f"({sin(b)} - ({cos(d)}))", f"({cos(b)} + ({sin(d)}))"
            plus, minus = f"({a}{lead} + {c})", f"({a}{lead} - {c})"
            for k, x in enumerate((f"{plus} + {f}", f"{minus} + {e}", f"{minus} - {e}", f"{plus} - {f}")):
                dst[4 * i + k] = f"({_w(x)}) >> {shift}"
    return _staged(first, second, "(SELECT vec_id, [x * 90 FOR x IN v] AS v FROM d)")


@register("h02_inverse_dct", with_(TILES, _DIFF)[:-1] + _idct_sql())
def h02(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients large enough for sums to wrap."""
    return spread(differences(spark, sf), bl.inverse_dct(F.transform("d", lambda x: x * 90)), "vec_id")


def _wht_sql(inverse: bool) -> str:
    first, second = {}, {}
    for i in range(4):
        if inverse:
            a, b, c, d = (f"v[{i + 4 * k + 1}]" for k in range(4))
            for k, x in enumerate((f"{a} + {b} + {c} + {d}", f"{a} - {d} + {b} - {c}", f"{a} + {d} - {b} - {c}", f"{a} - {d} - {b} + {c}")):
                first[i + 4 * k] = x
            a, b, c, d = (f"c{4 * i + k}" for k in range(4))
            for k, x in enumerate((f"{a} + {b} + {c} + {d}", f"{a} - {d} + {b} - {c}", f"{a} + {d} - {b} - {c}", f"{a} - {d} - {b} + {c}")):
                second[4 * i + k] = f"({x} + 3) >> 3"
        else:
            a, b, c, d = (f"v[{4 * i + k + 1}]" for k in range(4))
            for k, x in enumerate((f"{a} + {b} + {c} + {d}", f"{a} - {c} + {b} - {d}", f"{a} - {c} - {b} + {d}", f"{a} + {c} - {b} - {d}")):
                first[4 * i + k] = x
            a, b, c, d = (f"c{i + 4 * k}" for k in range(4))
            for k, x in enumerate((f"{a} + {b} + {c} + {d}", f"{a} - {c} + {b} - {d}", f"{a} - {c} - {b} + {d}", f"{a} + {c} - {b} - {d}")):
                second[i + 4 * k] = f"({x}) >> 1"
    return _staged(first, second)


@register("h03_wht", with_(TILES, _DIFF)[:-1] + _wht_sql(False))
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return spread(differences(spark, sf), bl.forward_wht(F.col("d")), "vec_id")


@register("h03_inverse_wht", with_(TILES, _DIFF)[:-1] + _wht_sql(True))
def h03_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return spread(differences(spark, sf), bl.inverse_wht(F.col("d")), "vec_id")


_Q_SQL = """, k AS (SELECT n, j, CASE WHEN j = 0 THEN 23 ELSE 31 END AS q, CASE WHEN j = 0 THEN 96 ELSE 110 END AS r, s FROM (SELECT unnest(range(16)) AS n, unnest([0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]) AS j, unnest([0, 30, 60, 60, 30, 60, 90, 90, 90, 90, 90, 90, 90, 90, 90, 90]) AS s)),
e AS (SELECT vec_id, n, v[j + 1] * 5 AS c, q, 131072 // q AS iq, r * 512 AS bias, (s * q) >> 11 AS sharp FROM d, k),
f AS (SELECT *, CASE WHEN abs(c) + sharp <= (131071 - bias) // iq THEN 0 ELSE least(2047, ((abs(c) + sharp) * iq + bias) >> 17) END AS lv FROM e)
"""


@register("h04_quantize", with_(TILES, _DIFF)[:-1] + _Q_SQL + "SELECT vec_id, CAST(n AS BIGINT) AS i, CAST(CASE WHEN c < 0 THEN -lv ELSE lv END AS BIGINT) AS v, CAST(max(CASE WHEN lv <> 0 THEN n + 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS BIGINT) AS used FROM f")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    df = differences(spark, sf).select("vec_id", bl.quantize(F.transform("d", lambda x: x * 5), 23, 31, 0).alias("lv")).withColumn("used", bl.used_levels(F.col("lv")).cast("long"))
    return spread(df, F.col("lv"), "vec_id", "used")


def _pred_sql(size: int) -> str:
    s = size
    corner = f"bs[{2 * s + 1}]"
    y, x = f"bs[{s} + (i // {s}) + 1]", f"bs[i % {s} + 1]"
    mean = f"(list_sum(bs[1:{2 * s}]) + {s}) >> {s.bit_length()}"
    return f"SELECT vec_id, m AS mode, i, CAST(CASE m WHEN 0 THEN CAST(list_sum(bs[1:{2 * s}]) + {s} AS BIGINT) >> {s.bit_length()} WHEN 1 THEN least(255, greatest(0, {y} + {x} - {corner})) WHEN 2 THEN {x} ELSE {y} END AS BIGINT) AS v FROM t, (SELECT unnest(range(4)) AS m), (SELECT unnest(range({s * s})) AS i)"


def _predicted(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """The plane's first bytes as the row above, the next as the left column, the next as the corner."""
    t = grids.tiles(spark, sf)
    top, left, corner = F.slice("px", 1, size), F.slice("px", size + 1, size), F.get("px", F.lit(2 * size))
    blocks = F.array(*[bl.block_prediction(m, top, left, corner, size) for m in range(4)])
    return spread(t.select("vec_id", F.posexplode(blocks).alias("m", "block")).withColumn("mode", F.col("m").cast("long")), F.col("block"), "vec_id", "mode")


@register("g14_predict_8x8", TL + _pred_sql(8))
def g14(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, 8)


@register("g14_predict_16x16", TL + _pred_sql(16))
def g14_luma(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, 16)


#: The ten 4x4 modes place by place: left column I J K L from above, corner X, row above A to H.
#: Two letters are a mean of two, three of three with the middle one twice.
_SMALL = {
    "ve": "XAB ABC BCD CDE " * 4,
    "he": "XIJ " * 4 + "IJK " * 4 + "JKL " * 4 + "KLL " * 4,
    "rd": "AXI BAX CBA DCB XIJ AXI BAX CBA IJK XIJ AXI BAX JKL IJK XIJ AXI",
    "vr": "XA AB BC CD IXA XAB ABC BCD JIX XA AB BC KJI IXA XAB ABC",
    "ld": "ABC BCD CDE DEF BCD CDE DEF EFG CDE DEF EFG FGH DEF EFG FGH GHH",
    "vl": "AB BC CD DE ABC BCD CDE DEF BC CD DE EFG BCD CDE DEF FGH",
    "hd": "IX IXA XAB ABC JI JIX IX IXA KJ KJI JI JIX LK LKJ KJ KJI",
    "hu": "IJ IJK JK JKL JK JKL KL KLL KL KLL L L L L L L",
}


def _small_sql() -> str:
    at = {c: f"bs[{i + 1}]" for i, c in enumerate("LKJIXABCDEFGH")}
    one = lambda s: at[s] if len(s) == 1 else f"({at[s[0]]} + {at[s[1]]} + 1) >> 1" if len(s) == 2 else f"({at[s[0]]} + 2 * {at[s[1]]} + {at[s[2]]} + 2) >> 2"
    lists = {m: [one(s) for s in text.split()] for m, text in _SMALL.items()}
    lists["dc"] = ["(" + " + ".join(at[c] for c in "ABCDIJKL") + " + 4) >> 3"] * 16
    lists["tm"] = [f"least(255, greatest(0, {at[a]} + {at[b]} - {at['X']}))" for b in "IJKL" for a in "ABCD"]
    parts = " UNION ALL ".join(f"SELECT vec_id, '{m}' AS mode, [{', '.join(lists[m])}] AS o FROM t" for m in bl.SMALL_MODES)
    return f", s AS ({parts}) SELECT vec_id, mode, i, CAST(o[i + 1] AS BIGINT) AS v FROM s, (SELECT unnest(range(16)) AS i)"


@register("g15_predict_4x4", TL[:-1] + _small_sql())
def g15(spark: SparkSession, sf: str) -> DataFrame:
    """The plane's first 13 bytes as the neighbours in a line."""
    made = F.array(*[F.struct(F.lit(m).alias("mode"), bl.small_prediction(m, F.col("px")).alias("block")) for m in bl.SMALL_MODES])
    df = grids.tiles(spark, sf).select("vec_id", F.explode(made).alias("s")).select("vec_id", "s.mode", "s.block")
    return spread(df, F.col("block"), "vec_id", "mode")


def _subpel_sql(taps: tuple, six: bool) -> str:
    weights = "[" + ", ".join("[" + ", ".join(map(str, f)) + "]" for f in taps) + "]"
    n = len(taps[0])
    across = " + ".join(f"bs[(i // 2) * 8 + {k} + i % 2 + 1] * w[fx + 1][{k + 1}]" for k in range(n))
    down = " + ".join(f"h[(j // 2 + {k}) * 2 + j % 2 + 1] * w[fy + 1][{k + 1}]" for k in range(n))
    rows = 7 if six else 3
    clip = (lambda e: f"least(255, greatest(0, ({e} + 64) >> 7))") if six else (lambda e: f"({e} + 64) >> 7")
    return f""", w AS (SELECT {weights} AS w), f AS (SELECT unnest(range({1 if six else 0}, 8)) AS fx), g AS (SELECT unnest(range({1 if six else 0}, 8)) AS fy),
a AS (SELECT vec_id, fx, fy, w, [{clip(across)} FOR i IN range({2 * rows})] AS h FROM t, w, f, g)
SELECT vec_id, fx, fy, j, CAST(least(255, greatest(0, ({down} + 64) >> 7)) AS BIGINT) AS v FROM a, (SELECT unnest(range(4)) AS j)"""


def _subpel(spark: SparkSession, sf: str, taps: tuple, six: bool) -> DataFrame:
    """A 2x2 block at each fraction, from the tile's upper left rows: across first, rounded, then down."""
    rows = 7 if six else 3

    def block(fx: int, fy: int) -> Column:
        across = F.transform(F.sequence(F.lit(0), F.lit(2 * rows - 1)), lambda i: bl.filtered_row(F.col("px"), F.floor(i / 2).cast("int") * 8 + i % 2, taps[fx], 1, 0))
        return bl.let(across, lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: bl.filtered_row(h, j, taps[fy], 2, 0)))

    first = 1 if six else 0
    cases = F.array(*[F.struct(F.lit(fx).cast("long").alias("fx"), F.lit(fy).cast("long").alias("fy"), block(fx, fy).alias("b")) for fx in range(first, 8) for fy in range(first, 8)])
    df = grids.tiles(spark, sf).select("vec_id", F.explode(cases).alias("c")).select("vec_id", "c.fx", "c.fy", "c.b")
    return spread(df, F.col("b"), "vec_id", "fx", "fy").withColumnRenamed("i", "j")


@register("g16_six_tap", TL[:-1] + _subpel_sql(tb.SIX_TAP, True))
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return _subpel(spark, sf, tb.SIX_TAP, True)


@register("g17_bilinear", TL[:-1] + _subpel_sql(tb.TWO_TAP, False))
def g17(spark: SparkSession, sf: str) -> DataFrame:
    return _subpel(spark, sf, tb.TWO_TAP, False)


_EDGE = ", e AS (SELECT vec_id, y, bs[y * 8 + 1] AS p3, bs[y * 8 + 2] AS p2, bs[y * 8 + 3] AS p1, bs[y * 8 + 4] AS p0, bs[y * 8 + 5] AS q0, bs[y * 8 + 6] AS q1, bs[y * 8 + 7] AS q2, bs[y * 8 + 8] AS q3 FROM t, (SELECT unnest(range(8)) AS y)) "
_C = lambda e, lo=0, hi=255: f"least({hi}, greatest({lo}, {e}))"
_A_SIMPLE = f"(3 * (q0 - p0) + {_C('p1 - q1', -128, 127)})"
_A_WIDE = _C(_A_SIMPLE, -128, 127)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of a tile as the eight pixels across an edge."""
    t = grids.tiles(spark, sf).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return t.select("vec_id", F.col("y").cast("long").alias("y"), *[F.get("px", F.col("y") * 8 + k).alias(n) for k, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))])


@register("d04_filter_masks", TL[:-1] + _EDGE + """SELECT vec_id, y, 4 * abs(p0 - q0) + abs(p1 - q1) <= 120 AS simple, 4 * abs(p0 - q0) + abs(p1 - q1) <= 120 AND abs(p3 - p2) <= 30 AND abs(p2 - p1) <= 30 AND abs(p1 - p0) <= 30 AND abs(q3 - q2) <= 30 AND abs(q2 - q1) <= 30 AND abs(q1 - q0) <= 30 AS normal,
  abs(p1 - p0) > 10 OR abs(q1 - q0) > 10 AS steep FROM e""")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    c = {k: F.col(k) for k in ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3")}
    p, q = [c[f"p{k}"] for k in range(4)], [c[f"q{k}"] for k in range(4)]
    return edges(spark, sf).select("vec_id", "y", bl.needs_simple(p[1], p[0], q[0], q[1], 120).alias("simple"), bl.needs_normal(p, q, 120, 30).alias("normal"), bl.steep(p[1], p[0], q[0], q[1], 10).alias("steep"))


@register("g13_edge_filters", TL[:-1] + _EDGE + f"""SELECT vec_id, y, CAST({_C('p0 + ' + _C(f'({_A_SIMPLE} + 3) >> 3', -16, 15))} AS BIGINT) AS simple_p0, CAST({_C('q0 - ' + _C(f'({_A_SIMPLE} + 4) >> 3', -16, 15))} AS BIGINT) AS simple_q0,
  CAST({_C('p1 + ((' + _C('(3 * (q0 - p0) + 4) >> 3', -16, 15) + ' + 1) >> 1)')} AS BIGINT) AS inner_p1, CAST({_C('q1 - ((' + _C('(3 * (q0 - p0) + 4) >> 3', -16, 15) + ' + 1) >> 1)')} AS BIGINT) AS inner_q1,
  CAST({_C(f'p2 + ((9 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_p2, CAST({_C(f'p1 + ((18 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_p1, CAST({_C(f'p0 + ((27 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_p0,
  CAST({_C(f'q0 - ((27 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_q0, CAST({_C(f'q1 - ((18 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_q1, CAST({_C(f'q2 - ((9 * {_A_WIDE} + 63) >> 7)')} AS BIGINT) AS wide_q2 FROM e""")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    """The three kernels of one edge; the order over a whole frame is the codec's."""
    c = [F.col(k) for k in ("p2", "p1", "p0", "q0", "q1", "q2")]
    simple, inner, wide = bl.edge_filter_simple(*c[1:5]), bl.edge_filter_inner(*c[1:5]), bl.edge_filter_wide(*c)
    made = dict(zip(("simple_p0", "simple_q0"), simple)) | {"inner_p1": inner[0], "inner_q1": inner[3]} | dict(zip(("wide_p2", "wide_p1", "wide_p0", "wide_q0", "wide_q1", "wide_q2"), wide))
    return edges(spark, sf).select("vec_id", "y", *[v.cast("long").alias(k) for k, v in made.items()])


@register("i01_best_mode", TL[:-1] + """, m AS (SELECT t.vec_id, m, list_sum([(bs[64 - i] - CASE m WHEN 0 THEN CAST(list_sum(bs[1:16]) + 8 AS BIGINT) >> 4 WHEN 1 THEN least(255, greatest(0, bs[9 + i // 8] + bs[i % 8 + 1] - bs[17])) WHEN 2 THEN bs[i % 8 + 1] ELSE bs[9 + i // 8] END) ** 2 FOR i IN range(64)]) AS sse FROM t, (SELECT unnest(range(4)) AS m)),
s AS (SELECT vec_id, m, 256 * CAST(sse AS BIGINT) + 40 * [302, 984, 439, 642][m + 1] AS score FROM m)
SELECT vec_id, arg_min(m, score * 4 + m) AS mode, min(score) AS score FROM s GROUP BY vec_id""")
def i01(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest 8x8 mode for the tile read backwards: squared error and the mode's bits; the first wins a tie."""
    t = grids.tiles(spark, sf)
    top, left, corner = F.slice("px", 1, 8), F.slice("px", 9, 8), F.get("px", F.lit(16))
    error = lambda m: F.aggregate(F.zip_with(F.reverse("px"), bl.block_prediction(m, top, left, corner, 8), lambda a, b: ((a - b) * (a - b)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    scored = F.array(*[F.struct((256 * error(m) + 40 * tb.CHROMA_MODE_COST[m]).alias("score"), F.lit(m).cast("long").alias("mode")) for m in range(4)])
    return t.select("vec_id", F.array_min(scored).alias("best")).select("vec_id", "best.mode", "best.score")


def _driver_sql() -> str:
    """Forward transform, quantisation and inverse transform, one after the other, from their own queries' SQL."""
    stages = lambda sql, name: sql.split(" SELECT vec_id, i, CAST(o[i + 1]")[0].replace(", one AS", f", one_{name} AS").replace(", two AS", f", two_{name} AS").replace("FROM one)", f"FROM one_{name})")
    levels = _Q_SQL.replace("SELECT vec_id, n, v[j + 1] * 5 AS c, q,", "SELECT vec_id, n, j, o[j + 1] AS c, q,").replace("FROM d, k)", "FROM two_f, k)").strip()
    back = stages(_idct_sql(), "b").replace("(SELECT vec_id, [x * 90 FOR x IN v] AS v FROM d)", "dq")
    return f"""{stages(_fdct_sql(), 'f')}{levels}, g AS (SELECT vec_id, n, j, q, CASE WHEN c < 0 THEN -lv ELSE lv END AS lv FROM f), dq AS (SELECT vec_id, list(lv * q ORDER BY j) AS v FROM g GROUP BY 1){back},
u AS (SELECT vec_id, max(CASE WHEN lv <> 0 THEN n + 1 ELSE 0 END) AS used, sum(abs(lv)) AS level_sum FROM g GROUP BY 1)
SELECT vec_id, CAST(used AS BIGINT) AS used, CAST(level_sum AS BIGINT) AS level_sum, CAST(list_sum([pow(d.v[i] - o[i], 2) FOR i IN range(1, 17)]) AS BIGINT) AS sse FROM two_b JOIN d USING (vec_id) JOIN u USING (vec_id)"""


@register("h06_block_driver", with_(TILES, _DIFF)[:-1] + _driver_sql())
def h06(spark: SparkSession, sf: str) -> DataFrame:
    """A luma block through transform, quantisation, and back: levels, and the squared error of what is rebuilt."""
    df = differences(spark, sf).select("vec_id", "d", bl.quantize(bl.forward_dct(F.col("d")), 23, 31, 0).alias("lv"))
    back = F.array(*[F.get("lv", F.lit(tb.ZIGZAG.index(j))) * (23 if j == 0 else 31) for j in range(16)])
    rebuilt = df.withColumn("back", bl.inverse_dct(back))
    error = F.aggregate(F.zip_with("d", "back", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return rebuilt.select("vec_id", bl.used_levels(F.col("lv")).cast("long").alias("used"), F.aggregate("lv", F.lit(0).cast("long"), lambda s, v: s + F.abs(v)).alias("level_sum"), error.alias("sse"))
