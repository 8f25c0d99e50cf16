"""Queries of histograms, entropy and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions import tables as tb
from . import grids
from .grids import ARGB, PIXELS, PLACED, TEXT_BYTES, TILES, with_
from .registry import register

TL, PX, AR, TX = with_(TILES, PLACED), with_(TILES, PLACED, PIXELS), with_(TILES, PLACED, PIXELS, ARGB), with_(TEXT_BYTES)


def xlog2(v: Column) -> Column:
    """v log2 v, 0 at 0."""
    return F.when(v > 0, v * F.log2(v.cast("double"))).otherwise(F.lit(0.0))


def entropy(n: Column) -> Column:
    """Bits of a histogram's symbols, as an aggregate over its counts."""
    return xlog2(F.sum(n)) - F.sum(xlog2(n))


_XL = "CASE WHEN {0} > 0 THEN {0} * log2(CAST({0} AS DOUBLE)) ELSE 0.0 END"
_ENT = f"{_XL.format('sum(n)')} - sum({_XL.format('n')})"


def stacked(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each channel (0: alpha to 3: blue) of pixels with a, r, g, b."""
    return df.select(*keep, F.expr("stack(4, 0L, a, 1L, r, 2L, g, 3L, b) AS (channel, symbol)")).withColumn("symbol", F.col("symbol").cast("long"))


_STACK = "st AS (SELECT vec_id, label, y, x, c AS channel, CAST(CASE c WHEN 0 THEN a WHEN 1 THEN r WHEN 2 THEN g ELSE b END AS BIGINT) AS symbol FROM px, (SELECT unnest(range(4)) AS c))"


@register("f01_symbol_histogram", PX[:-1] + f", {_STACK} SELECT label, channel, symbol, count(*) AS n FROM st GROUP BY 1, 2, 3")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return stacked(grids.pixels(spark, sf), "label").groupBy("label", "channel", "symbol").agg(F.count("*").alias("n"))


@register("f02_running_histogram", PX[:-1] + f""", {_STACK}, h AS (SELECT label, vec_id, channel, symbol, count(*) AS n FROM st GROUP BY 1, 2, 3, 4)
SELECT label, vec_id, channel, symbol, n, CAST(sum(n) OVER (PARTITION BY label, channel, symbol ORDER BY vec_id) AS BIGINT) AS so_far FROM h""")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile's counts, and those accumulated over the tiles of its group up to it."""
    h = stacked(grids.pixels(spark, sf), "label", "vec_id").groupBy("label", "vec_id", "channel", "symbol").agg(F.count("*").alias("n"))
    return h.withColumn("so_far", F.sum("n").over(Window.partitionBy("label", "channel", "symbol").orderBy("vec_id")))


@register("f03_entropy", TL + f""", h AS (SELECT label, v, count(*) AS n FROM pl GROUP BY 1, 2)
SELECT label, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS levels, CAST(max(v) AS BIGINT) AS top, round({_ENT}, 6) AS bits FROM h GROUP BY label""")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    h = grids.tiles(spark, sf).select("label", F.explode("px").alias("v")).groupBy("label", "v").agg(F.count("*").alias("n"))
    return h.groupBy("label").agg(F.sum("n").alias("pixels"), F.count("*").alias("levels"), F.max("v").cast("long").alias("top"), F.round(entropy(F.col("n")), 6).alias("bits"))


@register("f04_combined_entropy", TL + f""", h AS (SELECT label, v, count(*) AS n FROM pl GROUP BY 1, 2), a AS (SELECT v, sum(n) AS acc FROM h GROUP BY v), l AS (SELECT DISTINCT label FROM pl),
j AS (SELECT l.label, CAST(coalesce(h.n, 0) AS BIGINT) AS x, CAST(a.acc - coalesce(h.n, 0) AS BIGINT) AS y FROM l, a LEFT JOIN h ON h.label = l.label AND h.v = a.v),
s AS (SELECT label, sum(x) AS sx, sum(x + y) AS sxy, sum(CASE WHEN x > 0 THEN {_XL.format('x')} + {_XL.format('(x + y)')} ELSE {_XL.format('y')} END) AS parts FROM j GROUP BY label)
SELECT label, round({_XL.format('sx')} + {_XL.format('sxy')} - parts, 6) AS bits FROM s""")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of a group's histogram together with that of all the others.

    A symbol that a group lacks costs what the others' count does, so only pairs that exist are kept.
    """
    h = grids.tiles(spark, sf).select("label", F.explode("px").alias("v")).groupBy("label", "v").agg(F.count("*").alias("n"))
    h = h.withColumn("acc", F.sum("n").over(Window.partitionBy("v")))
    whole = h.dropDuplicates(["v"]).agg(F.sum("acc").alias("total"), F.sum(xlog2(F.col("acc"))).alias("alone"))
    per = h.groupBy("label").agg(F.sum("n").alias("sx"), F.sum(xlog2(F.col("n")) + xlog2(F.col("acc"))).alias("own"), F.sum(xlog2(F.col("acc"))).alias("seen"))
    joined = per.join(F.broadcast(whole))  # one row
    return joined.select("label", F.round(xlog2(F.col("sx")) + xlog2(F.col("total")) - F.col("own") - (F.col("alone") - F.col("seen")), 6).alias("bits"))


@register("f05_bias", TL + """, h AS (SELECT label, v, count(*) AS n FROM pl GROUP BY 1, 2)
SELECT label, round(-sum(CASE WHEN v = 0 THEN n WHEN v < 16 THEN n * 0.94 * pow(CAST(0.6 AS DOUBLE), v - 1) WHEN v > 240 THEN n * 0.94 * pow(CAST(0.6 AS DOUBLE), 255 - v) ELSE 0 END) / 10, 6) + 0.0 AS predicted,
  round(-sum(CASE WHEN v = 0 THEN 3 * n WHEN v < 16 THEN n * 1.44 * pow(CAST(0.6 AS DOUBLE), v - 1) WHEN v > 240 THEN n * 1.44 * pow(CAST(0.6 AS DOUBLE), 255 - v) ELSE 0 END) / 10, 6) + 0.0 AS crossed FROM h GROUP BY label""")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    """Bonus for residuals near zero, which fades by 0.6 a step on both sides of it."""
    h = grids.tiles(spark, sf).select("label", F.explode("px").alias("v")).groupBy("label", "v").agg(F.count("*").alias("n"))
    away = F.least(F.col("v"), 256 - F.col("v"))
    weight = lambda zero, first: F.when(away == 0, F.lit(zero)).when(away < 16, first * F.pow(F.lit(0.6), away - 1)).otherwise(0.0)
    return h.groupBy("label").agg(*[(F.round(-F.sum(F.col("n") * weight(z, f)) / 10, 6) + 0.0).alias(k) for k, z, f in (("predicted", 1.0, 0.94), ("crossed", 3.0, 1.44))])


@register("f06_filtered_histogram", AR + """, e AS (SELECT vec_id, p, v >> 4 AS v, v AS w FROM argb), q AS (SELECT vec_id, p, (v // 16777216) % 4 AS v FROM argb),
k AS (SELECT vec_id, p, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 8) OVER w AS u0, lag(v, 9) OVER w AS u1, lag(v, 10) OVER w AS u2 FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY p))
SELECT v AS symbol, count(*) AS n FROM k WHERE NOT coalesce(v = l1 AND v = l2, false) AND NOT coalesce(l2 = u2 AND l1 = u1 AND v = u0, false) GROUP BY v""")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    """Counts without pixels inside a run, or that repeat the row above with their two predecessors.

    The symbol is the low two bits of alpha, so that runs occur.
    """
    small = grids.argb_tiles(spark, sf).select(F.transform("argb", lambda v: ch.channel(v, 24).bitwiseAND(3)).alias("s")).select("s", F.posexplode("s").alias("p", "v"))
    back = lambda k: F.when(F.col("p") >= k, F.get("s", F.col("p") - k))
    run = (F.col("v") == back(1)) & (F.col("v") == back(2))
    row = (back(2) == back(10)) & (back(1) == back(9)) & (F.col("v") == back(8))
    kept = small.filter(~F.coalesce(run, F.lit(False)) & ~F.coalesce(row, F.lit(False)))
    return kept.groupBy(F.col("v").cast("long").alias("symbol")).agg(F.count("*").alias("n"))


@register("f07_plane_cost", TL + f""", h AS (SELECT label, v, count(*) AS n FROM pl GROUP BY 1, 2), m AS (SELECT label // 2 AS pair, v, sum(n) AS n FROM h GROUP BY 1, 2),
c AS (SELECT label, {_ENT} + 5 * count(*) + 40 AS cost FROM h GROUP BY 1), d AS (SELECT pair, {_ENT} + 5 * count(*) + 40 AS cost FROM m GROUP BY 1)
SELECT pair, round(d.cost, 6) AS merged, round(sum(c.cost), 6) AS apart FROM d JOIN c ON c.label // 2 = d.pair GROUP BY pair, d.cost""")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy, 5 bits a used symbol and 40: of two groups merged, and of each by itself."""
    h = grids.tiles(spark, sf).select("label", F.explode("px").alias("v")).groupBy("label", "v").agg(F.count("*").alias("n"))
    pair = F.expr("cast(label div 2 as int)").alias("pair")
    cost = entropy(F.col("n")) + 5 * F.count("*") + 40
    apart = h.groupBy("label").agg(cost.alias("cost")).groupBy(pair).agg(F.round(F.sum("cost"), 6).alias("apart"))
    merged = h.groupBy(pair, "v").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.round(cost, 6).alias("merged"))
    return merged.join(apart, "pair")


@register("f08_block_histogram", """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS len, l_returnflag AS symbol,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM lineitem)
SELECT (place // 16) // 4 AS ty, (place % 16) // 4 AS tx, symbol, count(*) AS n, CAST(sum(len) AS BIGINT) AS len FROM r GROUP BY 1, 2, 3""")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """References (an order's lines, as long as their quantity) charged to the 4x4 tile, of a picture 16 wide, where they begin."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").rowsBetween(Window.unboundedPreceding, -1)
    r = grids.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_quantity").cast("long").alias("len"), F.col("l_returnflag").alias("symbol"))
    r = r.withColumn("at", F.coalesce(F.sum("len").over(w), F.lit(0)))
    return r.groupBy(F.expr("(at div 16) div 4").alias("ty"), F.expr("(at % 16) div 4").alias("tx"), "symbol").agg(F.count("*").alias("n"), F.sum("len").alias("len"))


@register("f09_palette", TL + """, d AS (SELECT vec_id, v, count(*) AS n FROM (SELECT vec_id, v // 8 AS v FROM pl) GROUP BY 1, 2)
SELECT vec_id, CAST(v AS BIGINT) AS colour, n, row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS idx FROM d""")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct colours of a picture in ascending order, if there are 256 at most; with their counts."""
    palette = F.array_sort(F.array_distinct("q"))
    df = grids.tiles(spark, sf).select("vec_id", F.transform("px", lambda v: F.shiftright(v, 3).cast("long")).alias("q")).withColumn("palette", palette).filter(F.size("palette") <= 256)
    return df.select("vec_id", "q", F.posexplode("palette").alias("idx", "colour")).select("vec_id", "colour", F.size(F.filter("q", lambda v: v == F.col("colour"))).cast("long").alias("n"), F.col("idx").cast("long").alias("idx"))


@register("f10_level_stats", TL + """, d AS (SELECT DISTINCT vec_id, v FROM pl), g AS (SELECT vec_id, v, v - lag(v) OVER (PARTITION BY vec_id ORDER BY v) AS gap FROM d)
SELECT vec_id, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high, count(*) AS levels, CAST(coalesce(min(gap), 0) AS BIGINT) AS least_gap FROM g GROUP BY vec_id""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    d = F.array_sort(F.array_distinct("px"))
    df = grids.tiles(spark, sf).select("vec_id", d.alias("d"))
    gaps = F.zip_with(F.slice("d", 1, F.size("d") - 1), F.slice("d", 2, F.size("d") - 1), lambda a, b: b - a)
    return df.select("vec_id", F.array_min("d").cast("long").alias("low"), F.array_max("d").cast("long").alias("high"), F.size("d").cast("long").alias("levels"), F.coalesce(F.array_min(gaps), F.lit(0)).cast("long").alias("least_gap"))


def squared_error(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two planes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


@register("f11_sse", TL + """, n AS (SELECT vec_id, label, bs, lead(vec_id) OVER w AS other, lead(bs) OVER w AS bo FROM t WINDOW w AS (PARTITION BY vec_id // 20 ORDER BY vec_id))
SELECT vec_id, other, CAST(list_sum([(bs[i] - bo[i]) * (bs[i] - bo[i]) FOR i IN range(1, 65)]) AS BIGINT) AS sse FROM n WHERE other IS NOT NULL""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile against the next of its clip."""
    w = Window.partitionBy(grids.clip()).orderBy("vec_id")
    df = grids.tiles(spark, sf).select("vec_id", "px", F.lead("vec_id").over(w).alias("other"), F.lead("px").over(w).alias("next")).filter("other IS NOT NULL")
    return df.select("vec_id", "other", squared_error("px", "next").alias("sse"))


@register("f12_probabilities", """SELECT user_id, ((count(*) - count(*) FILTER (WHERE event_type = 'view')) * 255) // count(*) AS skip, greatest(1, least(255, (255 * (count(*) - count(*) FILTER (WHERE event_type = 'click'))) // count(*))) AS intra FROM events GROUP BY user_id""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as macroblocks: views are skipped ones, clicks inter-coded ones."""
    e = grids.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("skips"), F.count_if(F.col("event_type") == "click").alias("inter"))
    return e.select("user_id", F.expr("((n - skips) * 255) div n").alias("skip"), F.expr("greatest(1, least(255, (255 * (n - inter)) div n))").alias("intra"))


def bit_cost(p: Column) -> Column:
    """Cost of a bit whose probability is p of 256, in 1/256 bit, cut."""
    return F.floor(-F.log2(p.cast("double") / 256) * 256)


@register("f13_probability_update", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'purchase') AS n0, count(*) FILTER (WHERE event_type = 'purchase') AS n1 FROM events GROUP BY 1),
f AS (SELECT *, greatest(1, least(254, (n0 * 256) // (n0 + n1))) AS fresh FROM c),
k AS (SELECT *, CAST(n0 * trunc(-log2(200 / 256.0) * 256) + n1 * trunc(-log2(56 / 256.0) * 256) + trunc(-log2(240 / 256.0) * 256) AS BIGINT) AS keep,
  CAST(n0 * trunc(-log2(CAST(fresh AS DOUBLE) / 256) * 256) + n1 * trunc(-log2(CAST(256 - fresh AS DOUBLE) / 256) * 256) + trunc(-log2(16 / 256.0) * 256) + 2048 AS BIGINT) AS swap FROM f)
SELECT user_id, n0, n1, keep, swap, CASE WHEN swap < keep THEN fresh ELSE 200 END AS probability FROM k""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """A slot's new probability, kept if it saves more than it costs to send (old: 200, of an update: 240)."""
    c = grids.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("n0"), F.count_if(F.col("event_type") == "purchase").alias("n1"))
    c = c.withColumn("fresh", F.expr("greatest(1, least(254, (n0 * 256) div (n0 + n1)))"))
    price = lambda p, q: F.col("n0") * bit_cost(p) + F.col("n1") * bit_cost(256 - p) + q
    c = c.withColumn("keep", price(F.lit(200), bit_cost(F.lit(240)))).withColumn("swap", price(F.col("fresh"), bit_cost(F.lit(16)) + 8 * 256))
    return c.select("user_id", "n0", "n1", "keep", "swap", F.when(F.col("swap") < F.col("keep"), F.col("fresh")).otherwise(F.lit(200).cast("long")).alias("probability"))


@register("f14_stream_cost", TX + """, h AS (SELECT b, count(*) AS n FROM tx GROUP BY b), l AS (SELECT b, n, CAST(least(15, greatest(1, ceil(log2(CAST(sum(n) OVER () AS DOUBLE) / n)))) AS BIGINT) AS len FROM h)
SELECT CAST(sum(n * len) AS BIGINT) AS bits, CAST(sum(CASE WHEN b >= 64 THEN n * (CAST(floor(log2(CAST(b AS DOUBLE))) AS BIGINT) - 5) ELSE 0 END) AS BIGINT) AS extra FROM l""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each symbol's code times its count, and extra bits of symbols from 64 on."""
    h = grids.text_counts(spark, sf).groupBy("b").agg(F.sum("n").alias("n"))
    total = h.agg(F.sum("n").alias("total"))  # one row; a histogram of bytes has 256 at most
    length = F.least(F.lit(15), F.greatest(F.lit(1), F.ceil(F.log2(F.col("total").cast("double") / F.col("n")))))
    extra = F.when(F.col("b") >= 64, F.col("n") * (F.floor(F.log2(F.col("b").cast("double"))) - 5)).otherwise(F.lit(0).cast("long"))
    return h.join(F.broadcast(total)).agg(F.sum(F.col("n") * length).alias("bits"), F.sum(extra).alias("extra"))


@register("f15_cache_cost", AR + """, q AS (SELECT vec_id, p, (v // 67108864) * 67108864 AS v FROM argb), c AS (SELECT vec_id, p, v, k, ((v * 506832829) & 4294967295) >> (32 - k) AS slot FROM q, (SELECT unnest(range(1, 11)) AS k)),
h AS (SELECT k, slot, v, v = lag(v) OVER (PARTITION BY vec_id, k, slot ORDER BY p) AS hit FROM c), s AS (SELECT k, CASE WHEN coalesce(hit, false) THEN slot ELSE 1000000 + (v >> 26) END AS symbol, count(*) AS n FROM h GROUP BY 1, 2)
SELECT k AS bits, round(""" + _ENT + """, 6) AS cost FROM s GROUP BY k""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of cache hits and literals for each number of cache bits; pixels have four levels of alpha."""
    q = grids.argb_tiles(spark, sf).select("vec_id", F.posexplode(F.transform("argb", lambda v: F.shiftright(v, 26) * (1 << 26))).alias("p", "v"))
    c = q.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    slot = F.call_function("shiftright", (F.col("v") * ch.CACHE_MULTIPLIER).bitwiseAND(0xFFFFFFFF), (32 - F.col("k")).cast("int"))
    c = c.withColumn("slot", slot)
    hit = F.coalesce(F.col("v") == F.lag("v").over(Window.partitionBy("vec_id", "k", "slot").orderBy("p")), F.lit(False))
    s = c.withColumn("symbol", F.when(hit, F.col("slot")).otherwise(1_000_000 + F.shiftright("v", 26))).groupBy("k", "symbol").agg(F.count("*").alias("n"))
    return s.groupBy(F.col("k").alias("bits")).agg(F.round(entropy(F.col("n")), 6).alias("cost"))


@register("f16_cost_bins", TL + f""", h AS (SELECT vec_id, v // 16 AS v, count(*) AS n FROM pl GROUP BY 1, 2), c AS (SELECT vec_id, round({_ENT}, 6) AS cost FROM h GROUP BY 1), r AS (SELECT min(cost) AS lo, max(cost) AS hi FROM c)
SELECT CAST(CASE WHEN hi > lo THEN least(63, floor((cost - lo) * 64 / (hi - lo))) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM c, r GROUP BY 1""")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures dealt to 64 bins of equal width by the entropy of their levels."""
    h = grids.tiles(spark, sf).select("vec_id", F.explode("px").alias("v")).groupBy("vec_id", F.shiftright("v", 4).alias("v")).agg(F.count("*").alias("n"))
    c = h.groupBy("vec_id").agg(F.round(entropy(F.col("n")), 6).alias("cost"))
    r = c.agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))  # one row
    width = F.col("hi") - F.col("lo")
    return c.join(F.broadcast(r)).groupBy(F.when(width > 0, F.least(F.lit(63), F.floor((F.col("cost") - F.col("lo")) * 64 / width))).otherwise(0).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def step(table: tuple[int, ...], index: Column, most: int = 127) -> Column:
    """A quantizer step, by an index that is kept within the table."""
    return F.get(F.array(*[F.lit(v) for v in table]), ch.clamp(index, 0, most))


_DC, _AC = "[" + ", ".join(map(str, tb.DC_STEP)) + "]", "[" + ", ".join(map(str, tb.AC_STEP)) + "]"


def _at(table: str, index: str, most: int = 127) -> str:
    return f"{table}[least({most}, greatest(0, {index})) + 1]"


@register("f17_quantizers", f"""WITH q AS (SELECT p_partkey, p_size * 3 - 10 AS base, p_size % 31 - 15 AS d FROM part), k AS (SELECT unnest(range(0, 101)) AS quality)
SELECT p_partkey, CAST({_at(_DC, 'base + d')} AS BIGINT) AS y1_dc, CAST({_at(_AC, 'base')} AS BIGINT) AS y1_ac, CAST({_at(_DC, 'base - d')} * 2 AS BIGINT) AS y2_dc, CAST(greatest(8, {_at(_AC, 'base + d')} * 101581 >> 16) AS BIGINT) AS y2_ac,
  CAST({_at(_DC, 'base + d', 117)} AS BIGINT) AS uv_dc, CAST({_at(_AC, 'base - d')} AS BIGINT) AS uv_ac FROM q""")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of each kind of block, from a base index and a delta."""
    q = grids.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3 - 10).alias("base"), (F.col("p_size") % 31 - 15).alias("d"))
    base, d = F.col("base"), F.col("d")
    made = {"y1_dc": step(tb.DC_STEP, base + d), "y1_ac": step(tb.AC_STEP, base), "y2_dc": step(tb.DC_STEP, base - d) * 2, "y2_ac": F.greatest(F.lit(8), F.shiftright(step(tb.AC_STEP, base + d) * 101581, 16)), "uv_dc": step(tb.DC_STEP, base + d, 117), "uv_ac": step(tb.AC_STEP, base - d)}
    return q.select("p_partkey", *[c.cast("long").alias(k) for k, c in made.items()])


@register("f17_quality", "SELECT quality, CAST(greatest(0, least(127, trunc(127 * (1 - pow(CASE WHEN quality >= 75 THEN 2 * (quality / 100.0) - 1 ELSE (quality / 100.0) * 2 / 3 END, 1.0 / 3)) + 1e-9))) AS BIGINT) AS base FROM (SELECT unnest(range(0, 101)) AS quality)")
def f17_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quantizer index of a quality: a cube root of a curve with a knee at 75."""
    c = F.col("quality") / 100.0
    linear = F.when(F.col("quality") >= 75, 2 * c - 1).otherwise(c * 2 / 3)
    return spark.range(0, 101).select(F.col("id").alias("quality")).select("quality", ch.clamp(F.floor(127 * (1 - F.pow(linear, F.lit(1.0 / 3))) + 1e-9), 0, 127).cast("long").alias("base"))


@register("f18_filter_strength", """WITH s AS (SELECT b AS base, r AS ref, m AS mode, k AS sharpness, least(63, greatest(0, b + [2, 0, -2, -4][r + 1] + CASE WHEN r > 0 OR m = 0 THEN [4, -2, 2, 4][m + 1] ELSE 0 END)) AS level
  FROM (SELECT unnest(range(64)) AS b), (SELECT unnest(range(4)) AS r), (SELECT unnest(range(4)) AS m), (SELECT unnest(range(8)) AS k) WHERE NOT (r = 0 AND m > 1) AND NOT (r > 0 AND m = 0)),
i AS (SELECT *, greatest(1, CASE WHEN sharpness = 0 THEN level ELSE least(9 - sharpness, CASE WHEN sharpness > 4 THEN level >> 2 ELSE level >> 1 END) END) AS ilevel FROM s)
SELECT base, ref, mode, sharpness, level, CASE WHEN level = 0 THEN 0 ELSE ilevel END AS inner_limit, CASE WHEN level = 0 THEN 0 ELSE 2 * level + ilevel END AS edge_limit,
  CAST(CASE WHEN level >= 40 THEN 2 WHEN level >= 20 THEN 1 WHEN level >= 15 THEN 1 ELSE 0 END AS BIGINT) AS hev_key, CAST(CASE WHEN level >= 40 THEN 3 WHEN level >= 20 THEN 2 WHEN level >= 15 THEN 1 ELSE 0 END AS BIGINT) AS hev_inter FROM i""")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """Limits for every base level, reference frame, mode class and sharpness, with deltas for reference and mode."""
    grid = spark.range(64).select(F.col("id").alias("base"))
    for name, n in (("ref", 4), ("mode", 4), ("sharpness", 8)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    # only the intra frame has mode 0, and only modes 0 and 1
    grid = grid.filter(~((F.col("ref") == 0) & (F.col("mode") > 1)) & ~((F.col("ref") > 0) & (F.col("mode") == 0)))
    of = lambda values, c: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(c).cast("int"))
    delta = of((2, 0, -2, -4), "ref") + F.when((F.col("ref") > 0) | (F.col("mode") == 0), of((4, -2, 2, 4), "mode")).otherwise(0)
    g = grid.withColumn("level", ch.clamp(F.col("base") + delta, 0, 63))
    cut = F.when(F.col("sharpness") > 4, F.shiftright("level", 2)).otherwise(F.shiftright("level", 1))
    inner = F.greatest(F.lit(1), F.when(F.col("sharpness") == 0, F.col("level")).otherwise(F.least(9 - F.col("sharpness"), cut)))
    high = lambda *at: sum((F.when(F.col("level") >= a, 1).otherwise(0) for a in at), F.lit(0)).cast("long")
    none = F.col("level") == 0
    return g.select("base", "ref", "mode", "sharpness", "level", F.when(none, 0).otherwise(inner).cast("long").alias("inner_limit"), F.when(none, 0).otherwise(2 * F.col("level") + inner).cast("long").alias("edge_limit"), high(15, 40).alias("hev_key"), high(15, 20, 40).alias("hev_inter"))


@register("f19_bit_cost", "SELECT p, CAST(trunc(-log2(CAST(p AS DOUBLE) / 256) * 256) AS BIGINT) AS cost FROM (SELECT unnest(range(1, 257)) AS p)")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 257).select(F.col("id").alias("p"), bit_cost(F.col("id")).cast("long").alias("cost"))
