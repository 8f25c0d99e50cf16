"""Queries along scan order: unfilters, predictors, runs, caches, smoothing, codes, choices, composition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions import rows as rw
from ..functions.blocks import let
from ..operators import colour, lossless
from ..streaming.ordered import carried
from . import grids
from .grids import ARGB, PIXELS, PLACED, TEXT_BYTES, TILES, with_
from .registry import register
from .structure_queries import key_frames

TL, PL, AR, TX = with_(TILES), with_(TILES, PLACED), with_(TILES, PLACED, PIXELS, ARGB), with_(TEXT_BYTES)


def _placed(df: DataFrame, value: Column, *keep: str) -> DataFrame:
    out = df.select(*keep, F.posexplode(value).alias("p", "v"))
    return out.select(*keep, F.expr("cast(p div 8 AS bigint)").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.col("v").cast("long").alias("v"))


@register("g01_horizontal_unfilter", PL + """, h AS (SELECT vec_id, y, CAST(sum(v) OVER (PARTITION BY vec_id ORDER BY y) AS BIGINT) AS head, v AS v0 FROM pl WHERE x = 0), r AS (SELECT vec_id, y, x, sum(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS s FROM pl)
SELECT vec_id, y, x, CAST((s - v0 + head) % 256 AS BIGINT) AS v FROM r JOIN h USING (vec_id, y)""")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(grids.tiles(spark, sf), rw.horizontal_unfilter(F.col("px"), 8), "vec_id")


@register("g01_horizontal_round_trip", PL + "SELECT vec_id, y, x, CAST(v AS BIGINT) AS v FROM pl")
def g01_back(spark: SparkSession, sf: str) -> DataFrame:
    """Differences and then sums give the plane again."""
    t = grids.tiles(spark, sf).withColumn("d", rw.horizontal_filter(F.col("px"), 8))
    return _placed(t, rw.horizontal_unfilter(F.col("d"), 8), "vec_id")


@register("g02_vertical_unfilter", PL + """, f AS (SELECT vec_id, y, x, CASE WHEN y = 0 THEN sum(v) OVER (PARTITION BY vec_id, y ORDER BY x) ELSE v END AS v FROM pl)
SELECT vec_id, y, x, CAST(sum(v) OVER (PARTITION BY vec_id, x ORDER BY y) % 256 AS BIGINT) AS v FROM f""")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(grids.tiles(spark, sf), rw.vertical_unfilter(F.col("px"), 8), "vec_id")


def _residual_cte() -> str:
    """Residuals of all 14 modes channel by channel, from window lags."""
    clip = "least(255, greatest(0, {}))"
    half = f"CASE WHEN ((l + t) >> 1) < c THEN -((c - ((l + t) >> 1)) // 2) ELSE (((l + t) >> 1) - c) // 2 END"
    modes = ["bk", "l", "t", "r", "c", "(((l + r) >> 1) + t) >> 1", "(l + c) >> 1", "(l + t) >> 1", "(c + t) >> 1", "(t + r) >> 1", "(((l + c) >> 1) + ((t + r) >> 1)) >> 1", "CASE WHEN far <= 0 THEN t ELSE l END", clip.format("l + t - c"), clip.format(f"((l + t) >> 1) + {half}")]
    inner = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(modes))
    return f""", ln AS (SELECT vec_id, label, p, s, (v >> s) & 255 AS v, CASE s WHEN 24 THEN 255 ELSE 0 END AS bk FROM argb, (VALUES (0), (8), (16), (24)) AS k(s)),
lg AS (SELECT *, lag(v, 1) OVER w AS l, lag(v, 9) OVER w AS c, lag(v, 8) OVER w AS t, lag(v, 7) OVER w AS r FROM ln WINDOW w AS (PARTITION BY vec_id, s ORDER BY p)),
fr AS (SELECT *, sum(abs(l - c) - abs(t - c)) OVER (PARTITION BY vec_id, p) AS far FROM lg),
rs AS (SELECT vec_id, label, p, s, m AS mode, (v - (CASE WHEN p = 0 THEN bk WHEN p < 8 THEN l WHEN p % 8 = 0 THEN t ELSE CASE m {inner} END END) + 256) % 256 AS d FROM fr, (SELECT unnest(range(14)) AS m))"""


def _left(argb: pa.Array) -> Iterator[np.ndarray]:
    """For each tile the residuals of the 14 modes, 14 x 64 words."""
    for px in argb.to_numpy(zero_copy_only=False):
        px = px.astype(np.uint32)
        yield lossless.subtract(px[None, :], lossless.predictions(px, grids.SIDE))


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, p, mode, residual: each pixel less each of the 14 predictions.

    The first row is foretold from the left, the first column from above, others by the mode. The neighbour
    above right of a row's last pixel is the row's own first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # 57,344 rows out at once
                part = b.slice(at, 64)
                left = np.stack(list(_left(part.column(1)))).astype(np.int64)
                mode, p = np.divmod(np.arange(14 * 64), 64)
                columns = [np.repeat(part.column(0).to_numpy(), 14 * 64), np.tile(p, part.num_rows), np.tile(mode, part.num_rows), left.reshape(-1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "p", "mode", "residual"])

    return grids.argb_tiles(spark, sf).select("vec_id", "argb").mapInArrow(run, "vec_id long, p long, mode long, residual long")


@register("g05_residuals", AR + _residual_cte() + " SELECT vec_id, mode, p, CAST(sum(d * (CAST(1 AS BIGINT) << s)) AS BIGINT) AS residual FROM rs GROUP BY 1, 2, 3")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the 14 predictors leaves, against original neighbours."""
    return residuals(spark, sf).select("vec_id", "mode", "p", "residual")


_XL = "CASE WHEN {0} > 0 THEN {0} * log2(CAST({0} AS DOUBLE)) ELSE 0.0 END"


@register("i04_best_predictor", AR + _residual_cte() + f""", h AS (SELECT vec_id, mode, s, d, count(*) AS n FROM rs GROUP BY 1, 2, 3, 4), c AS (SELECT vec_id, mode, s, {_XL.format('sum(n)')} - sum({_XL.format('n')}) - sum(CASE WHEN d = 0 THEN n ELSE 0 END) / 10.0 AS cost FROM h GROUP BY 1, 2, 3),
m AS (SELECT vec_id, mode, round(sum(cost), 6) AS cost FROM c GROUP BY 1, 2) SELECT vec_id, arg_min(mode, cost * 1000 + mode * 1e-4) AS mode, min(cost) AS cost FROM m GROUP BY vec_id""")
def i04(spark: SparkSession, sf: str) -> DataFrame:
    """The predictor whose residuals cost least by their entropy, less a tenth of a bit for each zero; the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.concatenate([[0.0], np.log2(np.arange(1, 65))]) * np.arange(65)
        for b in batches:
            best, costs = [], []
            for left in _left(b.column(1)):
                channels = np.stack([left >> np.uint32(k) & np.uint32(255) for k in (0, 8, 16, 24)], 1).astype(np.int64)  # mode, channel, pixel
                h = np.bincount((channels + 256 * np.arange(56).reshape(14, 4, 1)).reshape(-1), minlength=56 * 256).reshape(14, 4, 256)
                cost = np.round((log[64] - log[h].sum(2) - h[:, :, 0] / 10).sum(1), 6)
                best.append(int(cost.argmin()))
                costs.append(float(cost.min()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int64()), pa.array(costs, pa.float64())], names=["vec_id", "mode", "cost"])

    return grids.argb_tiles(spark, sf).select("vec_id", "argb").mapInArrow(run, "vec_id long, mode long, cost double")


@register("g06_palette_deltas", AR + """, q AS (SELECT DISTINCT vec_id, (v >> 28) * 268435456 + ((v >> 12) & 15) * 4096 AS v FROM argb), o AS (SELECT vec_id, v, row_number() OVER w - 1 AS i, lag(v) OVER w AS b FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY v))
SELECT vec_id, i, CASE WHEN b IS NULL THEN v ELSE ((v >> 24) - (b >> 24) + 256) % 256 * 16777216 + (((v >> 16) & 255) - ((b >> 16) & 255) + 256) % 256 * 65536 + (((v >> 8) & 255) - ((b >> 8) & 255) + 256) % 256 * 256 + ((v & 255) - (b & 255) + 256) % 256 END AS delta, true AS inverse_ok FROM o""")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of neighbours in a sorted palette; running sums give the palette again."""
    coarse = F.transform("argb", lambda v: F.shiftright(v, 28) * (1 << 28) + F.shiftright(v, 12).bitwiseAND(15) * 4096)
    # each step worked out once, though later ones look at it again and again
    one = let(F.array_sort(F.array_distinct(coarse)), lambda p: let(rw.palette_deltas(p), lambda d: F.struct(d.alias("deltas"), (rw.palette_sums(d) == p).alias("inverse_ok"))))
    df = grids.argb_tiles(spark, sf).select("vec_id", F.explode(F.array(one)).alias("one"))
    return df.select("vec_id", F.posexplode("one.deltas").alias("i", "delta"), F.col("one.inverse_ok").alias("inverse_ok")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("delta").cast("long").alias("delta"), "inverse_ok")


@register("g07_runs", TX + """, g AS (SELECT doc_id, i, b, b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM tx), r AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), n AS (SELECT doc_id, k, min(i) AS start, count(*) AS len FROM r GROUP BY 1, 2)
SELECT doc_id, count(*) AS runs, max(len) AS longest, CAST(sum(CASE WHEN len >= 5 THEN 2 ELSE len END) AS BIGINT) AS refs FROM n GROUP BY 1""")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal bytes; one of five or more is a literal and a copy at distance 1."""

    def of(b: np.ndarray) -> list:
        n = grids.run_lengths(b)[1]
        return [np.array([x], np.int64) for x in (len(n), n.max(), np.where(n >= 5, 2, n).sum())]

    return grids.per_text(spark, sf, of, "runs long, longest long, refs long")


@register("g10_colour_cache", AR + """, q AS (SELECT vec_id, p, (v // 67108864) * 67108864 AS v FROM argb), c AS (SELECT vec_id, p, v, ((v * 506832829) & 4294967295) >> 28 AS slot FROM q)
SELECT vec_id, p, slot, coalesce(v = lag(v) OVER (PARTITION BY vec_id, slot ORDER BY p), false) AS hit FROM c""")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    """Hits in a cache of 16 slots, of pixels with few colours."""
    q = grids.argb_tiles(spark, sf).select("vec_id", F.transform("argb", lambda v: F.shiftright(v, 26) * (1 << 26)).alias("argb"))
    both = F.arrays_zip(F.transform("argb", lambda v: ch.cache_slot(v, 4)).alias("slot"), rw.cache_hits(F.col("argb"), 4).alias("hit"))
    return q.select("vec_id", F.posexplode(both).alias("p", "e")).select("vec_id", F.col("p").cast("long").alias("p"), F.col("e.slot").cast("long").alias("slot"), "e.hit")


@register("g11_level_smoothing", TL + """, q AS (SELECT vec_id, [v // 32 * 32 FOR v IN bs] AS bs FROM t), l AS (SELECT vec_id, v, v - lag(v) OVER (PARTITION BY vec_id ORDER BY v) AS gap FROM (SELECT DISTINCT vec_id, unnest(bs) AS v FROM q)), s AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, count(*) AS n, min(gap) * 4 AS t1 FROM l GROUP BY 1),
b AS (SELECT q.vec_id, p, p // 8 AS y, p % 8 AS x, bs[p + 1] AS v, bs FROM q, (SELECT unnest(range(64)) AS p)),
a AS (SELECT vec_id, y, x, v, list_sum([bs[least(7, greatest(0, y + k // 5 - 2)) * 8 + (CASE WHEN x + k % 5 - 2 < 0 THEN 1 - x - k % 5 WHEN x + k % 5 - 2 > 7 THEN 16 - x - k % 5 ELSE x + k % 5 - 2 END) + 1] FOR k IN range(25)]) AS total FROM b),
m AS (SELECT a.vec_id, y, x, v, lo, hi, n, t1, (3 * t1) >> 2 AS t2, ((CAST(total AS BIGINT) * 10485) >> 16) - v * 4 AS d FROM a JOIN s USING (vec_id)),
c AS (SELECT *, (CASE WHEN abs(d) <= t2 THEN abs(d) WHEN abs(d) < t1 THEN t2 * (t1 - abs(d)) // (t1 - t2) ELSE 0 END) >> 2 AS mv FROM m)
SELECT vec_id, y, x, CAST(CASE WHEN n <= 2 OR v <= lo OR v >= hi THEN v ELSE least(255, greatest(0, v + CASE WHEN d < 0 THEN -mv ELSE mv END)) END AS BIGINT) AS v FROM c""")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of eight levels, smoothed over 5x5 boxes."""
    t = grids.tiles(spark, sf).select("vec_id", F.transform("px", lambda v: F.floor(v / 32).cast("int") * 32).alias("px"))
    return _placed(t, rw.smoothed_levels(F.col("px"), 8, 8, 50), "vec_id")


@register("g12_block_contexts", PL + ", n AS (SELECT vec_id, y, x, CAST(v > 127 AS INTEGER) AS nz FROM pl) SELECT vec_id, y, x, CAST(nz AS BIGINT) AS nonzero, CAST(coalesce(lag(nz) OVER (PARTITION BY vec_id, y ORDER BY x), 0) + coalesce(lag(nz) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS BIGINT) AS context FROM n")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the blocks to the left and above have coefficients (here: a byte over 127)."""
    df = grids.placed(grids.tiles(spark, sf).select("vec_id", F.transform("px", lambda v: (v > 127).cast("long")).alias("nz")))
    side = lambda ok, d: F.when(ok, F.get("nz", F.col("p") - d)).otherwise(0)
    return df.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.get("nz", "p").alias("nonzero"), (side(F.col("x") > 0, 1) + side(F.col("y") > 0, 8)).cast("long").alias("context"))


@register("i05_cross_colour_search", with_(TILES, PLACED, PIXELS) + """, c AS (SELECT vec_id, m, sum(CASE WHEN d > 127 THEN 256 - d ELSE d END) AS cost FROM (SELECT vec_id, m, ((r - ((m * CASE WHEN g > 127 THEN g - 256 ELSE g END) >> 5)) % 256 + 256) % 256 AS d FROM px, (SELECT unnest(range(-16, 17, 4)) AS m)) GROUP BY 1, 2)
SELECT vec_id, arg_min(m, cost * 100 + abs(m) + CASE WHEN m < 0 THEN 1 ELSE 0 END) AS multiplier, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY vec_id""")
def i05(spark: SparkSession, sf: str) -> DataFrame:
    """The green-to-red multiplier that leaves the smallest reds, over a grid; of equal ones the smallest, positive first."""
    n = 64
    r = lambda i: F.get("px", (i + 1) % n)
    g = lambda i: ch.signed8(F.get("px", (i + 2) % n))
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def cost(m: int) -> Column:
        size = lambda d: F.when(d > 127, 256 - d).otherwise(d)
        return F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s + let(ch.wrap8(r(i) - F.shiftright(m * g(i), 5)), size))

    grid = F.array(*[F.struct(cost(m).alias("cost"), F.lit(abs(m)).alias("size"), F.lit(int(m < 0)).alias("neg"), F.lit(m).cast("long").alias("multiplier")) for m in range(-16, 17, 4)])
    return grids.tiles(spark, sf).select("vec_id", F.array_min(grid).alias("b")).select("vec_id", "b.multiplier", "b.cost")


@register("i06_best_stream", TX + """, g AS (SELECT doc_id, i, b, b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM tx), r AS (SELECT doc_id, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), n AS (SELECT doc_id, k, count(*) AS len FROM r GROUP BY 1, 2),
c AS (SELECT doc_id, 'literal' AS kind, sum(len) * 8 AS cost, 0 AS o FROM n GROUP BY 1 UNION ALL SELECT doc_id, 'runs', sum(CASE WHEN len >= 5 THEN 22 ELSE len * 8 END) + 5, 1 FROM n GROUP BY 1)
SELECT doc_id, arg_min(kind, cost * 2 + o) AS kind, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY 1""")
def i06(spark: SparkSession, sf: str) -> DataFrame:
    """Literals alone, or runs as copies: the cheaper stream, the first of equal ones."""

    def of(b: np.ndarray) -> list:
        n = grids.run_lengths(b)[1]
        cost, _, kind = min((len(b) * 8, 0, "literal"), (int(np.where(n >= 5, 22, n * 8).sum()) + 5, 1, "runs"))
        return [np.array([kind]), np.array([cost], np.int64)]

    return grids.per_text(spark, sf, of, "kind string, cost long")


@register("i09_canonical_codes", TX + """, h AS (SELECT doc_id, b, count(*) AS n FROM tx GROUP BY 1, 2), l AS (SELECT doc_id, b, CAST(greatest(1, ceil(log2(CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE) / n))) AS INTEGER) AS len FROM h),
c AS (SELECT doc_id, b, len, CAST(sum(CAST(1 AS BIGINT) << (32 - len)) OVER (PARTITION BY doc_id ORDER BY len, b) - (CAST(1 AS BIGINT) << (32 - len)) AS BIGINT) >> (32 - len) AS code FROM l)
SELECT doc_id, CAST(b AS BIGINT) AS symbol, CAST(len AS BIGINT) AS length, CAST(list_sum([((code >> i) & 1) << (len - 1 - i) FOR i IN range(len)]) AS BIGINT) AS code FROM c""")
def i09(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of each text's bytes; lengths are rounded-up bits, which always fit."""
    h = grids.text_counts(spark, sf)
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    length = F.greatest(F.lit(1), F.ceil(F.log2(total.cast("double") / F.col("n")) - 1e-12)).cast("int")
    s = h.select("doc_id", F.struct(length.alias("length"), F.col("b").cast("int").alias("symbol")).alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("s"))  # 256 symbols at most
    out = s.select("doc_id", F.explode(rw.canonical_codes(F.col("s"), 32)).alias("c"))
    return out.select("doc_id", F.col("c.symbol").cast("long").alias("symbol"), F.col("c.length").cast("long").alias("length"), "c.code")


@register("j02_composition", with_(TILES, PLACED, PIXELS, ARGB).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
fr AS (SELECT vec_id, vec_id // 20 AS clip, (bs[1] % 2) * 2 AS fx, (bs[2] % 3) AS fy, CASE WHEN bs[3] % 4 = 0 THEN 8 ELSE 4 END AS fw, CASE WHEN bs[3] % 4 = 0 THEN 8 ELSE 5 END AS fh, bs[4] % 2 = 0 AS blend, bs[5] % 3 = 0 AS dispose, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS k FROM t),
f2 AS (SELECT vec_id, clip, CASE WHEN fw = 8 THEN 0 ELSE fx END AS fx, CASE WHEN fw = 8 THEN 0 ELSE fy END AS fy, fw, fh, blend, dispose, k FROM fr), im AS (SELECT vec_id, list(v ORDER BY p) AS v FROM argb GROUP BY 1),
r AS (SELECT clip, vec_id, k, fx, fy, fw, fh, dispose, true AS key, [CASE WHEN p % 8 >= fx AND p % 8 < fx + fw AND p // 8 >= fy AND p // 8 < fy + fh THEN v[p + 1] ELSE 0 END FOR p IN range(64)] AS canvas FROM f2 JOIN im USING (vec_id) WHERE k = 1
UNION ALL SELECT clip, vec_id, k, fx, fy, fw, fh, dispose, key, [CASE WHEN NOT (p % 8 >= fx AND p % 8 < fx + fw AND p // 8 >= fy AND p // 8 < fy + fh) THEN (CASE WHEN key THEN 0 ELSE prev[p + 1] END)
  WHEN NOT blend OR key OR (pd AND p % 8 >= px AND p % 8 < px + pw AND p // 8 >= py AND p // 8 < py + ph) OR (v[p + 1] >> 24) = 255 THEN v[p + 1]
  ELSE CAST(list_sum([(((v[p + 1] >> s) & 255) + ((((prev[p + 1] >> s) & 255) * (256 - (v[p + 1] >> 24))) >> 8)) % 256 * (CAST(1 AS BIGINT) << s) FOR s IN [0, 8, 16, 24]]) AS BIGINT) END FOR p IN range(64)] FROM (
  SELECT f2.*, im.v, r.fx AS px, r.fy AS py, r.fw AS pw, r.fh AS ph, r.dispose AS pd, (NOT f2.blend AND f2.fw = 8) OR (r.dispose AND (r.fw = 8 OR r.key)) AS key,
    CASE WHEN r.dispose THEN [CASE WHEN p % 8 >= r.fx AND p % 8 < r.fx + r.fw AND p // 8 >= r.fy AND p // 8 < r.fy + r.fh THEN 0 ELSE r.canvas[p + 1] END FOR p IN range(64)] ELSE r.canvas END AS prev
  FROM r JOIN f2 ON f2.clip = r.clip AND f2.k = r.k + 1 JOIN im ON im.vec_id = f2.vec_id))
SELECT vec_id, p // 8 AS y, p % 8 AS x, CAST(canvas[p + 1] AS BIGINT) AS argb FROM r, (SELECT unnest(range(64)) AS p)""")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile as a frame of its clip; its bytes give place, size, blending and disposal.

    A key frame starts on a clear canvas, so a clip falls into runs that are drawn apart; others start on the one before,
    as disposal left it.
    """
    b = lambda k: F.get("px", F.lit(k))
    t = grids.tiles(spark, sf)
    n = grids.SIDE**2
    words = F.transform("px", lambda v, i: sum((F.get("px", (i + k) % n).cast("long") * (1 << s) for k, s in ((1, 16), (2, 8), (3, 0))), v.cast("long") * (1 << 24)))
    full = b(2) % 4 == 0
    f = t.select(
        "vec_id", grids.clip().alias("clip"), words.alias("argb"), F.when(full, 0).otherwise(b(0) % 2 * 2).alias("x"), F.when(full, 0).otherwise(b(1) % 3).alias("y"), F.when(full, 8).otherwise(4).alias("w"), F.when(full, 8).otherwise(5).alias("h"),
        full.alias("full"), F.lit(False).alias("opaque"), (b(3) % 2 == 0).alias("blend"), (b(4) % 3 == 0).alias("dispose"),
    )
    f = key_frames(f, ["clip"], ["vec_id"]).withColumn("run", F.sum(F.col("key").cast("long")).over(Window.partitionBy("clip").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        _, _, vec_id, argb, x, y, w, h, key, blend, dispose = row
        canvas, cleared = (np.zeros((8, 8, 4), np.uint8), None) if key else state
        part = (slice(y, y + h), slice(x, x + w))
        canvas = colour.drawn(canvas, colour.argb_to_rgba(np.array(argb, np.uint32), 8)[part], x, y, blend and not key, cleared)
        out = (vec_id, colour.rgba_to_argb(canvas).astype(np.int64).tolist())
        if dispose:
            canvas[part] = 0
        return (canvas, (x, y, w, h) if dispose else None), out

    drawn = carried(f.select("clip", "run", "vec_id", "argb", "x", "y", "w", "h", "key", "blend", "dispose"), ["clip", "run"], ["vec_id"], None, step, "vec_id long, canvas array<long>")
    out = drawn.select("vec_id", F.posexplode("canvas").alias("p", "argb"))
    return out.select("vec_id", F.expr("cast(p div 8 AS bigint)").alias("y"), (F.col("p") % 8).cast("long").alias("x"), "argb")
