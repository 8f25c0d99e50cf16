"""Functions along rows of a picture held as an array in raster order: filters, runs, caches, smoothing, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import let
from .channels import add_words, cache_slot, clamp, subtract_words, wrap8

LONGS = "array<bigint>"


def running(values: Column, start: Column, step) -> Column:
    """All values of a running state, as long: step(state, value)."""
    zero = F.struct(F.array().cast(LONGS).alias("out"), start.cast("long").alias("s"))

    def add(acc: Column, v: Column) -> Column:
        return let(step(acc["s"], v).cast("long"), lambda s: F.struct(F.concat(acc["out"], F.array(s)).alias("out"), s.alias("s")))

    return F.aggregate(values, zero, add, lambda acc: acc["out"])


def horizontal_filter(px: Column, width: int) -> Column:
    """Differences with the left neighbour mod 256; a row's first with the pixel above it, the very first with 0."""
    return F.transform(px, lambda v, i: wrap8(v - F.coalesce(F.when(i == 0, F.lit(0)).when(i % width == 0, F.get(px, i - width)).otherwise(F.get(px, i - 1)), F.lit(0))))


def horizontal_unfilter(px: Column, width: int) -> Column:
    """Running sums mod 256 along each row, which start from the pixel above.

    A row's first pixel is a running sum down the first column, so a row is its own sum plus that.
    """
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(px) / width).cast("int") - 1), lambda y: F.slice(px, y * width + 1, width))
    heads = running(F.transform(rows, lambda r: r[0]), F.lit(0), lambda s, v: s + v)
    return F.flatten(F.zip_with(rows, heads, lambda r, h: F.transform(running(r, h - r[0], lambda s, v: s + v), wrap8)))


def vertical_unfilter(px: Column, width: int) -> Column:
    """Running sums mod 256 down each column; the first row is summed along."""
    first = F.transform(running(F.slice(px, 1, width), F.lit(0), lambda s, v: s + v), wrap8)
    down = lambda p: F.aggregate(F.transform(F.sequence(F.lit(0), F.floor(p / width).cast("int")), lambda y: F.when(y > 0, F.get(px, y * width + p % width)).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, v: s + v)
    return let(first, lambda f: F.transform(px, lambda v, p: wrap8(F.get(f, p % width) + down(p))))


def palette_deltas(palette: Column) -> Column:
    """Differences of a sorted palette's words."""
    return let(palette, lambda listed: F.transform(listed, lambda v, i: F.when(i == 0, v).otherwise(subtract_words(v, F.get(listed, i - 1)))))


def palette_sums(deltas: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, d: Column) -> Column:
        return let(add_words(acc["last"], d), lambda word: F.struct(word.alias("last"), F.concat(acc["out"], F.array(word)).alias("out")))

    return F.aggregate(deltas, zero, add, lambda acc: acc["out"])


def runs(values: Column) -> Column:
    """array<struct<start, len>> of maximal runs of equal values."""
    starts = F.filter(F.transform(values, lambda v, i: F.when((i == 0) | (v != F.get(values, i - 1)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(values)) - s).alias("len")))


def cache_hits(argb: Column, bits: int) -> Column:
    """Whether each word is the last one that its cache slot took."""
    def hits(x: Column) -> Column:
        # the last earlier word of the same slot
        before = lambda e, i: F.element_at(F.filter(F.slice(x, 1, i), lambda o: o["slot"] == e["slot"]), -1)
        return F.transform(x, lambda e, i: F.when(F.exists(F.slice(x, 1, i), lambda o: o["slot"] == e["slot"]), before(e, i)["v"] == e["v"]).otherwise(False))

    return let(F.transform(argb, lambda v: F.struct(v.alias("v"), cache_slot(v, bits).alias("slot"))), hits)


def mirrored(i: Column, n: int) -> Column:
    """A place reflected into 0..n-1: the first repeats itself from the left, the last is the axis on the right."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 2 - i).otherwise(i)


def smoothed_levels(px: Column, width: int, height: int, strength: int) -> Column:
    """Levels moved towards the mean of the box around them, if the plane has over two levels.

    The move is what a table gives for the difference: itself up to three quarters of the least gap
    between levels, then falling to nothing at the gap. The lowest and highest level stay. Rows reflect
    as the running sums do: above the first row it repeats, below the last too.
    """
    radius = min(4 * strength // 100, (width - 1) >> 1, (height - 1) >> 1)
    box = 2 * radius + 1
    scale = (1 << 18) // (box * box)

    def work(x: Column) -> Column:
        gap = F.array_min(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: b - a))
        low, high = x[0], F.element_at(x, -1)
        edge = F.coalesce(gap, F.lit(0)) * 4
        knee = F.shiftright(edge * 3, 2)

        def one(v: Column, p: Column) -> Column:
            y, c = F.floor(p / width).cast("int"), p % width
            offsets = F.sequence(F.lit(0), F.lit(box * box - 1))
            cell = lambda k: F.get(px, clamp(y + F.floor(k / box).cast("int") - radius, 0, height - 1) * width + mirrored(c + k % box - radius, width))
            total = F.aggregate(offsets, F.lit(0).cast("long"), lambda s, k: s + cell(k))
            mean = F.shiftright(total.bitwiseAND(65535) * scale, 16)
            difference = mean.cast("int") - v * 4
            size = F.abs(difference)
            move = F.shiftright(F.when(size <= knee, size).when(size < edge, F.floor(knee * (edge - size) / F.greatest(edge - knee, F.lit(1))).cast("int")).otherwise(0), 2)
            return F.when((v <= low) | (v >= high), v).otherwise(clamp(v + F.when(difference < 0, -move).otherwise(move)))

        return F.when(F.size(x) <= 2, px).otherwise(F.transform(px, one))

    return px if radius <= 0 else let(F.array_sort(F.array_distinct(px)), work)


def canonical_codes(lengths: Column, most: int = 15) -> Column:
    """Codes of up to `most` bits by (length, symbol), first bit last: array<struct<symbol, length, code>> from array<struct<length, symbol>>."""
    ranked = F.array_sort(lengths)
    zero = F.struct(F.array().cast("array<struct<symbol:int,length:int,code:bigint>>").alias("out"), F.lit(0).cast("long").alias("next"))
    flipped = lambda code, n: F.conv(F.reverse(F.substring(F.lpad(F.bin(code), most, "0"), F.lit(most + 1) - n, n)), 2, 10).cast("long")

    def add(acc: Column, s: Column) -> Column:
        code = F.call_function("shiftright", acc["next"], most - s["length"])
        row = F.struct(s["symbol"].alias("symbol"), s["length"].alias("length"), flipped(code, s["length"]).alias("code"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), (acc["next"] + F.call_function("shiftleft", F.lit(1).cast("long"), most - s["length"])).alias("next"))

    return F.aggregate(ranked, zero, add, lambda acc: acc["out"])
