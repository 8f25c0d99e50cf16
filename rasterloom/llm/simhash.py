"""Near-duplicate groups by SimHash: pivot distance tables over distinct fingerprints.

Each distinct fingerprint gets its Hamming distances to fixed reference fingerprints
(pivots). By the triangle inequality two fingerprints whose distances to any one pivot
differ by more than the radius can't be linked, so a candidate pair is discarded by its
largest coordinate difference, and only survivors are compared bit by bit.

Near-uniform fingerprints agree within 3 on one pivot's distance with chance 0.46, so pivot
tables alone would still look at all pairs. Rows are therefore routed first: the bits are
cut into segments, and a pair within the radius agrees on all but `radius` of them, so it
meets under at least one choice of agreeing segments. No pair is lost. The bits that a crowded route
leaves open are cut and chosen from again. A route that many fingerprints share even then
isn't joined with itself: its members are cut into blocks of bounded size, and a task compares
two blocks by their pivot tables and returns a spanning forest of the links only, so rows out
stay in proportion to rows in.

Defined cases: null text reads as empty; a text without words has fingerprint zero, linked
like any other; repeated rows share a fingerprint; rows with a null id keep a null id, and
are never a component's name unless all its ids are null; empty input gives empty output.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_CHUNK, chunks, drop, id_and_text, kept, lean, saved

RADIUS = 3
SEGMENTS = 6
PIVOTS = 16
#: A route with more members than this is compared in blocks.
JOINED = 24
BLOCK = 1024

_PIVOTS = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def _ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _ascii_lower()


#: For each byte its eight bits, one to a byte of a 64-bit word, so that sums of up to 255 don't overflow.
_SPREAD = np.array([sum((v >> j & 1) << 8 * j for j in range(8)) for v in range(256)], np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each group of hashes the 64 bits that are 1 in over half of them; 0 for an empty group."""
    n = np.diff(bounds)
    out, full = np.zeros(len(n), np.uint64), np.flatnonzero(n > 0)
    if not len(full):
        return out
    begin, size = bounds[full], n[full]
    pieces = -(-size // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    starts = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    ones = np.zeros((len(full), 64), bool)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[raw[:, k]], starts).view(np.uint8).reshape(-1, 8)
        ones[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > size[:, None]
    out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    found = []
    digest = xxhash.xxh64_intdigest
    for _, _, texts in chunks(column, SMALL_CHUNK):
        texts.data = LOWER[texts.data]
        starts, ends = texts.words()
        # single spaces between words: only spans with other white space are joined anew
        doc = texts.document(starts)
        per = np.bincount(doc, minlength=texts.n)
        first = np.concatenate([[0], np.cumsum(per)])
        lengths = ends - starts + 1
        to = np.cumsum(lengths)
        packed = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
        if len(to):
            fill = np.ones(len(packed), bool)
            fill[to - 1] = False
            inside = np.zeros(len(texts.data) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            packed[fill] = texts.data[np.cumsum(inside)[:-1] > 0]
        begin, end = to - lengths, to - 1
        size = np.where(per >= shingle, per - shingle + 1, np.minimum(per, 1))
        bounds = np.concatenate([[0], np.cumsum(size)])
        which = np.repeat(np.arange(texts.n), size)
        lead = first[which] + (np.arange(bounds[-1]) - bounds[which])
        tail = np.where(per[which] >= shingle, lead + shingle - 1, first[which] + per[which] - 1)
        buffer = packed.tobytes()
        hashes = np.fromiter((digest(buffer[a:b], 42) for a, b in zip(begin[lead].tolist(), end[tail].tolist())), np.uint64, len(lead))
        found.append(majority(hashes, bounds))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (long, the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            fp = fingerprints_of(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _choices(bits: list[int], segments: int, radius: int) -> list[list[int]]:
    """The bits cut into segments, and every choice of all segments but `radius`: of bits that differ in `radius` at most, one choice agrees."""
    cuts = [round(len(bits) * k / segments) for k in range(segments + 1)]
    each = [bits[a:b] for a, b in itertools.pairwise(cuts)]
    return [sum(c, []) for c in itertools.combinations(each, segments - radius)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _sized(rows: DataFrame) -> DataFrame:
    """The rows whose route others share, with n, its size.

    Sides are merged: what is exploded is taken for as small as it was before, and would be broadcast through the driver.
    """
    return rows.hint("merge").join(rows.groupBy("route").agg(F.count("*").alias("n")).filter("n > 1"), "route")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp, pivots=_PIVOTS):
    """The row of the pivot distance table of a fingerprint column, as an array of bytes."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("tinyint") for p in pivots])


def _spanning(a: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints within the radius, by their pivot tables."""
    n = len(a)
    table = np.stack([np.bitwise_count(a ^ p) for p in _PIVOTS], 1).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    a, table = a[order], table[order]
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    reach = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(n):
        near = np.arange(i + 1, reach[i])
        if not len(near):
            continue
        near = near[np.abs(table[near, 1:4] - table[i, 1:4]).max(1) <= radius]
        near = near[np.abs(table[near, 4:] - table[i, 4:]).max(1) <= radius] if len(near) else near
        for j in near[np.bitwise_count(a[near] ^ a[i]) <= radius]:
            if (x := top(i)) != (y := top(int(j))):
                root[max(x, y)] = min(x, y)
                links.append((a[i], a[j]))
    return links


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct fp within the radius."""
    choices = _choices(list(range(64)), segments, radius)
    key = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits))))) for k, bits in enumerate(choices)])
    members = kept(_sized(distinct.select("fp", F.posexplode(key).alias("choice", "route"))))
    # members of a crowded route agree on its choice of bits, so the other bits are cut again in the same way
    inner = F.array(*[F.array(*[F.lit(_signed(_mask(bits))) for bits in _choices([b for b in range(64) if b not in picked], segments, radius)]) for picked in choices])
    crowded = members.filter(F.col("n") > JOINED)
    finer = crowded.select("fp", "route", F.posexplode(F.get(inner, F.col("choice"))).alias("choice", "mask"))
    finer = kept(_sized(finer.select("fp", "choice", F.xxhash64("route", "choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("route"))))
    members = members.filter(F.col("n") <= JOINED).unionByName(finer)
    few = members.filter(F.col("n") <= JOINED).select("route", "fp", pivot_table(F.col("fp")).alias("at"))
    other = few.select("route", F.col("fp").alias("fp2"), F.col("at").alias("at2"))
    apart = F.aggregate(F.zip_with("at", "at2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: F.greatest(s, x))
    pairs = (
        few.hint("merge").join(other, "route")  # as in _sized
        .filter(F.col("fp") < F.col("fp2"))
        .filter(apart <= radius)
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _spanning(np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64), radius)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    many = members.filter(F.col("n") > JOINED)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    # block x meets each block y once, under (smaller, larger)
    met = many.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("fp", "route", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    forest = met.groupBy("route", "x", "y").applyInPandas(compare, "a long, b long")
    return pairs.unionByName(forest).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of a link reaches, by alternating large and small stars.

    Each round writes its links to the shared folder, so a lost executor costs that round at most.
    """
    spark = edges.sparkSession
    e, path = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: greater neighbours are linked to the least of the neighbourhood
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: smaller neighbours, and the node itself, are linked to the least
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        new, new_path = saved(small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).filter("a < b").distinct(), "links")
        same = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        drop(spark, path)
        e, path = new, new_path
        if same:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id (the smallest id of its component) of fingerprints()."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(least.select("fp"), radius))
    grouped = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return grouped.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = kept(fingerprints(docs, id_col, text_col, shingle))
    of = classes(prints, radius)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
